"""Row stores that are written through a client of their own: rows out with retries and counts, rows in, and their schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: What a row store calls Spark's types.
COLUMN_KINDS = {T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "double", T.StringType: "text", T.BooleanType: "boolean", T.TimestampType: "datetime"}
TRIES = 3

Client = Callable[[], Callable[[dict], None]]


def write_rows(rows: DataFrame, client: Client, tries: int = 1) -> DataFrame:
    """(written, failed): each row goes to a store that takes one row at a time; a row that fails ``tries`` times is counted, not fatal.

    ``client`` is called once a task and returns what takes a row (as a dict);
    a task that runs again writes its rows again, so the store must take a row
    twice without harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put, written, failed = client(), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                for k in range(tries):
                    try:
                        put(row)
                    except Exception:  # noqa: BLE001 - whatever a client raises is a failed row
                        failed += k == tries - 1
                    else:
                        written += 1
                        break
        yield pa.RecordBatch.from_pydict({"written": [written], "failed": [failed]})

    return rows.mapInArrow(run, "written long, failed long").groupBy().sum("written", "failed").toDF("written", "failed")


def migrate(tables: dict[str, DataFrame], target: str) -> dict[str, int]:
    """Copy whole tables below ``target``; rows of each."""
    out = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        out[name] = rows.sparkSession.read.parquet(f"{target}/{name}").count()
    return out


def columns_of(schema: T.StructType) -> list[tuple[str, str, bool]]:
    """(name, kind, required) of the columns that a row store needs for a table."""
    return [(f.name, COLUMN_KINDS[type(f.dataType)], not f.nullable or f.name in ("id", "document_id")) for f in schema]


def indexes_of(schema: T.StructType) -> list[tuple[str, str]]:
    """(index, column) that a row store needs: keys, and what facets filter by."""
    return [(f"idx_{f.name}", f.name) for f in schema if f.name in ("id", "document_id", "document_number", "legal_type", "issuing_authority", "year")]
