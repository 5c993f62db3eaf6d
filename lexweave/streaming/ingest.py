"""Incremental ingestion as a stream that ends when the input does."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.resolve import citation_graph, relation_graph
from ..operators.selection import select_focused, select_recent
from ..schemas import METADATA, RUNS
from ..sources.corpus import VersionedTable, bootstrap_taxonomy, changed, content_of, load_selection, metadata_of, records, reset, save_selection


def log_event(runs: VersionedTable, run_id: str, event: str, **fields: object) -> None:
    """One row per start or end of a run; :func:`run_log` puts them together."""
    spark = runs.spark
    columns = {"dataset_name": "", "dataset_revision": "", "selection_mode": "", "notes": "", "scanned_count": 0, "imported_count": 0, "skipped_count": 0} | fields
    row = spark.createDataFrame([(run_id, *columns.values(), event)], "run_id string, dataset_name string, dataset_revision string, selection_mode string, notes string, scanned_count long, imported_count long, skipped_count long, event string").withColumn("at", F.current_timestamp())
    runs.replace(runs.read().unionByName(row))


def run_log(runs: DataFrame) -> DataFrame:
    """One row per run: what it was told at its start and what its last event says."""
    first = lambda c: F.min_by(c, F.struct("at", F.when(F.col("event") == "start", 0).otherwise(1)))
    last = lambda c: F.max_by(c, F.struct("at", F.when(F.col("event") == "start", 0).otherwise(1)))
    return runs.groupBy("run_id").agg(first("dataset_name").alias("dataset_name"), first("selection_mode").alias("selection_mode"), last("notes").alias("notes"), last("scanned_count").alias("scanned_count"), last("imported_count").alias("imported_count"), last("skipped_count").alias("skipped_count"), F.min("at").alias("started_at"), F.max(F.when(F.col("event") != "start", F.col("at"))).alias("finished_at"))


def import_batch(documents: VersionedTable, batch: DataFrame, skip_unchanged: bool = True) -> tuple[int, int, int]:
    """Upsert a batch of documents: (received, imported, skipped)."""
    new = changed(batch, documents.read()) if skip_unchanged else changed(batch, documents.read().limit(0))
    new = new.persist()
    try:
        received, imported = batch.count(), new.count()
        if imported:
            documents.upsert(new)
    finally:
        new.unpersist()
    return received, imported, received - imported


def ingest(spark: SparkSession, metadata_dir: str, content: DataFrame, documents: VersionedTable, runs: VersionedTable, checkpoint: str, last_year: int, files_per_batch: int = 16, dataset: str = "corpus") -> tuple[int, int, int]:
    """Import every metadata file that no earlier run has seen; returns counts of this run.

    The checkpoint remembers files, and upserts by id make a repeated batch
    harmless: together each document arrives once.
    """
    run_id, totals = uuid.uuid4().hex, [0, 0, 0]
    log_event(runs, run_id, "start", dataset_name=dataset, selection_mode="all")

    def batch(rows: DataFrame, _: int) -> None:
        got = import_batch(documents, records(rows, content, last_year))
        totals[:] = [a + b for a, b in zip(totals, got)]

    try:
        stream = spark.readStream.schema(METADATA).option("maxFilesPerTrigger", files_per_batch).parquet(metadata_dir)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except Exception as error:
        log_event(runs, run_id, "failed", notes=f"failed={type(error).__name__}", scanned_count=totals[0], imported_count=totals[1], skipped_count=totals[2])
        raise
    log_event(runs, run_id, "finish", scanned_count=totals[0], imported_count=totals[1], skipped_count=totals[2])
    return tuple(totals)


def runs_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, RUNS, ["run_id", "event"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, for a stream or a table: late rows are taken until the watermark passes."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


# -- batch runs ------------------------------------------------------------------------------------


def import_chunk(documents: VersionedTable, rows: DataFrame, skip: int, size: int) -> tuple[int, int, int]:
    """Import the ``size`` documents behind the first ``skip``, by id."""
    return import_batch(documents, rows.orderBy("id").offset(skip).limit(size))


def import_selected(documents: VersionedTable, metadata: DataFrame, content: DataFrame, ids: DataFrame, last_year: int, skip_unchanged: bool = True) -> tuple[int, int, int]:
    """Import the selected documents that have content, in one join: what is written is only the buckets that change."""
    chosen = metadata_of(metadata, ids)
    return import_batch(documents, records(chosen, content_of(content, ids), last_year), skip_unchanged)


def focused_update(documents: VersionedTable, metadata: DataFrame, content: DataFrame, selection: str, last_year: int, reuse: bool = False) -> tuple[tuple[int, int, int], int]:
    """(counts, selected): import the focused corpus by its kept selection, or a new one that is then kept."""
    spark = documents.spark
    ids = load_selection(spark, selection) if reuse else load_selection(spark, f"{selection}-none")
    if ids.isEmpty():
        save_selection(select_focused(metadata, content.where(F.length("content_html") > 0).select("id").distinct()), selection)
        ids = load_selection(spark, selection)
    return import_selected(documents, metadata, content, ids, last_year), ids.count()


def recent_update(documents: VersionedTable, metadata: DataFrame, content: DataFrame, target: int, last_year: int) -> tuple[int, int, int]:
    """Fill the corpus up to ``target`` documents with the newest that are not about the economy."""
    have = documents.read().select("id")
    needed = target - have.count()
    if needed <= 0:
        return 0, 0, 0
    ids = select_recent(metadata, content.where(F.length("content_html") > 0).select("id").distinct(), have, needed)
    return import_selected(documents, metadata, content, ids, last_year, skip_unchanged=False)


@dataclass
class Derived:
    """The tables that are made from documents, and the subjects to link them to."""

    subjects: VersionedTable
    subject_links: VersionedTable
    relations: VersionedTable
    links: VersionedTable
    seed: DataFrame


def rebuild_relations(documents: DataFrame, relations: VersionedTable) -> int:
    relations.replace(relation_graph(documents))
    return relations.read().count()


def rebuild_citations(documents: DataFrame, links: VersionedTable) -> int:
    links.replace(citation_graph(documents)[2])
    return links.read().count()


def rebuild_taxonomy(documents: DataFrame, derived: Derived) -> int:
    bootstrap_taxonomy(derived.subjects, derived.subject_links, derived.seed, documents)
    return derived.subject_links.read().count()


def postprocess(documents: VersionedTable, derived: Derived) -> dict[str, int]:
    """Subjects, relations and citations anew; rows of each."""
    docs = documents.read()
    return {"subjects": rebuild_taxonomy(docs, derived), "relations": rebuild_relations(docs, derived.relations), "citations": rebuild_citations(docs, derived.links)}


def startup(documents: VersionedTable, derived: Derived) -> dict[str, int]:
    """Make the derived tables that are empty while there are documents."""
    docs, out = documents.read(), {}
    if docs.isEmpty():
        return out
    for name, table, build in (("subjects", derived.subjects, lambda: rebuild_taxonomy(docs, derived)), ("relations", derived.relations, lambda: rebuild_relations(docs, derived.relations)), ("citations", derived.links, lambda: rebuild_citations(docs, derived.links))):
        if table.read().isEmpty():
            out[name] = build()
    return out


def monthly(documents: VersionedTable, runs: VersionedTable, derived: Derived, update: Callable[[], tuple[int, int, int]], mode: str = "focused", dataset: str = "corpus", revision: str = "", skip_postprocess: bool = False) -> dict[str, object]:
    """One logged run: ``update`` imports, and the derived tables are made anew if anything was imported.

    A failure is noted in the log and raised.
    """
    run_id, counts, notes = uuid.uuid4().hex, (0, 0, 0), ["monthly updater"]
    told = lambda: {"notes": "; ".join(notes), "scanned_count": counts[0], "imported_count": counts[1], "skipped_count": counts[2]}
    log_event(runs, run_id, "start", dataset_name=dataset, dataset_revision=revision, selection_mode=mode, notes=notes[0])
    try:
        counts = update()
        if skip_postprocess:
            notes.append("postprocess=skipped")
        elif counts[1]:
            notes += [f"{k}={v}" for k, v in postprocess(documents, derived).items() if k != "subjects"]
        else:
            notes.append("postprocess=unchanged")
    except Exception as error:
        notes.append(f"failed={error}")
        log_event(runs, run_id, "failed", **told())
        raise
    log_event(runs, run_id, "finish", **told())
    return {"run_id": run_id, **told()}


def demo(documents: VersionedTable, derived: Derived, rows: DataFrame, size: int) -> dict[str, int]:
    """Empty the tables, import ``size`` documents, and make the derived tables."""
    reset(documents, [derived.subject_links, derived.relations, derived.links])
    import_chunk(documents, rows, 0, size)
    return postprocess(documents, derived)
