"""Comparing two documents: clause differences and section alignment."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.legal import instruction_type
from ..functions.text import plain_field, token_set

#: Fixed values.
MATCHED_TYPES = ("article", "section", "chapter", "heading", "part")
SAME, CHANGED = 0.95, 0.55
LABEL_LEAST, ARTICLE_LEAST, CONTENT_LEAST = 0.35, 0.30, 0.62
REASONS = {
    "explicit-citation": "explicit citation", "referenced-article": "single article reference", "same-label": "same label", "same-article": "same article", "similar-content": "similar content",
    "left-only": "no reliable match", "right-only": "unmatched on right", "multi-target-instruction": "multi-target instruction", "unconfirmed-instruction": "unconfirmed instruction",
}
_ARTICLE = re.compile(r"\bdieu\s+\d+[a-z]?\b")


def fold(s: str | None) -> str:
    s = s or ""
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("đ", "d").replace("Đ", "D"))
        for c in set(s):
            if unicodedata.combining(c):
                s = s.replace(c, "")
    return s.lower().strip()


def label_of(s: str | None) -> str:
    return " ".join(re.sub(r"[^0-9a-z]+", " ", fold(s)).split())


def jaccard(left_label: Column, left_text: Column, right_label: Column, right_text: Column) -> Column:
    """Shared words of label and the text's first 500 characters, over all of them."""
    l = token_set(F.concat_ws(" ", left_label, F.substring(left_text, 1, 500)))  # noqa: E741
    r = token_set(F.concat_ws(" ", right_label, F.substring(right_text, 1, 500)))
    return F.when((F.size(l) > 0) & (F.size(r) > 0), F.size(F.array_intersect(l, r)) / F.size(F.array_union(l, r))).otherwise(F.lit(0.0))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@functools.lru_cache(1 << 14)
def _label_ratio(a: str, b: str) -> float:
    return ratio(a, b)


class _Section:
    """A section as alignment sees it: ``head`` is the text's beginning, ``targets`` the other articles that the whole text names."""

    __slots__ = ("ordinal", "section_type", "label", "form", "article", "anchor", "instruction", "head", "targets", "_seen")

    def __init__(self, *values: object):
        self.ordinal, self.section_type, self.label, self.form, self.article, self.anchor, self.instruction, self.head, self.targets = values
        self._seen: set[str] | None = None

    def words(self) -> set[str]:
        if self._seen is None:
            self._seen = set(re.findall("[0-9a-z]+", fold(self.label))) | set(re.findall("[0-9a-z]+", fold(self.head)))
        return self._seen


def similarity(left: _Section, right: _Section) -> float:
    """The better of the labels' likeness and the shared words."""
    a, b = left.words(), right.words()
    return max(_label_ratio(left.form, right.form), len(a & b) / len(a | b) if a and b else 0.0)


def clause_diff(left: list[str], right: list[str]) -> dict:
    """Counts of clauses that are unchanged, changed, removed and added; each takes its best unused partner."""
    matchers = [SequenceMatcher(None, "", label_of(x)) for x in right]
    free = list(range(len(right)))
    out = {"unchanged": 0, "changed": 0, "removed": 0}
    for clause in map(label_of, left):
        best = (0.0, 0)
        for k in free:
            m = matchers[k]
            m.set_seq1(clause)
            # the quick ratios are never less than the ratio, which matters from CHANGED on
            if m.real_quick_ratio() >= max(CHANGED, best[0]) and m.quick_ratio() >= max(CHANGED, best[0]):
                best = max(best, (m.ratio(), -k))
        kind = "unchanged" if best[0] >= SAME else "changed" if best[0] >= CHANGED else "removed"
        out[kind] += 1
        if kind != "removed":
            free.remove(-best[1])
    return out | {"added": len(free)}


def diff(pairs: DataFrame, left: str = "left_text", right: str = "right_text") -> DataFrame:
    """``pairs`` with counts of unchanged, changed, removed and added clauses."""
    from .segment import clause_units

    kinds = ["unchanged", "changed", "removed", "added"]
    cut = pairs.withColumn("l__", clause_units(F.col(left))).withColumn("r__", clause_units(F.col(right)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            told = [clause_diff(x, y) for x, y in zip(rows["l__"].to_pylist(), rows["r__"].to_pylist())]
            kept = [k for k, name in enumerate(rows.schema.names) if name not in ("l__", "r__")]
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], *[pa.array([t[k] for t in told], pa.int32()) for k in kinds]], [*[rows.schema.names[k] for k in kept], *kinds])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), *(f"{k} int" for k in kinds)])
    return cut.mapInArrow(run, schema)


def _align(left: list[_Section], right: list[_Section], explicit: dict[str, list[str]], lifecycle: bool, heuristics: bool) -> list[tuple]:
    used: set[str] = set()
    out = []

    def best(pool: list[_Section], least: float, me: _Section) -> _Section | None:
        scored = [(similarity(me, s), -k, s) for k, s in enumerate(pool) if s.anchor not in used]
        top = max(scored, key=lambda x: x[:2], default=None)
        return top[2] if top and top[0] >= least else None

    for me in left:
        if me.section_type not in ("title", *MATCHED_TYPES):
            continue
        article, targets = me.article, me.targets
        found, reason = None, None
        if me.anchor in explicit:
            wanted = [label_of(x) for x in explicit[me.anchor] if x]
            found = next((s for w in wanted for s in right if s.form == w), None)
            if not found and len(targets) == 1:
                found = next((s for s in right if s.article == targets[0]), None)
            if not found and article:
                found = next((s for s in right if s.article == article), None)
            reason = "explicit-citation" if found else None
        if not found and lifecycle and explicit and len(targets) == 1:
            found = next((s for s in right if s.article == targets[0] and s.anchor not in used), None)
            reason = "referenced-article" if found else None
        if not found and heuristics:
            typed = [s for s in right if s.section_type == me.section_type]
            tries = (
                ("same-label", [s for s in typed if s.section_type in MATCHED_TYPES and s.form == me.form], LABEL_LEAST),
                ("same-article", [s for s in right if article and s.article == article], ARTICLE_LEAST),
                ("similar-content", typed, CONTENT_LEAST),
            )
            for reason, pool, least in tries:
                if found := best(pool, least, me):
                    break
        if found:
            used.add(found.anchor)
            out.append(("matched", reason, me.anchor, found.anchor, round(similarity(me, found), 2)))
        else:
            kind = me.instruction if lifecycle else "reference"
            reason = "left-only" if kind == "reference" else "multi-target-instruction" if len(targets) > 1 else "unconfirmed-instruction"
            out.append(("left-only", reason, me.anchor, None, 0.0))
    out += [("right-only", "right-only", None, s.anchor, 0.0) for s in right if s.anchor not in used and s.section_type in ("title", *MATCHED_TYPES)]
    return out


SECTION = "ordinal int, section_type string, label string, form string, article string, anchor string, instruction string, head string, targets array<string>"
ALIGNED = "left_id long, right_id long, lifecycle boolean, kind string, reason string, left_anchor string, right_anchor string, score double"


def _articles(folded: str) -> Iterator[str]:
    """Every match of the article pattern, looked for only where its word stands."""
    at = folded.find("dieu")
    while at >= 0:
        hit = _ARTICLE.match(folded, at)
        if hit:
            yield hit[0]
        at = folded.find("dieu", hit.end() if hit else at + 1)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each section with what its label and whole text say; of the text itself only the beginning that similarity compares."""
    for rows in batches:
        told: dict[str, list] = {"form": [], "article": [], "head": [], "targets": []}
        for label, text in zip(rows["label"].to_pylist(), rows["text"].to_pylist()):
            hit, named = _ARTICLE.search(fold(label)), fold(text)
            article = hit[0] if hit else None
            told["form"].append(label_of(label))
            told["article"].append(article)
            told["head"].append((text or "")[:500])
            told["targets"].append(list(dict.fromkeys(a for a in _articles(named) if a != article)))
        kept = {c: rows[c] for c in ("document_id", "ordinal", "section_type", "label")} | {"form": told["form"], "article": told["article"], "anchor": rows["anchor"], "instruction": rows["instruction"], "head": told["head"], "targets": told["targets"]}
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.list_(pa.string()) if c == "targets" else pa.string()) for c, x in kept.items()], list(kept))


def _lists(column: pa.Array, make: Callable) -> list[list]:
    """The rows of a column of lists of structs, each struct made by ``make``; null is an empty list."""
    ends = list(accumulate(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), initial=0))
    fields = [f.to_pylist() for f in column.flatten().flatten()]
    made = [make(*x) for x in zip(*fields)]
    return [made[a:b] for a, b in zip(ends, ends[1:])]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sides = [[sorted(x, key=lambda s: s.ordinal) for x in _lists(rows[c], _Section)] for c in ("left", "right")]
        cited = _lists(rows["cited"], lambda anchor, label: (anchor, label))
        out: list[list] = [[] for _ in range(8)]
        for a, b, lifecycle, heuristics, left, right, links in zip(*[rows[c].to_pylist() for c in ("left_id", "right_id", "lifecycle", "heuristics")], *sides, cited):
            explicit: dict[str, list[str]] = {}
            for anchor, label in links:
                explicit.setdefault(anchor, []).append(label)
            for found in _align(left, right, explicit, lifecycle, heuristics):
                for column, value in zip(out, (a, b, lifecycle, *found)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 4, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [c.split()[0] for c in ALIGNED.split(", ")])


def _as_is(df: DataFrame, _: str) -> DataFrame:
    return df


def _with_cycle(pairs: DataFrame, sections: DataFrame, links: DataFrame | None, lifecycle: bool | Column, heuristics: bool | Column, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x
    # only where one document changes the other is it told what an instruction is
    instruction = F.lit("reference") if lifecycle is False else instruction_type(F.col("text"))
    named = sections.select("document_id", F.col("ordinal").cast("int").alias("ordinal"), "section_type", "label", "anchor", instruction.alias("instruction"), "text")
    facts = named.mapInArrow(_facts, f"document_id {named.schema['document_id'].dataType.simpleString()}, {SECTION}")
    whole = keep(facts.groupBy("document_id").agg(F.collect_list(F.struct(*[c.split()[0] for c in SECTION.split(", ")])).alias("sections")), "aligned-sections")
    both = pairs.select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), flag(lifecycle).alias("lifecycle"), flag(heuristics).alias("heuristics")).distinct()
    for side in ("left", "right"):
        both = both.join(whole.select(F.col("document_id").alias(f"{side}_id"), F.col("sections").alias(side)), f"{side}_id", "left")
    if links is None:
        both = both.withColumn("cited", F.lit(None).cast("array<struct<anchor:string,label:string>>"))
    else:
        order = [c for c in ("section_ordinal", "mention_order") if c in links.columns]
        each = F.struct(*order, F.coalesce("referenced_label", F.lit("")).alias("label"), "anchor")
        cited = links.groupBy("left_id", "right_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["anchor"].alias("anchor"), x["label"].alias("label"))).alias("cited"))
        both = both.join(cited, ["left_id", "right_id"], "left")
    return both.select("left_id", "right_id", "lifecycle", "heuristics", "left", "right", "cited").mapInArrow(_aligned, ALIGNED)


def align(pairs: DataFrame, sections: DataFrame, links: DataFrame | None = None, lifecycle: bool | Column = False, heuristics: bool | Column = True, keep: Callable[[DataFrame, str], DataFrame] = _as_is) -> DataFrame:
    """(left_id, right_id, kind, reason, left_anchor, right_anchor, score) for each pair of documents.

    The greedy walk over a pair's sections depends on their order, so a pair is
    one row; it holds the sections of two documents, of each text only the
    beginning, and no more. Every section's text is read once. ``links``
    (left_id, right_id, anchor, referenced_label) are citations from left to
    right. ``lifecycle`` and ``heuristics`` may be columns of ``pairs``.
    ``keep`` may store the documents' sections, which both sides read.
    """
    return _with_cycle(pairs, sections, links, lifecycle, heuristics, keep).drop("lifecycle")


#: What a reader is told of an instruction (fixed values).
INSTRUCTIONS = ("amending instruction", "repeal instruction", "guidance instruction", "targeted reference")


def counts(alignment: DataFrame) -> DataFrame:
    """Per pair, how many sections match or stand alone; with a column ``change``, also how many of each change."""
    n = lambda test: F.count(F.when(test, 1))
    kinds = [n(F.col("kind") == "matched").alias("matched"), n(F.col("kind") == "left-only").alias("left_only"), n(F.col("kind") == "right-only").alias("right_only"), n(F.col("reason").isin("explicit-citation", "referenced-article")).alias("explicit")]
    if "change" in alignment.columns:
        matched = F.col("kind") == "matched"
        kinds += [n(matched & (F.col("change") == c)).alias(c) for c in ("unchanged", "expanded", "reduced", "rewritten")]
        kinds.append(n(matched & F.col("change").isin(*INSTRUCTIONS)).alias("instruction"))
    return alignment.groupBy("left_id", "right_id").agg(*kinds)


def reason_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), c), F.replace(c, F.lit("-"), F.lit(" ")))


def same_label(a: Column, b: Column) -> Column:
    return plain_field(a) == plain_field(b)


def describe(rows: DataFrame, lifecycle: bool | Column = False) -> DataFrame:
    """``rows`` (reason, score, left_text and clause counts) with change: what became of an aligned section."""
    c = F.col
    pointed = (F.lit(lifecycle) if isinstance(lifecycle, bool) else lifecycle) & c("reason").isin("explicit-citation", "referenced-article")
    kind = instruction_type(c("left_text"))
    told = F.when(kind == "amendment", "amending instruction").when(kind == "repeal", "repeal instruction").when(kind == "guidance", "guidance instruction").otherwise("targeted reference")
    still = (c("score") >= 0.97) & (c("changed") == 0) & (c("added") == 0) & (c("removed") == 0)
    more = (c("added") > 0) & (c("removed") == 0) & (c("changed") <= 1)
    less = (c("removed") > 0) & (c("added") == 0) & (c("changed") <= 1)
    return rows.withColumn("change", F.when(c("reason").isNull(), F.lit(None)).when(pointed, told).when(still, "unchanged").when(more, "expanded").when(less, "reduced").otherwise("rewritten"))


def pair_links(pairs: DataFrame, links: DataFrame, mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations between the documents of each pair, in both directions: (left_id, right_id, direction, section_ordinal, mention_order, anchor, label, link_type, referenced_label, cue_phrase)."""
    key = ["source_document_id", "section_ordinal", "mention_order"]
    told = links.select(*key, "target_document_id").join(mentions.select(*key, "link_type", "referenced_label", "cue_phrase"), key)
    told = told.join(sections.select(F.col("document_id").alias("source_document_id"), F.col("ordinal").alias("section_ordinal"), "anchor", "label"), ["source_document_id", "section_ordinal"])
    ways = [("left_to_right", "left_id", "right_id"), ("right_to_left", "right_id", "left_id")]
    each = [pairs.join(told, (F.col(a) == F.col("source_document_id")) & (F.col(b) == F.col("target_document_id"))).select("left_id", "right_id", F.lit(way).alias("direction"), "section_ordinal", "mention_order", "anchor", "label", "link_type", "referenced_label", "cue_phrase") for way, a, b in ways]
    return each[0].unionByName(each[1])


def pair_relations(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations between the documents of each pair, in both directions: (left_id, right_id, direction, relation_type, evidence_text)."""
    ways = [("left_to_right", "left_id", "right_id"), ("right_to_left", "right_id", "left_id")]
    each = [pairs.join(relations, (F.col(a) == F.col("source_document_id")) & (F.col(b) == F.col("target_document_id"))).select("left_id", "right_id", F.lit(way).alias("direction"), "relation_type", "evidence_text") for way, a, b in ways]
    return each[0].unionByName(each[1])


def lifecycle_pairs(cited: DataFrame, related: DataFrame) -> DataFrame:
    """(left_id, right_id) of the pairs of which one document amends or replaces the other."""
    strong = lambda df, c: df.where(F.col(c).isin("amends", "replaces")).select("left_id", "right_id")
    return strong(cited, "link_type").unionByName(strong(related, "relation_type")).distinct()


def view(pairs: DataFrame, sections: DataFrame, cited: DataFrame, related: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _as_is) -> DataFrame:
    """The comparison of each pair: aligned sections with labels, clause counts and the change, and whether the pair is of one lifecycle.

    ``cited`` and ``related`` come from :func:`pair_links` and
    :func:`pair_relations`. Where one document changes the other, sections are
    matched by citations alone, not by likeness. ``keep`` as in :func:`align`.
    """
    changing = lifecycle_pairs(cited, related).withColumn("lifecycle", F.lit(True))
    both = pairs.join(changing, ["left_id", "right_id"], "left").withColumn("lifecycle", F.coalesce("lifecycle", F.lit(False)))
    forth = cited.where("direction = 'left_to_right'").select("left_id", "right_id", "section_ordinal", "mention_order", "anchor", "referenced_label")
    aligned = _with_cycle(both, sections, forth, F.col("lifecycle"), ~F.col("lifecycle"), keep)
    side = lambda name: sections.select(F.col("document_id").alias(f"{name}_id"), F.col("anchor").alias(f"{name}_anchor"), F.col("ordinal").alias(f"{name}_ordinal"), F.col("label").alias(f"{name}_label"), F.col("text").alias(f"{name}_text"))
    full = aligned.join(side("left"), ["left_id", "left_anchor"], "left").join(side("right"), ["right_id", "right_anchor"], "left")
    told = describe(diff(full.na.fill("", ["left_text", "right_text"])), lifecycle=F.col("lifecycle"))
    return told.withColumn("change", F.when(F.col("kind") == "matched", F.col("change")))


def focus(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """The row of each pair to show: that of the asked left anchor, else of the right one, else the first changed match, the first match, the first row.

    ``rows`` as made by :func:`view`; ``asks``: left_id, right_id, left_ask, right_ask (either may be null).
    """
    shown = rows.where("kind != 'right-only'").join(asks, ["left_id", "right_id"])
    matched = F.col("kind") == "matched"
    tier = F.when(F.col("left_anchor") == F.col("left_ask"), 1).when(F.col("right_anchor") == F.col("right_ask"), 2).when(matched & (F.col("change") != "unchanged"), 3).when(matched, 4).otherwise(5)
    keep = ["kind", "reason", "left_anchor", "right_anchor", "left_label", "right_label", "score", "change"]
    best = F.min_by(F.struct(tier.alias("tier"), *keep), F.struct(tier, "left_ordinal")).alias("b")
    return shown.groupBy("left_id", "right_id").agg(best).select("left_id", "right_id", "b.*")


def preview(rows: DataFrame, asks: DataFrame, docs: DataFrame) -> DataFrame:
    """:func:`focus` with the path of the comparison and the right document's title and number."""
    named = docs.select(F.col("id").alias("right_id"), F.col("title").alias("right_title"), F.col("document_number").alias("right_number"))
    path = F.concat(F.lit("/compare/"), F.col("left_id").cast("string"), F.lit("/"), F.col("right_id").cast("string"))
    return focus(rows, asks).join(named, "right_id").withColumn("compare_path", path)
