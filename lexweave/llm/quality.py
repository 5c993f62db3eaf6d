"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable

#: Common words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in is that it for as with on be at by this from are was or an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en los se del las un por con no una su para es al lo como".split(),
}
#: Texts of fewer words are too short for a histogram to tell: the divergence rules leave them alone.
LEAST_WORDS = 50
#: Jensen-Shannon distances (0 to 1) beyond which a text is unlike its language.
CHARS_BEYOND, WORDS_BEYOND = 0.20, 0.40
#: Languages with fewer documents that pass the base rules have no reference: their texts lie at distance 0.
LEAST_DOCUMENTS = 20
#: References of at most so many languages are broadcast (each has some 30 numbers); beyond, both sides are shuffled.
BROADCAST_LANGUAGES = 10_000
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Symbols by class of characters: what joins columns and what joins tags are told from the rest.
SYMBOL_CLASSES = {"bars": "|", "brackets": "<>", "symbols": "#*$%&"}
CLASSES = ("spaces", *SYMBOL_CLASSES, "digits", "capitals", "marks", "foreign", "small")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(windows: Column, at: str) -> Column:
    """Words covered by windows of five that occur twice or more; ``windows`` holds a hash for each place.

    Only texts with a repeat sort their windows; ``at`` names a column with
    the sorted places of repeated windows.
    """
    places = F.col(at)
    steps = F.transform(places, lambda p, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(places, i - 1))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """The columns ``keep``, the language, the base counts and both histograms (chars, hits) of each text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lists = F.create_map(*[x for k, v in common.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    language = F.lower(F.coalesce(F.col(lang).cast("string"), F.lit("")))
    base = docs.select(*keep, language.alias("lang_"), body.alias("t"), F.filter(F.split(body, SPACES + "+"), lambda w: w != "").alias("w"))
    rest = F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = F.coalesce(F.try_element_at(lists, F.col("lang_")), F.array().cast("array<string>"))
    counted = base.select(
        *keep,
        "lang_",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars_"),
        rest.alias("rest"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("wh"),
        F.filter(F.transform(F.filter("w", lambda w: F.length(w) <= max(len(x) for v in common.values() for x in v)), F.lower), lambda w: F.array_contains(known, w)).alias("hit"),
        known.alias("known"),
    )
    window = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(5)]))
    left = lambda chars: F.length("rest") - F.length(F.regexp_replace("rest", chars, ""))
    hashed = counted.select(
        *keep, "lang_", "n_words", "word_chars", "n_dup_lines", "n_chars_",
        *[(F.length("rest") - F.length(_without(F.col("rest"), chars))).cast("long").alias(name) for name, chars in SYMBOL_CLASSES.items()],
        left("[0-9]+").alias("digits"), left("[A-Z]+").alias("capitals"), left(r"""[.,;:!?'"()\-]+""").alias("marks"), left(r"[^\x00-\x7F]+").alias("foreign"),
        F.transform("known", lambda c: F.size(F.filter("hit", lambda w: w == c)).cast("long")).alias("hits"),
        F.when(F.col("n_words") >= 5, window).alias("win"),
    )
    order = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = hashed.withColumn("sorted", F.when(F.size(F.array_distinct("win")) < F.size("win"), order)).drop("win")
    same = lambda x, i: F.coalesce(F.get("sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False))
    placed = twice.withColumn("places", F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"]))).drop("sorted")
    spaces = F.col("n_chars_") - F.col("word_chars")
    inner = [F.col(c) for c in CLASSES[1:-1]]
    small = F.col("n_chars_") - spaces - sum(inner[1:], inner[0])
    chars = F.array(*[c.cast("long") for c in (spaces, *inner, small)])
    symbols = sum((F.col(c) for c in list(SYMBOL_CLASSES)[1:]), F.col(next(iter(SYMBOL_CLASSES)))).alias("n_symbols")
    return placed.select(*keep, "lang_", "n_words", "word_chars", symbols, "n_dup_lines", repeated_words(F.col("places"), "places").alias("n_repeat_words"), chars.alias("chars"), "hits")


def distance(p: Column, q: Column, width: int) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of ``width`` places given as arrays of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    tp, tq = total(p), total(q)
    out = F.lit(0.0)
    for k in range(width):
        a, b = F.coalesce(F.get(p, F.lit(k)), F.lit(0)) / tp, F.coalesce(F.get(q, F.lit(k)), F.lit(0)) / tq
        half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        out = out + (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(out, F.lit(0.0)))).otherwise(F.lit(0.0))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON_WORDS, least_words: int = LEAST_WORDS, chars_beyond: float = CHARS_BEYOND, words_beyond: float = WORDS_BEYOND, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document: id, the base counts, base_failed, chars_distance, words_distance, kept.

    The reference of a language is the sum of the histograms of all its
    documents that pass the base rules: nine classes of characters, and its
    common words against all others. A document is kept if it passes the base
    rules and, where it has ``least_words`` words, neither histogram lies
    beyond its bound from the language's. A language with fewer than
    ``least_documents`` such documents has no reference; distances are 0 there.
    Null languages are one language without common words; a language without a
    word list is judged by characters alone. Null and empty texts have no words
    and fail the base rules. Repeated rows each return a row. An empty table
    gives an empty result.
    """
    own = durable(measure(docs, text, lang, (id_col,), common), "quality-counts")
    most = max(len(v) for v in common.values())
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.coalesce(F.get("hits", F.lit(k)), F.lit(0))).alias(f"h{k}") for k in range(most)]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    totals = own.where(~failed).groupBy("lang_").agg(*sums, F.sum("n_words").alias("all_words"), F.count("*").alias("n")).where(F.col("n") >= least_documents)
    rest = lambda hits, n: F.concat(hits, F.array(n - F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + x)))
    padded = F.concat("hits", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("hits")))
    reference = totals.select("lang_", F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("ref_chars"), rest(F.array(*[f"h{k}" for k in range(most)]), F.col("all_words")).alias("ref_words"))
    reference = durable(reference, "quality-references")
    # one row a language: sent to all tasks while that is small, so that no language's documents are gathered
    small = reference.count() <= BROADCAST_LANGUAGES
    near = own.join(F.broadcast(reference) if small else reference, "lang_", "left").withColumn("words", rest(padded, F.col("n_words")))
    told = near.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.round(distance(F.col("chars"), F.col("ref_chars"), len(CLASSES)), 6).alias("chars_distance"),
        F.round(distance(F.col("words"), F.col("ref_words"), most + 1), 6).alias("words_distance"),
    )
    alike = (F.col("n_words") < least_words) | ((F.col("chars_distance") <= chars_beyond) & (F.col("words_distance") <= words_beyond))
    return told.withColumn("kept", ~F.col("base_failed") & alike)
