"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Control strings of the template (fixed values).
OPEN, HEAD, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
#: Further control strings of common templates that texts must not forge (fixed values).
FOREIGN = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
#: A backslash goes behind the first character of each control string, and before each backslash.
_GUARD = r"(?<=<)(?=\||s>|/s>|<SYS>|</SYS>)|(?<=\[)(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    """``text`` without any control string; :func:`unescape` undoes it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit(r"\\")), _GUARD, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turn: Column) -> Column:
    """A turn in the template."""
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(HEAD), escape(turn["text"]), F.lit(CLOSE))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Training examples: (conv, target, formatted, loss_start, loss_length).

    Every assistant turn becomes an example of its own: all turns before it are
    the context, and only its text is trainable (loss_start and loss_length
    count characters of ``formatted``, end mark left out). A conversation whose
    last turn is not the assistant's gets one more example, without target or
    loss, so that the output holds every turn. Null roles and texts count as
    empty. Turns are put in order by turn, then role and text; equal rows stay
    separate turns, and null conversation ids are one conversation. An empty
    table gives no example.

    Output grows with the square of a conversation's turns: that is the method.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    parts = convs.select(conv, "turns", F.transform("turns", render).alias("parts"), F.size("turns").alias("n"))
    is_target = lambda t: t["role"] == "assistant"
    places = F.filter(F.transform("turns", lambda t, i: F.when(is_target(t) | (i == F.col("n") - 1), i)), lambda i: i.isNotNull())
    each = parts.select(conv, "turns", "parts", F.explode(places).alias("at"))
    own = F.element_at("turns", F.col("at") + 1)
    before = F.array_join(F.slice("parts", 1, F.col("at")), "")
    shown = each.select(conv, "at", before.alias("before"), F.element_at("parts", F.col("at") + 1).alias("last"), own["role"].alias("r"), own["text"].alias("t"))
    target = F.col("r") == "assistant"
    return shown.select(
        conv,
        F.when(target, F.col("at")).alias("target"),
        F.concat("before", "last").alias("formatted"),
        F.when(target, F.length("before") + F.lit(len(OPEN) + len(HEAD)) + F.length(escape(F.col("r")))).alias("loss_start"),
        F.when(target, F.length(escape(F.col("t")))).alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The array of (role, text) turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.split(F.substring_index(p, CLOSE, 1), r"<\|says\|>"))
    return F.transform(bare, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the examples hold, read back from them: one row per conversation.

    n_turns and turns_sha256 (role, line feed, text, line feed per turn) come
    from the longest example; loss_chars and loss_sha256 from the text under
    the loss mask of every example in order; formatted_chars is their length.
    """
    loss = F.when(F.col("target").isNotNull(), F.struct("target", unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))).alias("text")))
    found = examples.groupBy(conv).agg(
        F.max_by("formatted", F.length("formatted")).alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(loss)), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = found.withColumn("turns", parse(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
