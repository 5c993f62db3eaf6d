"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality as q


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distance(p: str, r: str, width: int) -> str:
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"
    terms = []
    for k in range(1, width + 1):
        a, b = f"({p}[{k}] / list_sum({p})::DOUBLE)", f"({r}[{k}] / list_sum({r})::DOUBLE)"
        m = f"({a} + {b}) / 2"
        terms.append(f"({half(a, m)} + {half(b, m)}) / 2")
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({r}) > 0 THEN sqrt(greatest({' + '.join(terms)}, 0)) ELSE 0 END"


def quality_rules() -> str:
    most = max(len(v) for v in q.COMMON_WORDS.values())
    known = "CASE lg " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in q.COMMON_WORDS.items()) + " ELSE []::VARCHAR[] END"
    count = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    chars = ["length(t) - word_chars", *map(count, q.SYMBOL_CLASSES.values()), count("0-9"), count("A-Z"), count(".,;:!?''\"()\\-"), "length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"]
    n = len(q.CLASSES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lower(coalesce(lang, '')) AS lg FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln, {known} AS known FROM d),
b AS (SELECT rid, doc_id, t, lg, w, known, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) - list_unique(ln) AS n_dup_lines,
             list_transform(list_filter(w, lambda x: length(x) <= {max(len(x) for v in q.COMMON_WORDS.values() for x in v)}), lambda x: lower(x)) AS short FROM s),
win AS (SELECT rid, i, w[i + 1:i + 5] AS k FROM (SELECT rid, w, unnest(range(len(w) - 4)) AS i FROM b WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep CROSS JOIN (SELECT unnest(range(5)) AS j) GROUP BY rid),
h0 AS (SELECT b.*, coalesce(cov.n, 0) AS n_repeat_words, [{', '.join(chars)}] AS c0, list_transform(known, lambda c: len(list_filter(short, lambda x: x = c))) AS h FROM b LEFT JOIN cov USING (rid)),
h AS (SELECT *, list_concat(c0, [length(t) - list_sum(c0)]) AS c, list_concat(list_concat(h, list_resize([]::BIGINT[], {most} - len(h), 0)), [n_words - coalesce(list_sum(h), 0)]) AS hw FROM h0),
ref AS (SELECT lg, [{', '.join(f'sum(c[{k}])' for k in range(1, n + 1))}] AS rc, [{', '.join(f'sum(hw[{k}])' for k in range(1, most + 2))}] AS rw FROM h WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) GROUP BY lg HAVING count(*) >= {q.LEAST_DOCUMENTS}),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
             round({_distance('c', 'rc', n)}, 6) AS chars_distance, round({_distance('hw', 'rw', most + 1)}, 6) AS words_distance FROM h LEFT JOIN ref USING (lg))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, chars_distance::DOUBLE AS chars_distance, words_distance::DOUBLE AS words_distance,
       (NOT base_failed AND (n_words < {q.LEAST_WORDS} OR (chars_distance <= {q.CHARS_BEYOND} AND words_distance <= {q.WORDS_BEYOND}))) AS kept
FROM j"""
