"""DuckDB SQL of op5_quality: the same counts, references and distances."""

from __future__ import annotations

from .quality import CHAR_LIMIT, COMMON, LEAST_REFERENCE, LEAST_SHARE, LEAST_WORDS, WORD_LIMIT, WORD_SCATTER

#: In DuckDB's syntax, in order; what is left over is the eighth class.
_CLASSES = (r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[.,;:!?''\"()-]", r"[^\x00-\x7F]", r"[#*$%&|<>]", r"[0-9]")


def _js(p: str, q: str) -> str:
    norm = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    term = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    terms = f"list_transform(list_zip({norm(p)}, {norm(q)}), lambda z: ({term.format(1)} + {term.format(2)}) / 2)"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum({terms}), 0)) ELSE 0 END"


def sql() -> str:
    count = lambda c: f"length(regexp_replace(t, '[^' || '{c[1:]}', '', 'g'))" if not c.startswith("[^") else f"length(regexp_replace(t, '[{c[2:]}', '', 'g'))"
    chars = ", ".join(count(c) for c in _CLASSES)
    sums = lambda col, n: "[" + ", ".join(f"CAST(sum({col}[{i}]) AS DOUBLE)" for i in range(1, n + 1)) + "]"
    return rf"""
    WITH d AS (
        SELECT doc_id, lang, row_number() OVER () AS row, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), g AS (
        SELECT row, i, w[i:i + 2] AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
    ), twice AS (
        SELECT row, g FROM g GROUP BY row, g HAVING count(*) > 1
    ), rep AS (
        SELECT row, count(DISTINCT p) AS n FROM (SELECT g.row, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice ON g.row = twice.row AND g.g = twice.g) GROUP BY row
    ), f AS (
        SELECT d.row, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
               list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, [{chars}] AS part_chars, length(t) AS n_all,
               w, len(w) < {LEAST_WORDS} OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN rep ON d.row = rep.row
    ), vocabulary AS (
        SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM f WHERE NOT base_failed) GROUP BY lang, word
    ), totals AS (
        SELECT lang, sum(n) AS total FROM vocabulary GROUP BY lang
    ), ranked AS (
        SELECT v.lang, word, row_number() OVER (PARTITION BY v.lang ORDER BY n DESC, word) AS rank FROM vocabulary v JOIN totals t ON v.lang IS NOT DISTINCT FROM t.lang WHERE n * {LEAST_SHARE} >= total
    ), lists AS (
        SELECT lang, list(word ORDER BY rank) AS listed FROM ranked WHERE rank <= {COMMON} GROUP BY lang
    ), h AS (
        SELECT row, doc_id, f.lang, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
               base_failed, list_append(part_chars, n_all - list_sum(part_chars)) AS chars,
               list_transform(coalesce(listed, CAST([] AS VARCHAR[])), lambda x: len(list_filter(w, lambda y: y = x))) AS found
        FROM f LEFT JOIN lists ON f.lang IS NOT DISTINCT FROM lists.lang
    ), k AS (
        SELECT *, list_append(found, greatest(n_words - coalesce(list_sum(found), 0), 0)) AS words FROM h
    ), r AS (
        SELECT lang, {sums('chars', 8)} AS ref_chars, list_filter({sums('words', COMMON + 1)}, lambda v: v IS NOT NULL) AS ref_words, sum(n_words) AS size FROM k WHERE NOT base_failed GROUP BY lang
    ), j AS (
        SELECT k.*, n_words >= {LEAST_WORDS} AND coalesce(size, 0) >= {LEAST_REFERENCE} AS counts, {_js('chars', 'ref_chars')} AS char_distance, {_js('words', 'ref_words')} AS word_distance
        FROM k LEFT JOIN r ON k.lang IS NOT DISTINCT FROM r.lang
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND (NOT counts OR char_distance <= {CHAR_LIMIT}) AND (NOT counts OR len(words) < 2 OR word_distance <= {WORD_LIMIT} + {WORD_SCATTER} / sqrt(greatest(n_words, 1))) AS kept FROM j"""
