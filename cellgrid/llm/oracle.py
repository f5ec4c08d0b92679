"""DuckDB SQL with which the queries of this subpackage are compared."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def url_filter(rules, digits: str) -> str:
    """Rules in their order of length, then whether a host or a parent of it is listed: three labels or more, and an MD5 that begins with one of the digits."""
    listed = ", ".join(f"'{d}'" for d in digits)
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for h, p, v in ordered)
    return f"""
        WITH parted AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parsed AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parted
        ), keys AS (
            SELECT DISTINCT host FROM parsed
        ), hit AS (
            SELECT DISTINCT host AS bad FROM (SELECT host, unnest(string_split(host, '.')) AS _, generate_subscripts(string_split(host, '.'), 1) AS i FROM keys)
            WHERE len(string_split(host, '.')) - i >= 2 AND md5(array_to_string(string_split(host, '.')[i:], '.'))[1] IN ({listed})
        )
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM parsed p LEFT JOIN hit ON host = bad"""


MIXING = rf"""
    WITH d AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
               substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'mix-1')), 1, 16) AS k FROM documents
    ), c AS (
        SELECT *, CASE WHEN size > 0 THEN (length(bin(size)) - 1) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) ELSE -1 END AS cls FROM d
    ), classes AS (
        SELECT source, cls, count(*) AS n FROM c GROUP BY ALL
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source
    ), w AS (
        SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
    ), f AS (
        SELECT *, source_size * 2.0::DOUBLE AS full_size, source_size * 2.0::DOUBLE / weight AS full_at FROM w
    ), l AS (
        SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
        FROM f WINDOW before AS (ORDER BY full_at, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
        SELECT source, source_size, coalesce(least(full_size, max(CASE WHEN level <= full_at THEN level END) OVER () * weight), full_size) AS target FROM l
    ), r AS (
        SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
               CAST('0x' || substr(md5(concat_ws('|', coalesce(source, ''), 'mix-1')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM t
    ), placed AS (
        SELECT c.*, r.source_size, r.target, r.rate, r.u,
               row_number() OVER (PARTITION BY c.source ORDER BY c.cls, CASE WHEN n > 256000 THEN substr(k, 1, 3) WHEN n > 16000 THEN substr(k, 1, 2) WHEN n > 1000 THEN substr(k, 1, 1) ELSE '' END, size, k) AS e
        FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source JOIN classes ON c.source IS NOT DISTINCT FROM classes.source AND c.cls = classes.cls
    )
    SELECT doc_id, size, source_size, target, CAST(floor(e * rate + u) - floor((e - 1) * rate + u) AS BIGINT) * size AS taken FROM placed"""

DECONTAMINATE = r"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), items AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
    ), ks AS (
        SELECT DISTINCT k FROM windows
    ), starts AS (
        SELECT row, k, unnest(generate_series(1, len(w) - k + 1)) AS i, w FROM docs, ks WHERE len(w) >= k
    ), hits AS (
        SELECT s.row, s.i, s.k, item_id FROM starts s JOIN windows ON windows.k = s.k AND windows.win = array_to_string(s.w[s.i:s.i + s.k - 1], ' ')
    ), covered AS (
        SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY row
    ), found AS (
        SELECT row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered ON docs.row = covered.row LEFT JOIN found ON docs.row = found.row"""

CHAT = r"""
    WITH t AS (
        SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '<\|') AS name, replace(coalesce(text, ''), '<|', '<\|') AS body FROM conversations
    ), n AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, body) AS nth FROM t
    ), s AS (
        SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> ''
    ), v AS (
        SELECT n.conv_id, speaker, nth, name = speaker AS mine,
               CASE WHEN name = speaker THEN '<|assistant|>' WHEN name = '' THEN '<|user name=unknown|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head,
               body || '<|end|>' || chr(10) AS rest
        FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
    ), p AS (
        SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, speaker ORDER BY nth) AS stop FROM v
    )
    SELECT conv_id, speaker, CAST(0 AS BIGINT) AS piece, count(*) AS n_turns, CAST(0 AS BIGINT) AS n_context, string_agg(head || rest, '' ORDER BY nth) AS text,
           coalesce(string_agg(CAST(stop - length(rest) AS BIGINT) || ':' || CAST(stop - 1 AS BIGINT), ',' ORDER BY nth) FILTER (WHERE mine), '') AS mask
    FROM p GROUP BY conv_id, speaker"""

WARC = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
    ), f AS (
        SELECT hex, min(page_id) AS first FROM p GROUP BY hex
    )
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(p.hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f ON p.hex = f.hex"""

