"""SQL of the queries that SQL can express, for DuckDB over the same tables. Rows are numbered, as ids may repeat."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size FROM documents
), k AS (
    SELECT *, greatest(0.05, 1.0::DOUBLE - 5.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(length(t), 1)) * least(1.0::DOUBLE, (size + 6) / 60.0::DOUBLE) AS weight,
        (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source
), c AS (
    SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM s
), l AS (
    SELECT *, coalesce(least(cap, w * (SELECT arg_min(held, cap / w) FROM c WHERE held <= cap / w)), cap) AS target FROM c
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM l
), r AS (
    SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(k.u) / k.weight, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN size > 0 AND 2 * running - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED} AS w FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLDED} AS w FROM documents),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS p FROM m) GROUP BY rid),
x AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN x USING (rid)"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
p AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d WHERE text IS NOT NULL),
l AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM p),
bad AS (SELECT line, min({'d': doc_id, 'p': place}) AS f FROM l WHERE filled GROUP BY line HAVING count(DISTINCT coalesce('+' || source, '-')) >= 5),
j AS (SELECT l.*, filled AND bad.line IS NOT NULL AND NOT (l.doc_id = bad.f.d AND l.place = bad.f.p) AS gone FROM l LEFT JOIN bad ON l.line = bad.line),
a AS (SELECT rid, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS left_text FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(left_text) AS n_chars_left, md5(left_text) AS text_md5 FROM d LEFT JOIN a USING (rid)"""


def op9(rules) -> str:
    """Matches and the pieces between them, as in the query: places from their running lengths."""
    parts, quoted = [], lambda p: p.replace("'", "''")
    for k, r in enumerate(rules):
        hits, kept, pieces = f"regexp_extract_all(t, '{quoted(r.pattern)}')", f"regexp_extract_all(t, '{quoted(r.pattern)}', {r.group})", f"string_split_regex(t, '{quoted(r.pattern)}')"
        parts.append(f"""SELECT rid, {k} AS kind, '{r.name}' AS name, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s, length(h[i]) AS n
            FROM (SELECT rid, h, g, p, unnest(range(1, len(h) + 1)) AS i FROM (SELECT rid, {hits} AS h, {kept} AS g, {pieces} AS p FROM d WHERE regexp_matches(t, '{quoted(r.pattern)}'))) WHERE length(g[i]) >= {r.least}""")
    text = "name || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({text}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({text}, ',' ORDER BY s, kind) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS nd FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(l.n - l.nd, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper_letters, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters
    FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * lines OR (n_words >= 20 AND upper_letters > 0.7 * greatest(letters, 1)) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f"""
