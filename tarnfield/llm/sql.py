"""DuckDB SQL of the queries on training data, with all constants written out."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text as DuckDB takes them.
_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT r, n, k, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT r, page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, h || q) AS k FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
"""


def _spans(kind: str, pattern: str, good: str) -> str:
    """A list of the spans of one pattern in column t; ``good`` tests a match m."""
    step = f"list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 's': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)}})"
    return f"(SELECT list_transform(list_filter({step}, lambda z: {good}), lambda z: {{'kind': '{kind}', 'a': CAST(z.s AS BIGINT), 'b': CAST(z.s + length(z.m) AS BIGINT)}}) FROM (SELECT regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p))"


def _joined(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda z: z.kind || ':' || z.a || ':' || z.b), ',')"


_TEXTS = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS_BASE_SQL = f"""
WITH s AS (SELECT doc_id, {_spans("assign", _ASSIGN, f"length(regexp_extract(z.m, '^{_ASSIGN}', 2)) >= 6")} AS assigns,
  {_spans("access", "AKIA[A-Z0-9]+", "length(z.m) >= 20")} AS accesses, {_spans("hex", "[0-9a-f]+", "length(z.m) >= 24")} AS hexes FROM {_TEXTS})
SELECT doc_id, CAST(len(assigns) AS BIGINT) AS n_assign, CAST(len(accesses) AS BIGINT) AS n_access, CAST(len(hexes) AS BIGINT) AS n_hex,
  sha256({_joined("list_sort(list_transform(list_concat(list_concat(assigns, accesses), hexes), lambda q: {'a': q.a, 'o': list_position(['assign', 'access', 'hex'], q.kind), 'kind': q.kind, 'b': q.b}))")}) AS base_sha256 FROM s
"""

_DIGITS = "regexp_replace(z.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT) ELSE (2 * CAST(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT)) // 10 + (2 * CAST(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT)) % 10 END)) % 10 = 0"

PII_BASE_SQL = rf"""
WITH s AS (SELECT doc_id, {_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")} AS e,
  {_spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(z.m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(x, '0'), 3) AS INT), 0) > 255)) = 0")} AS i,
  {_spans("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")} AS c,
  {_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")} AS p FROM {_TEXTS})
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(i) AS BIGINT) AS n_ip, CAST(len(c) AS BIGINT) AS n_card, CAST(len(p) AS BIGINT) AS n_phone,
  sha256({_joined("list_concat(list_concat(e, i), list_concat(c, p))")}) AS base_sha256 FROM s
"""

QUALITY_COUNTS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) > 4)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (r) LEFT JOIN n USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


def _feistel(rows: str) -> str:
    """Four rounds on x of rows (id, h, n, x): two halves of h bits, 64-bit mixing in 128-bit arithmetic."""
    low, wide, q = "((CAST(1 AS UHUGEINT) << h) - 1)", "CAST(18446744073709551616 AS UHUGEINT)", f"SELECT id, h, n, x >> h AS a, x & ((CAST(1 AS UHUGEINT) << h) - 1) AS b FROM {rows}"
    for r in range(4):
        # the round's key: 20240229 * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03, modulo 2^64
        q = f"SELECT *, (b + CAST({(20240229 * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64} AS UHUGEINT)) % {wide} AS t FROM ({q})"
        q = f"SELECT id, h, n, a, b, (xor(t, t >> CAST(30 AS UHUGEINT)) * CAST({0xBF58476D1CE4E5B9} AS UHUGEINT)) % {wide} AS t FROM ({q})"
        q = f"SELECT id, h, n, a, b, (xor(t, t >> CAST(27 AS UHUGEINT)) * CAST({0x94D049BB133111EB} AS UHUGEINT)) % {wide} AS t FROM ({q})"
        q = f"SELECT id, h, n, b AS a, xor(a, xor(t, t >> CAST(31 AS UHUGEINT)) & {low}) AS b FROM ({q})"
    return f"SELECT id, h, n, (a << h) | b AS x FROM ({q})"


def _nibble_table() -> list[int]:
    """Remainders of the sixteen half bytes by the reversed polynomial of crc32."""
    out = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


#: crc32 of the UTF-8 bytes of t by half bytes, the lower one of each byte first.
_CRC = f"""xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, len(d)), lambda j: CAST(strpos('0123456789ABCDEF', d[xor(j, 1) + 1]) - 1 AS BIGINT))),
  lambda c, v: xor(c >> 4, CAST({_nibble_table()} AS BIGINT[])[CAST(xor(c, v) & 15 AS BIGINT) + 1])))"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC} END AS text_crc32 FROM (SELECT doc_id, t, string_split(hex(t), '') AS d FROM {_TEXTS})),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id, count(*) OVER () AS n FROM d),
w AS (SELECT id, CAST(greatest(1, (length(bin(CAST(greatest(n - 1, 1) AS BIGINT))) + 1) // 2) AS UHUGEINT) AS h, n, CAST(id AS UHUGEINT) AS x FROM k),
walk AS ({_feistel("w")} UNION ALL {_feistel("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 16 AS INTEGER) AS shard, CAST(x // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k JOIN (SELECT id, x FROM walk WHERE x < n) USING (id)
"""
