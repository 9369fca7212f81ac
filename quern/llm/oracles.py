"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from . import quality_rules as q
from . import sharding as s

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {_WORDS.format(t="t")} AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM twice, range(3) AS s(k) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(translate(t, E' \t\n\x0b\f\r', ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(t, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) AS w LEFT JOIN rep USING (doc_id)
),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS bad FROM f GROUP BY source),
p AS (SELECT sum(n) AS n, sum(n * n) AS nn, count(*) AS k, sum(bad) / sum(n) AS m, sum(bad * bad / n) AS qq FROM h),
v AS (SELECT m, CASE WHEN n - nn / n > 0 THEN (qq - n * m * m - (k - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS between_ FROM p),
b AS (SELECT m, CASE WHEN between_ > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / between_ - 1, 1) ELSE {q.FLAT_PRIOR} END AS weight FROM v),
r AS (SELECT source, (bad + weight * m) / (n + weight) AS rate FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {q.MAX_HOST_RATE} AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later)),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY doc_id, g),
cut AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
kept AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS a, s AS b, e - s AS n FROM cut)
SELECT doc_id, (len(any_value(h)) // 2)::BIGINT AS n_bytes, sum(n)::BIGINT AS n_removed, count(*) FILTER (n > 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b), ''))) AS kept_sha256
FROM kept JOIN d USING (doc_id) GROUP BY doc_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
    UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


#: CRC-32's table, from its polynomial.
_CRC_TABLE = """(SELECT list(v ORDER BY i) FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i)
))"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; the table is the column t."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {data}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


def _hilbert(cells: str, n: int, bits: int) -> str:
    """cells (with coordinates x0, x1, ..) with the index h on the Hilbert curve: one subquery a step."""
    out = cells
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        out = f"(SELECT * REPLACE (CASE WHEN x0 & {bit} <> 0 THEN xor(x0, {low}) ELSE x0 END AS x0) FROM {out})"
        for i in range(1, n):
            swap = f"(xor(x0, x{i}) & {low})"
            out = f"(SELECT * REPLACE (CASE WHEN x{i} & {bit} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0, CASE WHEN x{i} & {bit} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}) FROM {out})"
    for i in range(1, n):
        out = f"(SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {out})"
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    places = [f"((xor(x{i}, f) >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n)]
    return f"(SELECT *, {' + '.join(places)} AS h FROM (SELECT *, {flip} AS f FROM {out}))"




def _coordinate(column: str) -> str:
    """The part of the column's values, by equal shares of the rows; 0 for null."""
    return f"(SELECT v, 1 + least({s.TOP} * (upto - n) // total, {s.TOP - 1})::BIGINT AS x FROM (SELECT v, n, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM (SELECT {column} AS v, count(*) AS n FROM e WHERE {column} IS NOT NULL GROUP BY 1)))"


SHARDING = f"""
WITH k AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, source, lang, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, k),
e AS (SELECT d.*, {_crc("concat_ws(':', doc_id, text_crc32, source)")} AS hash, floor(doc_id / {s.STRETCH})::BIGINT AS stretch FROM d, k),
p AS (SELECT min(x) AS y, v FROM {_coordinate("source")} GROUP BY v), q AS (SELECT min(x) AS y, v FROM {_coordinate("lang")} GROUP BY v), u AS (SELECT min(x) AS y, v FROM {_coordinate("stretch")} GROUP BY v),
ranks AS (SELECT 0 AS dim, y, row_number() OVER (ORDER BY y) AS r FROM (SELECT DISTINCT y FROM p) UNION ALL SELECT 1, y, row_number() OVER (ORDER BY y) FROM (SELECT DISTINCT y FROM q) UNION ALL SELECT 3, y, row_number() OVER (ORDER BY y) FROM (SELECT DISTINCT y FROM u)),
c AS (
    SELECT doc_id, size, text_crc32, hash, coalesce(r0.r, 0) AS c0, coalesce(r1.r, 0) AS c1, least(length(bin(size)) - 1, {s.TOP})::BIGINT AS c2, coalesce(r3.r, 0) AS c3
    FROM e LEFT JOIN p ON p.v = e.source LEFT JOIN q ON q.v = e.lang LEFT JOIN u ON u.v = e.stretch
    LEFT JOIN ranks AS r0 ON r0.dim = 0 AND r0.y = p.y LEFT JOIN ranks AS r1 ON r1.dim = 1 AND r1.y = q.y LEFT JOIN ranks AS r3 ON r3.dim = 3 AND r3.y = u.y
),
f AS (SELECT *, hash % ((count(*) OVER (PARTITION BY c0, c1, c2, c3) + {s.CELL_ROWS - 1}) // {s.CELL_ROWS}) AS salt FROM c),
g AS (SELECT DISTINCT c0, c1, c2, c3, c0::BIGINT AS x0, c1::BIGINT AS x1, c2::BIGINT AS x2, c3::BIGINT AS x3 FROM c),
i AS (SELECT c0, c1, c2, c3, h FROM {_hilbert("g", 4, s.BITS)}),
r AS (SELECT f.*, h AS curve, row_number() OVER (ORDER BY h, salt, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER () AS n FROM f JOIN i USING (c0, c1, c2, c3)),
o AS (SELECT *, rank * 16 // n AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (rank - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, curve::INT AS curve FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING, "op3_quality_rules": QUALITY_RULES, "op4_repeats": REPEATS, "op9_near_dedup": NEAR_DEDUP}
