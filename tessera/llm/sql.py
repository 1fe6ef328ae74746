"""DuckDB SQL for the queries that SQL can express; for small tables, as it joins windows one by one."""

from __future__ import annotations

from tessera.llm import decontaminate as dc
from tessera.llm import repeats

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(comp) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

_L = repeats.LENGTH
REPEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, CAST(unnest(range(0, len(w) - {_L - 1})) AS BIGINT) AS s, unnest(list_transform(range(1, len(w) - {_L - 2}), lambda i: md5(array_to_string(w[i:i + {_L - 1}], ' ')))) AS h FROM w WHERE len(w) >= {_L}),
m AS (SELECT DISTINCT doc_id, s FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= before + {_L} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM m)),
p AS (SELECT doc_id, island, min(s) AS a, max(s) + {_L} AS b FROM i GROUP BY 1, 2)
SELECT p.doc_id, CAST(max(len(w.w)) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS repeated_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans
FROM p JOIN w USING (doc_id) GROUP BY p.doc_id
"""

_UNITS = ", ".join(f"'{u}'" for u in [*dc.UNITS, "%"])


def _words(c: str) -> str:
    """Tokens: points and commas stay between digits only (\\x01 and \\x02 hold their places)."""
    t = rf"regexp_replace(coalesce({c}, ''), '([0-9])([\p{{L}}%])', '\1 \2', 'g')"
    for mark, sign in ((1, r"\."), (2, ",")):
        for _ in range(2):  # twice, as neighbouring matches share a digit
            t = rf"regexp_replace({t}, '([0-9]){sign}([0-9])', '\1' || chr({mark}) || '\2', 'g')"
    t = rf"trim(regexp_replace({t}, '[^\p{{L}}\p{{N}}%\x01\x02]+', ' ', 'g'))"
    return rf"list_filter(string_split(replace(replace({t}, chr(1), '.'), chr(2), ','), ' '), lambda x: x <> '')"


_TYPED = r"list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^\p{Lu}') THEN '#p' WHEN regexp_full_match(x, '[0-9][0-9.,]*') THEN '#n' ELSE x END)"
_K = f"list_transform(y, lambda x, i: CASE WHEN i > 1 AND y[i - 1] = '#n' AND x IN ({_UNITS}) THEN '#u' ELSE lower(x) END)"


def _windows(source: str, key: str, k: str) -> str:
    return f"SELECT {key}, m, CAST(p AS BIGINT) AS p, w[p:p + m - 1] AS w, k[p:p + m - 1] AS k FROM (SELECT {key}, w, k, m, unnest(range(1, len(k) - m + 2)) AS p FROM {source} WHERE len(k) >= m)"


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, w, {_K} AS k FROM (SELECT *, {_TYPED} AS y FROM (SELECT doc_id, {_words("text")} AS w FROM documents))),
b AS (SELECT item_id, w, k, least(len(k), {dc.WINDOW}) AS m FROM (SELECT item_id, w, {_K} AS k FROM (SELECT *, {_TYPED} AS y FROM (SELECT item_id, {_words("text")} AS w FROM benchmark)))),
bw AS (SELECT * FROM ({_windows("b", "item_id", "k")}) WHERE m >= {dc.LITERALS} AND len(list_distinct(list_filter(k, lambda x: NOT starts_with(x, '#')))) >= {dc.LITERALS}),
dm AS (SELECT d.*, m FROM d CROSS JOIN (SELECT DISTINCT m FROM bw)),
dw AS ({_windows("dm", "doc_id", "k")}),
hit AS (SELECT doc_id, item_id, dw.p - bw.p AS shift, bw.p AS p, bw.k AS k, bw.w AS bt, dw.w AS dt FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
slot AS (SELECT DISTINCT doc_id, item_id, shift, k[i] AS t, bt[i] AS x, dt[i] AS y FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM hit) WHERE starts_with(k[i], '#')),
slots AS (SELECT doc_id, item_id, shift, count(*) AS n_slots, count(*) FILTER (WHERE x <> y) AS n_changed, count(DISTINCT t || ' ' || x) AS one, count(DISTINCT t || ' ' || y) AS other FROM slot GROUP BY 1, 2, 3),
diagonal AS (SELECT doc_id, item_id, shift, count(DISTINCT p) AS n_windows FROM hit GROUP BY 1, 2, 3),
good AS (SELECT g.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM diagonal g LEFT JOIN slots s USING (doc_id, item_id, shift) WHERE n_slots IS NULL OR (one = n_slots AND other = n_slots)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_changed, shift, n_slots DESC) AS r FROM good),
total AS (SELECT item_id, count(DISTINCT p) AS item_windows FROM bw GROUP BY item_id)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(item_windows AS BIGINT) AS item_windows, CAST(n_windows AS DOUBLE) / item_windows AS coverage, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_changed AS BIGINT) AS n_changed, CAST(shift AS BIGINT) AS position
FROM best JOIN total USING (item_id) WHERE r = 1 AND CAST(n_windows AS DOUBLE) / item_windows >= {dc.COVERAGE}
"""

#: Prefixes by grouping lists of turns; crc32 from its table of 256 remainders.
PREFIX_TRIE = """
WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) - 1 AS pos, item, size FROM (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || '|' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT i.conv_id, t.pos, t.item, t.size FROM ids i JOIN turns t ON t.conv_id = i.head AND t.pos < i.h
  UNION ALL SELECT i.conv_id, 1099511627776 + t.pos, t.item, t.size FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos >= i.h),
convs AS (SELECT i.conv_id, coalesce(r.items, CAST([] AS VARCHAR[])) AS items, coalesce(r.sizes, CAST([] AS BIGINT[])) AS sizes FROM ids i LEFT JOIN (
  SELECT conv_id, list(item ORDER BY pos) AS items, list(size ORDER BY pos) AS sizes FROM rebuilt GROUP BY conv_id) r ON r.conv_id = i.conv_id),
prefixes AS (SELECT conv_id, d, items[1:d] AS p, coalesce(sizes[d], 0) AS size, d = len(items) AS ends FROM (SELECT *, unnest(range(len(items) + 1)) AS d FROM convs)),
nodes AS (SELECT p, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT p[1:a] AS p, sum((n_convs - 1) * size) AS saved, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves FROM (
  SELECT n.p, n.n_convs, n.size, c.n IS NULL AS leaf, unnest(range(n.depth + 1)) AS a FROM nodes n LEFT JOIN children c ON c.p = n.p) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]
"""

ORACLE_SQL = {
    "op4_decontamination": DECONTAMINATION,
    "op5_jaccard_join": JACCARD,
    "op6_suffix_array_dedup": REPEATS,
    "op13_prefix_trie": PREFIX_TRIE,
}
