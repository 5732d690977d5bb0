"""SQL twins of the registered queries, for DuckDB.

They state each result by its definition (all pairs of documents compared, document
lists compared with each other, groups packed one by one), not by the plans used on Spark.
"""

from __future__ import annotations

from registry.fixtures import K, PARTS, WINDOW


def mixed(window: int = WINDOW) -> str:
    return f"""pairs AS (
  SELECT event_id // {window} AS w, event_id AS doc, 'event_type' AS attr, event_type AS val
  FROM events WHERE event_id % 7 <> 0
  UNION ALL
  SELECT event_id // {window}, event_id, 'user', CAST(user_id AS VARCHAR) FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT event_id // {window}, event_id, 'k', json_extract_string(props, '$.k') FROM events WHERE event_id % 3 <> 0
  UNION ALL
  SELECT event_id // {window}, event_id, 'grp', CAST(user_id % 4 AS VARCHAR) FROM events WHERE event_id % 5 <> 0)"""


PAIRS = mixed()

UNIVERSAL = f"""pairs AS (
  SELECT event_id // {WINDOW} AS w, event_id AS doc, 'event_type' AS attr, event_type AS val FROM events
  UNION ALL
  SELECT event_id // {WINDOW}, event_id, 'user', CAST(user_id AS VARCHAR) FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT event_id // {WINDOW}, event_id, 'k', json_extract_string(props, '$.k') FROM events WHERE event_id % 3 <> 0)"""

DOCS = f"docs AS (SELECT event_id // {WINDOW} AS w, event_id AS doc FROM events)"


def keyed(table: str, key: str, attrs: list[str]) -> str:
    parts = [
        f"SELECT {key} // {WINDOW} AS w, {key} AS doc, '{a}' AS attr, CAST({a} AS VARCHAR) AS val FROM {table}"
        for a in attrs
    ]
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


ORDERS = keyed("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])
CUSTOMERS = keyed("customer", "c_custkey", ["c_nationkey", "c_mktsegment"])

JOINED = """joined AS (
  SELECT x.w, x.doc AS a, y.doc AS b, CAST(count(*) FILTER (x.val = y.val) AS BIGINT) AS n_shared
  FROM pairs x JOIN pairs y ON x.w = y.w AND x.attr = y.attr AND x.doc < y.doc
  GROUP BY x.w, x.doc, y.doc
  HAVING count(*) FILTER (x.val = y.val) >= 1 AND count(*) FILTER (x.val <> y.val) = 0)"""

LINE = "l_orderkey * 10 + l_linenumber"
WIDE = """lines AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
    min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2),
pairs AS (""" + " UNION ALL ".join(
    f"SELECT 0::BIGINT AS w, {LINE} AS doc, '{attr}' AS attr, concat_ws('-', {', '.join(cols)}) AS val FROM lines WHERE ({LINE}) % {m} = {r}"
    for attr, m, r, cols in (
        ("part", 2, 0, ["l_partkey"]), ("order", 3, 0, ["l_orderkey"]), ("stock", 5, 0, ["l_suppkey", "l_partkey"]),
        ("line", 7, 0, ["l_orderkey", "l_returnflag"]), ("flag", 4, 1, ["l_partkey", "l_returnflag"]),
        ("state", 6, 1, ["l_partkey", "l_linestatus"]), ("supplied", 11, 2, ["l_orderkey", "l_suppkey"]),
        ("number", 13, 3, ["l_partkey", "l_linenumber"]),
    )
) + """),
met AS (
  SELECT DISTINCT x.w, x.doc AS a, y.doc AS b FROM pairs x JOIN pairs y ON x.w = y.w AND x.attr = y.attr AND x.val = y.val
  WHERE x.doc < y.doc),
joined AS (
  SELECT m.w, m.a, m.b FROM met m JOIN pairs x ON x.doc = m.a JOIN pairs y ON y.doc = m.b AND y.attr = x.attr
  GROUP BY m.w, m.a, m.b HAVING count(*) FILTER (x.val <> y.val) = 0)"""

# The flag is carried by every document, so couples are looked for among lines of equal item.
HOT = """lines AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
    min(l_returnflag) AS flag, l_orderkey * 10 + l_linenumber AS doc FROM lineitem GROUP BY 1, 2),
hot AS (
  SELECT doc, flag, l_partkey || '-' || l_suppkey AS item, CASE WHEN doc % 4 <> 0 THEN l_orderkey END AS ord FROM lines
  WHERE doc % 3 <> 0),
joined AS (
  SELECT 0::BIGINT AS w, x.doc AS a, y.doc AS b FROM hot x JOIN hot y
  ON x.flag = y.flag AND x.item = y.item AND x.doc < y.doc AND (x.ord IS NULL OR y.ord IS NULL OR x.ord = y.ord))"""

STATS = """stats AS (
  SELECT w, attr, count(*) AS n_docs, count(DISTINCT val) AS n_vals FROM pairs GROUP BY w, attr),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY n_docs DESC, n_vals, attr) AS rank FROM stats)"""


def chosen(k: int) -> str:
    return f"""chosen AS (
  SELECT w, attr, rank FROM (
    SELECT *,
      coalesce(sum(n_vals) OVER (PARTITION BY w ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      first_value(n_vals) OVER (PARTITION BY w ORDER BY rank) AS top
    FROM ranked) WHERE top < {k} AND before < {k})"""


# Complete documents get one pair named by the JSON list of attributes.
EXPANDED = f"""{STATS}, {chosen(K)},
names AS (SELECT w, to_json(list(attr ORDER BY rank))::VARCHAR AS name, count(*) AS n FROM chosen GROUP BY w),
complete AS (
  SELECT p.w, p.doc, to_json(list(p.val ORDER BY c.rank))::VARCHAR AS val
  FROM pairs p JOIN chosen c ON c.w = p.w AND c.attr = p.attr
  GROUP BY p.w, p.doc HAVING count(*) = (SELECT n FROM names WHERE names.w = p.w)),
expanded AS (
  SELECT p.w, p.doc, p.attr, p.val, n.w IS NOT NULL AND c.doc IS NULL AS route_all, false AS composite
  FROM pairs p LEFT JOIN complete c ON c.w = p.w AND c.doc = p.doc LEFT JOIN names n ON n.w = p.w
  WHERE c.doc IS NULL OR NOT EXISTS (SELECT 1 FROM chosen x WHERE x.w = p.w AND x.attr = p.attr)
  UNION ALL
  SELECT c.w, c.doc, n.name, c.val, false, true FROM complete c JOIN names n ON n.w = c.w)"""


def equivalence(pairs: str = "pairs", prefix: str = "") -> str:
    return f"""{prefix}sets AS (
  SELECT w, attr, val, list(doc ORDER BY doc) AS docs, count(*) AS n_docs FROM {pairs} GROUP BY w, attr, val),
{prefix}eq AS (
  SELECT w, first_value(attr) OVER same AS g_attr, first_value(val) OVER same AS g_val, n_docs, attr, val, docs
  FROM {prefix}sets WINDOW same AS (PARTITION BY w, docs ORDER BY attr, val))"""


def association(pairs: str = "pairs", prefix: str = "") -> str:
    """Every group against every larger group of its window, by comparing document lists."""
    return f"""{equivalence(pairs, prefix)},
{prefix}eg AS (SELECT w, g_attr, g_val, n_docs, docs FROM {prefix}eq WHERE attr = g_attr AND val = g_val),
{prefix}into_ AS (
  SELECT x.w, x.g_attr, x.g_val, y.g_attr AS i_attr, y.g_val AS i_val, y.n_docs AS i_docs
  FROM {prefix}eg x JOIN {prefix}eg y ON x.w = y.w AND y.n_docs > x.n_docs AND list_has_all(y.docs, x.docs)
  QUALIFY row_number() OVER (PARTITION BY x.w, x.g_attr, x.g_val ORDER BY y.n_docs DESC, y.g_attr, y.g_val) = 1),
{prefix}ag AS (
  SELECT e.w, coalesce(i.i_attr, e.g_attr) AS g_attr, coalesce(i.i_val, e.g_val) AS g_val,
    coalesce(i.i_docs, e.n_docs) AS n_docs, e.attr, e.val
  FROM {prefix}eq e LEFT JOIN {prefix}into_ i ON i.w = e.w AND i.g_attr = e.g_attr AND i.g_val = e.g_val)"""


def ordered(groups: str = "ag") -> str:
    return f"""ordered AS (
  SELECT w, g_attr, g_val, n_docs, n_pairs,
    row_number() OVER (PARTITION BY w ORDER BY n_docs DESC, g_attr, g_val) - 1 AS pos
  FROM (SELECT w, g_attr, g_val, max(n_docs) AS n_docs, count(*) AS n_pairs FROM {groups} GROUP BY w, g_attr, g_val))"""


AG = f"{association()}, {ordered()}"

SNAKE = f"""tab AS (
  SELECT a.w, a.attr, a.val,
    CASE WHEN (o.pos // {K}) % 2 = 0 THEN o.pos % {K} ELSE {K} - 1 - o.pos % {K} END AS pid
  FROM ag a JOIN ordered o ON o.w = a.w AND o.g_attr = a.g_attr AND o.g_val = a.g_val)"""


def routes(name: str, shift: int, pairs: str = "pairs") -> str:
    """Routing of each window by the table ``shift`` windows before it."""
    return f"""{name}_hit AS (
  SELECT p.w, p.doc, t.pid FROM {pairs} p
  LEFT JOIN tab t ON t.w = p.w - {shift} AND t.attr = p.attr AND t.val = p.val WHERE p.w >= {shift}),
{name} AS (
  SELECT DISTINCT w, doc, pid FROM {name}_hit WHERE pid IS NOT NULL
  UNION
  SELECT w, doc, unnest(range({K})) FROM {name}_hit WHERE pid IS NULL)"""


def quality(name: str, routed: str) -> str:
    return f"""{name} AS (
  SELECT w, (SELECT count(DISTINCT doc) FROM {routed} d WHERE d.w = l.w) AS n_docs,
    max(n) AS max_load, CAST(sum(n) AS DOUBLE) / (SELECT count(DISTINCT doc) FROM {routed} d WHERE d.w = l.w) AS avg_comm
  FROM (SELECT w, pid, count(*) AS n FROM {routed} GROUP BY w, pid) l GROUP BY w)"""


def loads(name: str, routed: str, shift: int = 0) -> str:
    """Documents per partition, 0 where a partition of the table got none."""
    return f"""{name} AS (
  SELECT w + {shift} AS w, pid, CAST(sum(n) AS BIGINT) AS n_docs
  FROM (SELECT w, pid, 1 AS n FROM {routed} UNION ALL SELECT DISTINCT w, pid, 0 FROM tab) GROUP BY w, pid)"""


BASE = f"{PAIRS}, {AG}, {SNAKE}"
IDLE = f"""{BASE}, few AS (SELECT * FROM pairs WHERE attr = 'grp'), {routes('own', 0, 'few')}, {loads('l', 'own')}"""
OWN = f"{BASE}, {routes('own', 0)}"
LATER = f"{BASE}, {routes('later', 1)}"

LOCAL_PAIRS = f"""{PAIRS},
local_pairs AS (SELECT {{'w': w, 'shard': doc % 4}} AS w, doc, attr, val FROM pairs)"""

LOCAL = f"""{LOCAL_PAIRS}, {association('local_pairs', 'l_')},
local AS (SELECT w.w AS w, w.shard AS shard, g_attr, g_val, n_docs, attr, val FROM l_ag)"""

DEDUPED = f"""{LOCAL},
sized AS (SELECT *, count(*) OVER (PARTITION BY w, shard, g_attr, g_val) AS n_pairs FROM local),
kept AS (
  SELECT w, shard, g_attr, g_val, attr, val FROM sized
  QUALIFY row_number() OVER (PARTITION BY w, attr, val ORDER BY n_pairs, n_docs DESC, g_attr, g_val, shard) = 1)"""

DRIFT = f"""{OWN}, {routes('later', 1)}, {quality('base', 'own')}, {quality('now', 'later')},
checked AS (
  SELECT n.w, (n.avg_comm - b.avg_comm) / b.avg_comm * 100 AS comm_pct,
    (n.max_load / n.n_docs - b.max_load / b.n_docs) / (b.max_load / b.n_docs) * 100 AS load_pct
  FROM now n JOIN base b ON b.w = n.w - 1),
flagged AS (SELECT *, comm_pct > 20 AS comm_flag, load_pct > 20 AS load_flag FROM checked)"""

UNSEEN = """unseen AS (
  SELECT p.w, p.attr, p.val, count(*) AS n_docs, count(*) >= 3 AS candidate
  FROM pairs p WHERE p.w >= 1 AND NOT EXISTS (
    SELECT 1 FROM tab t WHERE t.w = p.w - 1 AND t.attr = p.attr AND t.val = p.val)
  GROUP BY p.w, p.attr, p.val)"""

UPDATE = f"""{OWN}, {UNSEEN},
fresh AS (
  SELECT DISTINCT p.w, p.doc FROM pairs p JOIN unseen u ON u.w = p.w AND u.attr = p.attr AND u.val = p.val
  WHERE u.candidate),
{loads('loads', 'own', 1)},
scored AS (
  SELECT f.w, f.doc, l.pid, l.n_docs, (
    SELECT count(*) FROM pairs p JOIN tab t ON t.w = p.w - 1 AND t.attr = p.attr AND t.val = p.val AND t.pid = l.pid
    WHERE p.w = f.w AND p.doc = f.doc) AS overlap
  FROM fresh f JOIN loads l ON l.w = f.w),
picked AS (
  SELECT w, doc, pid, overlap FROM scored
  QUALIFY row_number() OVER (PARTITION BY w, doc ORDER BY overlap DESC, n_docs, pid) = 1)"""

# Every window under the table of every earlier one, then the chain from window to window.
PLAN = f"""{BASE},
under_hit AS (
  SELECT o.w AS i, p.w AS j, p.doc, t.pid FROM (SELECT DISTINCT w FROM pairs) o JOIN pairs p ON p.w >= o.w
  LEFT JOIN tab t ON t.w = o.w AND t.attr = p.attr AND t.val = p.val),
under AS (
  SELECT DISTINCT i, j, doc, pid FROM under_hit WHERE pid IS NOT NULL
  UNION
  SELECT i, j, doc, unnest(range({K})) FROM under_hit WHERE pid IS NULL),
under_docs AS (SELECT i, j, count(DISTINCT doc) AS n_docs FROM under GROUP BY i, j),
measured AS (
  SELECT l.i, l.j, d.n_docs, max(n) AS max_load, CAST(sum(n) AS DOUBLE) / d.n_docs AS avg_comm
  FROM (SELECT i, j, pid, count(*) AS n FROM under GROUP BY i, j, pid) l JOIN under_docs d ON d.i = l.i AND d.j = l.j
  GROUP BY l.i, l.j, d.n_docs),
checked AS (
  SELECT n.*, CASE
    WHEN (n.max_load / n.n_docs - b.max_load / b.n_docs) / (b.max_load / b.n_docs) * 100 > 20 THEN 'load'
    WHEN (n.avg_comm - b.avg_comm) / b.avg_comm * 100 > 20 THEN 'communication' ELSE 'none' END AS cause
  FROM measured n JOIN measured b ON b.i = n.i AND b.j = n.i),
chain AS (
  SELECT min(w) AS w, min(w) AS base, 1::BIGINT AS version FROM pairs
  UNION ALL
  SELECT c.w + 1, CASE WHEN k.cause <> 'none' THEN c.w + 1 ELSE c.base END, c.version + CASE WHEN k.cause <> 'none' THEN 1 ELSE 0 END
  FROM chain c JOIN checked k ON k.i = c.base AND k.j = c.w WHERE c.w < (SELECT max(w) FROM pairs))"""
PLANS = f"""WITH RECURSIVE {PLAN}
SELECT c.w, c.version, c.w = c.base AS rebuilt, k.n_docs, k.max_load, round(k.avg_comm, 9) AS avg_comm, k.cause
FROM chain c JOIN checked k ON k.i = c.base AND k.j = c.w"""

# Of three files the last brings events of windows that the second has closed.
LATE = f"""{PAIRS},
late AS (
  SELECT event_id AS doc, event_id // {WINDOW} AS w FROM events WHERE event_id < {2 * WINDOW} AND event_id % 10 = 3
    AND event_id // {WINDOW} <= (
      SELECT max(event_id // {WINDOW}) - 1 FROM events
      WHERE event_id * 3.0 / (SELECT count(*) FROM events) < 2 AND NOT (event_id < {2 * WINDOW} AND event_id % 10 = 3)))"""

FOLD = f"""fold AS (
  SELECT w, g_attr, g_val, pos, 0::BIGINT AS pid,
    list_concat([n_docs], list_resize([]::BIGINT[], {K - 1}, 0::BIGINT)) AS loads
  FROM ordered WHERE pos = 0
  UNION ALL
  SELECT w, g_attr, g_val, pos, pid, list_concat(list_concat(loads[:pid], [loads[pid + 1] + n_docs]), loads[pid + 2:])
  FROM (
    SELECT o.w, o.g_attr, o.g_val, o.pos, o.n_docs, f.loads,
      CASE WHEN o.pos < {K} THEN o.pos ELSE {K} - list_position(list_reverse(f.loads), list_min(f.loads)) END AS pid
    FROM fold f JOIN ordered o ON o.w = f.w AND o.pos = f.pos + 1))"""

DAY = """pairs AS (
  SELECT epoch(date_trunc('day', e.ts))::BIGINT AS w, p.doc, p.attr, p.val
  FROM base p JOIN events e ON e.event_id = p.doc)"""

JSON_BASE = """json_pairs AS (
  SELECT event_id AS doc, 'type' AS attr, event_type AS val FROM events
  UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'tags', to_json(list_sort(list_distinct(['b', 'a', event_type])))::VARCHAR FROM events
  UNION ALL SELECT event_id, 'none', 'null' FROM events)"""



def part(doc: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({doc} AS VARCHAR)), 1, 8) AS BIGINT) % {PARTS}"


SYMMETRIC = "both_ways AS (SELECT w, a AS doc, b AS partner FROM joined UNION ALL SELECT w, b, a FROM joined)"

ORACLES: dict[str, str] = {
    "doc_pairs": f"WITH {PAIRS} SELECT w, doc, attr, val FROM pairs",
    "doc_values_canonical": """
SELECT p_partkey AS doc, 'size' AS attr, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END AS val FROM part
UNION ALL SELECT p_partkey, 'brand', p_brand FROM part
UNION ALL SELECT p_partkey, 'type', to_json(list_sort(list_distinct(string_split(p_type, ' '))))::VARCHAR FROM part""",
    "doc_pairs_encoded": """
SELECT o_orderkey AS doc, 'o_orderpriority-' || o_orderpriority AS text, 'o_orderpriority' AS attr, o_orderpriority AS val FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus-' || o_orderstatus, 'o_orderstatus', o_orderstatus FROM orders""",
    "doc_maps": f"""WITH {PAIRS}
SELECT w, doc, count(*) AS n_attrs, string_agg(attr || '=' || val, ';' ORDER BY attr) AS pairs FROM pairs GROUP BY w, doc""",
    "doc_identity": """
SELECT event_type || '#' || CAST(event_id AS VARCHAR) AS doc, 'events' AS stream, true AS has_ingest_ts FROM events""",
    "doc_latest": f"""WITH latest AS (
  SELECT event_id // {WINDOW} AS w, user_id AS doc, event_type, json_extract_string(props, '$.k') AS k FROM events
  QUALIFY row_number() OVER (PARTITION BY event_id // {WINDOW}, user_id ORDER BY event_id DESC) = 1)
SELECT w, doc, 'type' AS attr, event_type AS val FROM latest
UNION ALL SELECT w, doc, 'k', k FROM latest WHERE k IS NOT NULL""",
    "doc_neighbours": f"""WITH {PAIRS}, {DOCS},
d AS (
  SELECT docs.w, docs.doc, coalesce(list(attr || '=' || val ORDER BY attr) FILTER (attr IS NOT NULL), []) AS ps,
    first(attr ORDER BY attr) AS f_attr, first(val ORDER BY attr) AS f_val
  FROM docs LEFT JOIN pairs ON pairs.w = docs.w AND pairs.doc = docs.doc GROUP BY docs.w, docs.doc),
c AS (
  SELECT x.w, x.doc AS a, count(*) FILTER (x.val <> y.val) AS bad
  FROM pairs x JOIN pairs y ON y.w = x.w AND y.doc = x.doc + 1 AND y.attr = x.attr GROUP BY x.w, x.doc)
SELECT x.w, x.doc AS a, CAST(len(list_intersect(x.ps, y.ps)) AS BIGINT) AS overlap,
  list_has_all(y.ps, x.ps) AS contained,
  len(list_intersect(x.ps, y.ps)) > 0 AS shares,
  coalesce(c.bad, 0) > 0 AS conflicts,
  x.f_attr IS NOT DISTINCT FROM y.f_attr AND x.f_val IS NOT DISTINCT FROM y.f_val AS first_equal,
  x.f_attr IS NOT DISTINCT FROM y.f_attr AS first_same_attr,
  x.f_val IS NOT DISTINCT FROM y.f_val AS first_same_val
FROM d x JOIN d y ON y.w = x.w AND y.doc = x.doc + 1 LEFT JOIN c ON c.w = x.w AND c.a = x.doc""",
    "json_lines": f"WITH {JSON_BASE} SELECT * FROM json_pairs",
    "json_arrays": f"WITH {JSON_BASE} SELECT * FROM json_pairs",
    "json_nested_whole": f"""WITH {JSON_BASE} SELECT * FROM json_pairs
UNION ALL SELECT event_id, 'props', replace(props, ': ', ':') FROM events""",
    "json_nested_flatten": f"""WITH {JSON_BASE} SELECT * FROM json_pairs
UNION ALL SELECT event_id, 'props_k', json_extract_string(props, '$.k') FROM events""",
    "join_wide": f"WITH {WIDE} SELECT w, a, b FROM joined",
    "join_wide_index": f"WITH {WIDE} SELECT w, a, b FROM joined",
    "join_wide_sets": f"""WITH {WIDE}, both_ways AS (SELECT w, a AS doc, b AS p FROM joined UNION ALL SELECT w, b, a FROM joined)
SELECT 0::BIGINT AS w, d.doc, coalesce({part('p')}, 0) AS part, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') AS partners
FROM (SELECT l_orderkey * 10 + l_linenumber AS doc FROM lines) d LEFT JOIN both_ways b ON b.doc = d.doc GROUP BY d.doc, coalesce({part('p')}, 0)""",
    "json_nested_deep": """SELECT o_orderkey AS doc, 'status' AS attr, o_orderstatus AS val FROM orders
UNION ALL SELECT o_orderkey, 'n0_n1_n2_n3_n4_n5_customer', CAST(o_custkey AS VARCHAR) FROM orders""",
    "doc_trimmed_pairs": """SELECT p_partkey AS doc, 'brand' AS attr, p_brand AS val FROM part
UNION ALL SELECT p_partkey, 'type', p_type FROM part""",
    "window_sizes": f"""
SELECT (r - 1) // {WINDOW} AS w, count(*) AS n_docs FROM (SELECT row_number() OVER (ORDER BY ts, event_id) AS r FROM events) GROUP BY 1""",
    "window_sizes_by_source": """
SELECT (r - 1) // 300 AS w, event_type, count(*) AS n_docs
FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2""",
    "window_sizes_sequence": f"SELECT event_id // {WINDOW} AS w, count(*) AS n_docs FROM events GROUP BY 1",
    "window_sizes_time": "SELECT epoch(date_trunc('day', ts))::BIGINT AS w, count(*) AS n_docs FROM events GROUP BY 1",
    "attr_profile": f"WITH {PAIRS}, {STATS} SELECT w, attr, n_docs, n_vals, rank FROM ranked",
    "attr_join_order": f"WITH {ORDERS}, {STATS} SELECT w, attr, rank FROM ranked",
    "attr_universal": f"""WITH {UNIVERSAL}
SELECT w, attr, count(*) AS n_docs FROM pairs p GROUP BY w, attr
HAVING count(*) = (SELECT count(DISTINCT doc) FROM pairs q WHERE q.w = p.w)""",
    "pair_postings": f"""WITH {PAIRS}
SELECT w, attr, val, CAST(sum(count(*)) OVER (PARTITION BY w, attr, val) AS BIGINT) AS n_docs, {part('doc')} AS block,
  string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS docs
FROM pairs GROUP BY w, attr, val, {part('doc')}""",
    "attr_postings": f"""WITH {CUSTOMERS},
totals AS (SELECT w, attr, count(*) AS n_occurrences, count(DISTINCT val) AS n_vals FROM pairs GROUP BY w, attr)
SELECT p.w, p.attr, n_occurrences, n_vals, val, {part('doc')} AS block, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS docs
FROM pairs p JOIN totals t ON t.w = p.w AND t.attr = p.attr GROUP BY p.w, p.attr, n_occurrences, n_vals, val, {part('doc')}""",
    "doc_sorted_pairs": f"""WITH {PAIRS}, {STATS}
SELECT p.w, p.doc, string_agg(p.attr || '=' || p.val, ';' ORDER BY r.rank) AS pairs
FROM pairs p JOIN ranked r ON r.w = p.w AND r.attr = p.attr GROUP BY p.w, p.doc""",
    "expansion_plan": f"WITH {PAIRS}, {STATS}, {chosen(K)} SELECT w, attr, rank FROM chosen",
    "expansion_lists": f"""WITH {PAIRS}, {STATS}, {chosen(5)}, {DOCS}
SELECT d.w, coalesce(string_agg(attr, ',' ORDER BY rank), '') AS attrs
FROM (SELECT DISTINCT w FROM docs) d LEFT JOIN chosen c ON c.w = d.w GROUP BY d.w""",
    "expanded_pairs": f"WITH {PAIRS}, {EXPANDED} SELECT w, doc, route_all, attr, val FROM expanded",
    "unexpanded_pairs": f"WITH {PAIRS} SELECT w, doc, false AS route_all, attr, val FROM pairs",
    "contracted_pairs": f"WITH {PAIRS} SELECT w, doc, attr, val FROM pairs",
    "eq_groups": f"WITH {PAIRS}, {equivalence()} SELECT w, g_attr, g_val, n_docs, attr, val FROM eq",
    "group_order": f"WITH {PAIRS}, {equivalence()}, {ordered('eq')} SELECT w, g_attr, g_val, n_docs, n_pairs, pos FROM ordered",
    "assoc_groups": f"WITH {PAIRS}, {association()} SELECT w, g_attr, g_val, n_docs, attr, val FROM ag",
    "partition_top_k": f"""WITH {PAIRS}, {AG}
SELECT w, g_attr, g_val, n_docs, n_pairs, pos + 1 AS rank FROM ordered WHERE pos < {K}""",
    "assoc_groups_local": f"WITH {LOCAL} SELECT w, shard, g_attr, g_val, n_docs, attr, val FROM local",
    "assoc_groups_collected": f"""WITH {PAIRS},
local_pairs AS (SELECT {{'w': w, 'shard': doc % 4}} AS w, doc, attr, val FROM pairs), {association('local_pairs', 'l_')}
SELECT w.w AS w, w.shard AS shard, g_attr, g_val, n_docs, attr, val FROM l_ag""",
    "groups_deduped": f"WITH {DEDUPED} SELECT w, shard, g_attr, g_val, attr, val FROM kept",
    "groups_merged": f"""WITH {DEDUPED},
gdocs AS (
  SELECT k.w, k.shard, k.g_attr, k.g_val, list_sort(list_distinct(list(p.doc))) AS docs
  FROM kept k JOIN pairs p ON p.w = k.w AND p.attr = k.attr AND p.val = k.val GROUP BY k.w, k.shard, k.g_attr, k.g_val)
SELECT k.w, first_value(k.attr) OVER same AS g_attr, first_value(k.val) OVER same AS g_val,
  CAST(len(g.docs) AS BIGINT) AS n_docs, k.attr, k.val
FROM kept k JOIN gdocs g ON g.w = k.w AND g.shard = k.shard AND g.g_attr = k.g_attr AND g.g_val = k.g_val
WINDOW same AS (PARTITION BY k.w, g.docs ORDER BY k.attr, k.val)""",
    "partition_assign": f"WITH RECURSIVE {PAIRS}, {AG}, {FOLD} SELECT w, g_attr, g_val, pid FROM fold",
    "partition_table": f"WITH {BASE} SELECT w, attr, val, pid FROM tab",
    "partition_load": f"WITH {OWN}, {loads('l', 'own')} SELECT w, pid, n_docs FROM l",
    "partition_load_idle": f"WITH {IDLE} SELECT w, pid, n_docs FROM l",
    "partition_idle_least": f"""WITH {IDLE}
SELECT w, pid, n_docs FROM l QUALIFY row_number() OVER (PARTITION BY w ORDER BY n_docs, pid DESC) = 1""",
    "partition_idle": f"""WITH {OWN}, {loads('l', 'own')}
SELECT w, pid, n_docs FROM l QUALIFY row_number() OVER (PARTITION BY w ORDER BY n_docs, pid DESC) = 1""",
    "partition_quality": f"WITH {OWN}, {quality('q', 'own')} SELECT w, n_docs, max_load, avg_comm FROM q",
    "routes": f"WITH {OWN} SELECT w, doc, pid FROM own",
    "routes_unseen": f"WITH {LATER} SELECT w, doc, pid FROM later",
    "routes_expanded": f"""WITH {PAIRS}, {EXPANDED}, {association('expanded')}, {ordered()}, {SNAKE},
used AS (
  SELECT * FROM expanded e WHERE composite OR NOT EXISTS (
    SELECT 1 FROM complete c WHERE c.w = e.w AND c.doc = e.doc))
SELECT DISTINCT u.w, u.doc, t.pid FROM used u JOIN tab t ON t.w = u.w AND t.attr = u.attr AND t.val = u.val WHERE NOT u.route_all
UNION SELECT DISTINCT w, doc, unnest(range({K})) FROM used WHERE route_all""",
    "routes_hash_complete": f"""WITH {PAIRS}, {JOINED}
SELECT w, count(*) AS n_couples, count(*) AS n_together FROM joined WHERE w >= 1 GROUP BY w""",
    "unseen_pairs": f"WITH {BASE}, {UNSEEN} SELECT w, attr, val, n_docs, candidate FROM unseen",
    "update_documents": f"WITH {UPDATE} SELECT w, doc FROM fresh",
    "partition_update": f"WITH {UPDATE} SELECT w, doc, pid, overlap FROM picked",
    "partition_updated_loads": f"""WITH {UPDATE}
SELECT l.w, l.pid, l.n_docs + (SELECT count(*) FROM picked p WHERE p.w = l.w AND p.pid = l.pid) AS n_docs
FROM loads l WHERE l.w IN (SELECT w FROM fresh)""",
    "partition_updated_pairs": f"""WITH {UPDATE}
SELECT w + 1 AS w, attr, val, pid FROM tab
UNION SELECT p.w, p.attr, p.val, k.pid FROM pairs p JOIN picked k ON k.w = p.w AND k.doc = p.doc""",
    "routing_profile": f"""WITH {LATER}, c AS (SELECT w, doc, count(*) AS n FROM later GROUP BY w, doc)
SELECT w, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS copies, avg(n) AS avg_copies, min(n) AS min_copies, max(n) AS max_copies
FROM c GROUP BY w""",
    "quality_drift": f"""WITH {DRIFT}
SELECT w, round(comm_pct, 6) AS comm_pct, round(load_pct, 6) AS load_pct, comm_flag, load_flag,
  comm_flag OR load_flag AS repartition FROM flagged""",
    "repartition_causes": f"""WITH {DRIFT}
SELECT CASE WHEN load_flag THEN 'load' WHEN comm_flag THEN 'communication' ELSE 'none' END AS cause, count(*) AS n_windows
FROM flagged GROUP BY 1""",
    "join_exact": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_index": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_universal": f"WITH {UNIVERSAL}, {JOINED} SELECT w, a, b FROM joined",
    "join_partitioned": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_partitioned_hash": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_partitioned_expanded": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_parts": f"""WITH {keyed('part', 'p_partkey', ['p_brand', 'p_type', 'p_size'])}, {JOINED} SELECT w, a, b FROM joined""",
    "join_customers": f"WITH {CUSTOMERS}, {JOINED} SELECT w, a, b FROM joined",
    "join_orders": f"WITH {ORDERS}, {JOINED} SELECT w, a, b FROM joined",
    "join_places": f"""WITH pairs AS (
  SELECT 0::BIGINT AS w, 'n' || n_nationkey AS doc, 'nationkey' AS attr, CAST(n_nationkey AS VARCHAR) AS val FROM nation
  UNION ALL SELECT 0, 'n' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT 0, 'n' || n_nationkey, 'regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 0, 's' || s_suppkey, 'nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 0, 's' || s_suppkey, 'supplier', s_name FROM supplier), {JOINED}
SELECT w, a, b FROM joined""",
    "join_turns": f"""WITH pairs AS (
  SELECT conv_id // 100 AS w, conv_id || '#' || turn AS doc, 'conv' AS attr, CAST(conv_id AS VARCHAR) AS val FROM conversations
  UNION ALL SELECT conv_id // 100, conv_id || '#' || turn, 'role', role FROM conversations), {JOINED}
SELECT w, a, b FROM joined""",
    "join_shared_counts": f"WITH {PAIRS}, {JOINED} SELECT w, a, b, n_shared FROM joined",
    "join_sets": f"""WITH {PAIRS}, {DOCS}, {JOINED}, {SYMMETRIC}
SELECT d.w, d.doc, coalesce({part('partner')}, 0) AS part, coalesce(string_agg(CAST(partner AS VARCHAR), ',' ORDER BY partner), '') AS partners
FROM docs d LEFT JOIN both_ways s ON s.w = d.w AND s.doc = d.doc GROUP BY d.w, d.doc, coalesce({part('partner')}, 0)""",
    "join_csv": f"""WITH {PAIRS}, {DOCS}, {JOINED}, {SYMMETRIC}
SELECT d.w, CAST(d.doc AS VARCHAR) AS "DocumentID",
  coalesce(string_agg(CAST(partner AS VARCHAR), ',' ORDER BY partner), 'None') AS "JoinableDocuments"
FROM docs d LEFT JOIN both_ways s ON s.w = d.w AND s.doc = d.doc GROUP BY d.w, d.doc""",
    "join_table": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "join_probe": f"""WITH {PAIRS}, {JOINED}, {SYMMETRIC}
SELECT w, doc, partner FROM both_ways""",
    "join_merged": f"""WITH {ORDERS}, {JOINED}
SELECT j.w, j.a, j.b, p.attr, p.val FROM joined j JOIN pairs p ON p.w = j.w AND (p.doc = j.a OR p.doc = j.b)
GROUP BY j.w, j.a, j.b, p.attr, p.val""",
    "set_ops": f"""WITH {PAIRS},
known AS (SELECT w, attr, val FROM pairs WHERE doc IN (SELECT doc FROM pairs WHERE attr = 'user')),
unknown AS (SELECT w, attr, val FROM pairs WHERE doc NOT IN (SELECT doc FROM pairs WHERE attr = 'user'))
SELECT *, 'union' AS op FROM (SELECT * FROM known UNION SELECT * FROM unknown)
UNION ALL SELECT *, 'both' FROM (SELECT * FROM known INTERSECT SELECT * FROM unknown)
UNION ALL SELECT *, 'first' FROM (SELECT * FROM known EXCEPT SELECT * FROM unknown)""",
    "stream_join": f"WITH {PAIRS.replace('pairs AS', 'base AS', 1)}, {DAY}, {JOINED} SELECT w, a, b FROM joined",
    "stream_join_index": f"WITH {PAIRS.replace('pairs AS', 'base AS', 1)}, {DAY}, {JOINED} SELECT w, a, b FROM joined",
    "stream_batches": f"WITH {PAIRS}, {JOINED} SELECT w, a, b FROM joined",
    "stream_partitioned": f"WITH {mixed(2500)}, {JOINED} SELECT w, a, b FROM joined",
    "repartition_plan": PLANS,
    "stream_plans": PLANS,
    "stream_routes": f"""WITH RECURSIVE {PLAN}
SELECT c.w, u.doc, u.pid FROM chain c JOIN under u ON u.i = c.base AND u.j = c.w""",
    "stream_late": f"""WITH {LATE}, {JOINED}
SELECT w, a, b, false AS late FROM joined WHERE a NOT IN (SELECT doc FROM late) AND b NOT IN (SELECT doc FROM late)
UNION ALL SELECT w, doc, doc, true FROM late""",
    "stream_json": f"""WITH {JSON_BASE}, pairs AS (SELECT doc // {WINDOW} AS w, doc, attr, val FROM json_pairs), {JOINED}
SELECT w, a, b FROM joined""",
    "join_hot": f"WITH {HOT} SELECT w, a, b FROM joined",
    "join_hot_index": f"WITH {HOT} SELECT w, a, b FROM joined",
    "join_hot_partitioned": f"WITH {HOT} SELECT w, a, b FROM joined",
    "join_hot_sets": f"""WITH {HOT}, {SYMMETRIC}
SELECT 0::BIGINT AS w, d.doc, coalesce({part('partner')}, 0) AS part, coalesce(string_agg(CAST(partner AS VARCHAR), ',' ORDER BY partner), '') AS partners
FROM hot d LEFT JOIN both_ways s ON s.doc = d.doc GROUP BY d.doc, coalesce({part('partner')}, 0)""",
}
