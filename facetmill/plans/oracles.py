"""SQL of the registered queries, for DuckDB on the same tables.  Maximal itemsets come from GROUP BY CUBE."""

from __future__ import annotations

SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) <= 5 THEN 'Spring' WHEN month({0}) <= 8 THEN 'Summer' ELSE 'Autumn' END"


def cube(source: str, columns: list[str], support: float = 0.1) -> str:
    """CTEs n, f (items, freq) and m (maximal) over a table t; a null cell is no item."""
    items = ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}___' || {c} END" for c in sorted(columns))
    return f"""
t AS ({source}),
n AS (SELECT count(*) AS n FROM t),
f AS (SELECT items, freq FROM (SELECT list_sort(list_filter([{items}], lambda x: x IS NOT NULL)) AS items, count(*) AS freq, {" + ".join(f"(grouping({c}) = 0 AND {c} IS NULL)::INT" for c in columns)} AS no_item
        FROM t GROUP BY CUBE({", ".join(columns)}))
      WHERE freq >= ceil({support}::DOUBLE * (SELECT n FROM n)) AND len(items) > 0 AND no_item = 0),
m AS (SELECT items, freq, freq / (SELECT n FROM n)::DOUBLE AS support FROM f a
      WHERE NOT EXISTS (SELECT 1 FROM f b WHERE len(b.items) > len(a.items) AND list_has_all(b.items, a.items)))"""


ORDERS = cube(f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders", ["o_orderdate", "o_orderpriority", "o_orderstatus"], 0.06)
def mined(source: str, columns: list[str], support: float, gamma: float, k: str | None = None) -> str:
    """CTEs of one table with a row_id: r (ranked itemsets, equal weights, k of them), ms (their rows), c (their cells), pr (pairs)."""
    items = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}___' || {c} END" for c in sorted(columns))
    return f"""{cube(source, columns, support)},
s AS (SELECT *, {gamma} * support + (1 - {gamma}::DOUBLE) * (len(items) / ({k or len(columns)})::DOUBLE) AS score FROM m),
r AS (SELECT (row_number() OVER (ORDER BY round(score, 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, items, freq, support, score FROM s),
x AS (SELECT row_id, list_filter([{items}], lambda y: y IS NOT NULL) AS items FROM t),
ms AS (SELECT r.itemset_id, x.row_id FROM r JOIN x ON list_has_all(x.items, r.items)),
c AS (SELECT itemset_id, split_part(i, '___', 1) AS col, substr(i, strpos(i, '___') + 3) AS val FROM (SELECT itemset_id, unnest(items) AS i FROM r)),
cols AS (SELECT itemset_id, list(DISTINCT col) AS cols FROM c GROUP BY itemset_id),
o AS (SELECT a.itemset_id AS i, b.itemset_id AS j, count(*) AS nij FROM ms a JOIN ms b ON a.row_id = b.row_id GROUP BY 1, 2),
pr AS (SELECT a.itemset_id AS i, b.itemset_id AS j, coalesce(o.nij, 0) AS nij, a.freq AS ni, b.freq AS nj, a.items AS ia, b.items AS ib,
              len(list_intersect(ca.cols, cb.cols))::DOUBLE / len(list_distinct(list_concat(ca.cols, cb.cols))) AS col_similarity,
              coalesce(o.nij, 0)::DOUBLE / (a.freq + b.freq - coalesce(o.nij, 0)) AS row_similarity,
              len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(ca.cols, cb.cols))) AS pair_similarity
       FROM r a JOIN r b ON a.itemset_id <> b.itemset_id JOIN cols ca ON ca.itemset_id = a.itemset_id JOIN cols cb ON cb.itemset_id = b.itemset_id
       LEFT JOIN o ON o.i = a.itemset_id AND o.j = b.itemset_id)"""


#: What describes clusters g (itemset_id, cluster).
GROUPS = """gs AS (SELECT cluster, count(*) AS size FROM g GROUP BY cluster),
gr AS (SELECT DISTINCT cluster, row_id FROM ms JOIN g USING (itemset_id)),
gc AS (SELECT cluster, col, val, itemset_id FROM c JOIN g USING (itemset_id)),
cc AS (SELECT cluster, col FROM gc JOIN gs USING (cluster) GROUP BY cluster, col, size HAVING count(DISTINCT itemset_id) = size)"""
FIXED = """g AS (SELECT itemset_id, (CASE WHEN array_to_string(items, '|') LIKE '%o_orderpriority%' THEN 2 ELSE 0 END + itemset_id % 2)::INT AS cluster FROM r)"""
#: Average linkage, a merge a step: assign has the cluster of each itemset; ties merge the smallest names first.  g: cut at a similarity of 0.4.
LINKED = """pd AS (SELECT list({'i': i, 'j': j, 'd': 1 - (col_similarity + row_similarity) / 2}) AS pairs FROM pr WHERE i < j),
ln AS (SELECT 0 AS step, (SELECT list(itemset_id ORDER BY itemset_id) FROM r) AS assign, 0 AS l, 0 AS r, 0.0::DOUBLE AS d, 0::BIGINT AS size
       UNION ALL
       SELECT step, list_transform(assign, lambda x: CASE WHEN x = b THEN a ELSE x END), a, b, d, len(list_filter(assign, lambda x: x = a OR x = b))
       FROM (SELECT * FROM (SELECT step + 1 AS step, assign, least(assign[p.i + 1], assign[p.j + 1]) AS a, greatest(assign[p.i + 1], assign[p.j + 1]) AS b, avg(p.d) AS d
             FROM (SELECT step, assign, unnest(pairs) AS p FROM ln, pd) WHERE assign[p.i + 1] <> assign[p.j + 1] GROUP BY ALL)
             QUALIFY row_number() OVER (ORDER BY round(d, 11), a, b) = 1)),
ct AS (SELECT assign FROM ln WHERE step = 0 OR d <= 0.6 + 1e-12 ORDER BY step DESC LIMIT 1),
g AS (SELECT unnest(range(len(assign)))::INT AS itemset_id, unnest(assign)::INT AS cluster FROM ct)"""
#: Constant columns over all clusters, and the clusters that have another common column, in order.
KEPT = """kc AS (SELECT col, min(val) AS val FROM gc GROUP BY col HAVING count(DISTINCT val) = 1 AND count(DISTINCT cluster) = (SELECT count(DISTINCT cluster) FROM g)),
co AS (SELECT cluster, col FROM cc WHERE col NOT IN (SELECT col FROM kc)),
kp AS (SELECT cluster, size, (row_number() OVER (ORDER BY size DESC, cluster) - 1)::INT AS position FROM gs WHERE cluster IN (SELECT cluster FROM co))"""
RANKED = f"""{mined(f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders", ["o_orderdate", "o_orderpriority", "o_orderstatus"], 0.06, 0.5)},
{FIXED},
{GROUPS},
nr AS (SELECT i AS target, j AS itemset_id, 0.5 * pair_similarity + 0.5 * row_similarity AS score, nij, ni, nj FROM pr),
nk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 12) DESC, itemset_id)::INT AS rank FROM nr),
k AS (SELECT count(*)::INT AS k FROM r),
rk AS (SELECT 'r' || r_regionkey AS session, CASE WHEN r_regionkey = 3 THEN w[1:k - 1] WHEN r_regionkey = 4 THEN list_concat(w[1:k - 1], w[1:1]) ELSE w END AS ranking
       FROM (SELECT r_regionkey, k, list_transform(range(k), lambda i: ((i + r_regionkey) % k)::INT) AS w FROM region, k)),
cv AS (SELECT cluster, col, val, count(*) AS n FROM gc GROUP BY 1, 2, 3),
gn AS (SELECT cluster, count(*) AS rows FROM gr GROUP BY 1),
cq AS (SELECT a.cluster AS target, b.cluster AS cluster, (SELECT count(*) FROM gr x JOIN gr y USING (row_id) WHERE x.cluster = a.cluster AND y.cluster = b.cluster) AS overlap, a.rows AS target_rows, b.rows AS rows,
              (SELECT count(DISTINCT col) FROM cv WHERE cluster IN (a.cluster, b.cluster)) AS columns FROM gn a JOIN gn b ON a.cluster <> b.cluster),
cs AS (SELECT target, cluster, col, CASE WHEN count(*) = 1 THEN least(max(m), max(n))::DOUBLE / greatest(max(m), max(n)) ELSE sum(m * n)::DOUBLE / sqrt(sum(m * m)::DOUBLE * sum(n * n)) END AS alike
       FROM (SELECT q.target, q.cluster, col, coalesce(sum(n) FILTER (WHERE cv.cluster = q.target), 0) AS m, coalesce(sum(n) FILTER (WHERE cv.cluster = q.cluster), 0) AS n FROM cq q JOIN cv ON cv.cluster IN (q.target, q.cluster) GROUP BY q.target, q.cluster, col, val)
       GROUP BY ALL HAVING max(m) > 0 AND max(n) > 0),
cr AS (SELECT q.*, coalesce((SELECT sum(alike) FROM cs WHERE cs.target = q.target AND cs.cluster = q.cluster), 0) / columns AS col_similarity, overlap::DOUBLE / (target_rows + rows - overlap) AS row_similarity FROM cq q),
ck AS (SELECT *, 0.5 * col_similarity + 0.5 * row_similarity AS score, row_number() OVER (PARTITION BY target ORDER BY round(0.5 * col_similarity + 0.5 * row_similarity, 12) DESC, cluster)::INT AS rank FROM cr),
vr AS (SELECT session, ranking FROM rk, k WHERE len(ranking) = k AND len(list_distinct(ranking)) = k)"""
DETAIL = "string_agg(col || ':' || val, '|' ORDER BY col)"


def clustered(source: str, columns: list[str], support: float, gamma: float, sql: str, k: str | None = None) -> str:
    return f"WITH RECURSIVE {mined(source, columns, support, gamma, k)}, {LINKED}, {GROUPS}, {KEPT} {sql}"


def prepared(table: str, row_id: str, columns: dict[str, str]) -> tuple[str, str]:
    """The table as analysis prepares it (constant and all-unique columns are null, more than 200 values become seasons or the top ten), and how many columns stay.

    columns: name -> text, float or date.
    """
    cells, stay = [], []
    for c, kind in columns.items():
        raw = f"round_even({c}, 0)::BIGINT" if kind == "float" else c
        text, n = f"({raw})::VARCHAR", f"(SELECT count(DISTINCT {raw}) FROM {table})"
        gone = f"(SELECT count(DISTINCT {raw}) + max(({raw} IS NULL)::INT) IN (1, count(*)) FROM {table})"
        top = f"CASE WHEN {text} IN (SELECT v FROM (SELECT {text} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) THEN {text} WHEN {c} IS NOT NULL THEN 'others' END"
        cells.append(f"CASE WHEN {gone} THEN NULL WHEN {n} > 200 THEN {SEASON.format(c) if kind == 'date' else top} ELSE {text} END AS {c}")
        stay.append(f"(NOT {gone})::INT")
    return f"SELECT {row_id} AS row_id, {', '.join(cells)} FROM {table}", " + ".join(stay)


def analysed(table: str, row_id: str, columns: dict[str, str]) -> str:
    source, k = prepared(table, row_id, columns)
    shown = f"SELECT '{table}' AS table_name, 'CLUSTER_' || position AS name, size::INT AS size, {COVERED} AS row_coverage, round(100 * ({COVERED}::DOUBLE / (SELECT count(DISTINCT row_id) FROM ms)), 6) AS row_coverage_percent, (SELECT round(avg(support), 6) FROM r JOIN g USING (itemset_id) WHERE g.cluster = kp.cluster) AS avg_support FROM kp"
    return f"SELECT * FROM ({clustered(source, list(columns), 0.1, 0.5, shown, k)})"


def clustered_orders(sql: str) -> str:
    return clustered(f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders", ["o_orderdate", "o_orderpriority", "o_orderstatus"], 0.06, 0.5, sql)


COVERED = "(SELECT count(*) FROM gr WHERE gr.cluster = kp.cluster)"
SHOWN_CLUSTERS = f"""SELECT position, size::INT AS size, (SELECT string_agg(itemset_id::VARCHAR, '|' ORDER BY itemset_id) FROM g WHERE g.cluster = kp.cluster) AS itemset_indices, (SELECT string_agg(col, '|' ORDER BY col) FROM co WHERE co.cluster = kp.cluster) AS common_columns,
        (SELECT string_agg(DISTINCT col, '|' ORDER BY col) FROM gc WHERE gc.cluster = kp.cluster) AS all_columns, {COVERED} AS row_coverage, round({COVERED}::DOUBLE / (SELECT count(DISTINCT row_id) FROM ms), 6) AS row_coverage_percent,
        (SELECT round(avg(support), 6) FROM r JOIN g USING (itemset_id) WHERE g.cluster = kp.cluster) AS avg_support FROM kp"""
CLUSTER_REPORT = f"""SELECT 'CLUSTER_' || position AS name, kp.size::INT AS size, {COVERED} AS row_coverage, round(100 * ({COVERED}::DOUBLE / (SELECT count(DISTINCT row_id) FROM ms)), 6) AS row_coverage_percent,
        (SELECT round(avg(support), 6) FROM r JOIN g h USING (itemset_id) WHERE h.cluster = kp.cluster) AS avg_support, (SELECT string_agg(col, '|' ORDER BY col) FROM co WHERE co.cluster = kp.cluster) AS common_columns,
        g.itemset_id, (SELECT '{{' || string_agg('"' || col || '":"' || val || '"', ',' ORDER BY col) || '}}' FROM c WHERE c.itemset_id = g.itemset_id AND col NOT IN (SELECT col FROM kc)) AS details, r.freq AS matching_rows_count, round(r.support, 6) AS support,
        round(100.0 * r.freq::DOUBLE / {COVERED}, 6) AS matching_rows_percent, (SELECT string_agg(row_id::VARCHAR, '|' ORDER BY row_id::VARCHAR) FROM (SELECT row_id FROM ms WHERE ms.itemset_id = g.itemset_id ORDER BY row_id LIMIT 5)) AS example_rows,
        coalesce((SELECT string_agg(col || ':' || val, '|' ORDER BY col) FROM kc), '') AS constant_columns
        FROM kp JOIN g ON g.cluster = kp.cluster JOIN r USING (itemset_id)"""


def over_orders(sql: str) -> str:
    return f"WITH {RANKED} {sql}"


LINEITEM = cube(
    f"SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, {SEASON.format('l_shipdate')} AS season, dayname(l_shipdate) AS weekday FROM lineitem",
    ["l_linenumber", "l_linestatus", "l_returnflag", "season", "weekday"],
)
FOUR = cube(
    """SELECT c_mktsegment, o_orderstatus, o_orderpriority, l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, p_type, quarter(l_shipdate)::VARCHAR AS quarter, dayname(o_orderdate) AS weekday
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    ["c_mktsegment", "l_linenumber", "l_linestatus", "l_returnflag", "o_orderpriority", "o_orderstatus", "p_type", "quarter", "weekday"],
)
FINAL = cube(f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders WHERE o_orderstatus = 'F'", ["o_orderdate", "o_orderpriority", "o_orderstatus"], 0.05)
ROUNDED = {c: f"round_even({c}, 0)::BIGINT" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
EVENT_COLUMNS = ["ts", "user_id", "event_type", "value", "props"]
SHOWN = "array_to_string(items, '|') AS items"
VALUES = "SELECT '{0}' AS col, {0}::VARCHAR AS val, count(*) AS count FROM {1} GROUP BY 2"


def profile(table: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, number in columns.items():
        mean = f"round(avg({c}), 6), round(stddev_samp({c}), 6)" if number else "NULL::DOUBLE, NULL::DOUBLE"
        top = f"(SELECT string_agg(val || ':' || n, '|' ORDER BY n DESC, val) FROM (SELECT {c}::VARCHAR AS val, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, val LIMIT 5))"
        parts.append(f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), min({c})::VARCHAR, max({c})::VARCHAR, {mean}, {top} FROM {table}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") q(col, n_rows, n_nulls, n_distinct, min_value, max_value, mean, stddev, top_values)"


def distribution(table: str, columns: dict[str, tuple[str, bool]]) -> str:
    """columns: name -> (text form as Spark writes it, whether it is a number)."""
    parts = []
    for c, (said, number) in columns.items():
        bins = f"(SELECT string_agg(n::VARCHAR, '|' ORDER BY b) FROM (SELECT b, (SELECT count(*) FROM {table}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {table}) WHERE least(floor(({c}::DOUBLE - lo) * 10 / (hi - lo)), 9) = b) AS n FROM range(10) q(b)))" if number else "NULL"
        top = f"(SELECT string_agg(val || ':' || n, '|' ORDER BY n DESC, val) FROM (SELECT {said} AS val, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, val LIMIT 5))"
        parts.append(f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), {bins}, {top} FROM {table}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") q(col, n_rows, n_nulls, n_distinct, histogram, top_values)"


def cut(c: str) -> str:
    return f"CASE WHEN length(coalesce({c}::VARCHAR, 'None')) > 50 THEN substr({c}::VARCHAR, 1, 47) || '...' ELSE coalesce({c}::VARCHAR, 'None') END AS {c}"


CUSTKEYS = cube(
    f"""SELECT o_orderstatus, {SEASON.format('o_orderdate')} AS o_orderdate, CASE WHEN k IS NULL THEN NULL WHEN (SELECT count(DISTINCT o_custkey) FROM orders) <= 200 OR k IN (SELECT o_custkey::VARCHAR FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1
        ORDER BY count(*) DESC, o_custkey::VARCHAR LIMIT 10) THEN k ELSE 'others' END AS o_custkey FROM (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey::VARCHAR END AS k FROM orders)""",
    ["o_custkey", "o_orderdate", "o_orderstatus"],
)
REPORT = over_orders("""SELECT 'CLUSTER_' || g.cluster AS name, gs.size::INT AS size, gn.rows AS row_coverage, round(100 * (gn.rows::DOUBLE / (SELECT count(DISTINCT row_id) FROM ms)), 6) AS row_coverage_percent,
        (SELECT round(avg(support), 6) FROM r JOIN g h USING (itemset_id) WHERE h.cluster = g.cluster) AS avg_support, coalesce((SELECT string_agg(col, '|' ORDER BY col) FROM cc WHERE cc.cluster = g.cluster), '') AS common_columns,
        g.itemset_id, (SELECT '{' || string_agg('"' || col || '":"' || val || '"', ',' ORDER BY col) || '}' FROM c WHERE c.itemset_id = g.itemset_id) AS details, r.freq AS matching_rows_count, round(r.support, 6) AS support,
        round(100.0 * r.freq::DOUBLE / gn.rows, 6) AS matching_rows_percent, (SELECT string_agg(row_id::VARCHAR, '|' ORDER BY row_id::VARCHAR) FROM (SELECT row_id FROM ms WHERE ms.itemset_id = g.itemset_id ORDER BY row_id LIMIT 5)) AS example_rows
        FROM g JOIN r USING (itemset_id) JOIN gs ON gs.cluster = g.cluster JOIN gn ON gn.cluster = g.cluster""")


def steps(source: str, itemsets: str) -> str:
    """CTEs of learning: the places of each valid session (source: session, ranking), its pairs in order, and `learnt`, the weights and gamma after each step.

    settings(lr_w, lr_g, start, in_a_row) must exist; in a row: all sessions are one, by name.
    """
    w = ["wd", "wp", "ws"]  # date, priority, status
    total = " + ".join(f"abs({x})" for x in w)
    own = lambda side: "(" + " + ".join(f"CASE WHEN {side}_{x} THEN {x} ELSE 0 END" for x in w) + ")"
    moved = ", ".join(f"{x} - lr_w * (1 - gamma) / total * slope * ((a_{x})::INT - (b_{x})::INT) AS {x}" for x in w)
    has = ", ".join(f"array_to_string({t}.items, '|') LIKE '%o_order{c}%' AS {s}_{x}" for t, s in (("ra", "a"), ("rb", "b")) for x, c in zip(w, ("date", "priority", "status")))
    return f"""
pl AS (SELECT session, unnest(ranking) AS i, unnest(range(len(ranking))) AS place FROM {source}),
sp AS (SELECT x.session, row_number() OVER (PARTITION BY CASE WHEN (SELECT any_value(in_a_row) FROM settings) THEN '' ELSE x.session END ORDER BY x.session, x.place, y.place) AS step, ra.support AS sa, rb.support AS sb, {has}
       FROM pl x JOIN pl y ON x.session = y.session AND x.place < y.place JOIN {itemsets} ra ON ra.itemset_id = x.i JOIN {itemsets} rb ON rb.itemset_id = y.i),
learnt AS (SELECT CASE WHEN in_a_row THEN '' ELSE session END AS session, lr_w, lr_g, in_a_row, 0::BIGINT AS step, start AS gamma, 1.0::DOUBLE / 3 AS wd, 1.0::DOUBLE / 3 AS wp, 1.0::DOUBLE / 3 AS ws FROM settings, (SELECT DISTINCT session FROM pl) GROUP BY ALL
      UNION ALL
      SELECT session, lr_w, lr_g, in_a_row, step, least(1.0, greatest(0.0, gamma - lr_g * slope * ((sa - ca) - (sb - cb)))), {moved}
      FROM (SELECT *, -1 / (1 + exp(least(700.0, gamma * (sa - sb) + (1 - gamma) * (ca - cb)))) AS slope
            FROM (SELECT l.session, lr_w, lr_g, in_a_row, sp.step, sa, sb, gamma, wd, wp, ws, {total} AS total, {own('a')} / ({total}) AS ca, {own('b')} / ({total}) AS cb, {", ".join(f"{s}_{x}" for s in "ab" for x in w)}
                  FROM learnt l JOIN sp ON sp.step = l.step + 1 AND (in_a_row OR sp.session = l.session)))),
last AS (SELECT * FROM learnt QUALIFY row_number() OVER (PARTITION BY session, lr_w, lr_g ORDER BY step DESC) = 1)"""


def learning(settings: str, source: str = "vr") -> str:
    return f"WITH RECURSIVE settings AS ({settings}), {RANKED}, {steps(source, 'r')}"


ONE_SETTING = "SELECT 0.12::DOUBLE AS lr_w, 0.8::DOUBLE AS lr_g, {}::DOUBLE AS start, {} AS in_a_row"
OWN_WEIGHT = "CASE WHEN array_to_string(items, '|') LIKE '%o_orderdate%' THEN wd ELSE 0 END + CASE WHEN array_to_string(items, '|') LIKE '%o_orderpriority%' THEN wp ELSE 0 END + CASE WHEN array_to_string(items, '|') LIKE '%o_orderstatus%' THEN ws ELSE 0 END"
# training mines at a support of 0.1 and ranks at gamma 0.7
TRAINED = f"""WITH RECURSIVE settings AS ({ONE_SETTING.format(0.7, 'true')}),
{cube(f"SELECT o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders", ["o_orderdate", "o_orderpriority", "o_orderstatus"], 0.1)},
r AS (SELECT (row_number() OVER (ORDER BY round(0.7 * support + (1 - 0.7::DOUBLE) * (len(items) / 3.0::DOUBLE), 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, items, freq, support FROM m),
k AS (SELECT count(*)::INT AS k FROM r),
vr AS (SELECT 'r' || r_regionkey AS session, list_transform(range(k), lambda i: ((i + r_regionkey) % k)::INT) AS ranking FROM region, k WHERE r_regionkey < 3),
{steps('vr', 'r')}"""
MANY_COLUMNS = ["o_orderpriority", "o_orderstatus", "season", "weekday", "year"]
MANY = cube(f"SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, {SEASON.format('o_orderdate')} AS season, dayname(o_orderdate) AS weekday, year(o_orderdate)::VARCHAR AS year FROM orders", MANY_COLUMNS, 0.005)


SQL = {
    "value_counts_orders": VALUES.format("o_orderstatus", "orders") + " UNION ALL " + VALUES.format("o_orderpriority", "orders"),
    "column_profile_customer": profile("customer", {"c_custkey": True, "c_nationkey": True, "c_mktsegment": False}),
    "column_distributions_lineitem": "WITH x AS (SELECT * REPLACE (nullif(l_linenumber, 7) AS l_linenumber) FROM lineitem) "
    + distribution("x", {c: (f"{c}::VARCHAR", c not in ("l_returnflag", "l_shipdate")) for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", "l_linenumber")}),
    "describe_part": "SELECT (row_number() OVER () - 1)::INT AS position, name, CASE type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(type) END AS type, false AS not_null, (SELECT count(*) FROM part) AS row_count FROM pragma_table_info('part')",
    "sample_rows_pages": f"SELECT {cut('page_id')}, {cut('url')}, {cut('html')} FROM (SELECT * FROM pages ORDER BY page_id LIMIT 10)",
    "round_floats_lineitem": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{x} AS {c}" for c, x in ROUNDED.items()) + " FROM lineitem",
    "constant_columns_lineitem": " UNION ALL ".join(f"SELECT '{c}' AS col FROM lineitem HAVING count(DISTINCT {ROUNDED.get(c, c)}) + max(({c} IS NULL)::INT) = 1" for c in LINEITEM_COLUMNS),
    "unique_columns_events": " UNION ALL ".join(f"SELECT '{c}' AS col FROM events HAVING count(DISTINCT {c}) + max(({c} IS NULL)::INT) = count(*)" for c in EVENT_COLUMNS),
    "prepare_lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity, 0)::BIGINT AS l_quantity, round_even(l_extendedprice, 0)::BIGINT AS l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
    "correlated_groups_orders": """WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, lower(o_orderstatus) AS status_copy, (o_orderstatus = 'F')::INT AS is_final, o_custkey * 2 AS twice_custkey FROM orders),
        v AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'status_copy', 'is_final']) AS col, unnest([o_orderstatus, o_orderpriority, status_copy, CASE WHEN is_final = 1 THEN 'high' END]) AS val FROM o),
        parts AS (SELECT col, val, list(o_orderkey ORDER BY o_orderkey) AS rows FROM v WHERE val IS NOT NULL GROUP BY 1, 2 HAVING count(*) < (SELECT count(*) FROM o)),
        num AS (SELECT corr(o_custkey, twice_custkey) AS a, corr(o_custkey, is_final) AS b, corr(twice_custkey, is_final) AS c FROM o),
        p AS (SELECT x.col AS a, y.col AS b FROM parts x JOIN parts y ON x.rows = y.rows AND x.col < y.col
              UNION SELECT 'o_custkey', 'twice_custkey' FROM num WHERE a >= 1 - 1e-12 UNION SELECT 'is_final', 'o_custkey' FROM num WHERE b >= 1 - 1e-12 UNION SELECT 'is_final', 'twice_custkey' FROM num WHERE c >= 1 - 1e-12),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y)
        SELECT DISTINCT columns FROM (SELECT x, string_agg(y, '|' ORDER BY y) AS columns FROM reach GROUP BY x)""",
    "drop_correlated_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, (o_orderstatus = 'F')::INT AS is_final, 'o_orderpriority' AS not_dropped FROM orders",
    "prepared_columns_lineitem": " UNION ALL ".join(f"SELECT '{c}' AS col FROM lineitem HAVING count(DISTINCT {ROUNDED.get(c, c)}) + max(({c} IS NULL)::INT) NOT IN (1, count(*))" for c in LINEITEM_COLUMNS),
    "datetime_columns_text_orders": "WITH x AS (SELECT strftime(o_orderdate, '%Y/%m/%d') AS slashes, strftime(o_orderdate, '%d-%m-%Y') AS day_first, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS half, o_orderpriority AS no_date, o_custkey::VARCHAR AS number FROM orders)"
    + " UNION ALL ".join(f" SELECT '{c}' AS col WHERE (SELECT greatest(" + ", ".join(f"avg((try_strptime({c}, '{f}') IS NOT NULL)::INT)" for f in ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S")) + ") FROM x) > 0.8" for c in ("slashes", "day_first", "half", "no_date", "number")),
    "datetime_columns_events": "SELECT name AS col FROM pragma_table_info('events') WHERE type LIKE 'TIMESTAMP%'",
    "bucket_time_of_day_events": "SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'Afternoon' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END AS ts FROM events",
    "bucket_day_of_week_orders": "SELECT o_orderkey, dayname(o_orderdate) AS o_orderdate FROM orders",
    "bucket_season_orders": f"SELECT o_orderkey, {SEASON.format('o_orderdate')} AS o_orderdate FROM orders",
    "bucket_year_orders": "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS o_orderdate FROM orders",
    "bucket_top10_part": "WITH k AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10) SELECT p_partkey, CASE WHEN p_name IN (FROM k) THEN p_name ELSE 'others' END AS p_name FROM part",
    "high_cardinality_events": "WITH e AS (SELECT * REPLACE (round(value * 100)::BIGINT AS value) FROM events) "
    + " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_unique, '{'datetime' if c == 'ts' else 'categorical'}' AS kind, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM e ORDER BY v LIMIT 5)) AS samples FROM e HAVING count(DISTINCT {c}) > 200" for c in EVENT_COLUMNS),
    "apply_buckets_events": f"""WITH k AS (SELECT user_id::VARCHAR AS u FROM events GROUP BY 1 ORDER BY count(*) DESC, u LIMIT 10)
        SELECT event_id, {SEASON.format('ts')} AS ts, CASE WHEN user_id::VARCHAR IN (FROM k) THEN user_id::VARCHAR ELSE 'others' END AS user_id, event_type FROM events""",
    "normalize_nulls_documents": "SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1) THEN NULL WHEN doc_id % 7 = 2 THEN 'Null' ELSE lang END AS lang, CASE WHEN doc_id % 3 > 0 THEN source END AS source, n_chars::VARCHAR AS n_chars FROM documents",
    "describe_columns_orders": """SELECT 'o_kind' AS col, 'constant with the value web' AS description
        UNION ALL SELECT 'o_orderstatus', 'categorical with ' || count(*) || ' values such as ' || string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)
        UNION ALL SELECT 'o_custkey', 'whole numbers from ' || min(o_custkey) || ' to ' || max(o_custkey) FROM orders
        UNION ALL SELECT 'o_orderdate', 'dates from ' || strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
        UNION ALL SELECT 'o_totalprice', 'numbers from ' || printf('%.2f', min(o_totalprice)) || ' to ' || printf('%.2f', max(o_totalprice)) FROM orders""",
    "zero_weight_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, 'o_custkey|o_orderstatus' AS weights FROM orders",
    "transactions_orders": over_orders(f"SELECT row_id, {SHOWN} FROM x"),
    "frequent_orders": over_orders(f"SELECT {SHOWN}, freq FROM f"),
    "frequent_fpgrowth_orders": over_orders(f"SELECT {SHOWN}, freq FROM f"),
    "maximal_orders": over_orders(f"SELECT {SHOWN}, freq, round(support, 6) AS support FROM m"),
    "maximal_lineitem": f"WITH {LINEITEM} SELECT {SHOWN}, freq, round(support, 6) AS support FROM m",
    "maximal_four_tables": f"WITH {FOUR} SELECT {SHOWN}, freq, round(support, 6) AS support FROM m",
    "scored_orders": over_orders(f"SELECT {SHOWN}, round(score, 6) AS score FROM s"),
    "ranked_orders": over_orders(f"SELECT itemset_id, {SHOWN}, freq, round(support, 6) AS support, round(score, 6) AS score, md5(array_to_string(list_sort(list_transform(items, lambda i: replace(i, '___', ':'))), '|')) AS unique_id FROM r"),
    "membership_orders": over_orders("SELECT itemset_id, row_id FROM ms"),
    "itemset_pairs_orders": over_orders("SELECT itemset_id, col, val FROM c"),
    "strip_common_orders": f"""WITH {FINAL},
        r AS (SELECT (row_number() OVER (ORDER BY round(0.5 * support + 0.5 * (len(items) / 3.0::DOUBLE), 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, items FROM m),
        c AS (SELECT itemset_id, split_part(i, '___', 1) AS col, substr(i, strpos(i, '___') + 3) AS val FROM (SELECT itemset_id, unnest(items) AS i FROM r)),
        w AS (SELECT col FROM c GROUP BY col, val HAVING count(DISTINCT itemset_id) = (SELECT count(*) FROM r))
        SELECT r.itemset_id, coalesce({DETAIL}, '') AS details FROM r LEFT JOIN (SELECT * FROM c WHERE col NOT IN (FROM w)) c USING (itemset_id) GROUP BY r.itemset_id""",
    "patterns_orders": over_orders("""SELECT pattern, count(*) AS n_itemsets, CASE count(*) WHEN 1 THEN 'very interesting' WHEN 2 THEN 'mildly interesting' ELSE 'uninteresting' END AS level, string_agg(itemset_id::VARCHAR, '|' ORDER BY itemset_id) AS itemset_ids
        FROM (SELECT itemset_id, string_agg(col, '|' ORDER BY col) AS pattern FROM c WHERE (col, val) NOT IN (SELECT (col, val) FROM c GROUP BY col, val HAVING count(*) = (SELECT k FROM k)) GROUP BY itemset_id) GROUP BY pattern"""),
    "unassigned_orders": over_orders("SELECT row_id FROM t WHERE row_id NOT IN (SELECT row_id FROM ms WHERE itemset_id < 1)"),
    "rank_listing_orders": over_orders(f"""SELECT itemset_id, string_agg(col, '|' ORDER BY col) AS pattern, {DETAIL} AS details, (SELECT count(*) FROM ms WHERE ms.itemset_id = c.itemset_id) AS n_rows,
        (SELECT string_agg(row_id::VARCHAR, '|' ORDER BY row_id) FROM (SELECT row_id FROM ms WHERE ms.itemset_id = c.itemset_id ORDER BY row_id LIMIT 5)) AS example_rows FROM c GROUP BY itemset_id"""),
    "pairwise_orders": over_orders("SELECT i, j, round(col_similarity, 6) AS col_similarity, round(row_similarity, 6) AS row_similarity, round((col_similarity + row_similarity) / 2, 6) AS similarity, round(1 - (col_similarity + row_similarity) / 2, 6) AS distance FROM pr WHERE i < j"),
    "similarity_matrix_orders": over_orders("SELECT i, j, round((col_similarity + row_similarity) / 2, 6) AS similarity FROM pr UNION ALL SELECT itemset_id, itemset_id, 1.0 FROM r"),
    "linkage_orders": clustered_orders("SELECT (step - 1)::INT AS step, l::INT AS left, r::INT AS right, round(d, 6) AS distance, size::INT AS size FROM ln WHERE step > 0"),
    "cut_clusters_orders": clustered_orders("SELECT itemset_id, cluster FROM g"),
    "clusters_orders": clustered_orders(SHOWN_CLUSTERS),
    "cluster_report_orders": clustered_orders(CLUSTER_REPORT),
    "cluster_graph_orders": clustered_orders("SELECT 'cluster_' || position AS source, 'itemset_' || itemset_id AS target, 1.0::DOUBLE AS weight FROM kp JOIN g USING (cluster)"),
    "cluster_graph_nodes_orders": clustered_orders(f"""SELECT 'cluster_' || position AS node, 'cluster' AS kind, size::INT AS size, {COVERED} AS row_coverage, NULL::DOUBLE AS support FROM kp
        UNION ALL SELECT 'itemset_' || itemset_id, 'itemset', NULL, NULL, round(support, 6) FROM r JOIN g USING (itemset_id) JOIN kp USING (cluster)"""),
    "cluster_hierarchy_orders": clustered_orders(f"""SELECT 'Root' AS label, '' AS parent, 100.0::DOUBLE AS value UNION ALL SELECT 'Cluster ' || position, 'Root', {COVERED} FROM kp
        UNION ALL SELECT 'Itemset ' || itemset_id, 'Cluster ' || position, freq FROM r JOIN g USING (itemset_id) JOIN kp USING (cluster)"""),
    "analyze_database_small": " UNION ALL ".join(
        analysed(t, key, columns)
        for t, key, columns in (
            ("orders", "o_orderkey", {"o_custkey": "text", "o_orderstatus": "text", "o_totalprice": "float", "o_orderdate": "date", "o_orderpriority": "text"}),
            ("part", "p_partkey", {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "text", "p_retailprice": "float"}),
            ("customer", "c_custkey", {"c_name": "text", "c_nationkey": "text", "c_acctbal": "float", "c_mktsegment": "text"}),
            ("labels", "doc_id", {"quality": "text", "toxic": "text"}),
        )
    ),
    "mine_and_cluster_customer": clustered("SELECT c_custkey AS row_id, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer", ["c_mktsegment", "c_nationkey"], 0.03, 0.7, SHOWN_CLUSTERS),
    "common_columns_orders": over_orders("SELECT cluster, col FROM cc"),
    "value_distributions_orders": over_orders("SELECT cluster, col, val, count(*) AS count FROM gc GROUP BY 1, 2, 3"),
    "constant_across_clusters_orders": f"""WITH {FINAL},
        r AS (SELECT (row_number() OVER (ORDER BY round(0.5 * support + 0.5 * (len(items) / 3.0::DOUBLE), 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, items FROM m),
        c AS (SELECT itemset_id % 3 AS cluster, split_part(i, '___', 1) AS col, substr(i, strpos(i, '___') + 3) AS val FROM (SELECT itemset_id, unnest(items) AS i FROM r))
        SELECT col, min(val) AS val FROM c GROUP BY col HAVING count(DISTINCT val) = 1 AND count(DISTINCT cluster) = (SELECT count(DISTINCT cluster) FROM c)""",
    "rank_maximal_orders": f"""WITH {CUSTKEYS},
        s AS (SELECT *, 0.5 * support + 0.5 * (len(items) / 3.0::DOUBLE) AS score FROM m)
        SELECT * FROM (SELECT (row_number() OVER (ORDER BY round(score, 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, {SHOWN}, freq, round(support, 6) AS support, round(score, 6) AS score,
            md5(array_to_string(list_sort(list_transform(items, lambda i: replace(i, '___', ':'))), '|')) AS unique_id FROM s) WHERE itemset_id < 10""",
    "fixed_report_orders": REPORT,
    "report_round_trip_orders": REPORT,
    "fixed_graph_orders": over_orders("SELECT 'cluster_' || cluster AS source, 'itemset_' || itemset_id AS target, 1.0::DOUBLE AS weight FROM g"),
    "fixed_graph_nodes_orders": over_orders("""SELECT 'cluster_' || cluster AS node, 'cluster' AS kind, gs.size::INT AS size, gn.rows AS row_coverage, NULL::DOUBLE AS support FROM gs JOIN gn USING (cluster)
        UNION ALL SELECT 'itemset_' || itemset_id, 'itemset', NULL, NULL, round(support, 6) FROM r"""),
    "fixed_hierarchy_orders": over_orders("""SELECT 'Root' AS label, '' AS parent, 100.0::DOUBLE AS value UNION ALL SELECT 'Cluster ' || cluster, 'Root', rows FROM gn
        UNION ALL SELECT 'Itemset ' || itemset_id, 'Cluster ' || cluster, freq FROM r JOIN g USING (itemset_id)"""),
    "similar_clusters_orders": over_orders("SELECT cluster, round(col_similarity, 6) AS col_similarity, round(row_similarity, 6) AS row_similarity, round(score, 6) AS score, rank FROM ck WHERE target = 0 AND rank <= 5"),
    "similar_clusters_overlap_orders": over_orders("""SELECT cluster, round(score, 6) AS score, rank, overlap, round(100.0 * overlap::DOUBLE / target_rows, 6) AS percent_of_target, round(100.0 * overlap::DOUBLE / rows, 6) AS percent_of_other, rows AS row_coverage,
        (SELECT '{' || string_agg('"' || col || '":[' || top || ']', ',' ORDER BY col) || '}' FROM (SELECT col, string_agg('"' || val || '"', ',' ORDER BY n DESC, val) AS top
            FROM (SELECT *, row_number() OVER (PARTITION BY cluster, col ORDER BY n DESC, val) AS place FROM cv JOIN cc USING (cluster, col)) v WHERE v.cluster = ck.cluster AND place <= 3 GROUP BY col)) AS top_values
        FROM ck WHERE target = 0 AND rank <= 5"""),
    "cluster_metadata_orders": over_orders("""SELECT cluster AS position, gs.size::INT AS size, (SELECT string_agg(itemset_id::VARCHAR, '|' ORDER BY itemset_id) FROM g WHERE g.cluster = gs.cluster) AS itemset_indices,
        coalesce((SELECT string_agg(col, '|' ORDER BY col) FROM cc WHERE cc.cluster = gs.cluster), '') AS common_columns, (SELECT string_agg(DISTINCT col, '|' ORDER BY col) FROM gc WHERE gc.cluster = gs.cluster) AS all_columns,
        (SELECT count(*) FROM gr WHERE gr.cluster = gs.cluster) AS row_coverage, round((SELECT count(*) FROM gr WHERE gr.cluster = gs.cluster)::DOUBLE / (SELECT count(DISTINCT row_id) FROM ms), 6) AS row_coverage_percent,
        (SELECT round(avg(support), 6) FROM r JOIN g USING (itemset_id) WHERE g.cluster = gs.cluster) AS avg_support FROM gs"""),
    "cluster_overlap_orders": over_orders("""SELECT a.cluster AS i, b.cluster AS j, round(coalesce(n, 0)::DOUBLE / (a.rows + b.rows - coalesce(n, 0)), 6) AS jaccard FROM gn a CROSS JOIN gn b
        LEFT JOIN (SELECT x.cluster AS ca, y.cluster AS cb, count(*) AS n FROM gr x JOIN gr y USING (row_id) GROUP BY 1, 2) q ON ca = a.cluster AND cb = b.cluster"""),
    "similar_itemsets_orders": over_orders(f"SELECT nk.itemset_id, round(score, 6) AS score, (SELECT {DETAIL} FROM c WHERE c.itemset_id = nk.itemset_id) AS details, nj AS n_rows, rank FROM nk WHERE target = 0 AND rank <= 10"),
    "similar_itemsets_overlap_orders": over_orders("SELECT itemset_id, round(score, 6) AS score, nj AS n_rows, rank, nij AS overlap, round(100.0 * nij::DOUBLE / ni, 6) AS percent_of_target, round(100.0 * nij::DOUBLE / nj, 6) AS percent_of_other FROM nk WHERE target = 0 AND rank <= 10"),
    "all_similar_itemsets_orders": over_orders("SELECT target, itemset_id, round(score, 6) AS score, rank FROM nk WHERE rank <= 3"),
    "valid_rankings_orders": over_orders("SELECT session, array_to_string(ranking, '|') AS ranking FROM vr"),
    "preference_pairs_orders": over_orders("""SELECT session, (row_number() OVER (PARTITION BY session ORDER BY pa, pb) - 1)::INT AS step, a, b, round(ra.support, 6) AS supp_a, round(rb.support, 6) AS supp_b
        FROM (SELECT session, unnest(ranking) AS a, unnest(range(len(ranking))) AS pa FROM vr) JOIN (SELECT session, unnest(ranking) AS b, unnest(range(len(ranking))) AS pb FROM vr) USING (session)
        JOIN r ra ON ra.itemset_id = a JOIN r rb ON rb.itemset_id = b WHERE pa < pb"""),
    "membership_many_orders": f"""WITH {MANY},
        r AS (SELECT (row_number() OVER (ORDER BY round(0.5 * support + 0.5 * (len(items) * 0.2::DOUBLE), 9) DESC, array_to_string(items, '|')) - 1)::INT AS itemset_id, items FROM m),
        x AS (SELECT row_id, [{", ".join(f"'{c}___' || {c}" for c in MANY_COLUMNS)}] AS items FROM t)
        SELECT r.itemset_id, x.row_id FROM r JOIN x ON list_has_all(x.items, r.items)""",
    "maximal_copies_orders": over_orders("""SELECT array_to_string(list_sort(flatten(list_transform(items, lambda x: CASE WHEN x LIKE 'o_orderstatus%' THEN list_transform(range(12), lambda i: 'status' || lpad(i::VARCHAR, 2, '0') || substr(x, 14)) ELSE [x] END))), '|') AS items,
        freq, round(support, 6) AS support FROM m"""),
    "update_weights_orders": learning(ONE_SETTING.format(0.5, "false")) + " SELECT session, round(gamma, 6) AS gamma, round(wd, 6) AS o_orderdate, round(wp, 6) AS o_orderpriority, round(ws, 6) AS o_orderstatus FROM last",
    "learning_rate_grid_orders": learning("SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS lr_w, g AS lr_g, 0.7::DOUBLE AS start, false AS in_a_row FROM (SELECT unnest([0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS g)", "(SELECT * FROM vr WHERE session = 'r1')")
    + f""", gs2 AS (SELECT l.*, r.itemset_id, row_number() OVER (PARTITION BY lr_w, lr_g ORDER BY round(gamma * support + (1 - gamma) * (({OWN_WEIGHT}) / (abs(wd) + abs(wp) + abs(ws))), 9) DESC, array_to_string(items, '|')) - 1 AS place FROM last l, r)
        SELECT 'r1' AS session, lr_w AS lr_weights, lr_g AS lr_gamma, round((abs(any_value(wd) - 1.0::DOUBLE / 3) + abs(any_value(wp) - 1.0::DOUBLE / 3) + abs(any_value(ws) - 1.0::DOUBLE / 3)) / 3, 6) AS mean_weight_change,
        round(abs(any_value(gamma) - 0.7), 6) AS gamma_change, round(any_value(gamma), 6) AS gamma, sum(abs(gs2.place - pl.place))::BIGINT AS rank_distance, sum(abs(itemset_id - pl.place))::BIGINT AS rank_distance_ref FROM gs2 JOIN pl ON pl.i = gs2.itemset_id GROUP BY lr_w, lr_g""",
    "train_orders": TRAINED + f""" SELECT (row_number() OVER (ORDER BY round(score, 9) DESC, items) - 1)::INT AS itemset_id, items, freq, round(support, 6) AS support, round(score, 6) AS score
        FROM (SELECT array_to_string(items, '|') AS items, freq, support, gamma * support + (1 - gamma) * (({OWN_WEIGHT}) / (abs(wd) + abs(wp) + abs(ws))) AS score FROM r, last)""",
    "train_save_load_orders": TRAINED + """ SELECT 'orders' AS table_name, unnest(['o_orderdate', 'o_orderpriority', 'o_orderstatus']) AS col, unnest([round(wd, 6), round(wp, 6), round(ws, 6)]) AS weight, round(gamma, 6) AS gamma, 0.1::DOUBLE AS min_support, -1::INT AS max_collection FROM last
        UNION ALL SELECT 'customer', 'c_mktsegment', 0.25, 0.6, 0.2, 3""",
    "config_two_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS col, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS weight FROM {t}" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("customer", "c_nationkey"), ("part", "p_brand"), ("part", "p_type"))),
    "report_two_tables": f"SELECT q.*, table_name FROM ({REPORT}) q, (SELECT unnest(['orders', 'again']) AS table_name) WHERE table_name = 'orders' OR name = 'CLUSTER_0'",
    "list_tables_small": "SELECT name, kind, count_if(kind = 'table') OVER ()::INT AS n_tables, count_if(kind = 'view') OVER ()::INT AS n_views, n_rows FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, 'table' AS kind, (SELECT count(*) FROM {t}) AS n_rows" for t in ("region", "nation", "orders", "events")) + " UNION ALL SELECT unnest(['final_orders', 'places']), 'view', NULL)",
    "config_round_trip_orders": "SELECT name AS col, CASE name WHEN 'o_orderstatus' THEN 0.5 ELSE 1.0::DOUBLE / (SELECT count(*) FROM pragma_table_info('orders')) END AS weight, (SELECT count(*) FROM orders) AS n_rows FROM pragma_table_info('orders')",
}
