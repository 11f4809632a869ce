"""What many itemsets, dense tables, several tables and large profiles need: each against plain Python."""

import collections
import itertools
import math
import random
import threading
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetmill.functions import incidence
from facetmill.operators import clusters as C
from facetmill.operators import itemsets as I
from facetmill.operators import learn as L
from facetmill.operators import prepare as P
from facetmill.operators import search as Q
from facetmill.plans.workflows import analyze_database, mine_and_cluster, side_by_side
from facetmill.sources import tables as S
from facetmill.sources.work import materialize

from .test_workflows import learnt, mined, rows_of


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_rows(n, columns, values, seed):
    r = random.Random(seed)
    return [(i, *[r.choice(values) if r.random() < 0.9 else None for _ in range(columns)]) for i in range(n)]


@pytest.fixture(scope="module")
def many(spark):
    rows = random_rows(3_000, 12, "abcdefgh", 1)
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"c{j} string" for j in range(12)))
    r = random.Random(2)
    sets = set()
    while len(sets) < 3_000:
        sets.add(tuple(sorted(f"c{j}___{r.choice('abcdefgh')}" for j in r.sample(range(12), r.choice([1, 2, 2, 3])))))
    sets = sorted(sets)
    r.shuffle(sets)
    return rows, I.to_transactions(df, "id"), sets, spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "itemset_id int, items array<string>")


def test_rows_of_many_itemsets(many):
    rows, tx, sets, itemsets = many
    found = I.matches(tx, itemsets)
    assert "c0___a" not in plan_of(found) and "Exchange" not in plan_of(found)
    held = {row[0]: {f"c{j}___{v}" for j, v in enumerate(row[1:]) if v is not None} for row in rows}
    got = {r.row_id: r.matches for r in found.collect()}
    assert got == {i: [k for k, s in enumerate(sets) if held[i].issuperset(s)] for i in held}


def test_shared_rows_of_many_itemsets(many):
    _, tx, _, itemsets = many
    found = I.matches(tx, itemsets.where("itemset_id < 700")).where("row_id < 800").cache()
    want = collections.Counter(p for r in found.collect() for p in itertools.combinations_with_replacement(sorted(r.matches), 2))
    overlaps = C.overlaps_in_rows(found)
    assert "explode" not in plan_of(overlaps).lower()
    assert {(r.i, r.j): r.nij for r in overlaps.collect()} == want
    assert {(r.i, r.j): r.nij for r in C.row_overlaps(I.membership_of(found)).collect()} == want


def test_pair_counts_of_great_numbers(monkeypatch):
    """Numbers beyond DENSE come in tiles of each batch."""
    monkeypatch.setattr(incidence, "DENSE", 40)
    r = random.Random(4)
    lists = [sorted(r.sample(range(3_000), r.randrange(9))) + [7] * r.randrange(3) for _ in range(900)] + [[], [5]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["m"])
    got = collections.Counter()
    for part in incidence.pair_counts(batch.slice(i, 250) for i in range(0, len(lists), 250)):
        for i, j, n in zip(*(c.to_pylist() for c in part.columns)):
            got[i, j] += n
    assert got == collections.Counter(p for x in lists for p in itertools.combinations_with_replacement(sorted(set(x)), 2))


def maximal_by_all(tx, support):
    every = {frozenset(r["items"]): r.freq for r in I.frequent_itemsets(tx, support).collect()}
    return {s: n for s, n in every.items() if not any(s < t for t in every)}


@pytest.mark.parametrize("few,most", [(500, 2_000), (0, 2_000), (500, 3)])
def test_maximal_by_unions(spark, monkeypatch, few, most):
    """With unions counted beside or before the members, and with FP-growth after too many candidates."""
    monkeypatch.setattr(I, "FEW", few)
    r = random.Random(few + most)
    for support in (0.04, 0.15):
        rows = []
        for i in range(150):
            a = r.choice("xxxyz")
            rows.append((i, a, a if r.random() < 0.9 else "q", a + "1" if r.random() < 0.8 else None, r.choice("mn"), r.choice("pppq"), a))
        tx = I.to_transactions(spark.createDataFrame(rows, "id int, a string, b string, c string, d string, e string, f string"), "id")
        got = I.maximal_frequent_itemsets(tx, support, most).collect()
        assert {frozenset(x["items"]): x.freq for x in got} == maximal_by_all(tx, support) and all(abs(x.support - x.freq / 150) < 1e-12 for x in got)


def test_dense_table(spark):
    """Twenty equal columns: a million subsets, two maximal ones."""
    rows = [(i, *["xy"[i % 2]] * 20, "z" if i % 3 else "w") for i in range(400)]
    tx = I.to_transactions(spark.createDataFrame(rows, "id int, " + ", ".join(f"c{j} string" for j in range(21))), "id")
    got = {frozenset(r["items"]): r.freq for r in I.maximal_frequent_itemsets(tx, 0.1).collect()}
    want = {frozenset([*(f"c{j}___{v}" for j in range(20)), f"c20___{w}"]): sum(1 for i in range(400) if "xy"[i % 2] == v and (w == "z") == bool(i % 3)) for v in "xy" for w in "zw"}
    assert got == want


def test_mining_leaves_nothing_cached(spark):
    tx = I.to_transactions(spark.createDataFrame(rows_of(), "id int, a string, b string, c string"), "id")
    I.maximal_frequent_itemsets(tx, 0.1).collect()
    assert not tx.storageLevel.useMemory


@pytest.fixture(scope="module")
def clustered(spark):
    df = spark.createDataFrame(rows_of(9, 200), "id int, a string, b string, c string")
    tx, itemsets = I.rank_maximal_itemsets(df, "id", {"a": 1.0, "b": 1.0, "c": 1.0}, 0.12, -1, 0.5)
    itemsets = itemsets.cache()
    held = I.matches(tx, itemsets).cache()
    assign = itemsets.select("itemset_id", (F.col("itemset_id") % 3).alias("cluster")).where("itemset_id <> 4").cache()
    return df, itemsets, held, I.membership_of(held).cache(), assign


def test_rows_stay_where_they_are(spark, clustered):
    """Rows with their itemsets give what exploded members give, and nothing is shuffled by the row id."""
    df, itemsets, held, members, assign = clustered
    none = spark.createDataFrame([], "col string, val string")
    details = I.strip_common_pairs(itemsets)
    clusters = C.cluster_metadata(assign, itemsets, members, none).withColumnRenamed("cluster", "position")
    clusters = materialize(clusters)
    ways = [
        lambda m: C.cluster_coverage(assign, m),
        lambda m: C.cluster_metadata(assign, itemsets, m, none),
        lambda m: C.cluster_report(clusters, none, itemsets, m),
        lambda m: C.cluster_overlap(assign, m),
        lambda m: C.row_overlaps(m),
        lambda m: C.pairwise_similarity(itemsets, m),
        lambda m: I.unassigned_rows(df, m, "id"),
        lambda m: I.rank_listing(details, m),
        lambda m: Q.similar_itemsets(itemsets, m, 0),
        lambda m: Q.similar_clusters(clusters, itemsets, m, 0),
        lambda m: Q.similar_clusters_overlap(clusters, itemsets, m, 0),
    ]
    for way in ways:
        x, y = way(held), way(members)
        assert x.count() > 0 or way is ways[6]
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
        assert "hashpartitioning(row_id" not in plan_of(x)


def test_configurations_of_several_tables(spark, tmp_path):
    path = str(tmp_path / "config")
    one = lambda name, w: spark.createDataFrame([(name, {"a": w}, 0.2, 5, 0.6, 0.1, 0.2)], S.CONFIG)
    for name, w in [("x", 0.1), ("y", 0.2), ("z z/ä", 0.3), ("y", 0.4)]:
        S.save_config(one(name, w), path)
    assert [S.load_config(spark, path, n, ["a"], "cluster")["weights"]["a"] for n in ("x", "y", "z z/ä")] == [0.1, 0.4, 0.3]
    with pytest.raises(ValueError):
        S.load_config(spark, path, "other", ["a"], "cluster")
    reports = str(tmp_path / "reports")
    for name, n in [("x", 3), ("y", 2), ("z", 4), ("x", 1)]:
        S.write_report(spark.range(n).withColumn("table_name", F.lit(name)), reports)
    assert {r.table_name: r["count"] for r in spark.read.json(reports).groupBy("table_name").count().collect()} == {"x": 1, "y": 2, "z": 4}


def test_training_saves_what_it_learns(spark, tmp_path):
    """Sessions one after another, each from the weights of the one before; the saved configuration is loaded again."""
    path = str(tmp_path / "config")
    rows = rows_of()
    start = {c: 1 / 3 for c in "abc"}
    want = mined(rows, 0.1, start, 0.7)
    k = len(want)
    orders = [list(range(k)) for _ in range(3)]
    for i, o in enumerate(orders):
        random.Random(i).shuffle(o)
    rankings = spark.createDataFrame([(f"s{i}", o) for i, o in reversed(list(enumerate(orders)))] + [("s9", orders[0][1:])], "session string, ranking array<int>")
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    S.save_config(spark.createDataFrame([("before", {"a": 0.9}, 0.2, 5, 0.6, 0.1, 0.2)], S.CONFIG), path)
    out = L.train(df, "id", rankings, start, 0.1, table_name="facets", path=path, unique_ids=True)
    w, gamma = start, 0.7
    for o in orders:
        w, gamma = learnt(want, o, w, gamma, 0.12, 0.8)
    got = S.load_config(spark, path, "facets", ["a", "b", "c"], "cluster")
    assert abs(got["gamma"] - gamma) < 1e-9 and all(abs(got["weights"][c] - w[c]) < 1e-9 for c in "abc")
    assert (got["min_support"], got["max_collection"], got["lr_weights"], got["lr_gamma"]) == (0.1, -1, 0.12, 0.8)
    assert out["learned"].count() == 1 and S.load_config(spark, path, "before", ["a"], "cluster")["weights"] == {"a": 0.9}
    assert out["unassigned"].count() == len(rows) - len(set().union(*(h for _, h, *_ in want))) and out["config"].columns == [c.split()[0] for c in S.CONFIG.split(", ")]
    # and the next run starts from it
    again = mine_and_cluster(df, "id", got, unique_ids=True)
    assert [tuple(r["items"]) for r in again["itemsets"].orderBy("itemset_id").collect()] == [s for s, *_ in mined(rows, 0.1, w, gamma)]


def test_learning_of_settings_side_by_side(spark):
    """All settings of a task at once, each as by hand."""
    itemsets = spark.createDataFrame([(i, [f"{c}___v{i}"], 0.1 * i) for i, c in enumerate("aabbc")], "itemset_id int, items array<string>, support double")
    rankings = spark.createDataFrame([("s", [4, 2, 0, 1, 3])], "session string, ranking array<int>")
    rates = spark.createDataFrame([(a, b) for a in (0.1, 0.2, 0.3) for b in (0.1, 0.5)], "lr_weights double, lr_gamma double")
    out = L.update_weights(rankings, itemsets, {"a": 0.2, "b": 0.3, "c": 0.5}, 0.6, rates)
    data = [([f"{c}___x"], None, 0.1 * i) for i, c in enumerate("aabbc")]
    for r in out.collect():
        w, gamma = learnt(data, [4, 2, 0, 1, 3], {"a": 0.2, "b": 0.3, "c": 0.5}, 0.6, r.lr_weights, r.lr_gamma)
        assert abs(r.gamma - gamma) < 1e-9 and all(abs(r.weights[c] - w[c]) < 1e-9 for c in "abc")


def test_catalog(spark, tmp_path):
    S.save_database(spark, "some_db", {"one": spark.range(7), "two": spark.range(3)}, {"v": "SELECT * FROM `some_db`.one WHERE id > 2"}, str(tmp_path / "db"))
    got = [tuple(r) for r in S.list_tables(spark, "some_db").where("name in ('one', 'two', 'v')").collect()]
    assert [r[:2] for r in got] == [("one", "table"), ("two", "table"), ("v", "view")] and [r[4] for r in got] == [7, 3, None]
    assert got[0][2] == 2 and S.read_table(spark, "`some_db`.v", "table").count() == 4
    S.save_database(spark, "some_db", {"two": spark.range(5)})
    assert S.list_tables(spark, "some_db").where("name = 'two'").first().n_rows == 5
    spark.sql("DROP DATABASE `some_db` CASCADE")


def test_jdbc_in_balanced_stretches(spark, tmp_path):
    """Keys of which most lie close together, nulls, dates and timestamps, read from the embedded database that comes with Spark."""
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    r = random.Random(1)
    keys = [int(math.exp(r.uniform(0, 14))) for _ in range(2_000)] + [None] * 40 + [5] * 100
    rows = [(k, f"t{i}", None if k is None else datetime(2020, 1, 1 + k % 28, k % 24, 0, 1), None if k is None else datetime(2000 + k % 20, 1, 1).date()) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, t string, ts timestamp, d date")
    df.coalesce(1).write.format("jdbc").options(dbtable="skewed", **options).save()
    for column in ("k", "ts", "d"):
        back = S.read_table(spark, "skewed", "jdbc", partitionColumn=column, numPartitions=6, **options)
        assert sorted(back.select("t").toPandas()["t"]) == sorted(x[1] for x in rows)
        sizes = [n["n"] for n in back.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 3 and max(sizes) < 2.2 * len(rows) / len(sizes)
    even = S.read_table(spark, "skewed", "jdbc", partitionColumn="k", lowerBound=1, upperBound=1_200_000, numPartitions=6, **options)
    assert max(n["n"] for n in even.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) > 1_500
    assert S.balanced_predicates(spark, "skewed", "k", 1, options) == ["1 = 1"]
    assert S.read_table(spark, "skewed", "jdbc", columns=["t"], **options).count() == len(rows)


def test_tables_side_by_side(spark):
    """Work of two tables meets at a barrier, which only both at once can pass; a failing one is left out."""
    both = threading.Barrier(2, timeout=60)
    pools = {}

    def work(name):
        both.wait()
        pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return spark.range(5).count()

    def fails():
        raise ValueError("broken")

    assert side_by_side(spark, {"a": lambda: work("a"), "b": lambda: work("b"), "c": fails}, 3) == {"a": 5, "b": 5}
    assert pools == {"a": "a", "b": "b"} and not spark.sparkContext.getLocalProperty("spark.scheduler.pool")


def test_database_is_linked_at_once(spark):
    """Each table's report is what the table alone gives."""
    tables = {f"t{s}": spark.createDataFrame(rows_of(s), "id int, a string, b string, c string") for s in (3, 5, 8)}
    tables["single"] = spark.createDataFrame([(i, "x") for i in range(5)] + [(9, "y")], "id int, a string")
    out = analyze_database(spark, tables, {n: "id" for n in tables}, unique_ids=True, most=3)
    got = collections.defaultdict(list)
    for r in out["reports"].collect():
        got[r.table_name].append((r.name, r.size, r.row_coverage, str(r["itemsets"])))
    for name, df in tables.items():
        want = mine_and_cluster(P.prepare_data(df, "id"), "id", {"min_support": 0.1, "max_collection": -1, "gamma": 0.5}, 0.4)["report"]
        assert sorted(got[name]) == sorted((r.name, r.size, r.row_coverage, str(r["itemsets"])) for r in want.collect())


def test_profile_by_sketches(spark, monkeypatch):
    """Columns with few values, many, only different ones, skewed ones, ties, nulls, NaN and no values."""
    monkeypatch.setattr(P, "FEW_VALUES", 5)
    r = random.Random(7)
    n = 3_000
    rows = [(i, f"u{i:05d}", r.choice("abc"), f"z{int(r.random() ** 4 * 900)}", f"p{i // 2}", r.choice([None, 1.5, 2.25, float("nan")]), int(r.gauss(0, 300)), None, i % 7 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, u string, c string, z string, p string, f double, g int, e string, b boolean")
    got = {x.col: x for x in P.column_profile(df).collect()}
    for k, name in enumerate(df.columns):
        text = {True: "true", False: "false"}
        values = [x[k] for x in rows if x[k] is not None]
        said = ["NaN" if v != v else text[v] if isinstance(v, bool) else str(v) for v in values]
        counts = sorted(collections.Counter(said).items(), key=lambda x: (-x[1], x[0]))
        assert (got[name].n_rows, got[name].n_nulls, got[name].n_distinct) == (n, n - len(values), len(counts)), name
        assert got[name].top_values == [f"{v}:{m}" for v, m in counts[:5]], name
    g = [x[6] for x in rows]
    bins = np.histogram(g, 10)[0].tolist()
    assert abs(np.array(got["g"].histogram) - bins).sum() <= 4 and sum(got["g"].histogram) == n and got["u"].histogram is None and got["e"].histogram is None
    assert all(abs(a - b) <= 3 for a, b in zip(got["g"].quantiles, np.quantile(g, [0.25, 0.5, 0.75])))
    assert P.distinct_counts(df, ["u", "c", "e"]) == {"u": n, "c": 3, "e": 0}
    assert P.column_profile(df.where("false")).select("n_rows", "n_distinct").distinct().collect() == [(0, 0)]


def test_equal_rows_are_counted_once(spark):
    """Levels are counted over the different sets of frequent codes, each with its number of rows."""
    rows = [(i, "xy"[i % 2], "pq"[i % 3 == 0], f"u{i}") for i in range(600)]
    tx = I.to_transactions(spark.createDataFrame(rows, "id int, a string, b string, c string"), "id")
    data = I.Counted(tx, 0.1)
    try:
        coded = data.coded.collect()
        assert len(coded) == 4 and sum(r["n"] for r in coded) == data.n == 600
        code = {x: i for i, x in enumerate(data.names)}
        pair = tuple(sorted((code["a___x"], code["b___q"])))
        assert data.pairs()[pair] == data.sets([pair])[pair] == sum(1 for r in rows if r[1:3] == ("x", "q"))
    finally:
        data.close()


def test_weighted_counts_beyond_float(monkeypatch):
    """Rows that stand for many: sums above 2 ** 24 stay exact."""
    for dense in (4_096, 2):
        monkeypatch.setattr(incidence, "DENSE", dense)
        batch = pa.RecordBatch.from_arrays([pa.array([[3, 5], [3, 5], [5]], pa.list_(pa.int32())), pa.array([2**24 + 1, 2**30 + 3, 7])], names=["codes", "n"])
        got = collections.Counter()
        for part in incidence.pair_counts([batch]):
            for i, j, n in zip(*(c.to_pylist() for c in part.columns)):
                got[i, j] += n
        both = 2**24 + 2**30 + 4
        assert got == {(3, 3): both, (3, 5): both, (5, 5): both + 7}
        assert [b.column(1).to_pylist() for b in incidence.set_counts([(3, 5)], 6)([batch])] == [[both]]


def test_buckets_without_joins(spark, monkeypatch):
    """Bucketing joins nothing to the table, and no text of a column with very many values is counted to plan it."""
    df = spark.range(3_000).select("id", (F.col("id") % 1_000).alias("n"), F.concat(F.lit("t"), F.col("id") % 900).alias("t"))
    with monkeypatch.context() as m:
        m.setattr(P, "value_counts", None)
        assert P.default_plan(df, 200, "id") == {"n": "top10", "t": "top10"}
    out = P.apply_buckets(df, {"n": "top10", "t": "top10"}, "id")
    assert "Join" not in plan_of(out)
    assert {r.n for r in out.collect()} == {"others", *(str(x) for x in sorted(map(str, range(1_000)))[:10])}
    edge = spark.range(3_000).select("id", (F.col("id") % 200).alias("at"), (F.col("id") % 201).alias("over"))
    assert P.default_plan(edge, 200, "id") == {"over": "top10"}
