"""Learning, groups of itemsets and whole workflows against plain Python versions."""

import itertools
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from facetmill.functions.items import item, item_column, item_value
from facetmill.operators import clusters as C
from facetmill.operators import itemsets as I
from facetmill.operators import learn as L
from facetmill.operators import prepare as P
from facetmill.plans import workflows
from facetmill.plans.queries import QUERIES
from facetmill.plans.workflows import analyze_database, mine_and_cluster

COLUMNS = ["a", "b", "c"]


def rows_of(seed=3, n=80):
    r = random.Random(seed)
    return [(i, r.choice("xxy"), r.choice("pqq"), r.choice("uvw")) for i in range(n)]


def mined(rows, support, weights, gamma):
    """Ranked maximal itemsets: (items, rows, support, score)."""
    sets = {row[0]: {f"{c}___{v}" for c, v in zip(COLUMNS, row[1:])} for row in rows}
    every = sorted(set().union(*sets.values()))
    found = {}
    for k in range(1, 4):
        for s in itertools.combinations(every, k):
            held = {i for i, x in sets.items() if set(s) <= x}
            if len(held) >= math.ceil(support * len(rows)):
                found[s] = held
    top = {s: h for s, h in found.items() if not any(set(s) < set(t) for t in found)}
    total = sum(abs(w) for w in weights.values())
    score = lambda s, h: gamma * len(h) / len(rows) + (1 - gamma) * sum(weights[i.split("___")[0]] for i in s) / total
    return sorted(((s, h, len(h) / len(rows), score(s, h)) for s, h in top.items()), key=lambda x: (-round(x[3], 12), "|".join(x[0])))


def clustered(itemsets, threshold):
    """Average linkage from the definition, cut at 1 - threshold; clusters with a common column, by size, then first itemset."""
    cols = [{i.split("___")[0] for i in s} for s, *_ in itemsets]
    far = lambda i, j: 1 - (len(cols[i] & cols[j]) / len(cols[i] | cols[j]) + len(itemsets[i][1] & itemsets[j][1]) / len(itemsets[i][1] | itemsets[j][1])) / 2
    groups = [[i] for i in range(len(itemsets))]
    while len(groups) > 1:
        best = min((sum(far(x, y) for x in g for y in h) / len(g) / len(h), min(g), min(h)) for g, h in itertools.combinations(groups, 2))
        if best[0] > 1 - threshold + 1e-12:
            break
        low = min(((abs(sum(far(x, y) for x in g for y in h) / len(g) / len(h) - best[0]) > 1e-12, min(min(g), min(h)), max(min(g), min(h)), g, h) for g, h in itertools.combinations(groups, 2)), key=lambda x: x[:3])
        groups = [g for g in groups if g not in low[3:]] + [sorted(low[3] + low[4])]
    kept = [g for g in groups if set.intersection(*(cols[i] for i in g))]
    return sorted(kept, key=lambda g: (-len(g), min(g)))


@pytest.mark.parametrize("seed", [3, 8])
def test_mine_and_cluster(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    weights = {"a": 0.5, "b": 0.2, "c": 0.3}
    out = mine_and_cluster(df, "id", {"weights": weights, "min_support": 0.15, "max_collection": -1, "gamma": 0.6}, 0.4, near_itemset=0)
    want = mined(rows, 0.15, weights, 0.6)
    got = out["itemsets"].orderBy("itemset_id").collect()
    assert [(tuple(r["items"]), r.freq, round(r.score, 9)) for r in got] == [(s, len(h), round(x, 9)) for s, h, _, x in want]
    groups = clustered(want, 0.4)
    covered = [set().union(*(want[i][1] for i in g)) for g in groups]
    total = len(set().union(*(h for _, h, *_ in want)))
    clusters = out["clusters"].orderBy("position").collect()
    assert [(r.itemset_indices, r.row_coverage, round(r.row_coverage_percent, 9)) for r in clusters] == [(g, len(c), round(len(c) / total, 9)) for g, c in zip(groups, covered)]
    report = out["report"].orderBy("name").collect()
    assert [(r.name, [(x.itemset_id, x.matching_rows_count, x.example_rows) for x in r["itemsets"]]) for r in report] == [
        (f"CLUSTER_{k}", [(i, len(want[i][1]), sorted(map(str, sorted(want[i][1])[:5]))) for i in g]) for k, g in enumerate(groups)
    ]
    assert out["near_itemsets"].count() == min(10, len(want) - 1) and out["unassigned"].count() == len(rows) - total
    # the same without unique row ids, which takes the way over shared rows
    twice = mine_and_cluster(df.unionByName(df), "id", {"weights": weights, "min_support": 0.15, "max_collection": -1, "gamma": 0.6})
    assert [r.itemset_indices for r in twice["clusters"].orderBy("position").collect()] == groups


def step_by_hand(w, gamma, better, worse, sa, sb, lw, lg):
    total = sum(map(abs, w.values())) or 1.0
    ca, cb = sum(w[c] for c in better) / total, sum(w[c] for c in worse) / total
    miss = 1 - 1 / (1 + math.exp(-(gamma * (sa - sb) + (1 - gamma) * (ca - cb))))
    new = dict(w)
    for c in better:
        new[c] += lw * (1 - gamma) / total * miss
    for c in worse:
        new[c] -= lw * (1 - gamma) / total * miss
    return new, min(1.0, max(0.0, gamma + lg * miss * ((sa - ca) - (sb - cb))))


def learnt(itemsets, ranking, w, gamma, lw, lg):
    for i, a in enumerate(ranking):
        for b in ranking[i + 1 :]:
            cols = lambda k: [x.split("___")[0] for x in itemsets[k][0]]
            w, gamma = step_by_hand(w, gamma, cols(a), cols(b), itemsets[a][2], itemsets[b][2], lw, lg)
    return w, gamma


def test_learning_by_hand(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    start = {c: 1 / 3 for c in COLUMNS}
    want = mined(rows, 0.1, start, 0.7)
    k = len(want)
    ranking = list(range(k))
    random.Random(1).shuffle(ranking)
    rankings = spark.createDataFrame([("s", ranking), ("bad", ranking[1:])], "session string, ranking array<int>")
    _, itemsets = I.rank_maximal_itemsets(df, "id", start, 0.1, -1, 0.7)
    itemsets = itemsets.cache()
    good = L.valid_rankings(rankings, k)
    got = L.update_weights(good, itemsets, start, 0.7, L.setting(spark)).first()
    w, gamma = learnt(want, ranking, start, 0.7, 0.12, 0.8)
    assert abs(got.gamma - gamma) < 1e-9 and all(abs(got.weights[c] - w[c]) < 1e-9 for c in COLUMNS)
    # the grid of learning rates
    grid = {(r.lr_weights, r.lr_gamma): r for r in L.learning_rate_grid(itemsets, good, start).collect()}
    assert set(grid) == set(itertools.product(L.RATES_WEIGHTS, L.RATES_GAMMA)) and len(grid) == 100
    for (lw, lg), r in grid.items():
        w, gamma = learnt(want, ranking, start, 0.7, lw, lg)
        total = sum(map(abs, w.values()))
        order = sorted(range(k), key=lambda i: (-round(gamma * want[i][2] + (1 - gamma) * sum(w[x.split("___")[0]] for x in want[i][0]) / total, 12), "|".join(want[i][0])))
        assert abs(r.gamma - gamma) < 1e-9 and abs(r.mean_weight_change - sum(abs(w[c] - 1 / 3) for c in COLUMNS) / 3) < 1e-9 and abs(r.gamma_change - abs(gamma - 0.7)) < 1e-9
        assert r.rank_distance == sum(abs(order.index(i) - ranking.index(i)) for i in range(k)) and r.rank_distance_ref == sum(abs(i - ranking.index(i)) for i in range(k))
    # training ranks again by what it learnt
    out = L.train(df, "id", rankings, start, 0.1)
    w, gamma = learnt(want, ranking, start, 0.7, 0.12, 0.8)
    assert [tuple(r["items"]) for r in out["itemsets"].orderBy("itemset_id").collect()] == [s for s, *_ in mined(rows, 0.1, w, gamma)]
    assert abs(out["config"].first().gamma - gamma) < 1e-9


def test_database_goes_on_after_a_failing_table(spark):
    rows = rows_of(5)
    good = spark.createDataFrame(rows, "id int, a string, b string, c string")
    fails = good.withColumn("c", F.when(F.col("id") < 5000, F.col("c")).otherwise(F.raise_error(F.lit("broken"))))
    late = good.withColumn("b", F.when(F.col("id") == 79, F.raise_error(F.lit("broken"))).otherwise(F.col("b")))
    out = analyze_database(spark, {"one": good, "two": late, "three": fails, "four": good.drop("id")}, {n: "id" for n in ("one", "two", "three")}, {"view": good})
    want = mine_and_cluster(P.prepare_data(good, "id"), "id", {"min_support": 0.1, "max_collection": -1, "gamma": 0.5})["report"]
    got = {t: sorted((r.name, r.row_coverage) for r in out["reports"].collect() if r.table_name == t) for t in ("one", "two", "three")}
    assert got["one"] == got["three"] == sorted((r.name, r.row_coverage) for r in want.collect()) and not got["two"]
    assert out["schemas"].where("table_name = 'four'").count() == 3 and out["views"]["view"].count() == 10


def test_failures_of_a_database_are_told(spark, monkeypatch):
    """Tables that fail stand in failures, or with strict in an error, whether rows or reports fail."""
    good = spark.createDataFrame(rows_of(5), "id int, a string, b string, c string")
    late = good.withColumn("b", F.when(F.col("id") == 79, F.raise_error(F.lit("broken"))).otherwise(F.col("b")))
    ids = {n: "id" for n in ("one", "two")}
    assert analyze_database(spark, {"one": good, "two": good}, ids, strict=True)["failures"].isEmpty()
    out = analyze_database(spark, {"one": good, "two": late}, ids)
    assert [(r.table_name, "broken" in r.error) for r in out["failures"].collect()] == [("two", True)] and out["reports"].select("table_name").distinct().count() == 1
    with pytest.raises(ExceptionGroup, match="analysed: two$") as told:
        analyze_database(spark, {"one": good, "two": late}, ids, strict=True)
    assert "broken" in str(told.value.exceptions[0])
    report, broken = workflows.cluster_report, threading.Lock()  # the first report to come fails
    monkeypatch.setattr(workflows, "cluster_report", lambda *a: report(*a) if not broken.acquire(blocking=False) else 1 / 0)
    with pytest.raises(ExceptionGroup, match="analysed: (one|two)$"):
        analyze_database(spark, {"one": good, "two": good}, ids, strict=True)
    broken.release()
    out = analyze_database(spark, {"one": good, "two": good}, ids)
    (left,) = [r.table_name for r in out["failures"].collect()]
    assert {r.table_name for r in out["reports"].collect()} == set(ids) - {left}


def test_query_of_a_database_needs_all_tables(spark, sf, tmp_path):
    """Without the labels' key, or with a balance that no whole number holds, there is no result that lacks a table's rows; a table of one row has no clusters and is no failure."""
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "part", "customer", "labels")}

    def rows(folder, **other):
        for n, df in (tables | other).items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{folder}/{n}.parquet")
        return {r.table_name for r in QUERIES["analyze_database_small"](spark, f"{tmp_path}/{folder}").collect()}

    with pytest.raises(ExceptionGroup, match="analysed: customer, labels$"):
        rows("broken", labels=tables["labels"].drop("doc_id"), customer=tables["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") > 1, F.col("c_acctbal")).otherwise(float("inf"))))
    assert rows("one", labels=tables["labels"].limit(1)) == {"orders", "part", "customer"}


def test_names_with_the_separator(spark):
    names = ["a___x", "b_", "c\\d", "__", "e f.g", "_h"]
    df = spark.createDataFrame([(1, "v___w", "_u", "\\_", "___", "z", "")], ", ".join(["id int", *[f"`{n}` string" for n in names]]))
    got = df.select(*[F.struct(item_column(item(n)), item_value(item(n))).alias(f"x{i}") for i, n in enumerate(names)]).first()
    assert [tuple(x) for x in got] == list(zip(names, ["v___w", "_u", "\\_", "___", "z", ""]))
    _, itemsets = I.rank_maximal_itemsets(df, "id", {n: 1.0 for n in names})
    assert {(r.col, r.val) for r in I.itemset_pairs(itemsets).collect()} == set(zip(names, ["v___w", "_u", "\\_", "___", "z", ""]))
    assert abs(itemsets.first().score - 1.0) < 1e-9 and C.similarity_matrix(itemsets, C.pairwise_similarity(itemsets, I.membership(I.to_transactions(df, "id"), itemsets))).count() == 1


def test_null_cells_are_no_frequent_value(spark):
    rows = [(i, "NULL" if i % 3 == 0 else f"v{i}", "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string, c string")
    tx, _ = I.rank_maximal_itemsets(df, "id")
    got = {tuple(x.split("___")[0] for x in r["items"]): n for r, n in ((r, r["n"]) for r in tx.groupBy(F.transform("items", item_column).alias("items")).agg(F.count(F.lit(1)).alias("n")).collect())}
    assert got == {("k", "c"): 600, ("c",): 300}


def test_two_valued_number_with_nulls(spark):
    """It is compared with text where it has a value, as pairwise correlation does."""
    r = random.Random(2)
    rows = [(i, r.choice("pqr"), r.choice("st")) for i in range(200)]
    df = spark.createDataFrame([(i, t, u, None if i % 4 == 0 else float(t == "p"), None if i % 5 == 0 else int(r.random() < 0.5)) for i, t, u in rows], "id int, t string, u string, f double, g int")
    assert P.correlated_column_groups(df, "id") == [["f", "t"]]
