import itertools
import random

import pytest

from facetmill.operators import clusters as C
from facetmill.operators import itemsets as I
from facetmill.operators import search as Q

TOY = [("r1", "red", "S"), ("r2", "red", "S"), ("r3", "red", "M"), ("r4", "blue", "M"), ("r5", "blue", None)]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(TOY, "id string, color string, size string")
    tx, itemsets = I.rank_maximal_itemsets(df, "id", {"color": 0.5, "size": 0.5}, 0.4, -1, 0.5)
    itemsets = itemsets.cache()
    return df, tx.cache(), itemsets, I.membership(tx, itemsets).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_toy_ranking(toy):
    got = [(r.itemset_id, r["items"], r.freq, round(r.support, 9), round(r.score, 9), r.unique_id) for r in toy[2].orderBy("itemset_id").collect()]
    assert got == [
        (0, ["color___red", "size___S"], 2, 0.4, 0.7, "9bbc96cc93317fb9fce4d01468290c2c"),
        (1, ["color___blue"], 2, 0.4, 0.45, "eb754cd6d46b75616904b165ee27b139"),
        (2, ["size___M"], 2, 0.4, 0.45, "eb2377c054d4d1c55808c668cd820779"),
    ]


def test_toy_rows(toy):
    df, tx, itemsets, members = toy
    assert rows(members, "itemset_id", "row_id") == [(0, "r1"), (0, "r2"), (1, "r4"), (1, "r5"), (2, "r3"), (2, "r4")]
    assert I.unassigned_rows(df, members, "id").count() == 0
    first = members.where("itemset_id = 0")
    assert rows(I.unassigned_rows(df, first, "id"), "row_id") == [("r3",), ("r4",), ("r5",)]
    patterns = {r.pattern: (r.n_itemsets, r.level) for r in I.group_by_pattern(I.strip_common_pairs(itemsets)).collect()}
    assert patterns == {p: (1, "very interesting") for p in ("color|size", "color", "size")}
    listing = {r.itemset_id: (r.n_rows, r.example_rows) for r in I.rank_listing(I.strip_common_pairs(itemsets), members).collect()}
    assert listing[2] == (2, ["r3", "r4"])


def test_toy_clusters(toy):
    _, _, itemsets, members = toy
    pairs = C.pairwise_similarity(itemsets, members).cache()
    got = {(r.i, r.j): (r.col_similarity, round(r.row_similarity, 6), round(r.distance, 6)) for r in pairs.collect()}
    assert got == {(0, 1): (0.5, 0.0, 0.75), (0, 2): (0.5, 0.0, 0.75), (1, 2): (0.0, 0.333333, 0.833333)}
    links = C.linkage_table(pairs)
    assert [(r.step, r.left, r.right, round(r.distance, 9), r["size"]) for r in links.orderBy("step").collect()] == [(0, 0, 1, 0.75, 2), (1, 0, 2, round(19 / 24, 9), 3)]
    assert rows(C.cut_clusters(itemsets, links, 0.4), "itemset_id") == [(0, 0), (1, 1), (2, 2)]
    assert rows(C.cut_clusters(itemsets, links, 0.2), "itemset_id") == [(0, 0), (1, 0), (2, 0)]
    clusters, constants = C.cluster_itemsets(itemsets, members, 0.4)
    assert [(r.position, r.row_coverage, r.row_coverage_percent) for r in clusters.orderBy("position").collect()] == [(0, 2, 0.4), (1, 2, 0.4), (2, 2, 0.4)]
    assert constants.count() == 0
    assert C.cluster_itemsets(itemsets, members, 0.2)[0].count() == 0  # no common column
    assert C.similarity_matrix(itemsets, pairs).count() == 9


def test_toy_search(toy):
    _, _, itemsets, members = toy
    assert [(r.itemset_id, round(r.score, 6)) for r in Q.similar_itemsets(itemsets, members, 1).orderBy("rank").collect()] == [(2, 0.166667), (0, 0.0)]
    assert Q.similar_itemsets(itemsets, members, 99).count() == 0
    assert Q.all_similar_itemsets(itemsets, members, 1).count() == 3


def random_table(spark, n, seed):
    r = random.Random(seed)
    data = [(i, *[r.choice("ab") if r.random() < 0.6 else r.choice("cde") if r.random() < 0.8 else None for _ in range(4)]) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, `a___x` string, b string, c string, d string")


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_against_brute_force(spark, seed):
    data, df = random_table(spark, 120, seed)
    names = ["a___x", "b", "c", "d"]
    sets = [frozenset(f"{c.replace('_', chr(92) + '-')}___{v}" for c, v in zip(names, row[1:]) if v is not None) for row in data]
    need = I.min_count(len(sets), 0.07)
    items = sorted(set().union(*sets))
    frequent = {frozenset(c): n for k in range(1, 5) for c in itertools.combinations(items, k) if (n := sum(set(c) <= s for s in sets)) >= need}
    tx = I.to_transactions(df, "id").cache()
    for mine in (I.frequent_itemsets, I.frequent_itemsets_fpgrowth):
        assert {frozenset(r["items"]): r.freq for r in mine(tx, 0.07).collect()} == frequent
    assert {frozenset(r["items"]): r.freq for r in I.frequent_itemsets(tx, 0.07, max_candidates=1).collect()} == frequent
    top = {s: n for s, n in frequent.items() if not any(s < t for t in frequent)}
    got = I.maximal_frequent_itemsets(tx, 0.07).cache()
    assert {frozenset(r["items"]): r.freq for r in got.collect()} == top
    ranked = I.rank_itemsets(I.score_itemsets(got, {c: 1.0 for c in names}), -1).cache()
    counts = {r.itemset_id: r["count"] for r in I.membership(tx, ranked).groupBy("itemset_id").count().collect()}
    assert counts == {r.itemset_id: r.freq for r in ranked.collect()}


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "id int, a string")
    tx, itemsets = I.rank_maximal_itemsets(empty, "id")
    assert itemsets.count() == 0 and I.membership(tx, itemsets).count() == 0
    one = spark.createDataFrame([(1, "x")], "id int, a string")
    tx, itemsets = I.rank_maximal_itemsets(one, "id")
    assert [r["items"] for r in itemsets.collect()] == [["a___x"]]
    clusters, _ = C.cluster_itemsets(itemsets, I.membership(tx, itemsets))
    assert Q.similar_clusters(clusters, itemsets, I.membership(tx, itemsets), 0).count() == 0


def test_support_counts_rows_without_items(spark):
    data = [(i, "x" if i < 3 else None, "y" if i < 2 else None) for i in range(27)]
    tx = I.to_transactions(spark.createDataFrame(data, "id int, a string, b string"), "id")
    assert {tuple(r["items"]): r.freq for r in I.frequent_itemsets(tx, 0.1).collect()} == {("a___x",): 3}
