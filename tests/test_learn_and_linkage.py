import math

import numpy as np
import pytest

from facetmill.functions.linkage import average_linkage
from facetmill.operators import itemsets as I
from facetmill.operators import learn as L
from facetmill.sources import tables as S


def test_linkage_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(20):
        k = int(r.integers(2, 9))
        d = r.random((k, k))
        d = (d + d.T) / 2
        groups = [[i] for i in range(k)]
        for step, left, right, distance, size in average_linkage(np.arange(k), d):
            best = min((np.mean([d[x, y] for x in a for y in b]), min(a), min(b), a, b) for i, a in enumerate(groups) for b in groups[i + 1 :])
            a, b = best[3], best[4]
            assert abs(distance - best[0]) < 1e-9 and {left, right} == {min(a), min(b)} and size == len(a) + len(b)
            groups = [g for g in groups if g not in (a, b)] + [a + b]


def test_one_update():
    w = {"color": 0.5, "size": 0.5}
    gamma = L.one_update(w, 0.5, ["color"], ["color", "size"], 0.4, 0.4, 0.12, 0.8)
    assert math.isclose(gamma, 0.7248706003543193) and math.isclose(w["color"], 0.5) and math.isclose(w["size"], 0.4662694099468521)


def test_rankings(spark):
    df = spark.createDataFrame([("a", [1, 0, 2]), ("b", [0, 1]), ("c", [0, 0, 1]), ("d", []), ("e", [1, 2, 3]), ("f", None)], "session string, ranking array<int>")
    assert [r.session for r in L.valid_rankings(df, 3).collect()] == ["a"]


def test_training(spark):
    toy = spark.createDataFrame([("r1", "red", "S"), ("r2", "red", "S"), ("r3", "red", "M"), ("r4", "blue", "M"), ("r5", "blue", None)], "id string, color string, size string")
    _, itemsets = I.rank_maximal_itemsets(toy, "id", {"color": 0.5, "size": 0.5}, 0.4, -1, 0.5)
    ranking = spark.createDataFrame([("s", [1, 0, 2])], "session string, ranking array<int>")
    pairs = L.preference_pairs(ranking, itemsets)
    assert [(r.step, r.a, r.b) for r in pairs.orderBy("step").collect()] == [(0, 1, 0), (1, 1, 2), (2, 0, 2)]
    grid = L.learning_rate_grid(itemsets, ranking, {"color": 0.5, "size": 0.5}).collect()
    assert len(grid) == 100 and all(0 <= r.gamma <= 1 for r in grid) and [r.rank_distance for r in grid] == sorted(r.rank_distance for r in grid)
    out = L.train(toy, "id", ranking, {"color": 0.5, "size": 0.5}, 0.4)
    assert out["itemsets"].count() == 3 and out["config"].first().gamma != 0.7


def test_configuration(spark, tmp_path):
    path = str(tmp_path / "config")
    assert S.load_config(spark, path, "t", ["a", "b"])["weights"] == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        S.load_config(spark, path, "t", ["a"], "cluster")
    S.save_config(spark.createDataFrame([("t", {"a": 0.9}, 0.2, 5, 0.6, 0.1, 0.2)], S.CONFIG), path)
    got = S.load_config(spark, path, "t", ["a", "b"], "cluster")
    assert got["weights"] == {"a": 0.9, "b": 0.5} and got["min_support"] == 0.2 and got["max_collection"] == 5


def test_sources(spark, sf, tmp_path):
    region = S.read_table(spark, f"{sf}/region.parquet", columns=["r_name"])
    assert region.columns == ["r_name"]
    with pytest.raises(ValueError):
        S.read_table(spark, "x", "csv")
    region.write.csv(str(tmp_path / "c"), header=True)
    assert S.read_table(spark, str(tmp_path / "c"), "csv", schema="r_name string", header=True).count() == region.count()
    assert S.sample_rows(spark.createDataFrame([(1, "x" * 60), (2, None)], "id int, t string")).collect()[0].t == "x" * 47 + "..."
    S.write_report(region.selectExpr("'t' as table_name", "r_name"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == region.count()
