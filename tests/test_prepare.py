import datetime as dt

import pytest
from pyspark.sql import functions as F

from facetmill.operators import prepare as P


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 7, 7, None, "a", 0.5, "nan"), (2, 7, None, None, "b", 1.5, "NULL"), (3, 7, 7, None, "c", 2.5, "None"), (4, 7, 7, None, "d", None, "x")],
        "id int, k int, kn int, n string, u string, f double, t string",
    )


def test_rounding_and_dropping(table):
    assert [r.f for r in P.round_floats(table).orderBy("id").collect()] == [0, 2, 2, None]
    assert P.constant_columns(table) == ["k", "n"]
    assert P.unique_columns(table, "id") == ["u", "f", "t"]
    assert P.prepare_data(table, "id").columns == ["id", "kn", "f"]


def test_nulls(table):
    assert [r.t for r in P.normalize_nulls(table, "id").orderBy("id").collect()] == [None, None, None, "x"]


def test_correlated(spark, table):
    df = table.withColumn("u2", F.upper("u")).withColumn("is_a", (F.col("u") == "a").cast("int")).withColumn("id3", F.col("id") * 3).withColumn("id9", F.col("id") * 9 + 1).drop("f")
    groups = P.correlated_column_groups(df, "id")
    assert ["is_a", "t", "u", "u2"] in groups and ["id3", "id9"] in groups
    kept, unknown = P.drop_correlated(df, groups, ["u2", "kn"])
    assert "u2" not in kept.columns and unknown == ["kn"]


def test_correlated_beside_many_values(spark, monkeypatch):
    rest = lambda i, side: F.concat(F.lit(side), (F.col("id") % (7 + 2 * i + (side == "b"))).cast("string"))
    few = [F.when(F.col("id").isin(i, i + 10), "two").otherwise(rest(i, side)).alias(f"p{i}_{side}") for i in range(6) for side in "ab"]
    df = spark.range(40_000).select("id", F.concat(F.lit("l"), "id").alias("left"), F.concat(F.lit("r"), "id").alias("right"), *few)
    want = [["left", "right"], *[[f"p{i}_a", f"p{i}_b"] for i in range(6)]]
    assert P.correlated_column_groups(df, "id") == want
    small = spark.createDataFrame([(i, "a" if i < 2 else "b" if i < 4 else f"u{i}", "x" if i in (1, 2) else "z" if i < 2 or i == 5 else None, "m" if i in (2, 3) else None) for i in range(8)], "id int, s string, t string, u string")
    want = P.correlated_column_groups(small, "id")
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all parts of equal size look equal
    assert P.correlated_column_groups(small, "id") == want == [["s", "u"]]


def test_buckets(spark):
    df = spark.createDataFrame([(i, dt.datetime(2021, m, 5, h)) for i, (m, h) in enumerate([(1, 6), (4, 12), (7, 21), (10, 22)])] + [(9, None)], "id int, t timestamp")
    bucket = lambda kind: [r.t for r in P.bucket_datetime(df, "t", kind).orderBy("id").collect()]
    assert bucket("time_of_day") == ["Morning", "Afternoon", "Evening", "Night", None]
    assert bucket("season") == ["Winter", "Spring", "Summer", "Autumn", None]
    assert bucket("year") == ["2021"] * 4 + [None]
    assert bucket("day_of_week")[0] == "Tuesday"
    with pytest.raises(ValueError):
        bucket("decade")


def test_top_values(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + ["d", None]], "v string")
    assert sorted(str(r.v) for r in P.bucket_categorical(df, "v", 2).collect()) == sorted(["a"] * 3 + ["b"] * 2 + ["others"] * 3 + ["None"])


def test_dates_and_cardinality(spark):
    df = spark.createDataFrame([(i, f"2021-01-{i % 28 + 1:02d}", f"{i}", f"{i % 28 + 1:02d}/03/2020") for i in range(60)], "id int, d string, n string, e string")
    assert P.datetime_columns(df) == ["d", "e"]
    got = {r.col: (r.n_unique, r.kind) for r in P.high_cardinality_columns(df, 20, "id").collect()}
    assert got == {"d": (28, "datetime"), "n": (60, "categorical"), "e": (28, "datetime")}
    plan = P.default_plan(df, 20, "id")
    assert plan == {"d": "season", "n": "top10", "e": "season"}
    assert {r.e for r in P.apply_buckets(df, plan).collect()} == {"Spring"}


def test_descriptions_and_profile(table):
    said = {r.col: r.description for r in P.describe_columns(table, ["u", "f", "kn"], {"k": "7"}, "id").collect()}
    assert said["k"] == "constant with the value 7" and said["u"] == "categorical with 4 values such as a, b, c, d"
    profile = {r.col: r for r in P.column_profile(table).collect()}
    assert profile["kn"].n_nulls == 1 and profile["n"].n_distinct == 0 and profile["f"].top_values[0] == "0.5:1"


def test_zero_weights(table):
    kept, weights = P.drop_zero_weight(table, {"k": 0.0, "u": 0.3})
    assert "k" not in kept.columns and weights == {"u": 0.3}


def test_empty_table(table):
    empty = table.where("false")
    assert P.constant_columns(empty) == [] and P.unique_columns(empty) == [] and P.prepare_data(empty).count() == 0
    assert P.correlated_column_groups(empty, "id") == []


def test_constants_by_text(spark, monkeypatch):
    """Equal ends settle whole numbers and dates; of the rest the texts do, also where hashes of texts meet."""
    rows = [(0.0, "a", 5, dt.datetime(2021, 1, 5), "c", float("nan")), (-0.0, "b", 5, dt.datetime(2021, 1, 5), "c", float("nan"))]
    df = spark.createDataFrame(rows, "zero double, t string, k int, at timestamp, c string, nan double")
    assert P.constant_columns(df) == ["k", "at", "c", "nan"]
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert P.constant_columns(df) == ["k", "at", "c", "nan"]
