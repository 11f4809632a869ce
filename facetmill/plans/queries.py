"""One registered query for each operator: (spark, sf_dir) -> DataFrame.  Arrays and maps come as strings, doubles rounded to 6 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators import clusters as C
from facetmill.operators import itemsets as I
from facetmill.operators import learn as L
from facetmill.operators import prepare as P
from facetmill.operators import search as Q
from facetmill.plans.workflows import analyze_database, mine_and_cluster
from facetmill.sources import tables as S
from facetmill.sources.work import materialize, work_dir

SUPPORT = 0.06
WEIGHTS = {"o_orderdate": 1 / 3, "o_orderpriority": 1 / 3, "o_orderstatus": 1 / 3}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return S.read_table(spark, f"{d}/{name}.parquet")


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def joined(name: str):
    return F.array_join(name, "|").alias(name)


# ---- preparation


def orders(spark: SparkSession, d: str) -> DataFrame:
    """The main fixture: status, priority and season of orders."""
    return P.bucket_datetime(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_orderdate", "season")


def lineitem_parts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_shipdate").alias("season"), F.col("l_shipdate").alias("weekday"))
    return P.bucket_datetime(P.bucket_datetime(x, "season", "season"), "weekday", "day_of_week")


def names_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "col string")


def correlated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.lower("o_orderstatus").alias("status_copy"), (F.col("o_orderstatus") == "F").cast("int").alias("is_final"), (F.col("o_custkey") * 2).alias("twice_custkey"))


def drop_correlated(spark: SparkSession, d: str) -> DataFrame:
    o = correlated(spark, d)
    kept, unknown = P.drop_correlated(o, P.correlated_column_groups(o, "o_orderkey"), ["status_copy", "twice_custkey", "o_orderpriority"])
    return kept.withColumn("not_dropped", F.lit("|".join(unknown)))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates as texts of two forms, every other cell a date, and texts that are none."""
    x = table(spark, d, "orders")
    day = F.col("o_orderdate")
    half = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    x = x.select(F.date_format(day, "yyyy/MM/dd").alias("slashes"), F.date_format(day, "dd-MM-yyyy").alias("day_first"), half.alias("half"), F.col("o_orderpriority").alias("no_date"), F.col("o_custkey").cast("string").alias("number"))
    return names_of(spark, P.datetime_columns(x))


def derived_nulls(spark: SparkSession, d: str) -> DataFrame:
    """documents with null literals in lang and real nulls in source."""
    x = table(spark, d, "documents")
    lang = F.when(F.col("doc_id") % 7 == 0, "NULL").when(F.col("doc_id") % 7 == 1, "nan").when(F.col("doc_id") % 7 == 2, "Null").otherwise(F.col("lang"))
    return x.select("doc_id", lang.alias("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"), "n_chars")


def described(spark: SparkSession, d: str) -> DataFrame:
    return P.describe_columns(table(spark, d, "orders"), ["o_orderstatus", "o_custkey", "o_orderdate", "o_totalprice"], {"o_kind": "web"}, "o_orderkey")


def zero_weight(spark: SparkSession, d: str) -> DataFrame:
    kept, weights = P.drop_zero_weight(table(spark, d, "orders"), {"o_orderstatus": 0.5, "o_orderpriority": 0.0, "o_custkey": 0.2, "o_totalprice": 0.0, "o_orderdate": 0.0})
    return kept.withColumn("weights", F.lit("|".join(sorted(weights))))


def profiled(spark: SparkSession, d: str) -> DataFrame:
    p = P.column_profile(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    return p.select("col", "n_rows", "n_nulls", "n_distinct", "min_value", "max_value", *six("mean", "stddev"), joined("top_values"))


def distributions(spark: SparkSession, d: str) -> DataFrame:
    """Profile of lineitem's numbers and texts with the histograms; l_shipdate and l_extendedprice have many values."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", F.expr("nullif(l_linenumber, 7)").alias("l_linenumber"))
    p = P.column_profile(x)
    return p.select("col", "n_rows", "n_nulls", "n_distinct", F.array_join(F.transform("histogram", lambda v: v.cast("string")), "|").alias("histogram"), joined("top_values"))


# ---- itemsets of orders


def tx_of(spark: SparkSession, d: str) -> DataFrame:
    return I.to_transactions(P.normalize_nulls(orders(spark, d), "o_orderkey"), "o_orderkey")


def maximal(spark: SparkSession, d: str) -> DataFrame:
    return I.maximal_frequent_itemsets(tx_of(spark, d), SUPPORT)


def ranked(spark: SparkSession, d: str, most: int = -1) -> DataFrame:
    return I.with_unique_id(I.rank_itemsets(I.score_itemsets(maximal(spark, d), WEIGHTS, 0.5), most))


def mined(spark: SparkSession, d: str, most: int = -1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranked itemsets, the rows with the itemsets that they hold, and the rows that two of them share; order keys are unique, so nothing is shuffled by them."""
    itemsets = materialize(ranked(spark, d, most))
    held = materialize(I.matches(tx_of(spark, d), itemsets))
    return itemsets, held, C.overlaps_in_rows(held)


def membership(spark: SparkSession, d: str) -> DataFrame:
    return I.membership(tx_of(spark, d), materialize(ranked(spark, d)))


def order_facets(spark: SparkSession, d: str) -> DataFrame:
    """Orders with season, weekday and year of their date: several hundred maximal itemsets at a low support."""
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", *[F.col("o_orderdate").alias(c) for c in ("season", "weekday", "year")])
    for column, kind in (("season", "season"), ("weekday", "day_of_week"), ("year", "year")):
        x = P.bucket_datetime(x, column, kind)
    return I.to_transactions(x, "o_orderkey")


def membership_many(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all itemsets of a low support."""
    tx = order_facets(spark, d)
    weights = {c: 0.2 for c in ("o_orderstatus", "o_orderpriority", "season", "weekday", "year")}
    return I.membership(tx, materialize(I.rank_itemsets(I.score_itemsets(I.maximal_frequent_itemsets(tx, 0.005), weights, 0.5), -1)))


def maximal_copies(spark: SparkSession, d: str) -> DataFrame:
    """A dense table: the status of an order stands in twelve columns, which level by level would be 4,096 subsets."""
    copies = [F.col("o_orderstatus").alias(f"status{i:02d}") for i in range(12)]
    tx = I.to_transactions(orders(spark, d).select("o_orderkey", "o_orderpriority", "o_orderdate", *copies), "o_orderkey")
    return I.maximal_frequent_itemsets(tx, SUPPORT).select(joined("items"), "freq", *six("support"))


def show_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("itemset_id", joined("items"), "freq", *six("support", "score"), "unique_id")


def details_text(c: str = "details"):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|").alias(c)


def stripped(spark: SparkSession, d: str) -> DataFrame:
    """On the itemsets of final orders, all of which have the status in common."""
    tx = I.to_transactions(P.normalize_nulls(orders(spark, d).where("o_orderstatus = 'F'"), "o_orderkey"), "o_orderkey")
    return I.strip_common_pairs(I.rank_itemsets(I.score_itemsets(I.maximal_frequent_itemsets(tx, 0.05), WEIGHTS), -1))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    g = I.group_by_pattern(I.strip_common_pairs(ranked(spark, d)))
    return g.select("pattern", "n_itemsets", "level", F.array_join(F.transform("itemset_ids", lambda x: x.cast("string")), "|").alias("itemset_ids"))


def unassigned(spark: SparkSession, d: str) -> DataFrame:
    _, held, _ = mined(spark, d, 1)
    return I.unassigned_rows(orders(spark, d), held, "o_orderkey")


def listing(spark: SparkSession, d: str) -> DataFrame:
    itemsets, members, _ = mined(spark, d)
    x = I.rank_listing(I.strip_common_pairs(itemsets), members)
    return x.select("itemset_id", "pattern", details_text(), "n_rows", F.array_join(F.transform("example_rows", lambda v: v.cast("string")), "|").alias("example_rows"))


def maximal_lineitem(spark: SparkSession, d: str) -> DataFrame:
    tx = I.to_transactions(P.normalize_nulls(lineitem_parts(spark, d), "l_orderkey"), "l_orderkey")
    return I.maximal_frequent_itemsets(tx, 0.1).select(joined("items"), "freq", *six("support"))


def four_tables(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order, customer and part: nine categorical columns (the bench input)."""
    o, c, p, x = (table(spark, d, n) for n in ("orders", "customer", "part", "lineitem"))
    j = x.join(o, x["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, x["l_partkey"] == p["p_partkey"])
    return j.select(
        "l_orderkey", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "l_linenumber", "p_type", F.quarter("l_shipdate").alias("quarter"), F.date_format("o_orderdate", "EEEE").alias("weekday")
    )


def maximal_four_tables(spark: SparkSession, d: str) -> DataFrame:
    tx = I.to_transactions(P.normalize_nulls(four_tables(spark, d), "l_orderkey"), "l_orderkey")
    return I.maximal_frequent_itemsets(tx, 0.1).select(joined("items"), "freq", *six("support"))


def ranked_custkeys(spark: SparkSession, d: str) -> DataFrame:
    """The whole of mining on a table with a frequent-value column in which some cells spell a null, and dates."""
    key = F.when(F.col("o_orderkey") % 50 == 0, "NULL").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey")
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", key, "o_orderdate")
    return I.rank_maximal_itemsets(x, "o_orderkey")[1].select("itemset_id", joined("items"), "freq", *six("support", "score"), "unique_id")


# ---- clusters


def pairwise(spark: SparkSession, d: str) -> DataFrame:
    itemsets, _, overlaps = mined(spark, d)
    return C.pairwise_similarity(itemsets, None, overlaps)


def fixed(spark: SparkSession, d: str):
    """A fixed assignment: itemsets with a priority in clusters 2 and 3, the others in 0 and 1, by even and odd ids."""
    itemsets, members, _ = mined(spark, d)
    cluster = F.when(F.exists("items", lambda x: x.startswith("o_orderpriority")), 2).otherwise(0) + F.col("itemset_id") % 2
    return itemsets.select("itemset_id", cluster.cast("int").alias("cluster")), itemsets, members


def constants_of_final(spark: SparkSession, d: str) -> DataFrame:
    """Of final orders all itemsets hold the status: it is constant over all clusters."""
    tx = I.to_transactions(P.normalize_nulls(orders(spark, d).where("o_orderstatus = 'F'"), "o_orderkey"), "o_orderkey")
    itemsets = I.rank_itemsets(I.score_itemsets(I.maximal_frequent_itemsets(tx, 0.05), WEIGHTS), -1)
    return C.constant_columns_across_clusters(itemsets.select("itemset_id", (F.col("itemset_id") % 3).alias("cluster")), I.itemset_pairs(itemsets))


def fixed_clusters(spark: SparkSession, d: str):
    assign, itemsets, members = fixed(spark, d)
    none = spark.createDataFrame([], "col string, val string")
    return materialize(C.cluster_metadata(assign, itemsets, members, none).withColumnRenamed("cluster", "position")), itemsets, members


def fixed_report(spark: SparkSession, d: str) -> DataFrame:
    clusters, itemsets, members = fixed_clusters(spark, d)
    return C.cluster_report(clusters, spark.createDataFrame([], "col string, val string"), itemsets, members)


def show_report(r: DataFrame) -> DataFrame:
    """A row for each itemset of each cluster of a report."""
    x = r.select("name", "size", "row_coverage", *six("row_coverage_percent", "avg_support"), joined("common_columns"), F.explode("itemsets").alias("x")).select("*", "x.*").drop("x")
    return x.withColumns({"support": F.round("support", 6), "matching_rows_percent": F.round("matching_rows_percent", 6), "example_rows": F.array_join("example_rows", "|")})


def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The report written as JSON to the shared folder and read back."""
    report, path = fixed_report(spark, d), work_dir(spark)
    S.write_report(report, path)
    return show_report(spark.read.schema(report.schema).json(path))


def show_clusters(c: DataFrame) -> DataFrame:
    return c.select("position", "size", F.array_join(F.transform("itemset_indices", lambda x: x.cast("string")), "|").alias("itemset_indices"), joined("common_columns"), joined("all_columns"), "row_coverage", *six("row_coverage_percent", "avg_support"))


def clustered(spark: SparkSession, d: str, threshold: float = 0.4):
    itemsets, members, overlaps = mined(spark, d)
    clusters, constants = C.cluster_itemsets(itemsets, members, threshold, overlaps)
    return clusters, constants, itemsets, members


def report(spark: SparkSession, d: str) -> DataFrame:
    r = C.cluster_report(*clustered(spark, d))
    constants = F.array_join(F.transform(F.map_entries(F.coalesce("constant_columns", F.expr("cast(map() as map<string,string>)"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return show_report(r).join(r.select("name", constants.alias("constant_columns")), "name")


def graph(spark: SparkSession, d: str) -> DataFrame:
    clusters, _, itemsets, _ = clustered(spark, d)
    return C.cluster_graph(clusters, itemsets)[1]


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    clusters, _, itemsets, _ = clustered(spark, d)
    return C.cluster_graph(clusters, itemsets)[0].select("node", "kind", "size", "row_coverage", *six("support"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    clusters, _, itemsets, _ = clustered(spark, d)
    return C.cluster_hierarchy(clusters, itemsets)


# ---- search


def near(spark: SparkSession, d: str) -> DataFrame:
    itemsets, members, overlaps = mined(spark, d)
    return Q.similar_itemsets(itemsets, members, 0, overlaps=overlaps).select("itemset_id", *six("score"), details_text(), "n_rows", "rank")


def near_overlap(spark: SparkSession, d: str) -> DataFrame:
    itemsets, members, overlaps = mined(spark, d)
    return Q.similar_itemsets_overlap(itemsets, members, 0, overlaps=overlaps).select("itemset_id", *six("score"), "n_rows", "rank", "overlap", *six("percent_of_target", "percent_of_other"))


def all_near(spark: SparkSession, d: str) -> DataFrame:
    itemsets, members, overlaps = mined(spark, d)
    return Q.all_similar_itemsets(itemsets, members, 3, overlaps).select("target", "itemset_id", *six("score"), "rank")


def near_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Q.similar_clusters(*fixed_clusters(spark, d), 0).select("cluster", *six("col_similarity", "row_similarity", "score"), "rank")


def near_clusters_overlap(spark: SparkSession, d: str) -> DataFrame:
    return Q.similar_clusters_overlap(*fixed_clusters(spark, d), 0).select("cluster", *six("score"), "rank", "overlap", *six("percent_of_target", "percent_of_other"), "row_coverage", "top_values")


# ---- learning


def rankings(spark: SparkSession, d: str, k: int) -> DataFrame:
    """A session for each region: the itemsets from place r on, then the earlier ones; regions 3 and 4 rank one too few and one twice."""
    r = table(spark, d, "region")
    key = F.col("r_regionkey")
    whole = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: ((i + key) % k).cast("int"))
    ranking = F.when(key == 3, F.slice(whole, 1, k - 1)).when(key == 4, F.concat(F.slice(whole, 1, k - 1), F.slice(whole, 1, 1))).otherwise(whole)
    return r.select(F.concat(F.lit("r"), key.cast("string")).alias("session"), ranking.alias("ranking"))


def valid(spark: SparkSession, d: str) -> DataFrame:
    k = ranked(spark, d).count()
    return L.valid_rankings(rankings(spark, d, k), k).select("session", F.array_join(F.transform("ranking", lambda x: x.cast("string")), "|").alias("ranking"))


def preferences(spark: SparkSession, d: str):
    itemsets = materialize(ranked(spark, d))
    k = itemsets.count()
    return L.preference_pairs(L.valid_rankings(rankings(spark, d, k), k), itemsets), itemsets


def learned(spark: SparkSession, d: str) -> DataFrame:
    itemsets = materialize(ranked(spark, d))
    k = itemsets.count()
    return L.update_weights(L.valid_rankings(rankings(spark, d, k), k), itemsets, WEIGHTS, 0.5, L.setting(spark)).select("session", *six("gamma"), *shown_weights())


def shown_weights():
    return [F.round(F.col("weights")[c], 6).alias(c) for c in sorted(WEIGHTS)]


def rate_grid(spark: SparkSession, d: str) -> DataFrame:
    itemsets = materialize(ranked(spark, d))
    k = itemsets.count()
    grid = L.learning_rate_grid(itemsets, rankings(spark, d, k).where("session = 'r1'"), WEIGHTS)
    return grid.select("session", "lr_weights", "lr_gamma", *six("mean_weight_change", "gamma_change", "gamma"), "rank_distance", "rank_distance_ref")


def trained(spark: SparkSession, d: str) -> DataFrame:
    out = L.train(orders(spark, d), "o_orderkey", rankings(spark, d, trained_itemsets(spark, d)), WEIGHTS, unique_ids=True)
    return out["itemsets"].select("itemset_id", joined("items"), "freq", *six("support", "score"))


def trained_itemsets(spark: SparkSession, d: str) -> int:
    return I.rank_maximal_itemsets(orders(spark, d), "o_orderkey", WEIGHTS, 0.1, -1, 0.7)[1].count()


def train_save_load(spark: SparkSession, d: str) -> DataFrame:
    """What training saves for orders, loaded again, beside a configuration that was there before and must stay."""
    path = work_dir(spark)
    S.save_config(spark.createDataFrame([("customer", {"c_mktsegment": 0.25}, 0.2, 3, 0.6, 0.1, 0.2)], S.CONFIG), path)
    L.train(orders(spark, d), "o_orderkey", rankings(spark, d, trained_itemsets(spark, d)), WEIGHTS, table_name="orders", path=path, unique_ids=True)
    loaded = [S.load_config(spark, path, name, columns, "cluster") for name, columns in (("orders", sorted(WEIGHTS)), ("customer", ["c_mktsegment"]))]
    rows = [(x["table_name"], c, w, x["gamma"], x["min_support"], x["max_collection"]) for x in loaded for c, w in sorted(x["weights"].items())]
    return spark.createDataFrame(rows, "table_name string, col string, weight double, gamma double, min_support double, max_collection int").withColumns({c: F.round(c, 6) for c in ("weight", "gamma")})


# ---- sources and workflows


def config_round_trip(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").count()
    row = ("orders", {"o_orderstatus": 0.5}, 0.1, -1, 0.7, 0.12, 0.8)
    path = work_dir(spark)
    S.save_config(spark.createDataFrame([row], S.CONFIG), path)
    back = S.load_config(spark, path, "orders", table(spark, d, "orders").columns)
    return spark.createDataFrame([(k, v, n) for k, v in sorted(back["weights"].items())], "col string, weight double, n_rows long")


def config_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of three tables saved in turn, one of them twice; each weight is the share of the column's distinct values."""
    path = work_dir(spark)
    names = {"orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_mktsegment", "c_nationkey"], "part": ["p_brand", "p_type"]}
    for name, columns in [("orders", ["o_orderstatus"]), *names.items()]:
        n = table(spark, d, name).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in columns]).first()
        S.save_config(spark.createDataFrame([(name, {c: n[c] / n["n"] for c in columns}, 0.1, -1, 0.7, 0.12, 0.8)], S.CONFIG), path)
    rows = [(name, c, w) for name, columns in names.items() for c, w in S.load_config(spark, path, name, columns, "cluster")["weights"].items()]
    return spark.createDataFrame(rows, "table_name string, col string, weight double").withColumn("weight", F.round("weight", 6))


def report_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Reports of two tables in one folder; the second is written again with its first cluster only, and the first stays."""
    report, path = materialize(fixed_report(spark, d)), work_dir(spark)
    named = lambda r, name: r.withColumn("table_name", F.lit(name))
    for part in (named(report, "orders"), named(report, "again"), named(report.where("name = 'CLUSTER_0'"), "again")):
        S.write_report(part, path)
    back = spark.read.schema(named(report, "").schema).json(path)
    shown = [show_report(back.where(F.col("table_name") == name)).withColumn("table_name", F.lit(name)) for name in ("orders", "again")]
    return shown[0].unionByName(shown[1])


def listed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Given tables saved in a database of their own, with two views over them; the catalog's counts."""
    path = work_dir(spark)
    database = f"listed_{path[-8:]}"
    tables = {n: table(spark, d, n) for n in ("region", "nation", "orders", "events")}
    views = {"final_orders": f"SELECT * FROM {database}.orders WHERE o_orderstatus = 'F'", "places": f"SELECT n_name, r_name FROM {database}.nation JOIN {database}.region ON n_regionkey = r_regionkey"}
    S.save_database(spark, database, tables, views, path)
    found = S.list_tables(spark, database).collect()  # a row for each table
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame([tuple(r) for r in found], "name string, kind string, n_tables int, n_views int, n_rows long")


def whole_table(spark: SparkSession, d: str) -> DataFrame:
    out = mine_and_cluster(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", {"min_support": 0.03, "max_collection": -1, "gamma": 0.7})
    return show_clusters(out["clusters"])


def whole_database(spark: SparkSession, d: str) -> DataFrame:
    names = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "labels": "doc_id"}
    out = analyze_database(spark, {n: table(spark, d, n) for n in names}, names, strict=True)
    return out["reports"].select("table_name", "name", "size", "row_coverage", *six("row_coverage_percent", "avg_support"))


QUERIES = {
    "value_counts_orders": lambda s, d: P.value_counts(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "column_profile_customer": profiled,
    "column_distributions_lineitem": distributions,
    "describe_part": lambda s, d: S.describe_table(table(s, d, "part")),
    "sample_rows_pages": lambda s, d: S.sample_rows(table(s, d, "pages"), key="page_id"),
    "round_floats_lineitem": lambda s, d: P.round_floats(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "constant_columns_lineitem": lambda s, d: names_of(s, P.constant_columns(P.round_floats(table(s, d, "lineitem")))),
    "unique_columns_events": lambda s, d: names_of(s, P.unique_columns(table(s, d, "events"), "event_id")),
    "prepare_lineitem": lambda s, d: P.prepare_data(table(s, d, "lineitem")),
    "correlated_groups_orders": lambda s, d: s.createDataFrame([("|".join(g),) for g in P.correlated_column_groups(correlated(s, d), "o_orderkey")], "columns string"),
    "drop_correlated_orders": drop_correlated,
    "prepared_columns_lineitem": lambda s, d: names_of(s, P.prepare_data(table(s, d, "lineitem")).columns),
    "datetime_columns_text_orders": text_dates,
    "datetime_columns_events": lambda s, d: names_of(s, P.datetime_columns(table(s, d, "events"))),
    "bucket_time_of_day_events": lambda s, d: P.bucket_datetime(table(s, d, "events").select("event_id", "ts"), "ts", "time_of_day"),
    "bucket_day_of_week_orders": lambda s, d: P.bucket_datetime(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "day_of_week"),
    "bucket_season_orders": lambda s, d: P.bucket_datetime(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "season"),
    "bucket_year_orders": lambda s, d: P.bucket_datetime(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "year"),
    "bucket_top10_part": lambda s, d: P.bucket_categorical(table(s, d, "part").select("p_partkey", "p_name"), "p_name", 10),
    "high_cardinality_events": lambda s, d: P.high_cardinality_columns(table(s, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long")), 200, "event_id").select("col", "n_unique", "kind", joined("samples")),
    "apply_buckets_events": lambda s, d: P.apply_buckets(table(s, d, "events"), {"ts": "season", "user_id": "top10", "props": "drop", "value": "drop"}, "event_id"),
    "normalize_nulls_documents": lambda s, d: P.normalize_nulls(derived_nulls(s, d), "doc_id"),
    "describe_columns_orders": described,
    "zero_weight_orders": zero_weight,
    "transactions_orders": lambda s, d: tx_of(s, d).select("row_id", F.array_join(F.array_sort("items"), "|").alias("items")),
    "frequent_orders": lambda s, d: I.frequent_itemsets(tx_of(s, d), SUPPORT).select(joined("items"), "freq"),
    "frequent_fpgrowth_orders": lambda s, d: I.frequent_itemsets_fpgrowth(tx_of(s, d), SUPPORT).select(joined("items"), "freq"),
    "maximal_orders": lambda s, d: maximal(s, d).select(joined("items"), "freq", *six("support")),
    "maximal_lineitem": maximal_lineitem,
    "maximal_four_tables": maximal_four_tables,
    "scored_orders": lambda s, d: I.score_itemsets(maximal(s, d), WEIGHTS, 0.5).select(joined("items"), *six("score")),
    "ranked_orders": show_ranked,
    "membership_orders": membership,
    "membership_many_orders": membership_many,
    "maximal_copies_orders": maximal_copies,
    "itemset_pairs_orders": lambda s, d: I.itemset_pairs(ranked(s, d)),
    "strip_common_orders": lambda s, d: stripped(s, d).select("itemset_id", details_text()),
    "patterns_orders": patterns,
    "rank_maximal_orders": ranked_custkeys,
    "unassigned_orders": unassigned,
    "rank_listing_orders": listing,
    "pairwise_orders": lambda s, d: pairwise(s, d).select("i", "j", *six("col_similarity", "row_similarity", "similarity", "distance")),
    "linkage_orders": lambda s, d: C.linkage_table(pairwise(s, d)).select("step", "left", "right", *six("distance"), "size"),
    "cut_clusters_orders": lambda s, d: C.cut_clusters(ranked(s, d), C.linkage_table(pairwise(s, d)), 0.4),
    "similarity_matrix_orders": lambda s, d: C.similarity_matrix(ranked(s, d), pairwise(s, d)).select("i", "j", *six("similarity")),
    "common_columns_orders": lambda s, d: C.common_columns(fixed(s, d)[0], I.itemset_pairs(ranked(s, d))),
    "value_distributions_orders": lambda s, d: C.value_distributions(fixed(s, d)[0], I.itemset_pairs(ranked(s, d))),
    "constant_across_clusters_orders": constants_of_final,
    "cluster_metadata_orders": lambda s, d: show_clusters(fixed_clusters(s, d)[0]),
    "clusters_orders": lambda s, d: show_clusters(clustered(s, d)[0]),
    "cluster_report_orders": report,
    "fixed_report_orders": lambda s, d: show_report(fixed_report(s, d)),
    "report_round_trip_orders": report_round_trip,
    "cluster_overlap_orders": lambda s, d: C.cluster_overlap(fixed(s, d)[0], fixed(s, d)[2]).select("i", "j", *six("jaccard")),
    "cluster_graph_orders": graph,
    "cluster_graph_nodes_orders": graph_nodes,
    "cluster_hierarchy_orders": hierarchy,
    "fixed_graph_orders": lambda s, d: C.cluster_graph(*fixed_clusters(s, d)[:2])[1],
    "fixed_graph_nodes_orders": lambda s, d: C.cluster_graph(*fixed_clusters(s, d)[:2])[0].select("node", "kind", "size", "row_coverage", *six("support")),
    "fixed_hierarchy_orders": lambda s, d: C.cluster_hierarchy(*fixed_clusters(s, d)[:2]),
    "similar_itemsets_orders": near,
    "similar_itemsets_overlap_orders": near_overlap,
    "all_similar_itemsets_orders": all_near,
    "similar_clusters_orders": near_clusters,
    "similar_clusters_overlap_orders": near_clusters_overlap,
    "valid_rankings_orders": valid,
    "preference_pairs_orders": lambda s, d: preferences(s, d)[0].select("session", "step", "a", "b", *six("supp_a", "supp_b")),
    "update_weights_orders": learned,
    "learning_rate_grid_orders": rate_grid,
    "train_orders": trained,
    "list_tables_small": listed_tables,
    "config_round_trip_orders": config_round_trip,
    "config_two_tables": config_two_tables,
    "report_two_tables": report_two_tables,
    "train_save_load_orders": train_save_load,
    "mine_and_cluster_customer": whole_table,
    "analyze_database_small": whole_database,
}
