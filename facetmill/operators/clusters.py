"""Clusters of itemsets: pairwise similarity, average linkage, flat clusters and what describes them.

Row-level work (which rows two itemsets or clusters share, how many rows a cluster covers) is one pass with sums in each task; everything else
works on the mined result.  Where row ids are unique, give the rows with the itemsets that they hold (itemsets.matches) as members: then nothing is shuffled by row id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.functions.incidence import PAIRS, pair_counts
from facetmill.functions.items import item_column
from facetmill.functions.linkage import average_linkage
from facetmill.operators.itemsets import has_matches, itemset_pairs, supporting_rows
from facetmill.sources.work import materialize

SLACK = 1e-12  # for the inclusive cut
LINKAGE = "step int, left int, right int, distance double, size int"


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast the mined result only up to a counted number of rows; beyond it Spark shuffles as usual."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def columns_of(items):
    return F.array_distinct(F.transform(items, item_column))


def row_overlaps(members: DataFrame) -> DataFrame:
    """(i, j, nij) for i <= j: how many distinct row ids two itemsets share; nii is the itemset's own number.  members as for has_matches."""
    if has_matches(members):
        return overlaps_in_rows(members)
    return overlaps_in_rows(members.groupBy("row_id").agg(F.collect_set("itemset_id").alias("matches")))  # at most k ids for a row


def overlaps_in_rows(matched: DataFrame) -> DataFrame:
    """The same from (row_id, matches) when row ids are unique: each task multiplies the matrix of its rows and itemsets with itself, and no pair of a row is written out."""
    counted = matched.select(F.col("matches").cast("array<int>").alias("matches")).mapInArrow(pair_counts, PAIRS)
    return counted.groupBy("i", "j").agg(F.sum("n").alias("nij"))


def clusters_in_rows(assign: DataFrame, held: DataFrame) -> DataFrame:
    """(row_id, matches): of rows with the itemsets that they hold, the clusters of these, each once; worked out in the row."""
    cluster = {r["itemset_id"]: r["cluster"] for r in assign.select("itemset_id", "cluster").collect()}  # the mined result
    if not cluster:
        return held.select("row_id", F.array().cast("array<int>").alias("matches"))
    by_id = ",".join(str(cluster.get(i, "")) for i in range(max(cluster) + 1))  # a cluster for each place, none for itemsets of no cluster
    table = F.split(F.lit(by_id), ",").try_cast("array<int>")
    return held.select("row_id", F.array_distinct(F.array_compact(F.transform("matches", lambda m: F.get(table, m)))).alias("matches"))


def pairwise_similarity(itemsets: DataFrame, members: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """(i, j, col_similarity, row_similarity, similarity, distance) of every pair i < j, also of those without a common row."""
    o = materialize(row_overlaps(members) if overlaps is None else overlaps)  # k * k numbers, used twice
    own = o.where("i = j").select(F.col("i").alias("id"), F.col("nij").alias("n"))
    s = itemsets.select("itemset_id", columns_of(F.col("items")).alias("cols")).join(own, F.col("itemset_id") == F.col("id"), "left").select("itemset_id", "cols", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = s.select(*[F.col(c).alias(f"{c}_a") for c in s.columns]), s.select(*[F.col(c).alias(f"{c}_b") for c in s.columns])
    pairs = a.join(b, F.col("itemset_id_a") < F.col("itemset_id_b"))  # k itemsets on both sides
    shared = o.where("i < j").select("i", "j", "nij")
    p = pairs.join(shared, (F.col("itemset_id_a") == F.col("i")) & (F.col("itemset_id_b") == F.col("j")), "left").withColumn("both", F.coalesce("nij", F.lit(0)))
    union_cols = F.size(F.array_union("cols_a", "cols_b"))
    col_sim = F.when(union_cols > 0, F.size(F.array_intersect("cols_a", "cols_b")) / union_cols).otherwise(0.0)
    union_rows = F.col("n_a") + F.col("n_b") - F.col("both")
    row_sim = F.when(union_rows > 0, F.col("both") / union_rows).otherwise(0.0)
    out = p.select(F.col("itemset_id_a").alias("i"), F.col("itemset_id_b").alias("j"), col_sim.alias("col_similarity"), row_sim.alias("row_similarity"))
    out = out.withColumn("similarity", (F.col("col_similarity") + F.col("row_similarity")) / 2)
    return out.withColumn("distance", 1 - F.col("similarity"))


def linkage_table(pairs: DataFrame, group: str = "table_name") -> DataFrame:
    """(step, left, right, distance, size) of average linkage; pairs of many tables (a column `group`) are linked at once.

    A table's k itemsets take k * k doubles and their k * k / 2 pairs in one task: 3 GB and as much again for k = 20,000; mine fewer, or rank and keep the first, beyond that.
    """
    grouped = group in pairs.columns

    def link(p: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[p["i"], p["j"]])
        d = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, p["i"]), np.searchsorted(ids, p["j"])
        d[i, j] = d[j, i] = p["distance"]
        out = pd.DataFrame(average_linkage(ids, d), columns=["step", "left", "right", "distance", "size"])
        if grouped:
            out.insert(0, group, p[group].iloc[0] if len(p) else None)
        return out

    keyed = pairs if grouped else pairs.withColumn("_one", F.lit(0))
    return keyed.groupBy(group if grouped else "_one").applyInPandas(link, (f"{group} string, " if grouped else "") + LINKAGE)  # k x k numbers of a table


def cut_clusters(itemsets: DataFrame, linkage: DataFrame, similarity_threshold: float = 0.4, group: str = "table_name") -> DataFrame:
    """(itemset_id, cluster): flat clusters of all merges at a distance of at most 1 - threshold, named by their smallest itemset.

    Average linkage never merges at a smaller distance than before, so the merges up to the cut form a forest.
    """
    grouped = group in linkage.columns
    keys = [group] if grouped else []

    def cut(key, ids: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {int(i): int(i) for i in ids["itemset_id"]}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for left, right, distance in links.sort_values("step")[["left", "right", "distance"]].itertuples(index=False):
            if distance <= 1 - similarity_threshold + SLACK:
                a, b = find(int(left)), find(int(right))
                root[max(a, b)] = min(a, b)
        out = pd.DataFrame({"itemset_id": sorted(root), "cluster": [find(i) for i in sorted(root)]}, dtype="int32")
        if grouped:
            out.insert(0, group, key[0])
        return out

    one = lambda d: d if grouped else d.withColumn("_one", F.lit(0))
    by = group if grouped else "_one"
    a = one(itemsets.select(*keys, "itemset_id"))
    return a.groupBy(by).cogroup(one(linkage).groupBy(by)).applyInPandas(cut, (f"{group} string, " if grouped else "") + "itemset_id int, cluster int")  # k ids of a table


def similarity_matrix(itemsets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, similarity): both halves and the diagonal."""
    up = pairs.select("i", "j", "similarity")
    down = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity")
    return up.unionByName(down).unionByName(itemsets.select(F.col("itemset_id").alias("i"), F.col("itemset_id").alias("j"), F.lit(1.0).alias("similarity")))


def _sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("itemset_id").alias("first_id"))


def common_columns(assign: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, col): columns that all itemsets of a cluster have; cells as from itemset_pairs."""
    n = assign.join(cells, "itemset_id").groupBy("cluster", "col").agg(F.count_distinct("itemset_id").alias("n"))
    return n.join(_sizes(assign), "cluster").where("n = size").select("cluster", "col")


def value_distributions(assign: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, col, val, count): itemsets of the cluster with the value."""
    return assign.join(cells, "itemset_id").groupBy("cluster", "col", "val").agg(F.count(F.lit(1)).alias("count"))


def constant_columns_across_clusters(assign: DataFrame, cells: DataFrame) -> DataFrame:
    """(col, val): columns that stand in every cluster with one value over all."""
    n = assign.agg(F.count_distinct("cluster").alias("n"))
    c = assign.join(cells, "itemset_id").groupBy("col").agg(F.count_distinct("cluster").alias("c"), F.count_distinct("val").alias("v"), F.min("val").alias("val"))
    return c.crossJoin(F.broadcast(n)).where("c = n and v = 1").select("col", "val")  # n is one row


def cluster_coverage(assign: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, row_coverage, row_coverage_percent): distinct rows of the cluster, and their share of the rows of any itemset; members as for has_matches."""
    if has_matches(members):
        rows = clusters_in_rows(assign, members.select("row_id", "matches"))
        counts = rows.select(F.explode("matches").alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("row_coverage"))
        total = members.where(F.size("matches") > 0).agg(F.count(F.lit(1)).alias("total"))
    else:
        covered = members.join(small(assign.select("itemset_id", "cluster")), "itemset_id").select("cluster", "row_id").distinct()
        counts = covered.groupBy("cluster").agg(F.count(F.lit(1)).alias("row_coverage"))
        total = members.select("row_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("cluster", "row_coverage", (F.col("row_coverage") / F.col("total")).alias("row_coverage_percent"))  # total is one row


def cluster_metadata(assign: DataFrame, itemsets: DataFrame, members: DataFrame, constants: DataFrame) -> DataFrame:
    """A row for each cluster; distributions and common columns leave the constants out, all_columns has them."""
    cells = itemset_pairs(itemsets)
    common = common_columns(assign, cells).join(constants, "col", "left_anti")
    spread = value_distributions(assign, cells).join(common, ["cluster", "col"]).groupBy("cluster", "col").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("val", "count")))).alias("values"))
    spread = spread.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "values")), lambda a, b: F.when(a["col"] < b["col"], -1).when(a["col"] > b["col"], 1).otherwise(0))).alias("value_distributions"))
    named = common.groupBy("cluster").agg(F.array_sort(F.collect_list("col")).alias("common_columns"))
    every = assign.join(cells, "itemset_id").groupBy("cluster").agg(F.array_sort(F.collect_set("col")).alias("all_columns"))
    base = assign.join(itemsets.select("itemset_id", "support"), "itemset_id").groupBy("cluster").agg(
        F.count(F.lit(1)).cast("int").alias("size"), F.array_sort(F.collect_list("itemset_id")).alias("itemset_indices"), F.avg("support").alias("avg_support")
    )
    out = base.join(named, "cluster", "left").join(every, "cluster").join(spread, "cluster", "left").join(cluster_coverage(assign, members), "cluster", "left")
    return out.select(
        "cluster",
        "size",
        "itemset_indices",
        F.coalesce("common_columns", F.array().cast("array<string>")).alias("common_columns"),
        "all_columns",
        F.coalesce("value_distributions", F.expr("cast(map() as map<string,map<string,bigint>>)")).alias("value_distributions"),
        F.coalesce("row_coverage", F.lit(0)).cast("long").alias("row_coverage"),
        F.coalesce("row_coverage_percent", F.lit(0.0)).alias("row_coverage_percent"),
        "avg_support",
    )


def cluster_itemsets(itemsets: DataFrame, members: DataFrame, similarity_threshold: float = 0.4, overlaps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, constants): linked, cut and described, see describe_clusters."""
    pairs = pairwise_similarity(itemsets, members, overlaps)
    return describe_clusters(itemsets, members, materialize(cut_clusters(itemsets, linkage_table(pairs), similarity_threshold)))


def describe_clusters(itemsets: DataFrame, members: DataFrame, assign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, constants): clusters without a common column go, the rest is numbered by size, then first itemset."""
    constants = constant_columns_across_clusters(assign, itemset_pairs(itemsets))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("size"), "cluster")  # the mined result
    kept = cluster_metadata(assign, itemsets, members, constants).where("size(common_columns) > 0").withColumn("position", F.row_number().over(order) - 1)
    return materialize(kept.select("position", *[c for c in kept.columns if c not in ("position", "cluster")])), materialize(constants)


def cluster_report(clusters: DataFrame, constants: DataFrame, itemsets: DataFrame, members: DataFrame, examples: int = 5) -> DataFrame:
    """A nested record CLUSTER_i for each cluster, with its itemsets, their rows and example row ids; constants on every record."""
    ids = clusters.select("position", "row_coverage", F.explode("itemset_indices").alias("itemset_id"))
    cells = itemset_pairs(itemsets).join(constants, "col", "left_anti")
    details = cells.groupBy("itemset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "val")))).alias("details"))
    support = supporting_rows(members, examples).select("itemset_id", F.col("n_rows").alias("rows"), F.array_sort(F.col("example_rows").cast("array<string>")).alias("example_rows"))
    rows = ids.join(itemsets.select("itemset_id", "support"), "itemset_id").join(details, "itemset_id", "left").join(support, "itemset_id", "left")
    percent = F.when(F.col("row_coverage") > 0, 100 * F.col("rows") / F.col("row_coverage")).otherwise(0.0)
    nested = rows.groupBy("position").agg(
        F.array_sort(
            F.collect_list(F.struct("itemset_id", "support", F.to_json("details").alias("details"), F.col("rows").alias("matching_rows_count"), percent.alias("matching_rows_percent"), "example_rows"))
        ).alias("itemsets")
    )
    fixed = constants.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "val")))).alias("constant_columns"))
    out = clusters.drop("itemset_indices").join(nested, "position").crossJoin(F.broadcast(fixed))  # one row
    return out.select(
        F.concat(F.lit("CLUSTER_"), "position").alias("name"),
        "size",
        "row_coverage",
        (F.col("row_coverage_percent") * 100).alias("row_coverage_percent"),
        "avg_support",
        "common_columns",
        "all_columns",
        "value_distributions",
        "itemsets",
        "constant_columns",
    )


def cluster_row_overlaps(assign: DataFrame, members: DataFrame) -> DataFrame:
    """row_overlaps of clusters instead of itemsets; members as for has_matches."""
    if has_matches(members):
        return overlaps_in_rows(clusters_in_rows(assign, members))
    return row_overlaps(members.join(small(assign), "itemset_id").select(F.col("cluster").alias("itemset_id"), "row_id").distinct())


def cluster_overlap(assign: DataFrame, members: DataFrame) -> DataFrame:
    """(i, j, jaccard) of the row sets of all pairs of clusters, the diagonal included."""
    o = materialize(cluster_row_overlaps(assign, members))  # as many numbers as pairs of clusters, used twice
    own = o.where("i = j").select(F.col("i").alias("id"), F.col("nij").alias("n"))
    names = assign.select("cluster").distinct().join(own, F.col("cluster") == F.col("id"), "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = names.select(F.col("cluster").alias("a"), F.col("n").alias("na")), names.select(F.col("cluster").alias("b"), F.col("n").alias("nb"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    p = a.crossJoin(b).join(o, (low == F.col("i")) & (high == F.col("j")), "left").withColumn("both", F.coalesce("nij", F.lit(0)))  # clusters only
    union = F.col("na") + F.col("nb") - F.col("both")
    return p.select(F.col("a").alias("i"), F.col("b").alias("j"), F.when(F.col("a") == F.col("b"), 1.0).when(union > 0, F.col("both") / union).otherwise(0.0).alias("jaccard"))


def cluster_graph(clusters: DataFrame, itemsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): clusters and their itemsets, an edge of weight 1 between them."""
    name = F.concat(F.lit("cluster_"), "position")
    nodes = clusters.select(name.alias("node"), F.lit("cluster").alias("kind"), "size", "row_coverage")
    ids = clusters.select(name.alias("source"), F.explode("itemset_indices").alias("itemset_id"))
    leaf = F.concat(F.lit("itemset_"), "itemset_id")
    leaves = ids.join(itemsets, "itemset_id").select(leaf.alias("node"), F.lit("itemset").alias("kind"), "support")
    return nodes.unionByName(leaves, allowMissingColumns=True), ids.select("source", leaf.alias("target"), F.lit(1.0).alias("weight"))


def cluster_hierarchy(clusters: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(label, parent, value): root (100), clusters (row coverage), itemsets (rows)."""
    root = clusters.sparkSession.createDataFrame([("Root", "", 100.0)], "label string, parent string, value double")
    name = F.concat(F.lit("Cluster "), "position")
    middle = clusters.select(name.alias("label"), F.lit("Root").alias("parent"), F.col("row_coverage").cast("double").alias("value"))
    ids = clusters.select(name.alias("parent"), F.explode("itemset_indices").alias("itemset_id"))
    leaves = ids.join(itemsets, "itemset_id").select(F.concat(F.lit("Itemset "), "itemset_id").alias("label"), "parent", F.col("freq").cast("double").alias("value"))
    return root.unionByName(middle).unionByName(leaves)
