"""Nearest itemsets and nearest clusters; members everywhere as for itemsets.has_matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.operators.clusters import cluster_row_overlaps, columns_of, row_overlaps, small
from facetmill.operators.itemsets import itemset_pairs, items_to_map
from facetmill.sources.work import materialize


def _measured(itemsets: DataFrame, members: DataFrame, target: int | None, overlaps: DataFrame | None = None) -> DataFrame:
    """(target, itemset_id, score, overlaps): half equal pairs over the union of columns, half Jaccard of the row sets.

    overlaps: as from clusters.overlaps_in_rows, which needs no shuffle where row ids are unique.
    """
    o = materialize(row_overlaps(members) if overlaps is None else overlaps)  # k * k numbers, used twice
    own = o.where("i = j").select(F.col("i").alias("id"), F.col("nij").alias("n"))
    s = itemsets.select("itemset_id", F.array_distinct("items").alias("items")).join(own, F.col("itemset_id") == F.col("id"), "left").select("itemset_id", "items", F.coalesce("n", F.lit(0)).alias("n"))
    a = s.select(F.col("itemset_id").alias("target"), F.col("items").alias("items_a"), F.col("n").alias("n_a"))
    a = a if target is None else a.where(F.col("target") == target)
    p = small(a).join(s, F.col("target") != F.col("itemset_id"))  # the mined result on both sides
    both = (F.least("target", "itemset_id") == F.col("i")) & (F.greatest("target", "itemset_id") == F.col("j"))
    p = p.join(o.where("i < j"), both, "left").withColumn("overlap", F.coalesce("nij", F.lit(0)))
    union = F.size(F.array_union(columns_of(F.col("items_a")), columns_of(F.col("items"))))
    column = F.when(union > 0, F.size(F.array_intersect("items_a", "items")) / union).otherwise(0.0)
    rows = F.col("n_a") + F.col("n") - F.col("overlap")
    row = F.when(rows > 0, F.col("overlap") / rows).otherwise(0.0)
    return p.select("target", "itemset_id", "items", column.alias("col_similarity"), row.alias("row_similarity"), (0.5 * column + 0.5 * row).alias("score"), "overlap")


def _best(measured: DataFrame, top_n: int, key: str, name: str) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc(F.round("score", 12)), name)
    return measured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def similar_itemsets(itemsets: DataFrame, members: DataFrame, itemset_id: int, top_n: int = 10, overlaps: DataFrame | None = None) -> DataFrame:
    """(itemset_id, score, details, n_rows, rank) of the nearest itemsets; empty for an unknown id."""
    best = _best(_measured(itemsets, members, itemset_id, overlaps), top_n, "target", "itemset_id").join(itemsets.select("itemset_id", "freq"), "itemset_id")
    return best.select("itemset_id", "score", items_to_map(F.col("items")).alias("details"), F.col("freq").alias("n_rows"), "rank")


def similar_itemsets_overlap(itemsets: DataFrame, members: DataFrame, itemset_id: int, top_n: int = 10, overlaps: DataFrame | None = None) -> DataFrame:
    """similar_itemsets with the number of common row ids and its share of both row lists (which count repeated ids)."""
    best = _best(_measured(itemsets, members, itemset_id, overlaps), top_n, "target", "itemset_id").join(itemsets.select("itemset_id", "freq"), "itemset_id")
    own = itemsets.where(F.col("itemset_id") == itemset_id).select(F.col("freq").alias("own"))
    share = lambda n: F.when(n > 0, 100 * F.col("overlap") / n).otherwise(0.0)
    return best.crossJoin(F.broadcast(own)).select(  # one row
        "itemset_id", "score", items_to_map(F.col("items")).alias("details"), F.col("freq").alias("n_rows"), "rank", "overlap", share(F.col("own")).alias("percent_of_target"), share(F.col("freq")).alias("percent_of_other")
    )


def all_similar_itemsets(itemsets: DataFrame, members: DataFrame, top_n: int = 10, overlaps: DataFrame | None = None) -> DataFrame:
    """(target, itemset_id, score, rank) for every target at once."""
    return _best(_measured(itemsets, members, None, overlaps), top_n, "target", "itemset_id").select("target", "itemset_id", "score", "rank")


def _cluster_measure(clusters: DataFrame, itemsets: DataFrame, members: DataFrame, cluster_id: int) -> DataFrame:
    """Of every other cluster: likeness of the value counts of all columns of both clusters, and of the row sets."""
    ids = clusters.select(F.col("position").alias("cluster"), F.explode("itemset_indices").alias("itemset_id"))
    spread = ids.join(itemset_pairs(itemsets), "itemset_id").groupBy("cluster", "col", "val").agg(F.count(F.lit(1)).alias("n"))
    mine = spread.where(F.col("cluster") == cluster_id).select("col", "val", F.col("n").alias("m"))
    others = spread.where(F.col("cluster") != cluster_id)
    shared = others.select("cluster", "col").distinct().join(mine.select("col").distinct(), "col")
    full = shared.join(mine, "col").join(others, ["cluster", "col", "val"], "full_outer").join(shared, ["cluster", "col"], "left_semi")
    full = full.select("cluster", "col", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("n", F.lit(0)).alias("n"))
    c = full.groupBy("cluster", "col").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("m") * F.col("n")).alias("dot"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("m").alias("m"), F.max("n").alias("n"))
    cosine = F.when((F.col("mm") > 0) & (F.col("nn") > 0), F.col("dot") / F.sqrt(F.col("mm").cast("double") * F.col("nn"))).otherwise(0.0)
    one = F.when(F.col("k") == 1, F.least("m", "n") / F.greatest("m", "n")).otherwise(cosine)
    summed = c.groupBy("cluster").agg(F.sum(one).alias("sum"))
    target = clusters.where(F.col("position") == cluster_id).select(F.col("all_columns").alias("mine"))
    union = clusters.where(F.col("position") != cluster_id).crossJoin(F.broadcast(target)).select(F.col("position").alias("cluster"), F.size(F.array_union("all_columns", "mine")).alias("columns"))  # one row
    o = materialize(cluster_row_overlaps(ids.select("itemset_id", "cluster"), members))  # as many numbers as pairs of clusters, used twice
    own = o.where("i = j").select(F.col("i").alias("id"), F.col("nij").alias("own"))
    rows = o.where(F.col("i") != F.col("j")).where((F.col("i") == cluster_id) | (F.col("j") == cluster_id)).select(F.when(F.col("i") == cluster_id, F.col("j")).otherwise(F.col("i")).alias("cluster"), "nij")
    t = own.where(F.col("id") == cluster_id).select(F.col("own").alias("target_rows"))
    out = union.join(summed, "cluster", "left").join(rows, "cluster", "left").join(own, F.col("cluster") == F.col("id"), "left").crossJoin(F.broadcast(t))  # one row
    overlap = F.coalesce("nij", F.lit(0))
    all_rows = F.coalesce("own", F.lit(0)) + F.col("target_rows") - overlap
    column = F.when(F.col("columns") > 0, F.coalesce("sum", F.lit(0.0)) / F.col("columns")).otherwise(0.0)
    row = F.when(all_rows > 0, overlap / all_rows).otherwise(0.0)
    return out.select("cluster", column.alias("col_similarity"), row.alias("row_similarity"), (0.5 * column + 0.5 * row).alias("score"), overlap.alias("overlap"), "own", "target_rows", F.lit(cluster_id).alias("target"))


def similar_clusters(clusters: DataFrame, itemsets: DataFrame, members: DataFrame, cluster_id: int, top_n: int = 5) -> DataFrame:
    """(cluster, col_similarity, row_similarity, score, rank) of the nearest clusters; empty if there is no other."""
    return _best(_cluster_measure(clusters, itemsets, members, cluster_id), top_n, "target", "cluster").select("cluster", "col_similarity", "row_similarity", "score", "rank")


def similar_clusters_overlap(clusters: DataFrame, itemsets: DataFrame, members: DataFrame, cluster_id: int, top_n: int = 5) -> DataFrame:
    """similar_clusters with common rows, their share of both clusters, coverage, and the top 3 values of each of the cluster's common columns."""
    best = _best(_cluster_measure(clusters, itemsets, members, cluster_id), top_n, "target", "cluster")
    values = clusters.select(F.col("position").alias("cluster"), F.explode("value_distributions").alias("col", "dist")).select("cluster", "col", F.explode("dist").alias("val", "n"))
    order = W.partitionBy("cluster", "col").orderBy(F.desc("n"), "val")
    top = values.withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("cluster", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "val"))), lambda x: x["val"]).alias("top"))
    top = top.groupBy("cluster").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "top"))))).alias("top_values"))
    share = lambda n: F.when(n > 0, 100 * F.col("overlap") / n).otherwise(0.0)
    return best.join(top, "cluster", "left").select(
        "cluster", "score", "rank", "overlap", share(F.col("target_rows")).alias("percent_of_target"), share(F.col("own")).alias("percent_of_other"), F.col("own").alias("row_coverage"), "top_values"
    )
