"""Whole workflows: one table from rows to a cluster report, and a whole database."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators.clusters import cluster_itemsets, cluster_report, cut_clusters, describe_clusters, linkage_table, pairwise_similarity, row_overlaps
from facetmill.operators.itemsets import group_by_pattern, matches, membership_of, rank_maximal_itemsets, strip_common_pairs, unassigned_rows
from facetmill.operators.prepare import drop_zero_weight, prepare_data
from facetmill.operators.search import similar_clusters, similar_itemsets
from facetmill.sources.tables import CLUSTER_DEFAULTS, DATABASE_DEFAULTS, describe_table, sample_rows
from facetmill.sources.work import materialize

log = logging.getLogger(__name__)
T = TypeVar("T")


def mined_table(df: DataFrame, row_id: str, config: dict | None = None, unique_ids: bool | None = None) -> dict[str, DataFrame]:
    """Mine, strip and group one table: itemsets, held (row_id, matches), rows (held if row ids are unique, else members), members, details, patterns, unassigned and overlaps.

    unique_ids: whether row ids are unique; None looks, which shuffles them.  Held is written to the shared folder, like all that is read several times.
    """
    config = CLUSTER_DEFAULTS | (config or {})
    weights = config.get("weights") or {c: 1 / max(1, len(df.columns) - 1) for c in df.columns if c != row_id}
    df, weights = drop_zero_weight(df, weights)
    tx, itemsets = rank_maximal_itemsets(df, row_id, weights, config["min_support"], config["max_collection"], config["gamma"], config.get("buckets"))
    itemsets = materialize(itemsets)
    held = materialize(matches(tx, itemsets))
    members = membership_of(held)
    if unique_ids is None:
        unique_ids = held.groupBy("row_id").count().where("count > 1").isEmpty()
    rows = held if unique_ids else members
    details = strip_common_pairs(itemsets)
    return {
        "itemsets": itemsets,
        "held": held,
        "rows": rows,
        "members": members,
        "details": details,
        "patterns": group_by_pattern(details),
        "unassigned": unassigned_rows(df, rows, row_id),
        "overlaps": materialize(row_overlaps(rows)),
    }


def mine_and_cluster(df: DataFrame, row_id: str, config: dict | None = None, similarity_threshold: float = 0.4, near_itemset: int | None = None, near_cluster: int | None = None, unique_ids: bool | None = None) -> dict[str, DataFrame]:
    """Mine, strip, group, cluster and report one table; searches on demand.  config as from load_config; what mined_table gives is in the result."""
    out = mined_table(df, row_id, config, unique_ids)
    itemsets, rows, overlaps = out["itemsets"], out["rows"], out["overlaps"]
    clusters, constants = cluster_itemsets(itemsets, rows, similarity_threshold, overlaps)
    out |= {"clusters": clusters, "constants": constants, "report": cluster_report(clusters, constants, itemsets, rows)}
    if near_itemset is not None:
        out["near_itemsets"] = similar_itemsets(itemsets, rows, near_itemset, overlaps=overlaps)
    if near_cluster is not None:
        out["near_clusters"] = similar_clusters(clusters, itemsets, rows, near_cluster)
    return out


def side_by_side(spark: SparkSession, work: dict[str, Callable[[], T]], most: int = 4, failed: dict[str, Exception] | None = None) -> dict[str, T]:
    """Results of functions that run Spark jobs, at most so many at once, each in a scheduler pool of its name.

    What fails is logged and left out; failed, where given, gets its exception by name.
    """

    def run(name: str, do: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return do()

    done = {}
    with ThreadPoolExecutor(max_workers=most) as threads:
        begun = {name: threads.submit(inheritable_thread_target(spark)(run), name, do) for name, do in work.items()}
        for name, future in begun.items():
            try:
                done[name] = future.result()
            except Exception as e:
                log.exception("table %s could not be analysed", name)
                if failed is not None:
                    failed[name] = e
    return done


def analyze_database(spark: SparkSession, tables: dict[str, DataFrame], row_ids: dict[str, str], views: dict[str, DataFrame] | None = None, unique_ids: bool | None = None, most: int = 4, strict: bool = False) -> dict[str, DataFrame]:
    """Reports of all tables with a row id (a column table_name), their schemas, a sample of each view, and failures (table_name, error).

    Tables are mined side by side, at most so many at once; their itemsets are linked and cut in one job for all, a group for each
    table; then the reports, which hold clusters only, are worked out side by side again.  A table that fails, whenever it does, is logged, has no report and stands in failures;
    the others go on.  With strict it is an error that names all failed tables and holds their exceptions: reports are of all tables or there are none.
    With spark.scheduler.mode=FAIR the tables share the executors evenly.
    """
    config = {k: DATABASE_DEFAULTS[k] for k in ("min_support", "max_collection", "gamma")}
    threshold = DATABASE_DEFAULTS["similarity_threshold"]
    own = lambda df, name: df.withColumn("table_name", F.lit(name))

    def mine(name: str):
        found = mined_table(prepare_data(tables[name], row_ids[name]), row_ids[name], config, unique_ids)
        found["pairs"] = materialize(own(pairwise_similarity(found["itemsets"], found["rows"], found["overlaps"]), name))
        return found

    failed: dict[str, Exception] = {}

    def all_of(work: dict[str, Callable[[], T]]) -> dict[str, T]:
        done = side_by_side(spark, work, most, failed)
        if strict and failed:
            raise ExceptionGroup(f"tables could not be analysed: {', '.join(sorted(failed))}", list(failed.values()))
        return done

    mined = all_of({n: partial(mine, n) for n in sorted(tables) if n in row_ids})
    reports = {}
    if mined:
        link = linkage_table(union([x["pairs"] for x in mined.values()]))
        ids = union([own(x["itemsets"].select("itemset_id"), n) for n, x in mined.items()])
        assigned = materialize(cut_clusters(ids, link, threshold))

        def report(name: str):
            x = mined[name]
            assign = assigned.where(F.col("table_name") == name).select("itemset_id", "cluster")
            clusters, constants = describe_clusters(x["itemsets"], x["rows"], assign)
            return materialize(own(cluster_report(clusters, constants, x["itemsets"], x["rows"]), name))

        reports = all_of({n: partial(report, n) for n in mined})
    schemas = [own(describe_table(df), name) for name, df in sorted(tables.items())]
    samples = {name: sample_rows(df) for name, df in (views or {}).items()}
    failures = spark.createDataFrame([(n, f"{type(e).__name__}: {e}") for n, e in sorted(failed.items())], "table_name string, error string")
    return {"reports": union(list(reports.values())), "schemas": union(schemas), "views": samples, "failures": failures}


def union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None
