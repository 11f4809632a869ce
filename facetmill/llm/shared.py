"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.sources.work import materialize, work_dir  # noqa: F401  (the operators take them from here)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    """Reduce tasks for an explicit repartition: the session's own number of shuffle partitions, times factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when a counted bound on the rows holds; beyond it Spark shuffles as usual."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


NO_ID = -(1 << 63)


def with_row_key(docs: DataFrame, id_col: str = "doc_id", version=None) -> DataFrame:
    """docs with __id, the id (null as the smallest), and __version, which tells rows of one id with differing contents apart.

    __version is a hash (of the text, unless another is given) where an id stands in several rows, else 0; equal rows have equal keys.
    """
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    several = materialize(keyed.groupBy("__id").count().where("count > 1").select(F.col("__id").alias("__several")))  # reads the ids only
    if several.isEmpty():
        return keyed.withColumn("__version", F.lit(0).cast("long"))
    keyed = keyed.join(broadcast_if_small(several, 1_000_000), F.col("__id") == F.col("__several"), "left")
    version = F.when(F.col("__several").isNotNull(), F.xxhash64("text") if version is None else version).otherwise(F.lit(0)).cast("long")
    return keyed.withColumn("__version", version).drop("__several")


def sums_before(df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
    """df with new columns: the sum of an existing one over all rows that stand before in this order, which should have no ties.

    Rows are range-partitioned; only one row for each range passes through one task.
    """
    spark = df.sparkSession
    placed = materialize(df.repartitionByRange(partitions(spark), *order).withColumn("__range", F.spark_partition_id()))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__{name}") for name, c in columns.items()])
    ranges = ranges.select("__range", *[before(W.partitionBy(F.lit(0)).orderBy("__range"), f"__{name}").alias(f"__{name}") for name in columns])
    inside = W.partitionBy("__range").orderBy(*order)
    placed = placed.select("*", *[before(inside, c).alias(name) for name, c in columns.items()])
    return placed.join(F.broadcast(ranges), "__range").select(*df.columns, *[(F.col(f"__{name}") + F.col(name)).alias(name) for name in columns])


def ascii_lower(col):
    """Lower-case A-Z only, so that other letters keep their code points."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
