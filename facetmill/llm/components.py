"""Connected components of a large graph by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


FEW_NODES = 1_000_000  # counted; the smallest neighbours of so many nodes, 16 bytes each, are broadcast, beyond it Spark shuffles


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that can be reached; nodes without an edge to another are left out.

    Each round is written to the shared folder.  Nothing but two numbers of each round comes to the driver.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:  # each round that is not the last brings nodes nearer to their smallest one
        few = (lambda x: F.broadcast(x)) if state[0] * 2 <= FEW_NODES else (lambda x: x)  # an edge has two nodes
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(few(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(few(low), "u")
        e = linked.select("u", F.col("m").alias("v")).unionByName(linked.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(e)
        before, state = state, _state(e)
        if before == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
