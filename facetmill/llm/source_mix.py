"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document gets a place in a shuffled order of its source (order of md5 of its id).  Its virtual finish time is the number of the
source's words up to and with it, divided by the source's target; a further pass over the source adds the whole
source's size.  All (document, pass) entries stand in order of finish time over all sources and are taken while the
running total of words stays within the budget.

The global order is sorted by ranges.  Fixed ranges of finish time are summed first; those before the one in which the budget
ends are taken whole, those after it not at all, and only the entries of that one are range-sorted and cut.

Running sums never run over one whole source or the whole table: rows fall into ranges of about ROWS_PER_RANGE rows, ranges into
groups of RANGES_PER_GROUP, and sums go from groups to ranges to rows; orders over all sources or entries go by sampled ranges.

Defined cases: null or wordless text has size 0 and is never taken; texts of any length count whole; a null source is one source, last in order; equal
finish times go by source, then md5 of the id, then id; rows with one id are separate documents, which stand in order of size,
all equal rows being alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import broadcast_if_small, documents, materialize, sums_before

PASSES = 3  # no document is taken more often
ROWS_PER_RANGE, RANGES_PER_GROUP = 1_000, 1_000
FINISH_RANGES, LAST_FINISH = 4_096, 2.0  # the budget ends near a finish time of 1; what lies beyond LAST_FINISH is one more range
MAX_BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: list[float] = (1, 2, 3), cap: int = PASSES) -> DataFrame:
    """(source, source_size) -> (source, weight, source_size, target).

    Sources by code point, null last, get the weights in turn.  Targets share the sum of all sizes by weight; a
    target above cap times its source's size is held there and the rest is shared again.  In closed form: with the
    sources in order of cap * size / weight, the first j are held where the level that is left to the others,
    (total - held) / (weight of the others), is above their own ratio.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = [F.col("source").isNull(), F.col("source")]
    s = sums_before(sizes.select("source", "source_size", F.lit(1).alias("one")), named, {"index": "one"})
    s = s.select("source", "source_size", F.element_at(table, (F.col("index") % len(weights) + 1).cast("int")).alias("weight"))
    s = s.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    s = sums_before(s, [F.col("ratio"), *named], {"held": "most", "lighter": "weight"})
    total = s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    s = s.crossJoin(F.broadcast(total)).withColumn("level", (F.col("total") - F.col("held")) / (F.col("weights") - F.col("lighter")))  # one row
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", named[0].alias("none"), "source", "level")))["level"]
    s = s.crossJoin(F.broadcast(s.agg(free.alias("final"))))  # one row
    target = F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final")), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return materialize(s.select("source", "weight", "source_size", target.alias("target")))


def placed_rows(docs: DataFrame, weights: list[float], id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Each row with its size, its source's size and target, and `upto`: the words of its source up to and with it."""
    key = F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *keep))
    n_ranges = max(1, rows.count() // ROWS_PER_RANGE)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n_ranges)
    rows = rows.withColumn("part", part).withColumn("many", F.floor(part / RANGES_PER_GROUP))

    # words before each range of each source, in order of the key: of the groups before its group, and of the ranges before it in the group
    parts = rows.groupBy("source", "many", "part").agg(F.sum("size").alias("words"))
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = parts.groupBy("source", "many").agg(F.sum("words").alias("words")).select(F.col("source").alias("s"), F.col("many").alias("m"), before(W.partitionBy("source").orderBy("many")).alias("earlier"))
    parts = parts.select("source", "many", "part", before(W.partitionBy("source", "many").orderBy("part")).alias("inside"))
    parts = parts.join(groups, parts["source"].eqNullSafe(groups["s"]) & (F.col("many") == F.col("m"))).select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("earlier") + F.col("inside")).alias("before"))

    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    offsets = parts.join(broadcast_if_small(targets, MAX_BROADCAST_ROWS), parts["s"].eqNullSafe(targets["source"])).select("s", "p", "before", "source_size", "target")
    within = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    placed = summed.join(offsets, summed["source"].eqNullSafe(offsets["s"]) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "source", "size", "key", "source_size", "target", (F.col("before") + F.col("upto")).alias("upto"), F.monotonically_increasing_id().alias("row"), *keep)


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = []) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row, and the columns of docs named in keep."""
    placed = materialize(placed_rows(docs, weights, id_col, text_col, source_col, keep))
    finish = lambda i: (F.lit(i) * F.col("source_size") + F.col("upto")) / F.col("target")
    at = lambda f: F.least(F.floor(f * (FINISH_RANGES / LAST_FINISH)), F.lit(FINISH_RANGES)).cast("int")

    # in which range of finish times the budget ends: at most FINISH_RANGES + 1 sums
    budget = placed.agg(F.sum("size")).first()[0] or 0
    some = placed.where(F.col("size") > 0)
    counted = some.select("size", F.explode(F.array(*[at(finish(i)) for i in range(PASSES)])).alias("range")).groupBy("range").agg(F.sum("size").alias("words"))
    spent, last = 0, FINISH_RANGES + 1
    for r in sorted(counted.collect(), key=lambda r: r["range"]):
        if spent + r["words"] > budget:
            last = r["range"]
            break
        spent += r["words"]

    # its entries in order, cut where the budget ends
    entries = some.select("row", "size", "source", "key", "doc_id", F.explode(F.array(*[finish(i) for i in range(PASSES)])).alias("finish")).where(at(F.col("finish")) == last)
    sort = [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]
    taken = sums_before(entries, sort, {"earlier": "size"}).where(F.col("earlier") + F.col("size") + spent <= budget)
    taken = materialize(taken.groupBy(F.col("row").alias("r")).agg(F.sum("size").alias("words")))
    sure = sum((F.when(at(finish(i)) < last, F.col("size")).otherwise(0) for i in range(1, PASSES)), F.when(at(finish(0)) < last, F.col("size")).otherwise(0))
    words = F.when(F.col("size") > 0, sure + F.coalesce("words", F.lit(0))).otherwise(0)
    return placed.join(broadcast_if_small(taken, MAX_BROADCAST_ROWS), F.col("row") == F.col("r"), "left").select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"), "source", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5('mix-' || coalesce(doc_id::VARCHAR, '')) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
r AS (SELECT *, 3 * source_size AS most, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM r) - coalesce(sum(most) OVER b, 0))::DOUBLE
                / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS final FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio < final THEN most::DOUBLE ELSE final * weight END AS target FROM l, f),
p AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, pass, (pass * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1), (2)) v(pass) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT doc_id, sum(size)::BIGINT AS words FROM g WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.words, 0)::BIGINT AS taken, p.source FROM p LEFT JOIN k ON p.doc_id = k.doc_id
"""
