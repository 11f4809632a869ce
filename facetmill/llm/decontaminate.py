"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item's windows (WINDOW consecutive words; a shorter item is one window) are the sets; a document contains
a window if the same words stand somewhere in it.  The words of a window are ordered by rarity in the documents.
Containment must be complete, so the necessary prefix is one word: the rarest.  Only places of these words in the
documents are looked at: rows (doc_id, position) that join on the word, keep their distance to both ends of the
document (positional and length bound) and are verified word by word over the window.

The text is read three times: to count the benchmark's words, to find prefix words, and to verify.  What moves between
the tasks is the places of rare words and, once, the text.

Defined cases: null, empty or wordless text has no words, no hits and is clean; texts of any length are looked at whole; a wordless item has no window; equal
items each count; of equally rare words the first by code point is a window's prefix; a share of exactly one in SHARE is contaminated; rows with one doc_id, or none, share their hits only if their texts are equal; an empty benchmark leaves every
document clean, an empty table of documents gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import NO_ID, ascii_lower, broadcast_if_small, documents, materialize

WINDOW = 13
SHARE = 20  # contaminated: at least one word in so many is hit
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_ROWS = 200_000  # windows are some 200 bytes each; with more of them the joins shuffle


def words(text):
    """Words of a text, in order; [] for null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAKS), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): the distinct windows of every item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents' keys with their number of words, and (row, start, n, item_id) of each window found in them; docs: (doc_id, version, text), none null but the text."""
    wins = materialize(item_windows(items, window))
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    n_small = MAX_BROADCAST_ROWS
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(broadcast_if_small(vocabulary, n_small), "word", "left_semi").groupBy("word").count()
    counts = materialize(counts)
    # the rarest word of each window, and where in the window it stands
    seen = (
        wins.withColumn("win_id", F.xxhash64(F.to_json("win")))
        .select("win_id", "win")
        .distinct()
        .select("win_id", "win", F.posexplode("win").alias("at", "word"))
        .join(broadcast_if_small(counts, n_small), "word")
    )
    known = F.count(F.lit(1)).alias("known")
    rare = seen.groupBy("win_id", "win").agg(F.min(F.struct(F.col("count"), F.col("word"), F.col("at"))).alias("rarest"), known).where(F.col("known") == F.size("win"))
    rare = materialize(rare.select("win", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at")))
    # and how many words before and after such a word its windows reach at most
    reach = rare.groupBy("word").agg(F.max("at").alias("before"), F.max(F.size("win") - F.col("at")).alias("after"))
    places = docs.select("doc_id", "version", F.posexplode(words(F.col("text"))).alias("place", "word")).join(broadcast_if_small(reach, n_small), "word")
    places = places.groupBy("doc_id", "version").agg(F.collect_set(F.struct("place", "before", "after")).alias("places"))
    w = docs.join(places, ["doc_id", "version"], "left")  # the text moves, not its words
    w = w.select("doc_id", words(F.col("text")).alias("w"), "version", "places")

    def cut(p):
        begin = F.greatest(p["place"] - p["before"], F.lit(0))
        near = F.slice("w", begin + 1, p["place"] + p["after"] - begin)
        return F.struct(p["place"].alias("place"), F.get("w", p["place"]).alias("word"), begin.alias("from"), near.alias("near"))

    around = F.transform("places", cut)
    w = materialize(w.select("doc_id", "version", F.size("w").cast("long").alias("n_words"), around.alias("around")))
    near = w.where(F.size("around") > 0).select("doc_id", "version", F.explode("around").alias("a")).select("doc_id", "version", "a.*")
    start = F.col("place") - F.col("at")
    inside = (start >= F.col("from")) & (start + F.size("win") <= F.col("from") + F.size("near"))
    same = F.slice("near", start - F.col("from") + 1, F.size("win")) == F.col("win")
    found = near.join(broadcast_if_small(rare, n_small), "word").where(inside & F.when(inside, same).otherwise(F.lit(False)))
    found = found.select("doc_id", "version", start.alias("start"), F.size("win").alias("n"), "win")
    return w.select("doc_id", "version", "n_words"), found.join(broadcast_if_small(wins, n_small), "win").select("doc_id", "version", "start", "n", "item_id")


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    return judged_rows(docs, items, window, share).drop("version")


def judged_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """judge() with the version of each row, xxhash64 of its text, which tells rows of one doc_id apart."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    sizes, found = hits(docs, items.select("item_id", "text"), window)
    key = ["doc_id", "version"]
    found = materialize(found)
    # words under the union of the hit windows: each window adds what reaches beyond all earlier ones
    before = W.partitionBy(*key).orderBy("start", F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)
    spans = found.select(*key, "start", "n").distinct().withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    n_hit = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "reached"))).alias("n_hit"))
    names = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("names"))
    both = n_hit.join(names, key).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "n_hit", "names")
    out = sizes.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v")), "left")
    n = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "version",
        "n_words",
        n.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "names"), F.lit("")), 256).alias("items_sha256"),
        ((n > 0) & (n * share >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS win,
              least(len(w), 13) AS n FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT DISTINCT n FROM bw),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p, m WHERE i + n - 1 <= len(w)),
h AS (SELECT g.doc_id, g.i, g.n, bw.item_id FROM g JOIN bw ON g.win = bw.win AND g.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
