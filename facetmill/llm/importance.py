"""Target-distribution importance resampling: array-scored weights, then a distributed quickselect.

Features are runs of consecutive words, hashed into buckets.  Each task counts its buckets in one array; the summed counts
(one number for each bucket) give a gain for each bucket, by how much more often the target has it.  A document's weight is
the floored mean of the gains of its features, looked up in that array.  A Gumbel number drawn from a hash of the id is
added, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The draw's last place is found by quickselect over the whole table: some pivot keys (score descending, id, hash of the text)
are drawn at random, one pass counts exactly how many keys stand before and on each, and only the stretch between two of
them is looked at again, until a pivot is the k-th key.  Only pivots and counts come to the driver.  The winners alone are sorted, by range, and
ranked.

Defined cases: null, empty and wordless texts have no features and weight 0; words of any length and texts of any length are counted
whole; a document without an id draws the number of the empty id and stands behind all ids of its score; rows with one id
are told apart by their text, equal rows take neighbouring ranks; with no target rows all buckets are as rare there; an empty table
gives an empty result; documents of too few words are scored but never drawn; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .shared import documents, materialize, sums_before
from .suffix_dedup import text_slices

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PIVOTS = 32  # pivot keys a round
PIECE = 1 << 20  # words hashed at once
LONG = 48  # bytes of a word that are hashed side by side with others
NO_ID_LAST = (1 << 63) - 1
KEY = "neg long, id long, version long"
ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def crc_steps(low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 registers after low[start:end] of each row, byte by byte for all rows side by side; long rows one by one."""
    length = end - start
    order = np.argsort(np.minimum(length, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    n = length[order]
    s, at = state[order], start[order]
    n_long = int(np.searchsorted(-n, -LONG, side="left"))
    for i in range(n_long):
        s[i] = zlib.crc32(low[at[i] : at[i] + n[i]], int(s[i] ^ ONES)) ^ 0xFFFFFFFF
    for j in range(LONG):
        k = int(np.searchsorted(-n, -j, side="left"))  # rows of more than j bytes
        if k <= n_long:
            break
        x = s[n_long:k]
        s[n_long:k] = _TABLE[(x ^ low[at[n_long:k] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    return out


def features(raw: np.ndarray, offsets: np.ndarray, most: int = MOST_WORDS):
    """Yields (row, crc32, number of words) of the runs of 1 to `most` words of each text, some of them at a time."""
    if not len(raw):
        return
    low = _LOWER[raw]
    word = _WORD[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word & (cut[:-1] | np.r_[True, ~word[:-1]]))
    end = np.flatnonzero(word & (cut[1:] | np.r_[~word[1:], True])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    for a in range(0, len(start), PIECE):
        last = np.arange(a, min(a + PIECE, len(start)))
        state = np.full(len(last), ONES)
        for size in range(1, most + 1):
            if size > 1:  # a blank, then the next word of the same text
                more = np.r_[row[1:] == row[:-1], False][last]
                last, state = last[more] + 1, state[more]
                state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = crc_steps(low, start[last], end[last], state)
            yield row[last], state ^ ONES, size


def count_rows(most: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, 4_000_000):
                for _, crc, _ in features(*R.text_bytes(part.column(1)), most):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most `buckets` numbers come to the driver."""
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count_rows(most, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, with one more feature in each."""
    n, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (big_s + n)) / float((s + 1) * (big_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weight_rows(gains: np.ndarray, most: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 4_000_000):
                n, words, total = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for row, crc, size in features(*R.text_bytes(part.column(1)), most):
                    count = np.bincount(row, minlength=part.num_rows)
                    n += count
                    words += count * (size == 1)
                    total += np.bincount(row, weights=gains[crc % np.uint32(len(gains))], minlength=part.num_rows).astype(np.int64)  # whole numbers, exact as doubles
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(words), pa.array(total // np.maximum(n, 1))], names=["doc_id", "version", "n_features", "n_words", "weight"])

    return run


def gumbel(doc_id, seed: int = SEED):
    """floor(-1000 ln(-ln u)) of a u in (0, 1) from the first 32 bits of sha256(`seed:doc_id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, version, n_features, n_words, weight, score) of every row; version is a hash of its text."""
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("version"))
    weighed = rows.mapInArrow(weight_rows(gains, most), "doc_id long, version long, n_features long, n_words long, weight long")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def select_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (neg, id, version) of keys, counted from 1; None if there are fewer.

    Rows of equal keys count each.  A round draws pivots among the keys that are left and counts in one pass what stands between and on them.
    """
    literal = lambda p: F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(p, keys.columns)])
    key = F.struct(*keys.columns)
    low = high = None
    before, turn = 0, 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.where((F.col("neg") >= low[0]) & (key > literal(low)))
        if high is not None:
            inside = inside.where((F.col("neg") <= high[0]) & (key < literal(high)))
        drawn = inside.orderBy(F.xxhash64(*keys.columns, F.lit(turn))).limit(pivots).collect()  # a bounded number of keys
        if not drawn:
            return None
        drawn = sorted({tuple(r) for r in drawn})
        these = F.array(*[literal(p) for p in drawn])
        passed = F.size(F.filter(these, lambda p: p < key))  # pivots that stand before the key; it may be on the next one
        counted = inside.groupBy(passed.alias("passed"), F.array_contains(these, key).alias("on")).agg(F.count(F.lit(1)).alias("n")).collect()  # two counts for each pivot
        n = {(r["passed"], r["on"]): r["n"] for r in counted}
        for i, p in enumerate(drawn):
            before += n.get((i, False), 0)
            if before >= k:
                before -= n.get((i, False), 0)
                high = p
                break
            before += n.get((i, True), 0)
            if before >= k:
                return p
            low = p
        turn += 1


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, version, n_words) of every row; rank from 1 for the drawn ones, else null.

    Of the n documents with at least least_words words, n * percent // 100 are drawn.
    """
    table = materialize(scored(docs, target, most, buckets, seed))
    able = F.col("n_words") >= least_words
    k = table.where(able).count() * percent // 100
    key = [(-F.col("score")).alias("neg"), F.coalesce("doc_id", F.lit(NO_ID_LAST)).alias("id"), F.col("version")]
    last = select_key(table.where(able).select(*key), k, pivots) if k else None
    if last is None:
        won, lost = table.where("false"), table
    else:
        wins = able & (F.struct(*key) <= F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(last, ("neg", "id", "version"))]))
        won, lost = table.where(wins), table.where(~wins)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("version")]
    placed = sums_before(won.withColumn("one", F.lit(1).cast("long")), order, {"before": "one"}).withColumn("place", F.col("before") + 1)
    ranked = placed.select(*table.columns, F.when(F.col("place") <= k, F.col("place")).alias("rank"))  # of rows equal to the last one only as many as are left
    every = ranked.unionByName(lost.withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank", "version", "n_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
q AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM d UNION SELECT word FROM q)),
b AS (SELECT word, list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)) AS bytes FROM v),
c AS (SELECT word, xor(list_reduce(bytes, lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM b, tab),
s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM q JOIN c USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT count(*) FROM d), 0) + {BUCKETS}))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM q) + {BUCKETS}))::DOUBLE))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN c USING (word) JOIN g USING (bucket) GROUP BY 1),
a AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n_features >= {LEAST_WORDS})
SELECT a.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)
"""
