"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings over hashed text features.

Grades are 0 (toxic), 1 (poor), 2 (good).  One weight vector over hashed features gives a latent score s; ordered
thresholds t1 < t2 cut it: P(grade >= k) = sigmoid(s - t_k).  The expected grade is the sum of these tails, and the
tail of the top grade selects documents.

Features are present or absent: the distinct words (lower case, outer punctuation stripped), their first STEM letters, and bins of what the whole
text looks like (share of each punctuation mark, of capitals, digits and line breaks, share of distinct words, length).

Fitting uses at most MAX_LABELLED labelled rows, drawn by a hash of doc_id.  They lie in SHARDS shards; in each round a
task runs a few passes over its shard from the common weights, and the driver averages the SHARDS results.  Scoring is
one narrow pass over all documents.

Defined cases: null text is the empty text and is scored by its bins alone; texts of any length are read whole; labels with a null quality and toxic, or
without a document, teach nothing; of several labels of a document the lowest grade counts, and every row of its id teaches; without any labels every
document is kept with tail probability 1; a tail equal to KEEP_TAIL keeps; an empty table gives an empty result; repeated rows give repeated results, and
a null doc_id is scored like any other; columns of the input pass through `select_documents`, extra ones included.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialize
from .suffix_dedup import text_slices
from .rolling import text_bytes

MAX_LABELLED = 24_000
SHARDS, ROUNDS, PASSES = 8, 5, 4
FEATURES = 1 << 17
MIN_DOCUMENTS = 4  # a feature in fewer labelled documents gets no weight
# nor one whose documents' mean grade lies within some standard errors of the overall mean, from 2.5 of them with 250 labels to 4 with 2,500;
LEAST_Z, MOST_Z, FEW_LABELS = 2.5, 4.0, 250
MOST_TELLING = 16  # where fewer features pass, so many that lie farthest from it get one
STEPS = 24  # gradient steps of a shard in a round at least: few rows are passed more often
STEM = 5
KEEP_TAIL = 0.5
GRADES = 3
_OUTER = ".,;:!?\"'()[]{}*&%$#|-_<>/\\+=~`^@"
SCORED = "doc_id long, expected_grade double, p_toxic double, p_good double, keep boolean"


class WordIds(dict):
    """Feature numbers (word, stem) of each word seen, worked out once; starts anew when large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        bare = word.strip(_OUTER)
        names = (bare, "stem " + bare[:STEM]) if len(bare) > STEM else (bare,)
        self[word] = at = tuple(zlib.crc32(x.encode()) % FEATURES for x in names)
        return at


def _bin(share: float) -> int:
    return 0 if share <= 0 else max(1, 12 + int(np.floor(np.log2(share))))


def look_features(data: np.ndarray, n_words: int, n_distinct: int) -> list[int]:
    """Bins of what the text looks like."""
    n = max(1, len(data))
    count = np.bincount(data, minlength=256)
    names = [f"has {c} {_bin(count[c] / n)}" for c in range(33, 127) if not chr(c).isalnum() and count[c]]
    names += [f"capitals {_bin(count[65:91].sum() / n)}", f"digits {_bin(count[48:58].sum() / n)}", f"lines {_bin(count[10] / n)}"]
    names += [f"distinct {int(10 * n_distinct / max(1, n_words))}", f"length {int(np.log2(n))}", f"word size {min(20, int(n / max(1, n_words)))}"]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def features(batch: pa.RecordBatch, ids: WordIds, text_at: int) -> list[np.ndarray]:
    raw, at = text_bytes(batch.column(text_at))
    out = []
    for i, text in enumerate(batch.column(text_at).to_pylist()):
        words = (text or "").lower().split()
        distinct = set(words)
        found = set().union(*map(ids.__getitem__, distinct))
        found.update(look_features(raw[at[i] : at[i + 1]], len(words), len(distinct)))
        out.append(np.fromiter(found, np.int64, len(found)))
    return out


def feature_rows(batches):
    ids = WordIds()
    for whole in batches:
        for batch in text_slices(whole, 2_000_000):
            found = features(batch, ids, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([np.sort(x).tolist() for x in found], pa.list_(pa.int32()))], names=["doc_id", "grade", "shard", "at"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def shard_passes(weights: np.ndarray, cuts: np.ndarray, useful: np.ndarray, seed: int, passes: int = PASSES, step: float = 0.3, ridge: float = 1e-4, batch_rows: int = 64):
    """For each shard: adaptive gradient passes from the common parameters; gives the shard's own."""

    def run(batches):
        shards: dict[int, list] = {}
        for b in batches:
            for doc, grade, shard, at in zip(*(c.to_pylist() for c in b.columns)):
                shards.setdefault(shard, []).append((doc, grade, at))
        for shard in sorted(shards):
            rows = sorted(shards[shard])
            grade = np.array([r[1] for r in rows])
            lists = [np.array(r[2], np.int64) for r in rows]
            lists = [np.r_[x[useful[x]], FEATURES] for x in lists]  # the last weight is always 0: no list is empty
            w, cut = np.r_[weights.astype(np.float64), 0.0], cuts.copy()  # cut: t1 and log(t2 - t1)
            seen, seen_cut = np.full(len(w), 1e-6), np.full(2, 1e-6)
            random = np.random.default_rng(seed * 1000 + shard)
            for _ in range(passes):
                order = random.permutation(len(rows))
                for i in range(0, len(rows), batch_rows):
                    part = order[i : i + batch_rows]
                    idx = np.concatenate([lists[j] for j in part])
                    n = np.array([len(lists[j]) for j in part])
                    s = np.add.reduceat(w[idx], np.r_[0, np.cumsum(n)[:-1]])
                    g_s, g_cut = gradient(s, grade[part], cut)
                    hit, place = np.unique(idx, return_inverse=True)
                    g = np.bincount(place, weights=np.repeat(g_s, n)) / len(part) - ridge * w[hit]
                    seen[hit] += g * g
                    w[hit] += step * g / np.sqrt(seen[hit])
                    w[-1] = 0
                    seen_cut += g_cut * g_cut
                    cut = cut + step * g_cut / np.sqrt(seen_cut)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(rows)]), pa.array([w[:-1].astype(np.float32).tobytes()], pa.binary()), pa.array([cut.tobytes()], pa.binary())], names=["shard", "n", "w", "cut"])

    return run


def tails(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2)."""
    return np.stack([sigmoid(s - cut[0]), sigmoid(s - cut[0] - np.exp(cut[1]))])


def gradient(s: np.ndarray, grade: np.ndarray, cut: np.ndarray):
    """Of the mean log likelihood by the scores (per row) and by the two threshold parameters."""
    t = np.vstack([np.ones_like(s), tails(s, cut), np.zeros_like(s)])
    row = np.arange(len(s))
    a, b = t[grade, row], t[grade + 1, row]
    p = np.maximum(a - b, 1e-9)
    da, db = -a * (1 - a) / p, b * (1 - b) / p  # by the threshold below and the one above
    d1 = np.where(grade == 1, da, 0) + np.where(grade == 0, db, 0)
    d2 = np.where(grade == 2, da, 0) + np.where(grade == 1, db, 0)
    return 1 - a - b, np.array([(d1 + d2).mean(), d2.mean() * np.exp(cut[1])])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic, else 1 for quality 0 and 2 for quality 1."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 1)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def least_z(n: int) -> float:
    """Standard errors that a feature needs with n labels: few labels cannot show much, many show chance effects among many features."""
    return float(np.clip(LEAST_Z + (MOST_Z - LEAST_Z) * np.log10(max(n, 1) / FEW_LABELS), LEAST_Z, MOST_Z))


def shards_of(n: int, batch_rows: int = 64) -> int:
    """One for each batch of labelled rows, SHARDS at most."""
    return max(1, min(SHARDS, n // batch_rows))


def passes_of(n: int, batch_rows: int = 64) -> int:
    return max(PASSES, -(-STEPS // -(-n // (shards_of(n) * batch_rows))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED):
    """(weights, cuts) from at most about `most` labelled documents, or None without any."""
    spark = docs.sparkSession
    grades = graded(labels)
    n = grades.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = grades.where(draw < int((1 << 30) * min(1.0, most / n))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards_of(min(n, most)))).cast("int"))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most about `most` rows of 20 bytes
    rows = materialize(taught.select("doc_id", "text", "grade", "shard").mapInArrow(feature_rows, "doc_id long, grade int, shard int, at array<int>"))
    share = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if not share:
        return None
    total = sum(share.values())
    mean = sum(g * n for g, n in share.items()) / total
    spread = (sum(g * g * n for g, n in share.items()) / total - mean**2) ** 0.5
    told = rows.select("grade", F.explode("at").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean"))
    told = told.where(F.col("n") >= min(MIN_DOCUMENTS, total)).select("f", (F.abs(F.col("mean") - mean) * F.sqrt("n")).alias("z"))
    useful = np.zeros(FEATURES, bool)
    found = told.where(F.col("z") >= least_z(total) * spread).select("f").collect()  # at most FEATURES numbers
    found = found if len(found) >= MOST_TELLING else told.where("z > 0").orderBy(F.round("z", 9).desc(), "f").limit(MOST_TELLING).collect()
    useful[[r.f for r in found]] = True
    above = [min(1 - 1e-3, max(1e-3, sum(share.get(g, 0) for g in range(k, GRADES)) / total)) for k in (1, 2)]
    t = [-np.log(p / (1 - p)) for p in above]
    weights, cuts = np.zeros(FEATURES, np.float32), np.array([t[0], np.log(max(t[1] - t[0], 0.05))])
    by_shard = rows.repartition(SHARDS, "shard")
    for turn in range(ROUNDS):
        own = by_shard.mapInArrow(shard_passes(weights, cuts, useful, turn, passes_of(total)), "shard long, n long, w binary, cut binary").collect()  # SHARDS rows
        own.sort(key=lambda r: r.shard)
        n_all = sum(r.n for r in own)
        weights = (sum(np.frombuffer(r.w, np.float32).astype(np.float64) * r.n for r in own) / n_all).astype(np.float32)
        cuts = sum(np.frombuffer(r.cut) * r.n for r in own) / n_all
    return weights, cuts


def score_batch(batch: pa.RecordBatch, ids: WordIds, model, text_at: int):
    """(expected grade, P(toxic), P(good)) of each row."""
    if model is None:
        n = batch.num_rows
        return np.full(n, GRADES - 1.0), np.zeros(n), np.ones(n)
    weights, cuts = model
    s = np.array([float(weights[f].sum()) for f in features(batch, ids, text_at)])
    t = tails(s, cuts)
    return t.sum(axis=0), 1 - t[0], t[1]


def score_rows(model, keep_tail: float):
    def run(batches):
        ids = WordIds()
        for whole in batches:
            for batch in text_slices(whole, 2_000_000):
                expected, toxic, good = score_batch(batch, ids, model, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(toxic), pa.array(good), pa.array(good >= keep_tail)], names=["doc_id", "expected_grade", "p_toxic", "p_good", "keep"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, expected_grade, p_toxic, p_good, keep) of every row; keep: the top grade's tail probability reaches keep_tail."""
    model = fit(docs, labels, most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score_rows(model, keep_tail), SCORED)


def select_documents(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL, most: int = MAX_LABELLED) -> DataFrame:
    """The documents that are kept, with all their columns: scored and filtered in one narrow pass."""
    model = fit(docs, labels, most)
    at = docs.columns.index("text")

    def run(batches):
        ids = WordIds()
        for whole in batches:
            plain = pa.RecordBatch.from_arrays([whole.column(0), whole.column(at)], names=["doc_id", "text"])
            good = np.concatenate([score_batch(b, ids, model, 1)[2] for b in text_slices(plain, 2_000_000)]) if whole.num_rows else np.zeros(0)
            yield whole.filter(pa.array(good >= keep_tail))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
