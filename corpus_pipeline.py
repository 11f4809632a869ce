"""A training-data pipeline over `documents`: five stages, each one of the operators in facetmill.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents`; the
last one adds the mix.  run() applies them in order; between two stages the documents are written to the shared folder.

    quality       documents whose top-grade tail is below one half go (poor or toxic)
    near copies   of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest doc_id stays
    repeats       byte strings of 100 bytes that also start earlier are cut out; documents left blank by that go
    benchmark     documents of which at least one word in twenty lies in a benchmark window go
    mix           sources are drawn to target weights; documents that the mix does not take go

Rows are told apart by doc_id and, where ids repeat or are missing, by their text (shared.with_row_key); rows equal in both count as
one document, of which the near-copies stage keeps one row.  Every stage takes empty tables, null and empty texts, and extra columns of any name, which pass through.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.llm import decontaminate, jaccard_join, quality, source_mix, suffix_dedup
from facetmill.llm.shared import NO_ID, materialize, with_row_key

NEAR_WORDS, NEAR_THRESHOLD = 5, "0.8"
KEY = ["__id", "__version"]


def one_row_each(keyed: DataFrame) -> DataFrame:
    """Of rows with equal keys the first by all columns; only keys that stand in several rows have a version other than 0."""
    if keyed.where("__version <> 0").isEmpty():
        return keyed
    first = W.partitionBy(*KEY).orderBy(F.to_json(F.struct(*[c for c in keyed.columns if c not in KEY])))
    return keyed.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from `labels`, grades good with a probability of at least one half.

    Null and empty texts are judged by what they look like; without labels all stay; equal rows stay or go together.
    """
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest doc_id (ids before none), then the smallest hash of text.

    A text without words is linked with nothing and stays; rows equal in id and text are one document, the first row by all columns stays.
    """
    groups = jaccard_join.joined_rows(docs, NEAR_WORDS, NEAR_THRESHOLD)
    first = F.min(F.struct((F.col("__id") == NO_ID).alias("none"), *KEY)).alias("first")
    kept = groups.groupBy("component").agg(first).select("first.__id", "first.__version")
    return one_row_each(with_row_key(docs).join(materialize(kept), KEY, "left_semi")).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier string of 100 bytes; n_chars is counted anew.

    A text that held more than white space and does not any more goes with its row; null and blank texts stay as they are.
    """
    had = F.col("text").rlike(r"\S")
    cut = suffix_dedup.without_repeats(docs.withColumn("__had_text", had)).where(F.col("text").isNull() | ~F.col("__had_text") | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by `benchmark`; each row is judged by its own text, a wordless one stays."""
    judged = decontaminate.judged_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    judged = judged.select(F.col("doc_id").alias("__judged"), F.col("version").alias("__version")).distinct()
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__judged")) & (F.xxhash64("text") == F.col("__version"))
    return docs.join(judged, own, "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (named mix_... where docs has such a column).

    Rows equal in id and text are one document and one row; wordless ones are never taken.
    """
    keyed = one_row_each(with_row_key(docs))
    named = {c: f"mix_{c}" if c in docs.columns else c for c in ("size", "source_size", "target", "taken")}
    taken = source_mix.mix(keyed, keep=KEY).where("taken > 0").select(*KEY, *[F.col(c).alias(f"__{c}") for c in named])
    return keyed.join(taken, KEY).select(*docs.columns, *[F.col(f"__{c}").alias(name) for c, name in named.items()])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mix_stage),
]

#: The classifier is learnt, so SQL cannot say the result; tests/llm compares each stage and run() with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
