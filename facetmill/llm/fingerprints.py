"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks, in DataFrame functions only.

Paragraphs are lines; a section is PER_SECTION paragraphs; a paragraph's leaves are hashes of its blocks of code points, finer at its start, so that
short texts have several.  A paragraph's node hashes its leaves, a section's node its paragraphs' nodes, and the root the sections' nodes: the
root is equal for equal texts, and where roots differ, differing sections name the differing paragraphs, and these
the differing blocks (`differing_blocks`).  The fingerprint spells the tree, leaves shortened to 31 bits:

    root:section=paragraph~leaf.leaf|paragraph~leaf.leaf;section=...

Likeness of two fingerprints is 1 for equal roots, else the share (Dice) of their leaves that are equal in place or,
if that is more, of their sets of leaves.

The neighbour of each document (the next smaller doc_id) comes from a range partition of the ids alone; only the
last one of each range needs the first of another, from a table with a row for each range.

Defined cases: null text is the empty text, which has one empty paragraph and no leaves; texts and lines of any length are hashed whole; rows that repeat a doc_id are taken in
order of their text's hash and stand next to each other, equal ones as one; a null doc_id is the smallest; a single document is its own
neighbour; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import NO_ID, documents, materialize, partitions

PER_SECTION = 8
#: Blocks of a paragraph: from code point, to code point, size.  Cuts depend on the place alone, so an edit spoils nothing before it.
BLOCKS = ((1, 8, 4), (9, 32, 8), (33, 1 << 30, 32))


def hashed(text):
    """Leaves of 64 bits of a text column, by paragraph."""
    cut = lambda p, size: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    blocks = lambda p: F.concat(*[cut(F.substring(p, a, b - a + 1), size) for a, b, size in BLOCKS])
    return F.transform(F.split(text, "\n"), lambda p: F.transform(blocks(p), lambda b: F.xxhash64(b)))


def short(leaves):
    """The leaves as a fingerprint spells them."""
    return F.transform(leaves, lambda p: F.transform(p, lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")))


def nodes(leaves):
    """The paragraphs' nodes over leaves of 64 bits."""
    return F.transform(leaves, lambda p: F.xxhash64(p))


def section_nodes(paragraphs):
    n = F.ceil(F.size(paragraphs) / F.lit(PER_SECTION)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(paragraphs, i * PER_SECTION + 1, PER_SECTION)))


def root_of(sections):
    return F.substring(F.sha2(F.array_join(F.transform(sections, lambda h: h.cast("string")), ";"), 256), 1, 32)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the tree of a text column: struct (leaves, paragraphs, sections, root).  Each level is a column first, so that it is worked out once."""
    level = {k: f"__{name}_{k}" for k in ("hashed", "leaves", "paragraphs", "sections", "root")}
    df = df.withColumn(level["hashed"], hashed(F.col(text)))
    df = df.withColumns({level["leaves"]: short(F.col(level["hashed"])), level["paragraphs"]: nodes(F.col(level["hashed"]))})
    df = df.withColumn(level["sections"], section_nodes(F.col(level["paragraphs"])))
    df = df.withColumn(level["root"], root_of(F.col(level["sections"])))
    return df.withColumn(name, F.struct(*[F.col(level[k]).alias(k) for k in ("leaves", "paragraphs", "sections", "root")])).drop(*level.values())


def spelled(t):
    """The fingerprint of a tree."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    rows = F.zip_with(t["paragraphs"], t["leaves"], lambda h, p: F.concat(digits(h), F.lit("~"), F.array_join(F.transform(p, lambda x: F.lower(F.hex(x))), ".")))
    named = F.transform(t["sections"], lambda h, i: F.concat(digits(h), F.lit("="), F.array_join(F.slice(rows, i * PER_SECTION + 1, PER_SECTION), "|")))
    return F.concat(t["root"], F.lit(":"), F.array_join(named, ";"))


def parsed(fingerprint):
    """The tree that a fingerprint spells, all nodes as strings."""
    sections = F.split(F.substring_index(fingerprint, ":", -1), ";")
    rows = F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "=", -1), r"\|")))
    return F.struct(
        F.transform(rows, lambda p: F.filter(F.split(F.substring_index(p, "~", -1), r"\."), lambda x: x != "")).alias("leaves"),
        F.transform(rows, lambda p: F.substring_index(p, "~", 1)).alias("paragraphs"),
        F.transform(sections, lambda s: F.substring_index(s, "=", 1)).alias("sections"),
        F.substring_index(fingerprint, ":", 1).alias("root"),
    )


def differing_blocks(a, b):
    """Where two trees differ, as (section, paragraph, block): only differing sections are descended into, and of them only differing paragraphs.

    A paragraph without blocks that differs is named with block 0.
    """
    differ = lambda x, y, i: ~F.get(x, i).eqNullSafe(F.get(y, i))
    count = lambda x, y: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)), F.lit(1))
    sections = F.filter(F.sequence(F.lit(0), count(a["sections"], b["sections"]) - 1), lambda i: differ(a["sections"], b["sections"], i))
    within = lambda s: F.filter(F.sequence(s * PER_SECTION, s * PER_SECTION + PER_SECTION - 1), lambda p: differ(a["paragraphs"], b["paragraphs"], p))
    named = lambda p, k: F.struct(F.floor(p / F.lit(PER_SECTION)).cast("int").alias("section"), p.alias("paragraph"), k.alias("block"))

    def inside(p):
        x, y = F.get(a["leaves"], p), F.get(b["leaves"], p)
        some = F.filter(F.sequence(F.lit(0), count(x, y) - 1), lambda k: differ(x, y, k))
        return F.transform(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(0))), lambda k: named(p, k))

    places = F.flatten(F.transform(F.flatten(F.transform(sections, within)), inside))
    return F.when(a["root"].eqNullSafe(b["root"]), F.slice(places, 1, 0)).otherwise(places)


def likeness(same_root, a, b):
    """1 for equal roots; else the larger of two Dice coefficients: of leaves equal in place, and of the sets of leaves."""
    in_place = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same))
    sets = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    share = F.greatest(2.0 * in_place / (F.size(a) + F.size(b)), 2.0 * F.size(F.array_intersect(a, b)) / sets)
    return F.when(same_root, F.lit(1.0)).when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(F.lit(0.0))


def neighbours(keys: DataFrame) -> DataFrame:
    """For every key (doc_id, version) the next one in descending order, next_id and next_version; the first again after the last."""
    desc = [F.col("doc_id").desc(), F.col("version").desc()]
    placed = materialize(keys.repartitionByRange(partitions(keys.sparkSession), *desc).withColumn("range", F.spark_partition_id()))
    head = placed.groupBy("range").agg(F.max(F.struct("doc_id", "version")).alias("head"))
    ring = W.partitionBy(F.lit(0)).orderBy("range")  # a row for each range
    heads = head.select("range", F.coalesce(F.lead("head").over(ring), F.min_by("head", "range").over(W.partitionBy(F.lit(0)))).alias("follows"))
    inside = W.partitionBy("range").orderBy(*desc)
    pairs = placed.withColumn("following", F.lead(F.struct("doc_id", "version")).over(inside)).join(F.broadcast(heads), "range")
    after = F.coalesce("following", "follows")
    return pairs.select("doc_id", "version", "n_chars", after["doc_id"].alias("next_id"), after["version"].alias("next_version"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_differing, first_differing) of every row.

    The last two tell in how many blocks the edited text's tree differs and where it does first: section.paragraph.block.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    keys = materialize(rows.groupBy("doc_id", "version").agg(F.min(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies")))
    asked = neighbours(keys.drop("copies")).select(
        F.col("next_id").alias("doc_id"), F.col("next_version").alias("version"), F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.floor(F.col("n_chars") / 3).cast("int").alias("take")
    )
    # both joins take the same columns by the same key, so Spark shuffles the texts once
    given = rows.join(asked, ["doc_id", "version"]).select("_d", "_v", "take", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("tail"), "text")
    given = with_tree(given, "text", "t").select(F.col("_d").alias("doc_id"), F.col("_v").alias("version"), "take", "tail", F.flatten("t.leaves").alias("next_leaves"), F.col("t.root").alias("next_root"))
    if keys.agg(F.max("copies")).first()[0] not in (None, 1):  # a neighbour that stands in several equal rows gives the same each time
        given = given.dropDuplicates(["doc_id", "version"])
    both = rows.join(given, ["doc_id", "version"]).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), F.col("tail"))
    both = both.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "text", edited.alias("edited"), "next_leaves", "next_root")
    both = with_tree(with_tree(both, "text", "a"), "edited", "b").withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    both = both.select("*", F.flatten("a.leaves").alias("la"), F.flatten("b.leaves").alias("lb"), differing_blocks(F.col("a"), F.col("b")).alias("differing"))
    first = F.get("differing", F.lit(0))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("a")).alias("fingerprint"),
        spelled(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a.root") == F.col("b.root"), F.col("la"), F.col("lb")).alias("near_edited"),
        likeness(F.col("a.root") == F.col("next_root"), F.col("la"), F.col("next_leaves")).alias("near_next"),
        F.size("differing").cast("long").alias("n_differing"),
        F.concat_ws(".", *[first[c].cast("string") for c in ("section", "paragraph", "block")]).alias("first_differing"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
