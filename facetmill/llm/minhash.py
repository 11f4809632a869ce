"""Near-duplicate detection by b-bit MinHash.

A document is the set of its distinct word shingles; equal sets are one class, represented by its smallest node.  Of 256
hash functions the minimum over the set is taken.  Hashes of 6 minima each are 42 band keys; of every minimum only 4 bits are
retained, packed into 128 bytes.  Sets that share a band key are candidates: at the threshold of 0.85 two sets share none with a
probability below 3e-9.  Bands join candidates to groups (a star for each key, then connected components).

Inside a group pairs are estimated by counting equal 4-bit lanes, e = (equal / 256 - 1/16) / (1 - 1/16), which takes out the lanes that
agree by chance.  Pairs whose estimate is less than CERTAIN standard errors below the threshold are confirmed on their full sets, most alike first,
and only while nothing has joined them yet.  A group of more than BLOCK_SETS sets is dealt by a hash into blocks of about as many, of like size:

    1  pairs within each block; the sets of a block that links join get one label
    2  of each label of an unfinished group the set that is like most others, again in blocks, until that joins no more
    3  blocks of one label each as far as possible; pairs of blocks only where labels differ and sizes allow a link

So a large group of near copies, whose blocks have one label after step 2, is compared with what is not linked to it, not with
itself; no link that could join two components is left out.

Defined cases: null, empty or wordless text has no shingles and is its own component; a text of fewer words than a shingle is one
shingle; texts of any length are taken whole; a similarity equal to the threshold links; rows that repeat a doc_id, or have none, are told apart by text, equal ones
are one node; component_id is the smallest doc_id of the component, null only if none of its rows has one; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rolling as R
from .components import connected_components
from .jaccard_join import KEY, SIGNED, groups_of, set_rows, sets_of, settle, star_rows
from .rolling import U
from .shared import NO_ID, broadcast_if_small, documents, materialize, partitions, with_row_key

HASHES, ROWS, LOW_BITS = 256, 6, 4
BANDS = HASHES // ROWS
CERTAIN = 5.5  # standard errors
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000
INFO = "doc_id long, __id long, __version long, n_shingles long, s1 long, s2 long, packed binary, bands binary"
U32 = np.uint32
_LANES = U(0x1111111111111111)


def _multipliers() -> np.ndarray:
    words = R.mix(np.arange(3 * HASHES, dtype=U) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))
    return (words >> U(32)).astype(U32).reshape(3, HASHES) | U32(1)


_A, _B, _C = _multipliers()


def minima(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """(set, function): the least hash of each set's shingles; head: where each set begins in h."""
    low, high = h.astype(U32), (h >> U(32)).astype(U32)
    out = np.empty((len(head), HASHES), U32)
    v, w = np.empty_like(low), np.empty_like(low)
    for i in range(HASHES):
        np.multiply(low, _A[i], out=v)
        np.multiply(high, _B[i], out=w)
        v += w
        v ^= _C[i]
        out[:, i] = np.minimum.reduceat(v, head)
    return out


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of minima."""
    mixed = R.mix(least.astype(U) + U(0x9E3779B97F4A7C15))
    keys = np.broadcast_to(R.mix(np.arange(1, BANDS + 1, dtype=U)), (len(least), BANDS))
    for j in range(ROWS):
        keys = R.mix(keys * U(0xA24BAED4963EE407) + mixed[:, j : BANDS * ROWS : ROWS])
    low = (mixed & U((1 << LOW_BITS) - 1)).astype(np.uint8)
    return keys, (low[:, ::2] | low[:, 1::2] << np.uint8(4))


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures (words of 16 lanes), corrected for lanes that agree by chance."""
    x = others ^ one
    x |= x >> U(1)
    x |= x >> U(2)
    equal = 1 - np.bitwise_count(x & _LANES).sum(axis=-1) / HASHES
    chance = 1 / (1 << LOW_BITS)
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: Fraction) -> float:
    """Estimates below it are not confirmed."""
    chance = 1 / (1 << LOW_BITS)
    p = chance + (1 - chance) * float(threshold)
    return float(threshold) - CERTAIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def info_rows(size: int):
    def run(batches):
        for batch in batches:
            for part, row, h in sets_of(batch, size):
                n = np.bincount(row, minlength=part.num_rows)
                sums = [np.zeros(part.num_rows, U) for _ in range(2)]
                for s, seed in zip(sums, (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)):
                    np.add.at(s, row, R.mix(h * U(seed)))
                packed, bands = [b""] * part.num_rows, [b""] * part.num_rows
                if len(row):
                    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    keys, low = signatures(minima(h, head))
                    for at, k, x in zip(row[head].tolist(), keys, low):
                        packed[at], bands[at] = x.tobytes(), k.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n.astype(np.int64)), *(pa.array(R.signed(s)) for s in sums), pa.array(packed, pa.binary()), pa.array(bands, pa.binary())],
                    names=["doc_id", "__id", "__version", "n_shingles", "s1", "s2", "packed", "bands"],
                )

    return run


def band_rows(batches):
    """Each band key of a batch once, and what shares one in the batch as edges."""
    for batch in batches:
        for i in range(0, batch.num_rows, 10_000):
            part = batch.slice(i, 10_000)
            doc = R.ids(part.column(0))
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), U)
            sig, a, b, known = settle(keys, np.repeat(doc, BANDS))
            for j in range(0, len(sig), 500_000):
                s = slice(j, j + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(R.signed(sig[s])), pa.array(a[s]), pa.array(b[s]), pa.array(known[s])], names=["sig", "a", "b", "known"])


# ---- pairs within a group


class Joined:
    """Union-find over the rows of a block."""

    def __init__(self, label: np.ndarray):
        _, first, index = np.unique(label, return_index=True, return_inverse=True)
        self.root = first[index].tolist()

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common shingles of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def linked_pairs(grp, label, size, packed, sets, threshold: Fraction):
    """Joins the rows of a block by links that are confirmed on their sets.

    Gives (pairs that joined two labels or what links had made of them, the union-find, how many rows each row is estimated like).
    """
    num, den, floor = threshold.numerator, threshold.denominator, least_estimate(threshold)
    joined, degree, found = Joined(label), np.zeros(len(grp), np.int64), []
    for i in range(len(grp) - 1):
        near = i + 1 + np.flatnonzero((grp[i + 1 :] == grp[i]) & (den * np.minimum(size[i + 1 :], size[i]) >= num * np.maximum(size[i + 1 :], size[i])))
        if not len(near):
            continue
        e = alike(packed[i], packed[near])
        some = e >= floor
        near, e = near[some], e[some]
        degree[i] += len(near)
        degree[near] += 1
        apart = label[near] != label[i]
        found.append((np.full(int(apart.sum()), i), near[apart], e[apart]))
    edges = []
    if found:
        a, b, e = (np.concatenate(x) for x in zip(*found))
        for k in np.argsort(-e, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            if joined.find(x) != joined.find(y):
                both = common(sets[x], sets[y])
                if den * both >= num * (size[x] + size[y] - both):
                    joined.join(x, y)
                    edges.append((x, y))
    return edges, joined, degree


def columns_of(table: pa.Table):
    grp, doc, size = (table.column(c).to_numpy() for c in ("grp", "doc_id", "n"))
    packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), U).reshape(-1, HASHES * LOW_BITS // 64)
    return grp, doc, size, packed, [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]


def whole_groups(batches, n_key: int, most: int):
    """Tables of consecutive whole groups of sorted rows, of about so many rows where there are as many."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_key)]
        new = np.logical_or.reduce([np.r_[True, k[1:] != k[:-1]] for k in keys])
        new[0] = tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        at, starts = 0, np.flatnonzero(new)
        while True:
            cut = starts[np.searchsorted(starts, max(at + most - rows, at + (not held))) :]
            if not len(cut):
                break
            held.append(batch.slice(at, cut[0] - at))
            yield pa.Table.from_batches(held)
            held, rows, at = [], 0, int(cut[0])
        held.append(batch.slice(at))
        rows += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def block_rows(threshold: Fraction, most: int):
    """Compare within blocks: each row with its label (the least doc_id of what is joined to it); hub: of its label the row that is like most others."""

    def run(batches):
        for table in whole_groups(batches, 2, most):
            grp, doc, size, packed, sets = columns_of(table)
            part = table.column("block").to_numpy()
            block = np.cumsum(np.r_[True, (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])])
            _, joined, degree = linked_pairs(block, doc, size, packed, sets, threshold)
            root = np.array([joined.find(i) for i in range(len(doc))])
            label = doc.copy()
            np.minimum.at(label, root, doc)
            label = label[root]
            order = np.lexsort([doc, -degree, label])
            hub = np.zeros(len(doc), bool)
            hub[order[np.r_[True, label[order][1:] != label[order][:-1]]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(doc), pa.array(label), pa.array(hub)], names=["grp", "doc_id", "label", "hub"])

    return run


def cross_rows(threshold: Fraction):
    """Compare what has different labels in a pair of blocks: edges between labels."""

    def run(batches):
        for _, table in groups_of(batches, 2):
            grp, _, size, packed, sets = columns_of(table)
            label = table.column("label").to_numpy()
            edges, _, _ = linked_pairs(grp, label, size, packed, sets, threshold)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(label[a]), pa.array(label[b])], names=["a", "b"])

    return run


def joined_in_groups(sets: DataFrame, threshold: Fraction, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(node, component), its least node, of all sets; sets: (grp, doc_id, n, packed, shingles)."""
    n = partitions(sets.sparkSession)
    # sets of one band, or of two that follow one another, may link, others never
    band = F.floor(F.log("n") / F.lit(-float(np.log(float(threshold))) * 1.0001)).cast("long")
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / block_sets), F.ceil(shingles / BLOCK_SHINGLES))

    def compared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(grp, doc_id, label, hub), and the groups of several blocks: one of at most block_sets rows is one block, a larger one has blocks of each band, dealt by a hash."""
        rows = rows.select("grp", "doc_id", "n", band.alias("band"), "packed", "shingles")
        counts = rows.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
        by_group = W.partitionBy("grp")  # as many rows as bands
        whole = (F.sum("rows").over(by_group) <= block_sets) & (F.sum("weight").over(by_group) <= BLOCK_SHINGLES)
        counts = materialize(counts.select("grp", "band", whole.alias("whole"), blocks(F.col("rows"), F.col("weight")).alias("blocks")))
        block = F.when(F.col("whole"), F.lit(-1)).otherwise(F.shiftleft("band", 32) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("long")
        placed = rows.join(counts, ["grp", "band"]).select("grp", block.alias("block"), "doc_id", "n", "packed", "shingles")
        dealt = placed.repartition(n, "grp", "block").sortWithinPartitions("grp", "block", "doc_id")
        out = materialize(dealt.mapInArrow(block_rows(threshold, block_sets), "grp long, doc_id long, label long, hub boolean"))
        return out, counts.where("not whole").select("grp").distinct()

    first, parted = compared(sets)
    labels = first.select("doc_id", "label")
    if parted.isEmpty():
        return labels.toDF("node", "component")
    rest = materialize(first.join(parted, "grp", "left_semi"))
    named, hubs, left = labels, rest, None
    while True:  # each turn but the last at least halves the hubs
        open_groups = hubs.groupBy("grp").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("grp")
        hubs = materialize(hubs.where("hub").join(open_groups, "grp", "left_semi").select("doc_id", "label"))
        now = hubs.count()
        if not now or left is not None and 2 * now > left:
            break
        left = now
        out, parted = compared(sets.join(hubs, "doc_id", "left_semi"))
        # a label becomes that of its hub
        renamed = hubs.withColumnRenamed("label", "old").join(out.select("doc_id", F.col("label").alias("new")), "doc_id").select("old", "new")
        named = materialize(named.join(renamed, named["label"] == renamed["old"], "left").select("doc_id", F.coalesce("new", "label").alias("label")))
        hubs = out.join(parted, "grp", "left_semi")

    # what still has several labels: blocks of one label each as far as possible, compared where labels differ
    rows = sets.join(rest.select("doc_id"), "doc_id", "left_semi").join(named, "doc_id")
    rows = rows.select("grp", "doc_id", "n", band.alias("band"), "label", "packed", "shingles")
    counts = materialize(rows.groupBy("grp", "band", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).withColumn("own", F.col("rows") >= block_sets // 2))
    open_groups = counts.groupBy("grp").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("grp")
    own = counts.where("own").select("grp", "band", "label", blocks(F.col("rows"), F.col("weight")).alias("own_blocks"))
    mixed = counts.where("not own").groupBy("grp", "band").agg(blocks(F.sum("rows"), F.sum("weight")).alias("mixed_blocks"))
    rows = rows.join(open_groups, "grp", "left_semi").join(own, ["grp", "band", "label"], "left").join(mixed, ["grp", "band"], "left")
    own_block = F.xxhash64("grp", "band", "label", F.pmod(F.xxhash64("doc_id"), F.col("own_blocks")))
    block = F.when(F.col("own_blocks").isNotNull(), own_block).otherwise(F.xxhash64("grp", "band", F.pmod(F.xxhash64("label"), F.col("mixed_blocks"))))
    placed = materialize(rows.select("grp", "band", block.alias("block"), "doc_id", "n", "label", "packed", "shingles"))
    meta = materialize(placed.groupBy("grp", "band", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1")))
    a, b = (meta.select("grp", *[F.col(c).alias(f"{c}_{x}") for c in ("band", "block", "l0", "l1")]) for x in "ab")
    after = (F.col("band_a") + 1 == F.col("band_b")) | (F.col("band_a") == F.col("band_b")) & (F.col("block_a") <= F.col("block_b"))
    differ = F.least("l0_a", "l0_b") != F.greatest("l1_a", "l1_b")
    pairs = a.join(b, "grp").where(after & differ).select(F.col("block_a").alias("b1"), F.col("block_b").alias("b2"))  # blocks, not rows
    ends = pairs.select("b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block")).distinct()
    met = placed.join(ends, "block").select("b1", "b2", "grp", "doc_id", "n", "label", "packed", "shingles")
    crossed = materialize(met.repartition(n, "b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(cross_rows(threshold), "a long, b long"))
    if not crossed.isEmpty():
        joined = connected_components(crossed)
        named = materialize(named.join(joined, named["label"] == joined["node"], "left").select("doc_id", F.coalesce("component", "label").alias("label")))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component"))  # a label may be any of its sets
    return named.join(least, "label").select(F.col("doc_id").alias("node"), "component")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: str = "0.85", id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept: the row has the smallest id of its component."""
    t = Fraction(threshold)
    n = partitions(docs.sparkSession)
    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    node = F.when(F.col("__version") != 0, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(*KEY), 2)).otherwise(F.col("__id"))  # rows of one id, or without one: below all ids
    rows = keyed.select(node.alias("doc_id"), "text", *KEY)
    info = materialize(rows.mapInArrow(info_rows(words), INFO))
    odd = not info.where((F.col("__version") != 0) | (F.col("__id") == NO_ID)).isEmpty()
    classes = info.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    classes = materialize(classes)

    signed = classes.select("rep", "bands").mapInArrow(band_rows, SIGNED).repartition(n, "sig")
    groups = connected_components(signed.mapInArrow(star_rows, "a long, b long"))
    able = materialize(classes.join(groups, classes["rep"] == groups["node"]).select("rep", F.col("component").alias("grp"), "n", "packed"))
    texts = rows.select("doc_id", "text").join(broadcast_if_small(able.select(F.col("rep").alias("doc_id")), 500_000), "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id"]) if odd else texts
    candidates = texts.join(able, texts["doc_id"] == able["rep"]).select("doc_id", "text", "grp", "n", "packed")
    sets = materialize(candidates.mapInArrow(set_rows(words), "doc_id long, grp long, n long, packed binary, shingles binary"))
    found = joined_in_groups(sets, t, block_sets)

    ends = classes.join(found, classes["rep"] == found["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    plain = info.select(*KEY, "doc_id", "n_shingles", "s1", "s2")
    named = plain.where("n_shingles > 0").join(ends, ["s1", "s2"]).select(*KEY, "n_shingles", "component")
    out = named.unionByName(plain.where("n_shingles = 0").select(*KEY, "n_shingles", F.col("doc_id").alias("component")))
    if odd:
        out = materialize(out)
        smallest = out.where(F.col("__id") != NO_ID).groupBy("component").agg(F.min("__id").alias("least"))
        out = out.join(smallest, "component", "left").withColumn("component", F.coalesce("least", F.lit(NO_ID)))
    return out.select(F.nullif("__id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("__id") == F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: All pairs that share a shingle, then the least id that links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
