"""N-gram Jaccard self-join by PartEnum signatures.

A document is the set of its distinct word shingles.  Two sets can only reach the threshold t if each has at least the
share t of its shingles in other sets; a count of shared shingles leaves aside all that do not (it may count too
many, by 32-bit collisions inside a bucket of hashes, never too few).  The others are joined.  Sets fall into bands of size such that two sets with a Jaccard
similarity of at least the threshold lie in one band or in neighbouring ones; within such a pair of bands the
threshold means a Hamming distance of at most k.  The feature domain (64-bit shingle hashes) is cut into n1 parts of n2
subparts, n1 = k // (k2 + 1) + 1: in at least one part two such sets differ in at most k2 subparts, so they agree on
some n2 - k2 subparts.  The hash of the contents of each choice of n2 - k2 subparts of each part is a signature, and
sufficiently similar sets share one.

What shares a signature is joined to a candidate group (a star for each signature, then connected components).  The
sets of a group that are of like size are compared exactly, in blocks of bounded size and, as far as there are tasks for
them, of some hundred sets; each pair of blocks is a group of rows of its own, so a large group is split.  Links give the components.

Hot groups: equal sets are one class, represented by its smallest node; a signature is reduced to one row for each
input batch before the shuffle; within a pair of blocks, shingles that most sets have are compared by the sets that lack them, so
near copies cost what they differ in, not what they share.

Defined cases: null, empty or wordless text has no shingles and links with nothing; a text of fewer words than a shingle is
one shingle; texts of any length are taken whole; a similarity equal to the threshold links; rows that repeat a doc_id, or have none, are told apart by text, equal ones count as one node;
component_id is the smallest doc_id of the component, null only if none of its rows has one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .components import connected_components
from .rolling import U
from .shared import NO_ID, documents, materialize, partitions, with_row_key
from .suffix_dedup import text_slices

BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 200
INFO = "doc_id long, __id long, __version long, n_shingles long, s1 long, s2 long"
SHINGLES = "part int, slice long, docs binary, owners binary, hashes binary"
KEY = ["__id", "__version"]
COUNTS = "slice long, docs binary, counts binary"
SIGNED = "sig long, a long, b long, known boolean"  # known: a and b are an edge already, else a has the signature
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = _LOWER[raw]
    word = (low != 32) & ~((low >= 9) & (low <= 13))
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word & (cut[:-1] | np.r_[True, ~word[:-1]]))
    end = np.flatnonzero(word & (cut[1:] | np.r_[~word[1:], True])) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = R.substring_hash(R.prefix_sums(low), start, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[head, len(row)])
    left = np.repeat(head + count, count) - np.arange(len(row))  # words from here to the end of the text
    acc = h.copy()
    short = np.repeat(count, count) < size
    whole = np.zeros(len(h), U)
    for j in range(1, size):
        done = short & (left == j)
        whole[done] = acc[done]
        more = left > j
        acc[more] = R.mix(acc[more] * U(0xA24BAED4963EE407) + h[np.flatnonzero(more) + j])
    first = np.zeros(len(h), bool)
    first[head] = True
    use = np.where(short, first, left >= size)
    whole[~short] = acc[~short]
    n_words = np.where(short, np.repeat(count, count), size)
    h, row = R.mix(whole[use] + n_words[use].astype(U)), row[use]
    order = np.lexsort([h, row])
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    return row[new], h[new]


class Bands:
    """Size bands and the parameters of their signatures for one threshold."""

    def __init__(self, threshold: Fraction, n2: int = 3, k2: int = 1):
        self.threshold, self.n2, self.k2, self.low = threshold, n2, k2, [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        t = self.threshold
        while len(sizes) and self.low[-3:][0] <= sizes.max() or len(self.low) < 3:
            self.low.append(self.low[-1] * t.denominator // t.numerator + 1)
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """(n1, n2, k2) for pairs of a set in this band with one in this or the next."""
        t = self.threshold
        while len(self.low) < band + 3:
            self.low.append(self.low[-1] * t.denominator // t.numerator + 1)
        k = int((self.low[band + 1] + self.low[band + 2] - 2) * (1 - t) / (1 + t))
        if k <= 4:  # few differences: one part, half of 2 k subparts (two of three for k = 1)
            return 1, (1, 3, 4, 6, 8)[k], k
        return k // (self.k2 + 1) + 1, self.n2, self.k2

    def signatures(self, row: np.ndarray, h: np.ndarray):
        """(row, signature) of each set; row and h as from shingle_hashes."""
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sizes = np.diff(np.r_[head, len(row)])
        bands = self.of(sizes)
        weight = R.mix(h + U(0x5851F42D4C957F2D))
        place = R.mix(h ^ U(0x14057B7EF767814F))
        for instance in np.unique(np.r_[bands, bands - 1]):
            if instance < 0:
                continue
            sets = np.flatnonzero((bands == instance) | (bands == instance + 1))
            n1, n2, k2 = self.plan(int(instance))
            size = sizes[sets]
            at = np.repeat(head[sets] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            sums = np.zeros((len(sets), n1 * n2), U)
            np.add.at(sums.reshape(-1), np.repeat(np.arange(len(sets)), size) * (n1 * n2) + (place[at] % U(n1 * n2)).astype(np.int64), weight[at])
            sums = sums.reshape(len(sets), n1, n2)
            for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
                name = R.mix(np.arange(n1, dtype=U) + U((int(instance) * 1000 + c) << 24))
                sig = np.broadcast_to(name, (len(sets), n1))
                for j in chosen:
                    sig = R.mix(sig * U(0x9E3779B97F4A7C15) + sums[:, :, j])
                yield np.repeat(row[head[sets]], n1), sig.reshape(-1)


def sets_of(batch: pa.RecordBatch, size: int):
    for part in text_slices(batch, 2_000_000):
        rows, hashes, at = [], [], 0
        for piece in text_slices(part, 500_000):  # hashing takes some hundred times the memory of its bytes
            row, h = shingle_hashes(*R.text_bytes(piece.column(1)), size)
            rows.append(row + at)
            hashes.append(h)
            at += piece.num_rows
        yield part, np.concatenate(rows), np.concatenate(hashes)


def info_rows(size: int):
    def run(batches):
        for batch in batches:
            for part, row, h in sets_of(batch, size):
                n = np.bincount(row, minlength=part.num_rows)
                sums = [np.zeros(part.num_rows, U) for _ in range(2)]
                for s, seed in zip(sums, (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)):
                    np.add.at(s, row, R.mix(h * U(seed)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n.astype(np.int64)), *(pa.array(R.signed(s)) for s in sums)], names=["doc_id", "__id", "__version", "n_shingles", "s1", "s2"])

    return run


def shingle_rows(size: int, parts: int):
    """The shingles of a slice of documents, packed by hash bucket: documents, owner of each hash, low half of each hash."""

    def run(batches):
        for batch in batches:
            for piece, row, h in sets_of(batch, size):
                part = ((h >> U(32)) * U(parts)) >> U(32)
                order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
                low, owner = h[order].astype(np.uint32), row[order].astype(np.uint32)
                cuts = np.searchsorted(part[order], np.arange(parts + 1).astype(U))
                docs = R.ids(piece.column(0))
                name = int(R.signed(R.mix(docs.view(U)).sum(dtype=U, keepdims=True))[0])
                found = []
                for p in np.flatnonzero(np.diff(cuts)):
                    own, index = np.unique(owner[cuts[p] : cuts[p + 1]], return_inverse=True)
                    found.append((p, name, docs[own].tobytes(), index.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes(), low[cuts[p] : cuts[p + 1]].tobytes()))
                if found:
                    p, n, d, o, x = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (d, o, x))], names=["part", "slice", "docs", "owners", "hashes"])

    return run


def shared_rows(batches):
    """For each slice of documents, how many shingles in this task's buckets another document has as well, packed by document."""
    buckets: dict[int, list] = {}
    for batch in batches:
        for part, name, docs, owners, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            low = np.frombuffer(hashes, np.uint32)
            buckets.setdefault(part, []).append((name, np.frombuffer(docs, np.int64), np.frombuffer(owners, np.uint16 if len(owners) == 2 * len(low) else np.uint32), low))
    for part in sorted(buckets):
        blobs = buckets.pop(part)
        base = np.r_[0, np.cumsum([len(d) for _, d, _, _ in blobs])]
        owner = np.concatenate([o.astype(np.int64) + b for (_, _, o, _), b in zip(blobs, base)])
        low = np.concatenate([x for _, _, _, x in blobs])
        order = np.argsort(low)
        low = low[order]
        twin = low[1:] == low[:-1]
        n = np.bincount(owner[order[np.r_[False, twin] | np.r_[twin, False]]], minlength=base[-1]).astype(np.uint32)
        rows = [(name, docs[some].tobytes(), own[some].tobytes()) for (name, docs, _, _), a, b in zip(blobs, base, base[1:]) if (some := (own := n[a:b]) > 0).any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["slice", "docs", "counts"])


def summed_rows(batches):
    """(doc_id, shared): the counts of a slice's documents over all buckets."""
    slices: dict[int, list] = {}
    for batch in batches:
        for name, docs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            slices.setdefault(name, []).append((np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32)))
    for blobs in slices.values():
        docs, at = np.unique(np.concatenate([d for d, _ in blobs]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c for _, c in blobs]))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(n.astype(np.int64))], names=["doc_id", "shared"])


def signature_rows(threshold: Fraction, n2: int, k2: int, most: int = 1 << 18):
    def run(batches):
        bands = Bands(threshold, n2, k2)
        for batch in batches:
            doc = R.ids(batch.column(0))
            sets = [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(sets):
                end, n = begin, 0
                while end < len(sets) and n < most:
                    n += len(sets[end])
                    end += 1
                row = np.repeat(np.arange(begin, end), [len(x) for x in sets[begin:end]])
                found = list(bands.signatures(row, np.concatenate(sets[begin:end])))
                begin = end
                sig, a, b, known = settle(np.concatenate([x for _, x in found]), doc[np.concatenate([r for r, _ in found])])
                for i in range(0, len(sig), 500_000):
                    s = slice(i, i + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(R.signed(sig[s])), pa.array(a[s]), pa.array(b[s]), pa.array(known[s])], names=["sig", "a", "b", "known"])

    return run


def stars(sig: np.ndarray, doc: np.ndarray):
    """Of rows sorted by (sig, doc): whether a row starts its signature, and the first doc of each row's signature."""
    head = np.r_[True, sig[1:] != sig[:-1]][: len(sig)]
    return head, doc[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))]


def distinct_edges(a: np.ndarray, b: np.ndarray):
    order = np.lexsort([b, a])
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


def settle(sig: np.ndarray, doc: np.ndarray):
    """One row for each signature of a batch; the batch's other documents of it become edges with a random key."""
    order = np.lexsort([doc, sig])
    sig, doc = sig[order], doc[order]
    head, first = stars(sig, doc)
    other = ~head & (doc != first)
    a, b = distinct_edges(doc[other], first[other])
    spread = R.mix(a.view(U) * U(0x9E3779B97F4A7C15) + b.view(U))
    n = int(head.sum())
    return np.concatenate([sig[head], spread]), np.concatenate([doc[head], a]), np.concatenate([np.zeros(n, np.int64), b]), np.repeat([False, True], [n, len(a)])


def star_rows(batches):
    """Edges from the smallest document of each signature to its others."""
    sig, a, b, known = R.table_of(batches, ["sig", "a", "b", "known"])
    known = known.astype(bool)
    edges = [distinct_edges(a[known], b[known])]
    sig, doc = sig[~known], a[~known]
    order = np.lexsort([doc, sig])
    sig, doc = sig[order], doc[order]
    if len(sig):
        head, first = stars(sig, doc)
        other = ~head & (doc != first)
        edges.append(distinct_edges(doc[other], first[other]))
    a, b = distinct_edges(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
    for i in range(0, len(a), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 500_000]), pa.array(b[i : i + 500_000])], names=["a", "b"])


def set_rows(size: int):
    """The set of each candidate, as bytes of its sorted shingle hashes."""

    def run(batches):
        for batch in batches:
            for part, row, h in sets_of(batch, size):
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                data = h.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array([data[8 * a : 8 * b] for a, b in zip(at, at[1:])], pa.binary())],
                    names=["doc_id", *part.schema.names[2:], "shingles"],
                )

    return run


def groups_of(batches, n_key: int):
    """Rows of a sorted stream, group by group."""
    kept, key = [], None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_key)]
        new = np.flatnonzero(np.logical_or.reduce([np.r_[True, c[1:] != c[:-1]] for c in columns])) if batch.num_rows else []
        for a, b in zip(new, [*new[1:], batch.num_rows]):
            this = tuple(c[a] for c in columns)
            if kept and this != key:
                yield key, pa.Table.from_batches(kept)
                kept = []
            key = this
            kept.append(batch.slice(a, b - a))
    if kept:
        yield key, pa.Table.from_batches(kept)


def link_rows(threshold: Fraction):
    """Compare the sets of one pair of blocks exactly: edges that join them, and (doc, doc, number of linked rows)."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        for key, table in groups_of(batches, 4):
            doc, block, side, copies = (table.column(c).to_numpy() for c in ("doc_id", "block", "side", "copies"))
            sets = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
            a, b, n = compare(doc, block, side, copies, sets, key[2] == key[3], num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def minority(owner: np.ndarray, feature: np.ndarray, n_sets: int):
    """(owner, feature) such that each feature is listed for at most half of the sets: a feature of more of them is listed for those that lack it.

    With it the number of sets' common features: frequent - lacking[i] - lacking[j] + features listed for both.
    """
    count = np.bincount(feature)
    often = np.flatnonzero(2 * count > n_sets)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    mine = place[feature] >= 0
    present = np.zeros(n_sets * len(often), bool)  # at most twice the pairs given
    present[owner[mine] * len(often) + place[feature[mine]]] = True
    absent = np.flatnonzero(~present)
    lacks = absent // max(1, len(often))
    return np.r_[owner[~mine], lacks], np.r_[feature[~mine], often[absent % max(1, len(often))]], len(often), np.bincount(lacks, minlength=n_sets)


def compare(doc, block, side, copies, sets, within: bool, num: int, den: int):
    """Edges that join the sets, and numbers of links; two sets of side 1 meet in the next band, two of one block in that block's own task."""
    n_sets = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n_sets), size)
    _, feature, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, U), return_inverse=True, return_counts=True)
    shared = count[feature] > 1
    owner, feature, frequent, lacking = minority(owner[shared], feature[shared], n_sets)
    _, feature = np.unique(feature, return_inverse=True)
    by_owner = np.argsort(owner, kind="stable")
    owner, feature = owner[by_owner], feature[by_owner]
    own_at = np.searchsorted(owner, np.arange(n_sets + 1))
    listed = owner[np.argsort(feature, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(feature))]
    label, links = np.arange(n_sets), np.zeros(n_sets, np.int64)
    a, b = [], []
    for i in range(n_sets):
        f = feature[own_at[i] : own_at[i + 1]]
        begin, n = first[f], first[f + 1] - first[f]
        at = np.repeat(begin - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())
        common = np.bincount(listed[at], minlength=n_sets) + frequent - lacking[i] - lacking
        linked = (den * common >= num * (size[i] + size - common)) & (doc != doc[i]) & ((side == 0) | (side[i] == 0))
        if not within:
            linked &= block != block[i]
        links[i] = copies[linked].sum()
        apart = np.flatnonzero(linked & (label != label[i]))
        if len(apart):  # one edge to each group that this set joins
            names, one = np.unique(label[apart], return_index=True)
            a += [doc[i]] * len(one)
            b += doc[apart[one]].tolist()
            label[np.isin(label, np.r_[names, label[i]])] = min(names[0], label[i])
    some = links > 0
    return np.r_[np.array(a, np.int64), doc[some]], np.r_[np.array(b, np.int64), doc[some]], np.r_[np.zeros(len(a), np.int64), links[some]]


def joined_rows(docs: DataFrame, words: int = 3, threshold: str = "0.9", n2: int = 3, k2: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __version, n_shingles, component, component_id, n_links) of every row, by shared.with_row_key; component names rows that links join."""
    t = Fraction(threshold)
    n = partitions(docs.sparkSession)
    keyed = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    several = F.col("__version") != 0  # of one id, or without one: nodes of their own, below all ids
    node = F.when(several, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(*KEY), 2)).otherwise(F.col("__id"))
    rows = keyed.select(node.alias("doc_id"), "text", *KEY)
    texts = rows.select("doc_id", "text")
    info = materialize(rows.mapInArrow(info_rows(words), INFO))
    odd = not info.where((F.col("__version") != 0) | (F.col("__id") == NO_ID)).isEmpty()
    classes = info.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    classes = materialize(classes)

    # only sets with enough shingles that other sets have can link
    counted = texts.mapInArrow(shingle_rows(words, n), SHINGLES).repartition(n, "part").mapInArrow(shared_rows, COUNTS)
    counted = counted.repartition(n, "slice").mapInArrow(summed_rows, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    able = counted.join(classes, counted["doc_id"] == classes["rep"]).where(F.col("shared") * t.denominator >= F.col("n") * t.numerator).select("rep", "copies")
    single = texts.dropDuplicates(["doc_id"]) if odd else texts
    candidates = single.join(able, single["doc_id"] == able["rep"]).select("doc_id", "text", "copies")
    sets = materialize(candidates.mapInArrow(set_rows(words), "doc_id long, copies long, shingles binary"))

    # what shares a signature, directly or by others, is compared
    signed = sets.select("doc_id", "shingles").mapInArrow(signature_rows(t, n2, k2), SIGNED).repartition(n, "sig")
    groups = connected_components(signed.mapInArrow(star_rows, "a long, b long"))
    # and of a group only sets of like size: of one band (side 0), or one of it and one of the next (side 1)
    width = math.log(t.denominator / t.numerator) * 1.0001
    band = F.floor(F.log(F.length("shingles") / F.lit(8)) / F.lit(width)).cast("int")
    sides = F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("side")), F.struct((band - 1).alias("band"), F.lit(1).alias("side"))))
    members = sets.join(groups, sets["doc_id"] == groups["node"]).select("component", "doc_id", "copies", "shingles", sides.alias("x")).select("*", "x.band", "x.side").where("band >= 0")
    # so many blocks that a pair of them is one of enough tasks and bounded in size; a set goes to as many tasks as there are blocks
    by_rows = F.least(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)), F.lit(math.ceil(math.sqrt(2 * n))))
    by_size = F.ceil(F.sum(F.length("shingles")) / F.lit(8 * BLOCK_SHINGLES))
    sizes = members.groupBy("component", "band").agg(F.count(F.lit(1)).alias("m"), F.min("side").alias("low"), F.greatest(by_rows, by_size).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    placed = members.join(sizes.where("m > 1 and low = 0"), ["component", "band"]).select("component", "band", "side", "doc_id", "copies", "blocks", block, "shingles")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("*", other).select("component", "band", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "doc_id", "block", "side", "copies", "shingles")
    key = ["component", "band", "b1", "b2"]
    keyed = pairs.repartition(n, *key).sortWithinPartitions(*key, "doc_id")
    links = materialize(keyed.mapInArrow(link_rows(t), "a long, b long, n long"))

    found = connected_components(links.select("a", "b"))
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    ends = classes.join(found, classes["rep"] == found["node"], "left").join(counts, classes["rep"] == counts["a"], "left")
    ends = ends.select("s1", "s2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = info.where("n_shingles > 0").join(ends, ["s1", "s2"]).select(*KEY, "n_shingles", F.col("component_id").alias("component"), F.col("n_links").cast("long").alias("n_links"))
    out = out.unionByName(info.where("n_shingles = 0").select(*KEY, "n_shingles", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("n_links")))
    if not odd:
        return out.withColumn("component_id", F.col("component"))
    out = materialize(out)
    smallest = out.where(F.col("__id") != NO_ID).groupBy("component").agg(F.min("__id").alias("component_id"))
    return out.join(smallest, "component", "left")


def jaccard_components(docs: DataFrame, words: int = 3, threshold: str = "0.9", n2: int = 3, k2: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links counts the other rows that it links with."""
    return joined_rows(docs, words, threshold, n2, k2, id_col, text_col).select(F.nullif("__id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", "component_id", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


#: All pairs that share a shingle, then the least id that links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, (SELECT count(*) FROM e WHERE e.a = c.doc_id) AS n_links FROM c LEFT JOIN n USING (doc_id)
"""
