"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A window (LENGTH bytes) is a repeat if the same bytes also start earlier: in a document of smaller doc_id, or
earlier in the same one.  Every byte of a repeat goes.

Suffixes.  Of every window only one suffix is looked at, the one at its anchor: the leftmost ANCHOR-byte string of
least hash in it.  Equal windows have equal anchors at equal places, so no match is lost, while only about one
position in thirty-five is an anchor.  Neighbouring windows with one anchor form a run.  A run travels with the suffix's
leading WORDS * 8 bytes, a hash of all its bytes, and its place.

Sort.  Splitters (leading bytes and hash) are sampled from some documents; every input batch sorts its suffixes by
multikey quicksort and deals them, cut at the splitters, to their ranges.  Each range is sorted locally by multikey
quicksort again: leading bytes, then the hash that stands for the bytes that follow, then place; neighbours are compared, and a run equal to an earlier one is repeated whole.
Suffixes that agree in their leading bytes but not in the rest go to a second round, in which all their windows are
sorted by all their bytes (multikey: eight at a time, only what is still equal looks on) and neighbours are compared over LENGTH bytes.

Boundaries.  A splitter may fall among suffixes with equal leading bytes, as it does where one string is very frequent.
The groups at either side of such a boundary, and those with more than LARGE_GROUP differing runs, are compared window by
window across ranges: their windows meet by hash (128 bits stand for the bytes), no group meets in one task.

Hot strings: of what repeats inside one input batch only the first goes to a range, so that a string in a third of all
rows reaches it once for each input batch at most.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing, and longer ones are looked at whole, however long; rows that repeat
a doc_id count as one place if their texts are equal, each of them gets a result; if not, they stand in order of a hash of their text; rows with
a null doc_id stand first, as rows of one id; equal strings: all but the first go; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .rolling import U
from .shared import documents, materialize, partitions, with_row_key

LENGTH, ANCHOR = 100, 32
WORDS = 3  # words of 8 leading bytes of a suffix that travel
CHUNK = 1 << 19  # starts that are hashed at once
SAMPLED = 20  # documents sampled for the splitters, for each range; it decides on the ranges' balance only
LARGE_GROUP = 20_000
KEY = ["__id", "__version"]  # what tells documents apart, see shared.with_row_key
# A run of n windows from byte `start` on is start * 256 + n
PACKED = "range int, n int, repeat boolean, lead binary, content binary, id binary, version binary, start binary, size binary"
# kind 1: repeat; 2: to be compared with its group; 3: the same, in a group that is large or lies in several ranges
FOUND = "__id long, __version long, run long, g long, kind int"
# kind 0: a run with its bytes; 1: a window, of which h is a second hash; 2: a window known to be a repeat
SECOND = "g long, h long, kind int, __id long, __version long, run long, bytes binary"


def multikey_quicksort(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of rows by several key words: three-way partition by a pivot word; only rows equal in it look at the next word."""
    out = np.empty(len(keys[0]), np.int64)
    stack = [(np.arange(len(out)), 0, 0)]
    while stack:
        rows, level, at = stack.pop()
        if len(rows) <= small or level == len(keys) - 1:
            tail = keys[level:][::-1]
            out[at : at + len(rows)] = rows[np.lexsort([k[rows] for k in tail])]
            continue
        word = keys[level][rows]
        sample = np.sort(word[:: max(1, len(word) // 255)])
        pivot = sample[len(sample) // 2]
        less, equal = word < pivot, word == pivot
        n_less, n_equal = int(less.sum()), int(equal.sum())
        stack.append((rows[less], level, at))
        stack.append((rows[equal], level + 1, at + n_less))
        stack.append((rows[~(less | equal)], level, at + n_less + n_equal))
    return out


def equal_to_previous(*columns: np.ndarray) -> np.ndarray:
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


def later_twin(same: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """In sorted rows: equal to the row before (same) and standing later than the first of its group."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & np.logical_or.reduce([p != p[first] for p in place])


def sorted_by_bytes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[at : at + length], and whether each is equal to the one before: multikey, 8 bytes at a time."""
    words = R.byte_words(data)
    word = words[at]
    order = np.argsort(word, kind="stable")
    same = equal_to_previous(word[order])
    for level in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        mine = order[tied]
        word, group = words[at[mine] + level], np.cumsum(~same[tied])
        by = np.lexsort([word, group])
        order[tied], word = mine[by], word[by]
        same[tied] &= np.r_[False, word[1:] == word[:-1]]
    return order, same


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(row, start, windows, leading words, content hash) of each run of windows that share an anchor."""
    out = []
    w = length - anchor + 1
    for c in range(0, max(0, len(raw) - length + 1), CHUNK):
        data = raw[c : c + CHUNK + length - 1]
        n = len(data) - length + 1
        p = R.prefix_sums(data)
        k = np.arange(len(data) - anchor + 1)
        grams = R.substring_hash(p, k, k + anchor)
        packed = (grams & ~U((1 << 20) - 1)) | k.astype(U)
        at = (R.sliding_min(packed, w) & U((1 << 20) - 1)).astype(np.int64)
        # no window crosses the end of a document
        blocked = np.zeros(n + 1, np.int32)
        inner = offsets[(offsets > c) & (offsets < c + len(data))] - c
        np.add.at(blocked, np.clip(inner - length + 1, 0, n), 1)
        np.add.at(blocked, np.clip(inner, 0, n), -1)
        valid = np.cumsum(blocked[:n]) == 0
        head = np.ones(n, bool)
        head[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        start = np.flatnonzero(valid & head)
        if not len(start):
            continue
        stop = np.flatnonzero(valid & np.r_[head[1:] | ~valid[1:], True]) + 1
        row = np.searchsorted(offsets, start + c, side="right") - 1
        words = R.byte_words(data)
        lead = [words[at[start] + 8 * i] for i in range(WORDS)]
        out.append((row, start + c - offsets[row], stop - start, *lead, R.substring_hash(p, start, stop + length - 1)))
    if not out:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, *[U] * (WORDS + 1))]
    return [np.concatenate(x) for x in zip(*out)]


def text_slices(batch: pa.RecordBatch, most: int = 8_000_000):
    """Zero-copy slices of a batch of about so many bytes of text (one document at least)."""
    begin, size = 0, 0
    lengths = batch.column(1).fill_null("")
    at = R.text_bytes(lengths)[1]
    for i in range(len(at) - 1):
        size += at[i + 1] - at[i]
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def sorted_runs(batch: pa.RecordBatch, length: int, anchor: int):
    """A slice (id, text, version): its runs in suffix order (keys; id, version, start, windows) and whether an earlier one of the slice is equal."""
    raw, offsets = R.text_bytes(batch.column(1))
    row, start, n, *keys = runs_of(raw, offsets, length, anchor)
    doc, version = (R.ids(batch.column(i))[row] for i in (0, 2))
    order = multikey_quicksort([*keys, doc, version, start])
    keys, place = [k[order] for k in keys], [x[order] for x in (doc, version, start)]
    return keys, [*place, n[order]], later_twin(equal_to_previous(*keys), *place)


def sampled_rows(length: int, anchor: int, each: int = 4):
    """Keys of some suffixes of every slice, evenly spaced in suffix order."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                keys, _, again = sorted_runs(batch, length, anchor)
                keys = [k[~again] for k in keys]
                step = max(1, len(keys[0]) // (each * batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(k[step // 2 :: step].view(np.int64)) for k in keys], names=[f"k{i}" for i in range(len(keys))])

    return run


def splitters(texts: DataFrame, n: int, length: int, anchor: int) -> np.ndarray:
    """(n - 1, WORDS + 1) keys that cut the suffixes into about equal ranges, from about SAMPLED * n documents."""
    total = texts.count()
    share = int(min(1.0, SAMPLED * n / max(1, total)) * (1 << 30))
    some = texts.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < share).select("__id", "text", "__version")
    found = some.mapInArrow(sampled_rows(length, anchor), ", ".join(f"k{i} long" for i in range(WORDS + 1))).toArrow()  # some 80 n rows
    keys = [c.to_numpy().view(U) for c in found.columns]
    order = np.lexsort(keys[::-1])
    at = order[np.arange(1, n) * len(order) // n] if len(order) else order
    return np.stack([k[at] for k in keys], axis=1) if len(at) else np.zeros((0, WORDS + 1), U)


def cut_at(splits: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Where in sorted rows each range begins and ends."""
    cuts = [0]
    for split in splits:
        a, b = 0, len(keys[0])
        for k, word in zip(keys, split):
            a, b = a + np.searchsorted(k[a:b], word, side="left"), a + np.searchsorted(k[a:b], word, side="right")
        cuts.append(int(a))
    return np.array([*cuts, len(keys[0])])


def run_rows(splits: np.ndarray, length: int, anchor: int):
    """The runs of every slice, dealt to the ranges and packed."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                keys, place, again = sorted_runs(batch, length, anchor)
                rows = []
                known = [x[again] for x in place]
                if len(known[0]):  # what is repeated for sure rides along, under any range
                    rows.append(((int(known[0][0]) * 31 + int(known[2][0])) % (len(splits) + 1), len(known[0]), True, b"", b"", *map(R.packed, known)))
                keys, place = [k[~again] for k in keys], [x[~again] for x in place]
                cuts = cut_at(splits, keys)
                for i in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[i], cuts[i + 1])
                    lead = np.stack([k[s] for k in keys[:-1]], axis=1).astype(">u8")
                    rows.append((int(i), int(cuts[i + 1] - cuts[i]), False, lead.tobytes(), keys[-1][s].tobytes(), *(R.packed(x[s]) for x in place)))
                if rows:
                    kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["range", "n", "repeat", "lead", "content", "id", "version", "start", "size"])

    return run


def compare_range(splits: np.ndarray):
    """One range of the suffix array: sort, compare neighbours, and name what must be compared by window."""

    def run(batches):
        ranges: dict[int, list] = {}
        for batch in batches:
            for at, n, repeat, lead, content, *place in zip(*(c.to_pylist() for c in batch.columns)):
                doc, version, start, size = (R.unpacked(x, n) for x in place)
                if repeat:
                    yield from found_rows(doc, version, start * 256 + size, np.zeros(n, np.int64), 1)
                else:
                    ranges.setdefault(at, []).append((*np.frombuffer(lead, ">u8").reshape(n, -1).astype(U).T, np.frombuffer(content, U), doc, version, start, size))
        for at in sorted(ranges):
            *keys, doc, version, start, size = [np.concatenate(x) for x in zip(*ranges.pop(at))]
            order = multikey_quicksort([*keys, doc, version, start])
            keys, (doc, version, start, size) = [k[order] for k in keys], [x[order] for x in (doc, version, start, size)]
            same_lead, same = equal_to_previous(*keys[:-1]), equal_to_previous(*keys)
            repeat = later_twin(same, doc, version, start)
            head = np.flatnonzero(~same_lead)
            wide = np.add.reduceat((~same).astype(np.int64), head) > LARGE_GROUP
            for end, split in ((0, at - 1), (-1, at)):  # a group that the splitter cuts goes on in the next range
                if 0 <= split < len(splits) and all(k[end] == word for k, word in zip(keys[:-1], splits[split])):
                    wide[end] = True
            count = np.diff(np.r_[head, len(order)])
            mixed = np.repeat(wide | np.logical_or.reduceat(same_lead & ~same, head), count)
            wide = np.repeat(wide, count)
            g, packed = R.signed(group_word(keys[:-1])), start * 256 + size
            yield from found_rows(doc[repeat], version[repeat], packed[repeat], g[repeat], 1)
            for kind, rows in ((2, mixed & ~same & ~wide), (3, mixed & ~same & wide)):
                yield from found_rows(doc[rows], version[rows], packed[rows], g[rows], kind)

    return run


def group_word(lead: list[np.ndarray]) -> np.ndarray:
    """One word that names the leading bytes, to bring their runs together."""
    g = R.mix(lead[0])
    for k in lead[1:]:
        g = R.mix(g * U(0xA24BAED4963EE407) + k)
    return g


def found_rows(doc, version, packed, g, kind: int):
    for i in range(0, len(doc), 200_000):
        s = slice(i, i + 200_000)
        n = len(doc[s])
        yield pa.RecordBatch.from_arrays([pa.array(x[s], pa.int64()) for x in (doc, version, packed, g)] + [pa.array(np.full(n, kind, np.int32))], names=["__id", "__version", "run", "g", "kind"])


def pieces(raw: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """raw[begin : begin + size] laid end to end, with each byte's place within its piece."""
    ends = np.cumsum(size)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    return raw[np.repeat(begin, size) + within], within


def windows_of(within: np.ndarray, n: np.ndarray, size: np.ndarray):
    """Where the windows of pieces begin, the piece of each, and its place in it."""
    at = np.flatnonzero(within < np.repeat(n, size))
    return at, np.repeat(np.arange(len(size)), size)[at], within[at]


def second_rows(length: int):
    """What the second round needs of the runs in doubt: their bytes, or every window's hashes where the group is wide."""

    def rows(kind, g, h, doc, version, run, content=None):
        n = len(g)
        kinds = pa.array(kind if isinstance(kind, np.ndarray) else np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), kinds, pa.array(doc), pa.array(version), pa.array(run), pa.nulls(n, pa.binary()) if content is None else content], names=["g", "h", "kind", "__id", "__version", "run", "bytes"])

    def run(batches):
        for batch in batches:
            raw, offsets = R.text_bytes(batch.column("text"))
            doc_ids, versions = (R.ids(batch.column(c)) for c in KEY)
            lists = batch.column("__runs")
            at = np.asarray(lists.offsets, np.int64)
            packed, g, kind = (lists.values.field(f).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for f in ("run", "g", "kind"))
            row = np.repeat(np.arange(len(doc_ids)), np.diff(at))
            for i in range(0, len(packed), 40_000):
                s = slice(i, i + 40_000)
                few = kind[s] == 2
                run_, own, group = packed[s][few], row[s][few], g[s][few]
                size = (run_ & 255) + length - 1
                data, _ = pieces(raw, offsets[own] + (run_ >> 8), size)
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield rows(0, group, np.zeros(len(group), np.int64), doc_ids[own], versions[own], run_, content)
                run_, own = packed[s][~few], row[s][~few]
                if len(run_):
                    start, n = run_ >> 8, run_ & 255
                    size = n + length - 1
                    data, within = pieces(raw, offsets[own] + start, size)
                    begin, piece, place = windows_of(within, n, size)
                    h1, h2 = (R.substring_hash(R.prefix_sums(data, seed), begin, begin + length) for seed in (1, 2))
                    doc, version, place = doc_ids[own][piece], versions[own][piece], start[piece] + place
                    order = np.lexsort([place, version, doc, h2, h1])
                    h1, h2, doc, version, place = (x[order] for x in (h1, h2, doc, version, place))
                    again = later_twin(equal_to_previous(h1, h2), doc, version, place)
                    spread = R.mix(doc.view(U) * U(0x9E3779B97F4A7C15) + place.view(U))  # a repeat for sure goes anywhere
                    yield rows(np.where(again, 2, 1).astype(np.int32), R.signed(np.where(again, spread, h1)), R.signed(h2), doc, version, place * 256 + 1)

    return run


def compare_windows(length: int, most_bytes: int = 4_000_000):
    """Second round: windows of the runs of one group against each other."""

    def repeats(same, doc, version, packed):
        again = later_twin(same, doc, version, packed)
        return doc[again], version[again], packed[again]

    def by_bytes(data, at, doc, version, packed):
        order, same = sorted_by_bytes(data, at, length)
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        mine = order[tied]
        by = np.lexsort([packed[mine], version[mine], doc[mine], np.cumsum(~same[tied])])
        mine = mine[by]
        return repeats(same[tied], doc[mine], version[mine], packed[mine])

    def run(batches):
        contents, hashed, found = [], [], []
        for b in batches:
            kind = b.column("kind").to_numpy()
            columns = [b.column(c).to_numpy() for c in ("g", "h", *KEY, "run")]
            hashed.append([x[kind == 1] for x in columns])
            found.append([x[kind == 2] for x in columns[2:]])
            contents.append(b.filter(pa.array(kind == 0)))
        if not hashed:
            return
        h1, h2, doc, version, packed = [np.concatenate(x) for x in zip(*hashed)]
        if len(h1):
            order = multikey_quicksort([h1, h2, doc, version, packed])
            h1, h2, doc, version, packed = [x[order] for x in (h1, h2, doc, version, packed)]
            found.append(repeats(equal_to_previous(h1, h2), doc, version, packed))
        table = pa.Table.from_batches(contents).combine_chunks().sort_by("g")
        g, doc, version, packed = (table.column(c).to_numpy() for c in ("g", *KEY, "run"))
        size = (packed & 255) + length - 1
        ends = np.cumsum(size)
        last = np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool)
        begin = 0
        while begin < len(g):  # whole groups, of about so many bytes together
            enough = np.flatnonzero(last[begin:] & (ends[begin:] - ends[begin] >= most_bytes))
            end = begin + enough[0] + 1 if len(enough) else len(g)
            s = slice(begin, end)
            raw, offsets = R.text_bytes(table.column("bytes").slice(begin, end - begin))
            data, within = pieces(raw, offsets[:-1], size[s])
            at, piece, place = windows_of(within, packed[s] & 255, size[s])
            found.append(by_bytes(data, at, doc[s][piece], version[s][piece], ((packed[s] >> 8)[piece] + place) * 256 + 1))
            begin = end
        doc, version, packed = merged(*[np.concatenate(x) for x in zip(*found)])
        yield from found_rows(doc, version, packed, np.zeros(len(doc), np.int64), 1)

    return run


def merged(doc: np.ndarray, version: np.ndarray, packed: np.ndarray, most: int = 255):
    """Single windows that stand next to each other as runs of up to so many."""
    order = np.lexsort([packed, version, doc])
    doc, version, start = doc[order], version[order], packed[order] >> 8
    if not len(doc):
        return doc, version, packed
    new = np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] > start[:-1] + 1)]
    head = np.flatnonzero(new)
    since = start - np.repeat(start[head], np.diff(np.r_[head, len(start)]))
    new |= (since % most == 0) & np.r_[True, start[1:] != start[:-1]]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(start)] - 1
    return doc[head], version[head], start[head] * 256 + (start[last] - start[head] + 1)


def with_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows with a column __repeats: the runs of repeated windows of each, null without one."""
    n = partitions(docs.sparkSession)
    keyed = with_row_key(docs)
    texts = keyed.select("__id", "text", "__version")
    splits = splitters(texts, n, length, anchor)
    dealt = texts.mapInArrow(run_rows(splits, length, anchor), PACKED).repartitionById(n, "range")
    found = materialize(dealt.mapInArrow(compare_range(splits), FOUND))
    # both joins take the same columns by the same key, so Spark shuffles the texts once
    unsure = found.where("kind > 1").groupBy(*KEY).agg(F.collect_list(F.struct("run", "g", "kind")).alias("__runs"))
    again = keyed.join(unsure, KEY).select(*docs.columns, *KEY, "__runs").mapInArrow(second_rows(length), SECOND)
    again = again.repartition(n, "g").mapInArrow(compare_windows(length), FOUND)
    every = found.where("kind = 1").unionByName(again)
    return keyed.join(every.groupBy(*KEY).agg(F.collect_list("run").alias("__repeats")), KEY, "left").select(*docs.columns, "__repeats")


def removed_mask(size: int, packed: np.ndarray, length: int) -> np.ndarray:
    """True for each byte that a repeated window covers."""
    cover = np.zeros(size + 1, np.int32)
    start, n = packed >> 8, packed & 255
    np.add.at(cover, start, 1)
    np.add.at(cover, np.minimum(start + n + length - 1, size), -1)
    return np.cumsum(cover[:size]) > 0


def digest_rows(length: int):
    def run(batches):
        for batch in batches:
            raw, offsets = R.text_bytes(batch.column(1))
            lists = batch.column(2).to_pylist()
            sizes, removed, spans, shas = [], [], [], []
            for i, packed in enumerate(lists):
                data = raw[offsets[i] : offsets[i + 1]]
                gone = 0
                n_spans = 0
                if packed:
                    mask = removed_mask(len(data), np.array(packed, np.int64), length)
                    gone = int(mask.sum())
                    n_spans = int((mask & ~np.r_[False, mask[:-1]]).sum())
                    data = data[~mask]
                sizes.append(int(offsets[i + 1] - offsets[i]))
                removed.append(gone)
                spans.append(n_spans)
                shas.append(hashlib.sha256(data.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_repeats(docs, length).mapInArrow(digest_rows(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text_rows(length: int):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raw, offsets = R.text_bytes(batch.column(at))
            texts, old = [], batch.column(at).to_pylist()
            for i, packed in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if packed:
                    data = raw[offsets[i] : offsets[i + 1]]
                    texts.append(data[~removed_mask(len(data), np.array(packed, np.int64), length)].tobytes().decode("utf-8", "ignore"))
                else:
                    texts.append(old[i])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes cut out of their text; a character cut in half goes whole."""
    return with_repeats(docs, length).mapInArrow(kept_text_rows(length), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


#: All windows by their md5 and first place; covered bytes as runs of starts.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n - 99)) AS s, x FROM d WHERE n >= 100),
h AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 200)) AS h FROM p),
f AS (SELECT h, min((doc_id, s)) AS first FROM h GROUP BY h HAVING count(*) > 1),
t AS (SELECT doc_id, s FROM h JOIN f USING (h) WHERE (doc_id, s) > first),
g AS (SELECT doc_id, s, (s > coalesce(lag(s) OVER w, -1000) + 100)::INT AS head FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
r AS (SELECT doc_id, sum(head) OVER (PARTITION BY doc_id ORDER BY s) AS run, s FROM g),
u AS (SELECT doc_id, run, min(s) AS low, max(s) + 100 AS high FROM r GROUP BY 1, 2),
k AS (SELECT u.doc_id, high - low AS cut, substr(x, 2 * coalesce(lag(high) OVER w, 0) + 1, 2 * (low - coalesce(lag(high) OVER w, 0))) AS before, CASE WHEN lead(low) OVER w IS NULL THEN substr(x, 2 * high + 1) ELSE '' END AS after, low
      FROM u JOIN d USING (doc_id) WINDOW w AS (PARTITION BY u.doc_id ORDER BY low)),
z AS (SELECT doc_id, sum(cut)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(before || after, '' ORDER BY low) AS kept FROM k GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)
"""
