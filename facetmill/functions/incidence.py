"""Rows that hold sets of small whole numbers, as matrices of a batch of rows: counts of pairs and sets, and look-ups by an inverted index (numpy).

Each function goes into mapInArrow: it sees one task's rows batch by batch and keeps nothing of them but sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 8_000_000  # of a matrix of some rows
DENSE = 4_096  # numbers up to here have their pair counts summed over a whole task

PAIRS = "i int, j int, n long"
COUNTS = "place int, n long"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the entries of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), length), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(row: np.ndarray, number: np.ndarray, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width), np.float32)
    out[row, number] = 1
    return out


def weights(part: pa.RecordBatch) -> np.ndarray:
    """How many rows each row stands for: a second column, else one."""
    return part.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if part.num_columns > 1 else np.ones(part.num_rows, np.int64)


def slices(batch: pa.RecordBatch, rows: int):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _pairs(names_a: np.ndarray, names_b: np.ndarray, product: np.ndarray) -> pa.RecordBatch | None:
    i, j = np.nonzero(product)
    a, b = names_a[i], names_b[j]
    up = a <= b
    return pa.RecordBatch.from_arrays([pa.array(a[up].astype(np.int32)), pa.array(b[up].astype(np.int32)), pa.array(product[i[up], j[up]].astype(np.int64))], names=["i", "j", "n"])


def pair_counts(batches):
    """How many rows hold both numbers, for i <= j, by a product of each batch's matrix with itself; rows as in weights.

    Up to DENSE numbers are summed over the task; where greater ones occur, each batch gives its own counts, in tiles of bounded size.
    """
    total = np.zeros((0, 0))
    for batch in batches:
        for part in slices(batch, 8_192):
            row, number = flat(part.column(0))
            if not len(number):
                continue
            count = weights(part)
            exact = np.float32 if count.sum() < 2**24 else np.float64  # whole numbers below 2 ** 24, 2 ** 53
            count = count.astype(exact)[:, None]
            names, index = np.unique(number, return_inverse=True)
            if names[-1] < DENSE:
                size = int(names[-1]) + 1
                if size > len(total):
                    grown = np.zeros((min(DENSE, 2 * size),) * 2)
                    grown[: len(total), : len(total)] = total
                    total = grown
                held = matrix(row, index, part.num_rows, len(names))
                total[np.ix_(names, names)] += held.T.astype(exact) @ (held * count)
                continue
            for s in range(0, len(names), 1_024):
                one = (index >= s) & (index < s + 1_024)
                left = matrix(row[one], index[one] - s, part.num_rows, min(1_024, len(names) - s))
                for t in range(s, len(names), 1_024):
                    two = (index >= t) & (index < t + 1_024)
                    right = matrix(row[two], index[two] - t, part.num_rows, min(1_024, len(names) - t))
                    yield _pairs(names[s : s + 1_024], names[t : t + 1_024], left.T.astype(exact) @ (right * count))
    if len(total):
        names = np.arange(len(total))
        for s in range(0, len(total), 512):
            yield _pairs(names[s : s + 512], names, total[s : s + 512])


def set_counts(sets: list[tuple[int, ...]], width: int):
    """How many rows hold all numbers of each set (numbers below width); rows as in weights."""

    def run(batches):
        index = SetIndex(sets, width)
        total = np.zeros(len(sets), np.int64)
        for batch in batches:
            for part in slices(batch, index.rows):
                (row, number), count = flat(part.column(0)), weights(part)
                for some_rows, places, hits in index.hits(row, number, part.num_rows):
                    total[places] += count[some_rows] @ hits
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "n"])

    return run


class SetIndex:
    """Inverted index of sets of numbers: each stands under the one of its numbers that fewest sets have, and is looked at only for rows with that number."""

    def __init__(self, sets: list[tuple[int, ...]], width: int):
        self.width = width
        self.rows = max(64, min(8_192, CELLS // max(1, width), CELLS // max(1, len(sets))))
        spread = np.bincount([x for s in sets for x in s], minlength=width)
        under: dict[int, list[int]] = {}
        for place, s in enumerate(sets):
            under.setdefault(min(s, key=lambda x: (spread[x], x)), []).append(place)
        self.under = []
        for number, places in under.items():
            columns = np.unique([x for p in places for x in sets[p]])
            need = np.zeros((len(places), len(columns)), np.float32)
            for k, p in enumerate(places):
                need[k, np.searchsorted(columns, sets[p])] = 1
            self.under.append((number, np.array(places), columns, need.T.copy(), need.sum(axis=1)))

    def hits(self, row: np.ndarray, number: np.ndarray, rows: int):
        """(rows, places of sets, whether each of these rows holds each of these sets)."""
        return self.hits_of(matrix(row, number, rows, self.width))

    def hits_of(self, held: np.ndarray):
        for first, places, columns, need, size in self.under:
            some = np.flatnonzero(held[:, first])
            if len(some):
                yield some, places, held[np.ix_(some, columns)] @ need == size


def index_rows(names: list[str], sets: list[tuple[int, ...]], ids: list[int]):
    """(row_id, matches) of rows (row_id, items): the ids of the sets whose items a row holds; sets are of places in names.

    Rows of a batch with the same of these items are looked up once.
    """

    def run(batches):
        index, known, own = SetIndex(sets, len(names)), pa.array(names), np.array(ids, np.int32)
        for batch in batches:
            for part in slices(batch, index.rows):
                items = part.column(1)
                row = np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy(zero_copy_only=False))
                code = pc.index_in(items.flatten(), value_set=known.cast(items.type.value_type))
                there = code.is_valid().to_numpy(zero_copy_only=False)
                held, like = distinct_rows(matrix(row[there], code.drop_null().to_numpy(), part.num_rows, len(names)))
                found = [(some[i], places[j]) for some, places, hit in index.hits_of(held) for i, j in [np.nonzero(hit)]]
                at, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                order = np.lexsort([own[place], at])
                offsets = np.searchsorted(at[order], np.arange(len(held) + 1)).astype(np.int32)
                matches = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own[place[order]]))
                yield pa.RecordBatch.from_arrays([part.column(0), matches.take(pa.array(like))], names=["row_id", "matches"])

    return run


def distinct_rows(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of zeros and ones, and for each row its place among them."""
    if not held.shape[1]:
        return held[:1], np.zeros(len(held), np.int64)
    bits = np.packbits(held.astype(bool), axis=1)
    key = bits.view(np.dtype((np.void, bits.shape[1]))).ravel()
    _, first, like = np.unique(key, return_index=True, return_inverse=True)
    return held[first], like.ravel()
