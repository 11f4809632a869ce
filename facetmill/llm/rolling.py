"""Vectorised hashing of byte strings: prefix sums of a polynomial modulo 2**64 give every substring's hash in O(1)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def byte_codes(seed: int) -> np.ndarray:
    """A random word for each byte value (one more for padding)."""
    return mix(np.arange(257, dtype=U) * U(0xD1342543DE82EF95) + U(seed * 0x632BE59BD9B4E019 & _MASK))


@lru_cache(maxsize=2)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    size = 1 << max(12, (n - 1).bit_length())
    return _powers_of(_BASE, size)[:n], _powers_of(pow(_BASE, -1, 1 << 64), size)[:n]


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """P with P[j] - P[i] = sum of code(data[t]) * base**t over i <= t < j."""
    out = np.zeros(len(data) + 1, U)
    if len(data):
        np.cumsum(byte_codes(seed)[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    return mix((p[end] - p[start]) * powers(len(p))[1][start] + (end - start).astype(U) * U(0x9FB21C651E98DF25))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w]) for all full windows, in linear time (block prefix and suffix minima)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def byte_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, in the order of the bytes (a view; the last 7 places have none)."""
    return np.ndarray(max(0, len(data) - 7), ">u8", np.ascontiguousarray(data), 0, (1,))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by their distance to the least one, in as few bytes each as do."""
    base = int(x.min())
    span = int(x.max()) - base
    width = next(w for w in (0, 1, 2, 4, 8) if span < 1 << (8 * w))
    rest = (x.view(U) - np.array([base], np.int64).view(U)).astype(f"u{width}") if width else np.zeros(0, np.uint8)
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + rest.tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    base, width = int.from_bytes(blob[:8], "little", signed=True), blob[8]
    if not width:
        return np.full(n, base, np.int64)
    return (np.frombuffer(blob, f"u{width}", n, 9).astype(U) + np.array([base], np.int64).view(U)).view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def ids(column: pa.Array) -> np.ndarray:
    """doc_id as int64; null becomes the smallest value, so that it sorts first and never raises."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def table_of(batches, names):
    """All batches of one task as numpy columns."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]
