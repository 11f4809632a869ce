"""Token counts: byte-pair merging of many pre-tokens at once in numpy (rank-synchronous array merging).

The pre-tokens of a batch are held as one ragged array of symbol ids.  Each round looks up the rank of every
adjacent pair, takes for each sequence its lowest rank, merges every occurrence of that pair in that sequence
(left to right, without overlap) and compacts the array; sequences without a mergeable pair are done.  What is
left of each is its token count.

A very long pre-token has thousands of different ranks to go through, so going over all of it each round would take
quadratic time.  Those longer than LONG are merged by rank as well, all occurrences of a pair at once, but on linked
places: the places of each rank wait in a list of their own, and a round looks at that list and its neighbours only.

Defined cases: null or empty text has 0 bytes and 0 tokens; an empty table gives an empty result; of equal pairs that overlap the left one merges; repeated rows give repeated results; extra columns
of the input are ignored; a text of any length is counted whole, in about linear time.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_REMEMBERED, _LETTERS = 400_000, 20_000_000  # runs, and their characters, whose counts a task keeps; then it starts anew
LONG = 512  # bytes of a pre-token from which on it is merged on linked places


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Counts tokens of pre-tokens (bytes) by the merges of one vocabulary file."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        ids = dict(vocab)
        number = lambda s: ids.setdefault(s, len(ids))
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        left, right = (np.array([number(p[i]) for p in pairs], np.int64) for i in (0, 1))
        made = np.array([number(a + b) for a, b in pairs], np.int64)
        symbols = byte_symbols()
        self.first = np.array([ids.get(symbols[b], -1) for b in range(256)], np.int64)
        self.last = np.array([ids.get(symbols[b] + suffix, -1) for b in range(256)], np.int64)
        self.width = len(ids) + 1
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], len(self.key))

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each byte, and the word it belongs to; bytes outside the vocabulary are left out."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        sym = self.first[data]
        full = lengths > 0
        sym[ends[full] - 1] = self.last[data[ends[full] - 1]]
        known = sym >= 0
        return sym[known], owner[known]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; a byte outside the vocabulary counts none, as the library drops unknown symbols."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self.count_short(words)
        counts = self.count_short([b"" if len(w) > LONG else w for w in words])
        counts[long] = [self.count_long(words[i]) for i in long]
        return counts

    def count_long(self, word: bytes) -> int:
        """Tokens of one long word: the lowest rank first, all its places at once, on a list of linked places."""
        none = len(self.key)
        sym, _ = self.symbols([word])
        n = len(sym)
        if n < 2:
            return n
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, none)  # of the pair that starts at each place; none where no pair does
        rank[: n - 1] = self.ranks(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            """List places under the rank of their pair."""
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.r_[True, rank[at[1:]] != rank[at[:-1]]][: len(at)])
            for a, b in zip(cut, [*cut[1:], len(at)]):
                r = int(rank[at[a]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(at[a:b])

        wait(np.arange(n - 1))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # the others have changed since
            if not len(at):
                continue
            # in a run of neighbouring places (a pair such as "a a" in "aaaa") only every second one merges
            new_run = np.r_[True, after[at[:-1]] != at[1:]]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            rank[gone] = none
            follow = after[gone]
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            left -= len(at)
            rank[at] = none
            rank[at[inner]] = self.ranks(sym[at[inner]], sym[follow[inner]])
            prior = before[at]
            prior = prior[prior >= 0]
            rank[prior] = self.ranks(sym[prior], sym[after[prior]])
            wait(np.unique(np.r_[at, prior]))
        return left

    def count_short(self, words: list[bytes]) -> np.ndarray:
        none = len(self.key)
        counts = np.zeros(len(words), np.int64)
        sym, owner = self.symbols(words)
        while len(sym) > 1:
            rank = np.full(len(sym), none)
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
            head = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(sym)])
            done = low == none
            if done.any():
                counts[owner[head[done]]] = size[done]
                keep = ~np.repeat(done, size)
                sym, owner, rank = sym[keep], owner[keep], rank[keep]
                low, size = low[~done], size[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            # in a run of neighbouring hits (a pair such as "a a" in "aaaa") only every second one merges
            at = np.flatnonzero(hit)
            new_run = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        if len(sym) == 1:
            counts[owner[0]] = 1
        return counts


@lru_cache(maxsize=2)
def load(path: str):
    """Vocabulary, special strings and split pattern of a word-end BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    special = [t["content"] for t in spec["added_tokens"]]
    return Merger(model["vocab"], model["merges"], model["end_of_word_suffix"] or ""), regex.compile(split), regex.compile("|".join(map(regex.escape, special)))


def normalized(text: str) -> str:
    """NFC, white space to one blank, lower case code point by code point (no rule for a final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Remembered(dict):
    """Counts of runs between blanks, which no pre-token crosses; `letters` is the length of them all."""

    letters = 0

    def tidy(self) -> None:
        if len(self) > _REMEMBERED or self.letters > _LETTERS:
            self.clear()
            self.letters = 0


def count_texts(texts: list[str], path: str, remembered: Remembered) -> list[int]:
    """Tokens of each text."""
    merger, split, special = load(path)
    words: list[list[str]] = []
    extra: list[int] = []
    for text in texts:
        parts = special.split(text) if "<|" in text else [text]
        extra.append(len(parts) - 1)
        words.append([w for part in parts for w in normalized(part).replace("\n", " ").split(" ")])
    remembered.tidy()
    new = list(set().union(*words).difference(remembered))
    for i in range(0, len(new), 100_000):
        runs = new[i : i + 100_000]
        pieces = [split.findall(w) for w in runs]
        distinct = list(set().union(*pieces))
        count = dict(zip(distinct, merger.count([w.encode() for w in distinct]).tolist()))
        remembered.update((w, sum(map(count.__getitem__, p))) for w, p in zip(runs, pieces))
        remembered.letters += sum(map(len, runs))
    get = remembered.__getitem__
    return [n + sum(map(get, ws)) for n, ws in zip(extra, words)]


def slices(texts: list[str], most: int = 4_000_000):
    """Runs of texts of about so many characters, to bound what a task holds."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; narrow: no shuffle."""

    def run(batches):
        remembered = Remembered()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens: list[int] = []
            for a, b in slices(texts):
                n_tokens += count_texts(texts[a:b], tokenizer_path, remembered)
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
