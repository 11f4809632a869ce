"""Language identification of mixed-language texts.

Learning: of at most about MAX_TAUGHT texts of each language the words are counted in Spark over the whole sample; a
word seen n times counts 1 + floor(log2 n), so that a few frequent words do not decide alone.  Its character 1- to 4-grams are
counted by hash, which gives each language a log-probability table; the scripts of the words' first letters are counted as
well.  All counts are whole numbers, so the model does not depend on partitions or batches.

Prediction: the script of a word (by code-point ranges) narrows the languages; each distinct word of a task gets a score
for each language once; Viterbi over the words of every text, with a penalty for every switch, labels spans.  All texts of
a slice are walked at once, word by word, so the path is always the best one, however long the text is.

Defined cases: null and empty texts and texts without a letter are `und` with score 0 and no spans; equal scores go to the language
that comes first by name; a word in a script that was never taught is judged by all languages; an empty table gives an
empty result; texts of any length are labelled whole; rows without a language teach nothing; with nothing to learn from, all is
`und`; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .rolling import U
from .shared import documents, materialize
from .suffix_dedup import text_slices

MAX_TAUGHT = 4_000
GRAMS = 1 << 16
SWITCH = 25.0
SCRIPT_SHARE = 0.002
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"
WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 20  # code points of a text that are cut into words at once
KEPT_WORDS, KEPT_LETTERS = 300_000, 20_000_000  # what a task remembers; then it starts anew
#: First code point of each stretch of letters and its script (fixed values).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
NAMES = sorted({s for _, s in SCRIPTS})
_FROM, _SCRIPT = np.array([a for a, _ in SCRIPTS]), np.array([NAMES.index(s) for _, s in SCRIPTS])


def pieces_of(text: str):
    """A text in stretches that end between words."""
    begin = 0
    while len(text) - begin > PIECE:
        end = begin + PIECE
        while end < len(text) and (text[end].isalnum() and text[end - 1].isalnum()):
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of <word><word>... and the length of each word with its brackets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32), sizes


def grams_of(code: np.ndarray, sizes: np.ndarray):
    """For n = 1 .. 4: the number of the n-gram that starts at each code point, and whether it ends within its word."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    h = R.mix(code.astype(U) * U(0x9E3779B97F4A7C15))
    so_far = h
    for n in (1, 2, 3, 4):
        if n > 1:
            so_far = R.mix(so_far[:-1] * U(0xA24BAED4963EE407) + h[n - 1 :])
        yield (so_far % U(GRAMS)).astype(np.int64), left[: len(so_far)] >= n


def script_of(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of the script of each word's first letter."""
    return _SCRIPT[np.searchsorted(_FROM, code[np.cumsum(sizes) - sizes + 1], side="right") - 1]


def word_rows(batches):
    """(lang, word, n) of each batch."""
    for whole in batches:
        for batch in text_slices(whole):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in pieces_of((text or "").lower()):
                    counts.setdefault(lang, Counter()).update(WORD.findall(piece))
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


def gram_rows(batches):
    """(lang, word, n, weight) -> (lang, kind, at, n): kind 0 counts grams by weight, kind 1 scripts by n."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        words, n, weight = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for lang in set(langs):
            mine = np.flatnonzero(langs == lang)
            code, sizes = code_points([words[i] for i in mine])
            table = grams.setdefault(lang, np.zeros(GRAMS, np.int64))
            for gram, inside in grams_of(code, sizes):
                each = np.repeat(weight[mine], sizes)[: len(gram)]
                np.add.at(table, gram[inside], each[inside])
            np.add.at(scripts.setdefault(lang, np.zeros(len(NAMES), np.int64)), script_of(code, sizes), n[mine])
    for kind, tables in ((0, grams), (1, scripts)):
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "kind", "at", "n"])


class Model:
    """Log probabilities of grams and the scripts of each language."""

    def __init__(self, langs: list[str], counts: pa.Table | None):
        self.langs = langs
        grams, scripts = np.zeros((GRAMS, len(langs))), np.zeros((len(NAMES), len(langs)))
        if counts is not None and counts.num_rows:
            own = np.searchsorted(np.array(langs, object), np.array(counts.column("lang").to_pylist(), object))
            kind, at, n = (counts.column(c).to_numpy() for c in ("kind", "at", "n"))
            for k, table in ((0, grams), (1, scripts)):
                table[at[kind == k], own[kind == k]] = n[kind == k]
        self.log = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * GRAMS)).astype(np.float32)
        self.allowed = scripts / np.maximum(1, scripts.sum(axis=0)) >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(axis=1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): score of each word, relative to its best language; about one gram in four is evidence of its own."""
        code, sizes = code_points(words)
        first = np.cumsum(sizes) - sizes
        s = np.zeros((len(words), len(self.langs)), np.float32)
        for gram, inside in grams_of(code, sizes):
            each = np.zeros((len(code), len(self.langs)), np.float32)
            each[: len(gram)][inside] = self.log[gram[inside]]
            s += np.add.reduceat(each, first, axis=0)
        s = np.where(self.allowed[script_of(code, sizes)], s / 4, s.min(axis=1, keepdims=True) / 4 - 10)
        return s - s.max(axis=1, keepdims=True)


class WordScores(dict):
    """Number of each word that a task has seen; the words' scores stand in a table that grows by doubling."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.letters = model, [], 0
        self.table, self.sizes = np.zeros((1 << 12, len(model.langs)), np.float32), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self[word] = at
        self.new.append(word)
        return at

    def numbers(self, text: str) -> np.ndarray:
        found = [np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)) for piece in pieces_of(text.lower()) if (ws := WORD.findall(piece))]
        return np.concatenate(found) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)

    def fill(self) -> None:
        """Score the words that are new; a word without a letter, such as a superscript digit, has size 0 and no say."""
        while len(self.table) < len(self):
            self.table, self.sizes = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        at = len(self) - len(self.new)
        size, part = 0, []
        for i, word in enumerate(self.new):
            part.append(word)
            size += len(word) + 2
            if size > 500_000 or i == len(self.new) - 1:
                lettered = np.fromiter((any(map(str.isalpha, w)) for w in part), bool, len(part))
                self.table[at : at + len(part)] = self.model.scores(part) * lettered[:, None]
                self.sizes[at : at + len(part)] = np.fromiter(map(len, part), np.int64, len(part)) * lettered
                at, size, part, self.letters = at + len(part), 0, [], self.letters + size
        self.new = []

    def tidy(self) -> None:
        if len(self) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self.clear()
            self.letters = 0


def best_paths(s: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on each text's best path: the sum of its words' scores less `switch` for every change.

    s (words, languages) holds the words of all texts, text after text; sizes counts the words of each.  The texts are walked
    side by side, the longest first, so that those with a word left are always the first ones.
    """
    path = np.zeros(len(s), np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return path
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    going = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    came, stay, row = np.empty(s.shape, np.int16), np.arange(s.shape[1], dtype=np.int16), np.arange(len(order))
    value = s[first].astype(np.float64)
    for t in range(1, int(size[0])):
        n = going[t]
        v, at = value[:n], first[:n] + t
        top = v.argmax(axis=1)
        high = (v[row[:n], top] - switch)[:, None]
        came[at] = np.where(v < high, top[:, None], stay)
        np.maximum(v, high, out=v)
        v += s[at]
    state = value.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = going[t]
        at = first[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return path


def label(batch: pa.RecordBatch, known: WordScores, text_at: int):
    """(language, score, spans) of each text, as Arrow arrays."""
    kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    langs, n_texts = known.model.langs, batch.num_rows
    if not langs:
        return pa.array(["und"] * n_texts), pa.array(np.zeros(n_texts)), pa.array([[]] * n_texts, pa.list_(kind))
    lists = [known.numbers(t) if t else np.zeros(0, np.int64) for t in batch.column(text_at).to_pylist()]
    known.fill()
    sizes = np.fromiter(map(len, lists), np.int64, n_texts)
    word = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    path = best_paths(known.table[word], sizes)
    text = np.repeat(np.arange(n_texts), sizes)
    letters = np.bincount(text * len(langs) + path, weights=known.sizes[word], minlength=n_texts * len(langs)).reshape(n_texts, len(langs))
    known.tidy()
    total = letters.sum(axis=1)
    some = total > 0
    named = np.array([*langs, "und"], object)
    pred = named[np.where(some, letters.argmax(axis=1), len(langs))]
    score = np.where(some, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])][: len(path)])
    cut = cut[some[text[cut]]]
    own = text[cut]
    last = np.r_[own[1:] != own[:-1], True][: len(own)]
    begin = cut - (np.cumsum(sizes) - sizes)[own]
    end = np.where(last, sizes[own], np.r_[begin[1:], 0][: len(own)])
    values = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(named[path[cut]], pa.string())], fields=list(kind))
    spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own, minlength=n_texts))].astype(np.int32)), values)
    return pa.array(pred, pa.string()), pa.array(score), spans


def learn(taught: DataFrame, most: int = MAX_TAUGHT) -> Model:
    """taught (key, lang, text): the model from at most about `most` texts of each language, drawn by a hash of key."""
    sizes = {r["lang"]: r["count"] for r in taught.where("lang is not null").groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], None)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, most / n))) for k, n in sizes.items()])
    drawn = taught.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    words = drawn.mapInArrow(word_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    weighed = words.select("lang", "word", "n", (F.lit(1) + F.length(F.bin("n")) - 1).cast("long").alias("weight"))  # binary digits: 1 + floor(log2 n)
    counts = weighed.mapInArrow(gram_rows, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    return Model(langs, materialize(counts).toArrow())  # at most GRAMS rows for each language


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, lang_pred, score, spans (in words)."""

    def run(batches):
        known = WordScores(model)
        for whole in batches:
            for batch in text_slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *label(batch, known, 1)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, PREDICTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = learn(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "lang", "text"))
    return predict(docs, model)
