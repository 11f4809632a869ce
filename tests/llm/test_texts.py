"""Operators on texts against brute force, and their cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from facetmill.llm import components, decontaminate, fingerprints, jaccard_join, source_mix, suffix_dedup, token_counts

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=60):
    """Invented texts with copies, near copies, shared passages, nulls, empty, tiny, white and non-ASCII ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "re", "ß", "an"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k)) + r.choice([".", "\n", ""])
    passage = text(60)
    out = [text(r.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 7):
        out[i] = out[i][: len(out[i]) // 2] + " " + passage + " " + out[i]
    out += out[:6] + out[:2]
    for i in range(10):
        w = (out[i] + " " + text(60)).split(" ")
        out.append(" ".join(w))
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [None, None, "", " \t\n", "a", "A", "a b", "aé" * 300, "x" * 700, "word " * 3000, "日本語のテキスト。" * 30]
    r.shuffle(out)
    return [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns with the names that the operators use inside."""
    names = ["run", "runs", "key", "part", "taken", "size", "version", "places", "component", "n", "w", "_d", "places"]
    return docs.select("*", *[F.lit(7).alias(x) for x in dict.fromkeys(names)])


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("large_group", [20_000, 1])
def test_repeats(docs, rows, monkeypatch, large_group):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large_group)
    got = by_id(suffix_dedup.digests(clashing(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats([r[:2] for r in rows])


def test_repeats_cases(spark, docs, empty):
    assert suffix_dedup.digests(empty).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 200), (1, "ab" * 200), (None, "ab" * 200), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.digests(twice).collect())
    assert [n for d, n in got if d == "2"] == [0] and len(got) == 4 and len({n for d, n in got if d == "1"}) == 1
    kept = suffix_dedup.without_repeats(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.count() == docs.count()


def test_repeats_of_one_id(spark, docs, rows):
    """Rows of one id (or none) with differing texts are documents of their own, in order of their text's hash; equal rows are one place."""
    r = random.Random(9)
    texts = [t for _, t, *_ in rows] + ["ab" * 300, "ab" * 120, "ab" * 300]
    some = [(None if i % 5 == 0 else i // 9, t) for i, t in enumerate(texts)] + [(1, texts[0])] * 2 + [(None, texts[1])] * 2
    r.shuffle(some)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    version = {x.text: x.v for x in df.select("text", F.xxhash64("text").alias("v")).collect()}
    key = lambda d, t: (-1 if d is None else d, version[t])
    want = brute.repeats({key(d, t): t for d, t in some}.items())
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(df).collect())
    assert got == sorted((str(d), *want[key(d, t)]) for d, t in some)


def test_repeats_across_boundaries(spark, monkeypatch):
    """One passage in every document, in differing surroundings, so that splitters fall among suffixes with equal leading bytes."""
    import numpy as np

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 30))) + passage[r.randint(0, 60) :] + " " + " ".join(word() for _ in range(20))) for i in range(120)]
    whole = suffix_dedup.splitters
    found = []
    monkeypatch.setattr(suffix_dedup, "splitters", lambda texts, n, *rest: found.append(whole(texts, 400, *rest)) or found[0])
    got = by_id(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    lead = found[0][:, :-1]
    assert np.all(lead[1:] == lead[:-1], axis=1).sum() > 5 and got == brute.repeats(rows)


def test_repeats_in_a_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcd \n") for _ in range(1_200_000))
    rows = [(1, long[5_000:5_400]), (2, long), (3, long[900_000:])]
    got = by_id(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "n_spans")
    assert got == {1: (0, 0), 2: (400, 1), 3: (300_000, 1)}


def test_sorted_by_bytes_and_packing():
    import numpy as np

    from facetmill.llm import rolling

    r = np.random.default_rng(4)
    data = np.r_[r.integers(97, 99, 3000), r.integers(97, 99, 60).repeat(1), np.tile(r.integers(0, 256, 40), 20)].astype(np.uint8)
    for length in (32, 100, 37):
        at = r.permutation(len(data) - length + 1)
        order, same = suffix_dedup.sorted_by_bytes(data, at, length)
        strings = [data[a : a + length].tobytes() for a in at[order]]
        assert strings == sorted(strings) and same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
    for x in ([5], [-(1 << 63), (1 << 63) - 1, 0], [7, 7], [1000, 1255], [0, 70_000], [-3, 1 << 40]):
        x = np.array(x, np.int64)
        assert rolling.unpacked(rolling.packed(x), len(x)).tolist() == x.tolist()


def test_multikey_quicksort():
    import numpy as np

    r = np.random.default_rng(1)
    keys = [r.integers(0, 4, 9000), r.integers(0, 5, 9000), r.integers(0, 1000, 9000)]
    order = suffix_dedup.multikey_quicksort(keys, small=16)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys)))


@pytest.mark.parametrize("words,threshold", [(3, "0.9"), (5, "0.8")])
def test_jaccard(docs, rows, words, threshold):
    got = by_id(jaccard_join.jaccard_components(clashing(docs), words, threshold), "n_shingles", "component_id", "n_links")
    assert got == brute.components([r[:2] for r in rows], words, threshold)


def test_jaccard_blocks_and_cases(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 200)  # large groups in many pairs of blocks
    got = by_id(jaccard_join.jaccard_components(docs), "n_shingles", "component_id", "n_links")
    assert got == brute.components([r[:2] for r in rows])
    assert jaccard_join.jaccard_components(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "q")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in jaccard_join.jaccard_components(some).collect()) == ["4", "4", "4", "9"]


def test_jaccard_repeated_and_null_ids(spark):
    """Rows of one id or none with differing texts are nodes of their own; a component has its smallest id, if any."""
    near = lambda seed: [" ".join([*(f"w{seed}x{i}" for i in range(100)), *(["end"] * k)]) for k in range(4)]
    a, b, c, d = near(1), near(2), near(3), near(4)
    rows = [(None, a[0]), (5, a[1]), (7, a[2]), (None, a[0]), (None, b[0]), (9, b[1]), (None, "alone here now"), (11, c[0]), (12, c[1]), (None, None)]
    rows += [(30, d[0]), (30, b[2]), (30, c[2]), (30, d[0]), (None, "other words stand here"), (None, "other words stand here"), (40, ""), (40, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute.components([(i, t) for i, (_, t) in enumerate(rows)])
    ids = {}
    for i, (_, k, _) in want.items():
        ids[k] = min([x for x in (ids.get(k), rows[i][0]) if x is not None], default=None)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard_join.jaccard_components(df).collect())
    assert got == sorted((str(rows[i][0]), n, str(ids[k]), links) for i, (n, k, links) in want.items())
    assert sum(g[3] for g in got) > 10


def test_jaccard_on_a_table(spark, sf):
    """Every link of a larger table against all pairs of its sets."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(brute.shingles(r.text, 3)) for r in docs.collect()}
    got = by_id(jaccard_join.jaccard_components(docs), "component_id", "n_links")
    links = collections.Counter()
    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            n = len(sets[x] & sets[y])
            if n and 10 * n >= 9 * (len(sets[x]) + len(sets[y]) - n):
                links[x] += 1
                links[y] += 1
                assert got[x][0] == got[y][0]
    assert {d: n for d, (_, n) in got.items() if n} == dict(links) and len(links) > 50


def test_compare_against_pairs():
    """Sets with frequent and rare shingles in common, as near copies have."""
    import numpy as np

    r = np.random.default_rng(7)
    for seed in range(30):
        base = r.integers(1, 1 << 60, 60).astype(np.uint64)
        sets = []
        for _ in range(25):
            keep = base[r.random(60) > r.choice([0, 0.03, 0.1, 0.8])]
            sets.append(np.unique(np.r_[keep, r.integers(1, 40, int(r.integers(0, 6))).astype(np.uint64)]) if seed % 3 else np.unique(r.integers(1, 30, 20).astype(np.uint64)))
        doc, block, side, copies = np.arange(25) * 10, r.integers(0, 2, 25), r.integers(0, 2, 25), r.integers(1, 4, 25)
        for within in (True, False):
            a, b, n = jaccard_join.compare(doc, block, side, copies, sets, within, 9, 10)
            linked = {(i, j) for i in range(25) for j in range(25) if i != j and not (side[i] and side[j]) and (within or block[i] != block[j]) and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
            want = {int(doc[i]): int(sum(copies[j] for x, j in linked if x == i)) for i in {i for i, _ in linked}}
            assert {int(x): int(m) for x, m in zip(a, n) if m} == want
            root = {int(x): int(x) for x in doc}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                root[find(x)] = find(y)
            groups = {x: find(x) for x in root}
            assert all(groups[doc[i]] == groups[doc[j]] for i, j in linked)
            assert sum(x != y for x, y in zip(a, b)) <= 24


def test_signatures_meet():
    """Every pair at the threshold shares a signature, whatever its sizes."""
    from fractions import Fraction

    import numpy as np

    r = np.random.default_rng(2)
    for t in ("0.9", "0.8"):
        bands = jaccard_join.Bands(Fraction(t))
        for _ in range(150):
            common = r.integers(1, 1 << 62, int(r.integers(4, 300))).astype(np.uint64)
            extra = int(len(common) / float(t)) - len(common)
            k = int(r.integers(0, extra + 1))
            a = np.r_[common, r.integers(1, 1 << 62, k).astype(np.uint64)]
            b = np.r_[common, r.integers(1, 1 << 62, extra - k).astype(np.uint64)]
            found = list(bands.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b]))
            row, sig = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            assert set(sig[row == 0]) & set(sig[row == 1])


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(8)
    long_words = [brute.bench_words(t) for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(i, " ".join(r.choice(long_words)[3 : 3 + n])) for i, n in enumerate([13, 20, 30, 5, 1, 14, 13])] + [(90, None), (91, "!!"), (92, "no such words in any text at all"), (9, "a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.judge(clashing(docs), table), *columns) == brute.contamination([x[:2] for x in rows], items)
    clean = by_id(decontaminate.judge(docs, table.where("false")), "n_hit", "contaminated")
    assert set(clean.values()) == {(0, False)} and decontaminate.judge(empty, table).count() == 0


def test_mix(spark, docs, rows, empty):
    got = by_id(source_mix.mix(clashing(docs)), "size", "source_size", "target", "taken")
    want = brute.mixed([(d, t, s) for d, t, _, s, _ in rows])
    assert {d: (a, b, round(c, 6), e) for d, (a, b, c, e) in got.items()} == {d: (a, b, round(c, 6), e) for d, (a, b, c, e) in want.items()}
    assert source_mix.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (1, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in source_mix.mix(blank).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    assert source_mix.mix(same).count() == 3


def test_fingerprints(spark, docs, rows, empty):
    """Every column against a tree built by hand."""
    more = [(10_000 + i, t) for i, t in enumerate(["\n" * 20, "long line " * 30_000, "a\nb\n" * 40, "a\nb\n" * 39 + "a\nc\n", "\n", "tail\n"])]
    rows = [r[:2] for r in rows] + more
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in fingerprints.fingerprints(clashing(docs)).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n, k = len(text), len(text) // 3
        edited = text[: n - k] + after[:k]
        r, a, b = got[d], brute.merkle(text), brute.merkle(edited)
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a[0], b[0]) and (a[2] == b[2]) == (text == edited)
        assert abs(r.near_edited - brute.alike(a, b)) < 1e-9 and abs(r.near_next - brute.alike(a, brute.merkle(after))) < 1e-9
        where = brute.differing(a, b)
        assert (r.n_differing, r.first_differing) == (len(where), ".".join(map(str, where[0])) if where else "")
    assert len({got[d].fingerprint.split(":")[0] for d, _ in rows}) == len({t or "" for _, t in rows})  # roots differ as texts do
    assert fingerprints.fingerprints(empty).count() == 0
    some = spark.createDataFrame([(5, "same"), (5, "same"), (None, "x"), (5, "other")], "doc_id long, text string")
    assert fingerprints.fingerprints(some).count() == 4
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "same")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_differing_blocks(spark):
    """Edits are located from the fingerprints alone."""
    lines = [f"paragraph number {i} of the text" for i in range(20)]
    changed = [x if i != 9 else x.replace("number 9", "number x") for i, x in enumerate(lines)]
    longer = [*lines, "one more", ""]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(x)) for x in (changed, longer, lines)], "a string, b string")
    fp = fingerprints.with_tree(fingerprints.with_tree(df, "a", "x"), "b", "y").select(fingerprints.spelled(F.col("x")).alias("a"), fingerprints.spelled(F.col("y")).alias("b"))
    got = [[tuple(x) for x in r.d] for r in fp.select(fingerprints.differing_blocks(fingerprints.parsed(F.col("a")), fingerprints.parsed(F.col("b"))).alias("d")).collect()]
    assert got == [[(1, 9, 3)], [(2, 20, 0), (2, 20, 1), (2, 21, 0)], []]
    assert got == [brute.differing(brute.merkle("\n".join(lines)), brute.merkle("\n".join(x))) for x in (changed, longer, lines)]


def test_token_counts(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["ΣΑΣ Σ", "İstanbul Ǆ", "a<|endoftext|>b <|startoftext|>", "aaaa aaaaaaa " * 50, "don't I'LL 12345 x²", "<|endoftext|", "😀👍🏽 !!!???", "ẞ ﬁ ŉ", "\x85a\x1cb"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    library = Tokenizer.from_file(path)
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in [r[:2] for r in rows] + [(10_000 + i, t) for i, t in enumerate(odd)]}
    got = by_id(token_counts.token_counts(clashing(table), path), "n_tokens", "n_bytes", "over_limit")
    assert {d: x[0] for d, x in got.items()} == want and all(x[2] == (x[0] > 2048) for x in got.values())
    assert token_counts.token_counts(empty, path).count() == 0


def test_long_runs_of_letters():
    """Long pre-tokens: equal to the library and to the merging of short ones, in about linear time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, merger = Tokenizer.from_file(path), token_counts.load(path)[0]
    r = random.Random(11)
    words = ["".join(r.choice(a) for _ in range(r.randint(1, 150))) for a in ("ab", "aab", "etaoinsrhl", "aé日x", "abcdefghijklmnopqrstuvwxyz") for _ in range(80)]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert [merger.count_long(w.encode()) for w in words] == want == merger.count_short([w.encode() for w in words]).tolist()
    long = ["".join(r.choice(a) for _ in range(n)) for a, n in (("etaoinsrhldu", 1_000_000), ("a", 300_001), ("xy日", 100_000))]
    began = time.process_time()
    got = token_counts.count_texts([*long, "", "a b"], path, token_counts.Remembered())
    assert time.process_time() - began < 20
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in [*long, "", "a b"]]
