"""b-bit MinHash, importance resampling and conversation repair against brute force, and their cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm import conversations, decontaminate, importance, jaccard_join, minhash, source_mix

from . import brute
from .test_texts import SCHEMA, by_id, clashing, corpus


@pytest.fixture(scope="module")
def rows():
    return corpus(11)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# ---- b-bit MinHash


def near_copies(rows):
    return {d: (n, c, d == c) for d, (n, c, _) in brute.components([r[:2] for r in rows], 5, "0.85").items()}


@pytest.mark.parametrize("block_sets", [256, 2])
def test_minhash(docs, rows, block_sets):
    got = by_id(minhash.near_duplicates(clashing(docs), block_sets=block_sets), "n_shingles", "component_id", "kept")
    assert got == near_copies(rows) and sum(not x[2] for x in got.values()) > 10


def test_minhash_chains_across_blocks(spark):
    """Groups whose links are chains, stars and isles, in blocks of two sets; long texts among them."""
    r = random.Random(6)
    texts = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(r.choice([80, 200, 4000]))]
        step = len(words) // (9 if g % 2 else 14)  # similar to the next at 0.8 or at 0.87
        for k in range(7):
            texts.append(" ".join(words[: len(words) - step // 2] + [f"end{k // 2 if g == 3 else k}x{i}" for i in range(step // 2)]))
        drift = words
        for k in range(9):  # each links with the next only
            drift = drift[len(words) // 30 :] + [f"new{g}n{k}m{i}" for i in range(len(words) // 30)]
            texts.append(" ".join(drift))
    r.shuffle(texts)
    texts += [" ".join(t.split()[:-2]) for t in texts[:40]]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    want = near_copies(rows)
    assert len({c for _, c, _ in want.values()}) < len(rows) - 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block_sets in (2, 256):
        assert by_id(minhash.near_duplicates(df, block_sets=block_sets), "n_shingles", "component_id", "kept") == want


def test_minhash_cases(spark):
    near = lambda seed: [" ".join([*(f"w{seed}x{i}" for i in range(100)), *(["end"] * k)]) for k in range(4)]
    a, b, c = near(1), near(2), near(3)
    rows = [(None, a[0]), (5, a[1]), (7, a[2]), (None, a[0]), (None, b[0]), (9, b[1]), (None, "alone here now"), (11, c[0]), (12, c[1]), (None, None), (30, b[2]), (30, c[2]), (40, ""), (40, ""), (50, "A b"), (51, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute.components([(i, t) for i, (_, t) in enumerate(rows)], 5, "0.85")
    ids = {}
    for i, (_, k, _) in want.items():
        ids[k] = min([x for x in (ids.get(k), rows[i][0]) if x is not None], default=None)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in minhash.near_duplicates(df).collect())
    assert got == sorted((str(rows[i][0]), n, str(ids[k])) for i, (n, k, _) in want.items())
    assert minhash.near_duplicates(df.where("false")).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(df.where("doc_id = 40")).collect()] == [(40, 0, 40, True)] * 2


def test_minhash_estimates():
    """Estimates scatter around the similarity as the formula says, and sets at the threshold share a band."""
    r = np.random.default_rng(4)
    off, met = [], 0
    for _ in range(300):
        n = int(r.integers(30, 600))
        both = r.integers(1, 1 << 63, n).astype(np.uint64)
        extra = int(n / 0.85) - n
        k = int(r.integers(0, extra + 1))
        x, y = np.r_[both, r.integers(1, 1 << 63, k).astype(np.uint64)], np.r_[both, r.integers(1, 1 << 63, extra - k).astype(np.uint64)]
        keys, low = minhash.signatures(minhash.minima(np.r_[x, y], np.array([0, len(x)])))
        words = low.reshape(2, -1).copy().view(np.uint64)
        off.append(float(minhash.alike(words[0], words[1:])[0]) - n / (n + extra))
        met += bool((keys[0] == keys[1]).any())
    assert met == 300 and abs(np.mean(off)) < 0.006 and 0.018 < np.std(off) < 0.028
    assert minhash.least_estimate(Fraction("0.85")) < 0.85 - 5 * 0.0225


# ---- importance resampling


def crc(x):
    return zlib.crc32(x.encode())


def resampled(docs, target, most=1, buckets=10_000, least=20, percent=10):
    """[(doc_id, n_features, weight, score, rank)] in order of score for unique doc_id."""
    runs = lambda t: (lambda w: [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)])(brute.bench_words(t))
    s, t = (Counter(crc(f) % buckets for _, x in rows for f in runs(x)) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, x in docs:
        g = [gain(crc(f) % buckets) for f in runs(x)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute.bench_words(x)) >= least])
    out.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    k = sum(r[4] for r in out) * percent // 100
    place = itertools.count(1)
    return [(*r[:4], p if r[4] and (p := next(place)) <= k else None) if r[4] else (*r[:4], None) for r in out]


@pytest.mark.parametrize("most,percent", [(1, 10), (3, 37), (1, 0), (2, 100)])
def test_resampling(spark, docs, rows, most, percent):
    words = brute.bench_words(" ".join(t for _, t, *_ in rows if t))
    target = [(1, " ".join(words[:300]).upper()), (2, None), (3, "ééé " * 40), (4, "")]
    table = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(clashing(docs), table, most, percent=percent, pivots=3)
    want = resampled([r[:2] for r in rows], target, most, percent=percent)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect())) == sorted(want)


def test_resampling_cases(spark):
    """Equal rows, one id with two texts, no id, long words and texts, no target, no documents."""
    text = "some words that go on " * 6
    rows = [(7, text)] * 9 + [(7, text + "more")] * 2 + [(None, text)] * 3 + [(8, "x" * 5000 + " y" * 40), (9, "w " * 30_000), (10, None), (11, "few")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(df, none, percent=50, pivots=2).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 9)) and len(got) == len(rows)  # 16 of them have the words
    by_rank = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in by_rank] == sorted((r.score for r in got if r.n_words >= 20), reverse=True)[:8]
    want = {(d, x): r for d, n, x, *r in resampled(list(dict.fromkeys(rows)), [])}
    counts = {(r.doc_id, r.n_features) for r in got}
    assert counts == {(d, len(brute.bench_words(t))) for d, t in rows} and len(want)
    again = importance.resample(df.repartition(2), none, percent=50, pivots=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert importance.resample(df.where("false"), none).count() == 0 and all(r["rank"] is None for r in importance.resample(df.where("doc_id > 9"), none).collect())


def test_select_key(spark):
    r = random.Random(3)
    keys = [(r.randrange(-4, 4), r.randrange(3), r.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(keys, importance.KEY).repartition(3).cache()
    for k in (1, 2, 57, 199, 200):
        assert importance.select_key(df, k, pivots=2) == sorted(keys)[k - 1]
    assert importance.select_key(df, 201) is None


def test_crc_of_runs():
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcé9") for _ in range(r.choice([1, 2, 5, 9, 47, 48, 49, 300]))) for _ in range(r.randrange(12))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    got = Counter((int(i), int(c)) for row, code, _ in importance.features(data, offsets, 3) for i, c in zip(row, code))
    assert got == Counter((i, crc(" ".join(w[k : k + n]))) for i, t in enumerate(texts) for w in [t.split()] for n in (1, 2, 3) for k in range(len(w) - n + 1))


# ---- conversation repair

WHITE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """Row by row over the states of the pattern, the best (cost, audit, lines) of each: rows are (turn, role, text) in order."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    kinds, seen = [], set()
    for _, role, text in rows:
        kinds.append("b" if not text.strip(WHITE) else "d" if (role, text) in seen else "k" if text.rstrip(WHITE)[-1] in ".!?" else "t")
        seen.add((role, text))

    def put(best, q, x):
        if q not in best or x < best[q]:
            best[q] = x

    def inserted(best):
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in step:
                        put(best, step[q, role[0]], (c + 5, a + "I", [*lines, role + ":"]))
        return best

    best = inserted({0: (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for q, (c, a, lines) in best.items():
            put(new, q, (c + 2, a + "D", lines))
            if kind in "kt":
                more = 5 * (kind == "t")
                if (q, role[:1]) in step:
                    put(new, step[q, role[:1]], (c + more, a + "K", [*lines, f"{role}:{text}"]))
                for name in ("user", "assistant"):
                    if (q, name[0]) in step:
                        put(new, step[q, name[0]], (c + more + 1, a + "R", [*lines, f"{name}:{text}"]))
        best = inserted(new)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(table):
    """conv_id -> rows in order after damage."""
    out = {}
    for c, t, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def talk(seed, n=40):
    r = random.Random(seed)
    out = []
    for c in [None, *range(n)]:
        size = r.choice([1, 2, 3, 6, 9, 40]) if c != 5 else 700
        for t in range(size):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "No!", "Why?", "", " \n", None, "cut off", "cut, off ", "Done.\x0b", f"word {r.randrange(9)}.", f"part {t}", f"whole {t}."])
            out.append((c, None if r.random() < 0.05 else t + r.randrange(2) * (r.random() < 0.2), role, text))
    return out


@pytest.mark.parametrize("segment,long", [(512, 2048), (1, 3), (7, 20)])
def test_repair(spark, segment, long):
    table = talk(2)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in ("cid", "seg", "cost", "audit")})
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df.repartition(4)), segment, long).collect()}
    assert got == {c: repaired(x) for c, x in damaged(table).items()}
    assert {c for x in got.values() for c in x[6]} == set("DKR")  # an insert never pays at these costs


def test_repair_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], schema))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    got = conversations.repair(conversations.damaged(spark.createDataFrame([(gone, 1, "user", "Hi.")], schema))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    plain = spark.createDataFrame([(1, 1, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 5, "assistant", "x" * 3_000_000 + "."), (2, None, "user", "Alone.")], schema)
    got = {r.conv_id: r for r in conversations.repair(plain).collect()}
    assert (got[1].gaps, got[1].illegal, got[1].cost, got[1].audit) == (2, 0, 0, "KKK") and (got[2].gaps, got[2].cost, got[2].audit) == (0, 2, "D")
    assert got[1].repaired_sha256 == hashlib.sha256(("system:Be kind.\nuser:Hi.\nassistant:" + "x" * 3_000_000 + ".").encode()).hexdigest()


def test_cheapest_against_all_edits():
    """All edit sequences of up to five rows and two inserts."""
    r = random.Random(5)
    for _ in range(60):
        rows = [r.choice("suax") + r.choice("kkdt") for _ in range(r.randrange(6))]
        best = None
        for letters in itertools.product("DKRI", repeat=len(rows)):
            if "I" in letters:
                continue
            for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), 2):
                for n in (0, 1, 2):
                    spots = Counter(gaps[:n])
                    audit = "".join("I" * spots[i] + (letters[i] if i < len(rows) else "") for i in range(len(rows) + 1))
                    for x in walks(rows, audit):
                        best = x if best is None else min(best, x)
        assert conversations.cheapest("".join(rows)) == best


def walks(rows, audit):
    """Totals of an audit under every choice of roles that gives the pattern."""
    states = {("", 0)}
    at, total = 0, 0
    for letter in audit:
        code = rows[at] if letter != "I" else None
        at += letter != "I"
        if letter == "D":
            total += 2
            continue
        if letter != "I" and code[1] == "d":
            return
        total += {"K": 0, "R": 1, "I": 5}[letter] + (5 if letter != "I" and code[1] == "t" else 0)
        states = {(s + c, 0) for s, _ in states for c in ([code[0]] if letter == "K" else "ua")}
    import re

    if any(re.fullmatch(r"(s?(ua)+)?", s) for s, _ in states):
        yield total, audit


def test_composed_segments():
    r = random.Random(8)
    for _ in range(40):
        rows = [r.choice("suax") + r.choice("kkdt") for _ in range(r.randrange(1, 30))]
        cuts = sorted(r.sample(range(len(rows) + 1), min(3, len(rows))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        table = conversations.composed([conversations.segment_table("".join(p)) for p in parts])
        best = min(t for t in (table[q] for q in conversations.ACCEPTED) if t)
        assert best == conversations.cheapest("".join(rows))
        lines = [(c[0] if c[0] != "x" else "tool", c) for c in rows]
        pieces, at = [], 0
        for p, (share, state) in zip(parts, conversations.shares(best[1], [len(p) for p in parts])):
            pieces += conversations.rewritten(lines[at : at + len(p)], share, state)
            at += len(p)
        assert pieces == conversations.rewritten(lines, best[1])


# ---- more of earlier operators: long texts, and many rows of one id


def long_rows(seed):
    """Texts of 4,000 to 20,000 words, some of them near copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3_000)]
    base = [[r.choice(words) for _ in range(n)] for n in (4_000, 9_000, 20_000)]
    out = []
    for b in base:
        for share in (0, 0.005, 0.02, 0.2):
            out.append(" ".join("changed" if r.random() < share else w for w in b))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(out)]


def test_long_texts(spark):
    rows = long_rows(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert by_id(jaccard_join.jaccard_components(docs), "n_shingles", "component_id", "n_links") == brute.components([r[:2] for r in rows])
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == near_copies(rows)
    got = by_id(source_mix.mix(docs), "size", "source_size", "target", "taken")
    want = brute.mixed([(d, t, s) for d, t, _, s, _ in rows])
    assert {d: (x[0], x[1], round(x[2], 6), x[3]) for d, x in got.items()} == {d: (x[0], x[1], round(x[2], 6), x[3]) for d, x in want.items()}
    cut = lambda d, a, n: " ".join(rows[d][1].split()[a : a + n])
    items = [(1, cut(2, 3_500, 40)), (2, cut(4, 8_990, 13)), (3, "w7"), (4, cut(8, 19_000, 900)), (5, "w1 w2 w3 nowhere")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.judge(docs, table), *columns) == brute.contamination([r[:2] for r in rows], items)


def test_many_rows_without_an_id(spark):
    """Each row tries the places of its own text only."""
    r = random.Random(5)
    texts = [" ".join(f"v{r.randrange(40)}" for _ in range(40)) for _ in range(10_000)]
    items = [(1, " ".join(texts[3].split()[5:18])), (2, "v7"), (3, " ".join(texts[9].split()[:20])), (4, None)]
    docs = spark.createDataFrame([(None if i % 5 else 77, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(docs, table).collect())
    assert got == Counter(brute.contamination(list(enumerate(texts)), items).values())


def test_jaccard_in_many_blocks(spark, monkeypatch):
    """A group of near copies in blocks of a few sets: same links."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    r = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join("x" + str(r.randrange(9)) if r.random() < 0.01 else w for w in base)) for i in range(40)] + [(50, None), (51, " "), (52, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(jaccard_join.jaccard_components(df), "n_shingles", "component_id", "n_links") == brute.components(rows)
