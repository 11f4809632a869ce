"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re
import struct
from fractions import Fraction

import xxhash


def repeats(rows, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def without_repeats(rows, length=100):
    """doc_id -> text without the bytes of repeats()."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        out[d] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size=3, threshold="0.9"):
    """doc_id -> (n_shingles, component_id, n_links)."""
    t = Fraction(threshold)
    sets = {d: shingles(x, size) for d, x in rows}
    root, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and Fraction(n, len(sets[a] | sets[b])) >= t:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in ids}


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def contamination(docs, items, window=13, share=20):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    out = {}
    for d, text in docs:
        w, hit, names = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    names |= found
                    hit.update(range(i, i + n))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w))
    return out


def mixed(rows, weights=(1, 2, 3), cap=3):
    """doc_id -> (size, source_size, target, taken) for unique doc_id."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    total = collections.Counter()
    for d, _, s in rows:
        total[s] += size[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = sum(total.values()), {}, set(names)
    while free:
        left, w = budget - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * total[s]}
        for s in over or free:
            target[s] = float(cap * total[s]) if over else left * weight[s] / w
        free -= over or free
    key = {d: hashlib.md5(f"mix-{d}".encode()).hexdigest() for d in size}
    upto, run = {}, collections.Counter()
    for d, _, s in sorted(rows, key=lambda r: key[r[0]]):
        run[s] += size[d]
        upto[d] = run[s]
    entries = sorted(((p * total[s] + upto[d]) / target[s], s is None, s or "", key[d], d) for d, _, s in rows if size[d] for p in range(cap))
    taken, spent = collections.Counter(), 0
    for *_, d in entries:
        spent += size[d]
        if spent > budget:
            break
        taken[d] += size[d]
    return {d: (size[d], total[s], target[s], taken[d]) for d, _, s in rows}


def _chained(words):
    """Spark's hash of an array of longs."""
    h = 42
    for x in words:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return h - (1 << 64) if h >> 63 else h


def merkle(text):
    """(fingerprint, leaves by paragraph as they are spelled, root)."""
    leaves = []
    for p in text.split("\n"):
        blocks = [p[:8][i : i + 4] for i in range(0, len(p[:8]), 4)] + [p[8:32][i : i + 8] for i in range(0, len(p[8:32]), 8)] + [p[32:][i : i + 32] for i in range(0, len(p[32:]), 32)]
        leaves.append([xxhash.xxh64_intdigest(b.encode(), seed=42) for b in blocks])
    signed = [[x - (1 << 64) if x >> 63 else x for x in p] for p in leaves]
    paragraphs = [_chained(p) for p in signed]
    sections = [_chained(paragraphs[i : i + 8]) for i in range(0, len(paragraphs), 8)]
    root = hashlib.sha256(";".join(map(str, sections)).encode()).hexdigest()[:32]
    short = [[x & 0x7FFFFFFF for x in p] for p in leaves]
    rows = [f"{h & (1 << 64) - 1:016x}~" + ".".join(f"{x:x}" for x in p) for h, p in zip(paragraphs, short)]
    named = [f"{h & (1 << 64) - 1:016x}=" + "|".join(rows[8 * i : 8 * i + 8]) for i, h in enumerate(sections)]
    return f"{root}:" + ";".join(named), short, root


def alike(a, b):
    """Likeness of two merkle() results."""
    if a[2] == b[2]:
        return 1.0
    x, y = ([h for p in t[1] for h in p] for t in (a, b))
    if not x or not y:
        return 0.0
    return max(2 * sum(p == q for p, q in zip(x, y)) / (len(x) + len(y)), 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y))))


def differing(a, b):
    """(section, paragraph, block) where the leaves of two merkle() results differ."""
    out = []
    for p in range(max(len(a[1]), len(b[1]))):
        x, y = (t[1][p] if p < len(t[1]) else None for t in (a, b))
        if x != y:
            at = [k for k in range(max(len(x or ()), len(y or ()))) if (x or ())[k : k + 1] != (y or ())[k : k + 1]]
            out += [(p // 8, p, k) for k in at or [0]]
    return out
