"""Learnt operators by held-out accuracy, page operators by worked cases, and the pipeline by stages."""

import collections
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetmill.llm import html_text, language_id, quality, url_filter

from . import brute


def test_ordinal_gradient():
    r = np.random.default_rng(0)
    s, grade, cut = r.normal(size=30), r.integers(0, 3, 30), np.array([-0.4, 0.2])

    def loss(s, cut):
        t = np.vstack([np.ones_like(s), quality.tails(s, cut), np.zeros_like(s)])
        return np.log(t[grade, np.arange(30)] - t[grade + 1, np.arange(30)])

    g_s, g_cut = quality.gradient(s, grade, cut)
    assert np.allclose(g_s, (loss(s + 1e-6, cut) - loss(s - 1e-6, cut)) / 2e-6, atol=1e-5)
    for i in range(2):
        e = np.eye(2)[i] * 1e-6
        assert abs(g_cut[i] - ((loss(s, cut + e) - loss(s, cut - e)) / 2e-6).mean()) < 1e-5


def graded_corpus(spark, n=600):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["th", "er", "on", "re", "an", "st"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        kind = i % 5
        if kind == 0:
            words[r.randrange(len(words))] = words[-1] = "moron"
        if kind == 1:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = graded_corpus(spark)
    got = {r.doc_id: r for r in quality.score_documents(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = [i for i in got if i % 3 == 0]
    right = sum(got[i].keep == (i % 5 > 1) for i in held) / len(held)
    assert right > 0.95 and all(0 <= got[i].expected_grade <= 2 for i in held)
    kept = quality.select_documents(docs.withColumn("grade", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "grade"] and 0 < kept.count() < docs.count()


def test_quality_scores(spark, sf):
    """The scores of documents against the model's formula, features made one by one."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, cuts = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(7), labels)
    assert np.allclose(weights, again[0]) and np.allclose(cuts, again[1])
    number = lambda name: zlib.crc32(name.encode()) % quality.FEATURES
    bin_of = lambda share: 0 if share <= 0 else max(1, 12 + math.floor(math.log2(share)))
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    for r in docs.limit(60).collect():
        text, data = r.text, r.text.encode()
        words = text.lower().split()
        bare = {w.strip(".,;:!?\"'()[]{}*&%$#|-_<>/\\+=~`^@") for w in words}
        found = {number(b) for b in bare} | {number("stem " + b[:5]) for b in bare if len(b) > 5}
        n = max(1, len(data))
        found |= {number(f"has {c} {bin_of(data.count(c) / n)}") for c in range(33, 127) if not chr(c).isalnum() and data.count(c)}
        shares = {"capitals": sum(65 <= c < 91 for c in data) / n, "digits": sum(48 <= c < 58 for c in data) / n, "lines": data.count(10) / n}
        found |= {number(f"{k} {bin_of(x)}") for k, x in shares.items()}
        found |= {number(f"distinct {int(10 * len(set(words)) / max(1, len(words)))}"), number(f"length {int(math.log2(n))}"), number(f"word size {min(20, int(n / max(1, len(words))))}")}
        s = sum(float(weights[i]) for i in found)
        tail = [1 / (1 + math.exp(-(s - t))) for t in (cuts[0], cuts[0] + math.exp(cuts[1]))]
        x = got[r.doc_id]
        assert abs(x.expected_grade - sum(tail)) < 1e-4 and abs(x.p_good - tail[1]) < 1e-4 and abs(x.p_toxic - 1 + tail[0]) < 1e-4 and x.keep == (x.p_good >= 0.5)


def test_quality_of_few_labels(spark):
    """A dozen labels still tell documents apart."""
    docs, labels = graded_corpus(spark, 60)
    got = {r.doc_id: r.keep for r in quality.score_documents(docs, labels.where("doc_id < 15")).collect()}
    assert 0 < sum(got.values()) < 60 and sum(got[i] == (i % 5 > 1) for i in range(15)) >= 13


def test_quality_of_given_labels(spark, sf):
    """Held-out thirds of the few labels of a small table: most good documents stay, most others go."""
    folder = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {}
    for part in range(3):
        out = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == part
        scores = quality.score_documents(docs, labels.where(~out))
        for r in scores.join(quality.graded(labels.where(out)), "doc_id").groupBy("grade").agg(F.sum(F.col("keep").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")).collect():
            a, b = kept.get(r.grade, (0, 0))
            kept[r.grade] = (a + r.kept, b + r.n)
    shares = {g: a / b for g, (a, b) in kept.items()}
    assert sum(b for _, b in kept.values()) == labels.count() and shares[2] >= 0.95 and shares[1] <= 0.5 and shares[0] <= 0.5, kept


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert [r.keep for r in quality.score_documents(docs, none).collect()] == [True] * 4
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, some).count() == 4 and quality.score_documents(docs.where("false"), some).count() == 0
    assert {r.doc_id: r.grade for r in quality.graded(some).collect()} == {1: 1, 2: 2, 7: 0}


def test_viterbi_against_all_paths():
    """Every path of thousands of random texts, several walked at once; two other languages that share one switch included."""
    r = np.random.default_rng(0)
    for _ in range(1500):
        sizes = r.integers(0, 7, 3)
        s, switch = r.normal(size=(sizes.sum(), 3)) * 3, float(r.choice([0.5, 2.0, 5.0]))
        path = language_id.best_paths(s, sizes, switch)
        for end, n in [(e, n) for e, n in zip(np.cumsum(sizes), sizes) if n]:
            own, got = s[end - n : end], path[end - n : end]
            paths = np.array(list(itertools.product(range(3), repeat=int(n)))).reshape(-1, n)
            values = own[np.arange(n), paths].sum(axis=1) - switch * (paths[:, 1:] != paths[:, :-1]).sum(axis=1)
            value = own[np.arange(n), got].sum() - switch * (got[1:] != got[:-1]).sum()
            assert abs(values.max() - value) < 1e-9
    assert language_id.best_paths(np.array([[0, 20, -30], [0, -30, 20.0]]), np.array([2]), 25.0).tolist() == [1, 2]


def test_language_model_by_hand(spark):
    """The counts behind the model do not depend on partitions, and the scores follow from them."""
    r = random.Random(6)
    texts = [(i, k, " ".join(r.choice(w) for _ in range(r.randint(1, 90)))) for i in range(40) for k, w in (("a", ["the", "cat", "sat", "ǆ"]), ("b", ["кот", "сел", "the"]))]
    taught = spark.createDataFrame([*texts, (99, None, "no say"), (98, "a", None)], "key long, lang string, text string")
    one, many = language_id.learn(taught.coalesce(1)), language_id.learn(taught.repartition(50))
    assert one.langs == ["a", "b"] and (one.log == many.log).all() and (one.allowed == many.allowed).all()
    seen = {k: collections.Counter(w for _, x, t in texts if x == k for w in t.lower().split()) for k in "ab"}
    totals = [sum((1 + int(np.log2(n))) * sum(len(w) + 3 - m for m in (1, 2, 3, 4)) for w, n in seen[k].items()) for k in "ab"]
    p = np.exp(one.log.astype(float))
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4) and np.allclose(p.min(axis=0), [0.5 / (t + 0.5 * language_id.GRAMS) for t in totals])
    s = one.scores(["кот", "cat"])
    assert s[0, 1] == s[1, 0] == 0 and s[0, 0] < -5 and s[1, 1] < -5


def test_language_cases(spark):
    """Long texts, words cut at a piece's end, an empty table, extra columns, equal scores."""
    taught = spark.createDataFrame([(i, k, t) for i in range(20) for k, t in (("en", "the cat and the dog"), ("de", "der hund und die katze"))], "key long, lang string, text string")
    model = language_id.learn(taught)
    long = "the cat and the dog " * 60_000 + "der hund und die katze " * 30_000
    cases = [(1, long, False), (2, "x" * 2_500_000, True), (3, "² ³", False), (None, "der hund", None)]
    docs = spark.createDataFrame(cases, "doc_id long, text string, held_out boolean").withColumn("score", F.lit(7)).withColumn("spans", F.lit("clash"))
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [(s.begin, s.end, s.lang) for s in out[1].spans] == [(0, 300_000, "en"), (300_000, 450_000, "de")] and out[1].lang_pred == "en"
    assert len(out[2].spans) == 1 and out[3].lang_pred == "und" and out[3].score == 0 and out[None].lang_pred == "de"
    assert language_id.predict(docs.where("false"), model).count() == 0
    tie = language_id.learn(spark.createDataFrame([(1, k, "same words here") for k in ("q", "p")], taught.schema))
    assert language_id.predict(docs.where("doc_id is null"), tie).first().lang_pred == "p"


def test_languages(spark, sf):
    got = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.95
    taught = spark.createDataFrame([(i, k, t) for i in range(20) for k, t in (("en", "the cat and the dog sat with that man"), ("ru", "кот и собака сидели там"), ("de", "der hund und die katze waren nicht da"))], "key long, lang string, text string")
    model = language_id.learn(taught)
    both = "the cat and the dog sat with that man " * 4 + "der hund und die katze waren nicht da " * 2
    cases = [(1, both, False), (2, None, False), (3, "123 !!", False), (4, "кот", True), (5, "", False), (5, "", False)]
    out = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(cases, "doc_id long, text string, held_out boolean"), model).collect()}
    assert [s.lang for s in out[1].spans] == ["en", "de"] and out[1].lang_pred == "en" and 0.5 < out[1].score < 1
    assert out[2].lang_pred == out[3].lang_pred == out[5].lang_pred == "und" and out[2].score == 0 and out[4].lang_pred == "ru"
    nothing = language_id.learn(taught.where("false"))
    assert language_id.predict(spark.createDataFrame(cases[:1], "doc_id long, text string, held_out boolean"), nothing).first().lang_pred == "und"


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><a>Home</a></header><nav><ul><li>a<li>b</ul></nav>
<div class="sidebar">side</div><article><header><h1>T &lt;b&amp</h1></header><p>One <b>two<br>three <i>x</i><p>Four&nbsp; five<ul><li>six<li>seven</ul>
<form>send</form><script>var t="</p>";</script><div class="comments"><p>bad</p></div><table><tr><td>1<td>2<tr><td>3</table></article><footer>f</footer>"""


def test_page_text():
    assert html_text.Page(PAGE).text() == "T <b&\nOne two three x\nFour five\nsix\nseven\n1 2\n3"
    assert html_text.Page("<p>plain<div class='ad'>x</div> tail").text() == "plain\ntail"
    assert html_text.Page("").text() == "" and html_text.Page("<").text() == "<"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html_text.Page(deep).text() == "x"
    assert html_text.Page("<p title='a > b' id=don't>it's<br/>so<!-- no --> <?php no ?>x</P>y").text() == "it's so x\ny"
    assert html_text.Page('<p>a<b title="c>d').text() == "ad"
    assert html_text.Page("<p>a<TITLE>no</title >b<div data-class='ad'>c</div></x></p>").text() == "ab\nc"


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "<span>" * 80_000 + "<h1>" * 80_000, "<p><body>" + "<span>" * 80_000 + "<h1>" * 80_000, "<a title=\">\" " * 100_000, "<a href='" * 100_000 + ">", "<title" * 150_000, "<title>" + "</title" * 150_000]
    + ["<!--" * 200_000, "<a<b" * 250_000 + ">", "</b>" * 100_000 + "<b>" * 100_000, "<li><b>" * 100_000, "&amp" * 200_000, "<p class=\"" * 90_000],
)
def test_broken_pages_take_linear_time(page):
    """Pages of about 1 MB that end no tag, quote or element."""
    began = time.process_time()
    whole = html_text.Page(page)
    whole.text()
    whole.block_hashes()
    assert time.process_time() - began < 15


def test_template_counts_by_hand(spark):
    """Subtrees by host against a count over the pages, with copies, pages without a host or html, repeated and missing ids."""
    r = random.Random(12)
    lines = [f"<p class=c{i}>line {i}</p>" for i in range(6)] + ["<p> </p>", "<ul><li>x<li>y</ul>"]
    rows = [(r.randrange(60), f"http://h{r.randrange(4)}.org/" if r.random() < 0.9 else None, "".join(r.choice(lines) for _ in range(r.randint(0, 5))) + r.choice(["", "<div>own</div>"])) for _ in range(150)]
    rows += [(None, "http://h1.org/", "<p>a</p>"), (3, "http://h1.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    pages = [(html_text.Page(h), u) for _, u, h in rows if h is not None]
    on, whole = collections.defaultdict(set), collections.defaultdict(set)
    for p, u in pages:
        whole[u].add(p.content())
        for h in set(p.block_hashes()) - {0}:
            on[u, h].add(p.content())
    want = collections.Counter()
    for p, u in pages:
        gone = [k for k, h in enumerate(p.block_hashes()) if h and len(on[u, h]) >= 3 and len(on[u, h]) >= 0.4 * len(whole[u])]
        want[p.text(gone)] += 1
    want[""] += 1
    got = collections.Counter(x.text for x in html_text.extract(df, 3, 0.4).collect())
    assert got == want and any(html_text.Page(h).text() not in got for _, _, h in rows if h)


def test_templates(spark):
    page = lambda i: f"<body><div>Site name and motto</div><div><p>Own text {i}</p><p>same line</p></div></body>"
    rows = [(i, f"http://A.org/{i}", page(i)) for i in range(12)] + [(50, "http://b.org/", page(50)), (51, None, None), (52, "http://b.org/", ""), (None, "http://a.org/x", page(7)), (3, "http://a.org/3", page(3))]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()]
    text = {p: t for p, t, _ in got}
    assert text[5] == "Own text 5" and "Site name" in text[50] and text[51] == "" and len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_in_articles(spark):
    box = "<div class='x7'><p>By the editors</p><p>Write to us</p></div>"
    page = lambda i: f"<body><article><h1>Title {i}</h1><div>before {i}{box}after</div></article><div>elsewhere {i}</div></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)] + [(20 + i, f"http://b.org/{i}", page(7)) for i in range(9)] + [(40, "http://c.org/", page(40))]
    rows += [(60 + i, f"http://d.org/{i}", f"<body><article><p>teaser</p></article><div>own {i}</div><p>and {i}</p></body>") for i in range(6)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = {r.page_id: r.text for r in got.collect()}
    assert all(text[i] == f"Title {i}\nbefore {i}\nafter" for i in range(12))  # the box goes, and does not join what stands around it
    whole = "Title {0}\nbefore {0}\nBy the editors\nWrite to us\nafter"
    assert {text[20 + i] for i in range(9)} == {whole.format(7)} and text[40] == whole.format(40)  # copies of one page count once
    assert text[60] == "own 0\nand 0"  # an article that recurs is template: what is left decides


def test_url_rules(spark):
    urls = ["http://x.net/a", "http://www.Example.NET/en/1?q", "https://example.com/de/2", "http://a.org/fr/", "http://a.org/frx", "http://example.net?x", "nothing", None, "http://com/zz#a/b", "ftp://u.org/a/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string").withColumn("path", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.listed_rules(spark)).collect()}
    assert got[0] == got[10] == ("x.net", "/a", "net/", "block") and got[1][:3] == ("www.example.net", "/en/1", "example.net/en/") and got[1][3] == "allow"
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow") and got[4][2] is None
    assert got[5][:3] == ("example.net", "", None) and got[6][:3] == got[7][:3] == ("", "", None) and got[6][3] == "allow"
    assert url_filter.filter_urls(pages.where("false"), url_filter.listed_rules(spark)).count() == 0


def test_mined_rules_against_all_combinations(spark):
    r = random.Random(3)
    rows = []
    for _ in range(200):
        t = sorted({r.choice(["a", "b", "c"]), r.choice(["d", "e"]), r.choice(["f", "g", "h", "i"])})
        rows.append((t, "block" if "a" in t and "d" in t or "i" in t else "allow"))
    got = {(tuple(x.antecedent), x.verdict): (round(x.confidence, 6), round(x.support, 6)) for x in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8, 1).collect()}
    every = {}
    for k in (1, 2, 3):
        for c in itertools.combinations("abcdefghi", k):
            fits = [v for t, v in rows if set(c) <= set(t)]
            for v in ("allow", "block"):
                n = fits.count(v)
                if n and n >= 0.02 * len(rows) and n / len(fits) >= 0.8:
                    every[c, v] = (n / len(fits), n / len(rows))
    want = {(c, v): (round(x[0], 6), round(x[1], 6)) for (c, v), x in every.items() if not any((p, v) in every and every[p, v][0] >= x[0] for p in itertools.combinations(c, len(c) - 1))}
    assert got == want


def test_mining_takes_long_paths(spark):
    """URLs that share 30 path parts: undecided ones would have 2 ** 30 combinations."""
    began = time.time()
    deep = "/".join(f"part{i}" for i in range(30))
    urls = [(f"http://a{i}.com/x{i}", "block" if i % 2 else "allow") for i in range(60)] + [(f"http://b{i}.com/{deep}", "block" if i % 2 else "allow") for i in range(40)]
    labels = spark.createDataFrame(urls, "url string, verdict string")
    pages = spark.createDataFrame([(1, f"http://c.com/{deep}"), (2, "http://a1.com/x1"), (3, f"http://c.com/{'x/' * 20_000}y")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.listed_rules(spark).where("false"), labels).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow"} and time.time() - began < 60


def test_pairs_of_tokens_far_apart(spark):
    """Two undecided tokens that point to a verdict together only, with thirty undecided ones between them."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        first, last = r.choice("ab"), r.choice("yz")
        middle = [f"m{k}{r.randrange(2)}" for k in range(30)]
        rows.append(([first, *middle, last], "block" if (first, last) == ("a", "z") else r.choice(["allow", "allow", "block"])))
    rules = {tuple(x.antecedent): (x.verdict, x.confidence) for x in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.95, 5).collect()}
    assert rules[("a", "z")] == ("block", 1.0)


def test_url_verdicts_by_hand(spark):
    """Which mined rule judges each URL, against all rules tried on all URLs."""
    r = random.Random(5)
    url = lambda: f"http://{r.choice(['www', 'm', 'blog'])}.{r.choice(['cat', 'dog', 'cow'])}.{r.choice(['com', 'co.uk'])}/{r.choice(['win', 'news', '2024'])}/{r.choice(['a', 'b', 'c'])}{r.choice(['', '?id=3', '?casino=1&x'])}"
    bad = lambda u: "casino" in u or ("win" in u and "cat" in u) or "2024/a" in u
    taught = sorted({url() for _ in range(300)})
    labels = spark.createDataFrame([(u, "block" if bad(u) else "allow") for u in taught], "url string, verdict string")
    pages = spark.createDataFrame([(i, url()) for i in range(200)] + [(900, "http://x.org/"), (901, None)], "page_id long, url string")
    tokens = labels.select(url_filter.tokens(F.col("url")).alias("tokens"), "verdict")
    rules = [(x.confidence, x.support, len(x.antecedent), " ".join(x.antecedent), x.verdict, set(x.antecedent)) for x in url_filter.mine(tokens).collect()]
    held = {x.page_id: set(x.t) for x in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()}
    got = {x.page_id: (x.verdict, x.mined_rule) for x in url_filter.filter_urls(pages, url_filter.listed_rules(spark).where("false"), labels).collect()}
    for page, t in held.items():
        fits = [x for x in rules if x[5] <= t]
        assert got[page] == (max(fits)[4], max(fits)[3]) if fits else got[page] == ("allow", None)
    right = [got[x.page_id][0] == ("block" if bad(x.url) else "allow") for x in pages.where("page_id < 900").collect()]
    assert sum(right) / len(right) > 0.95


def test_url_held_out(spark, sf):
    """The rules mined from three quarters of the URLs that listed rules judge say the same of the other quarter."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    listed = url_filter.filter_urls(pages, url_filter.listed_rules(spark)).where("rule is not null").select("page_id", "url", F.col("verdict").alias("listed"))
    part = F.pmod(F.xxhash64("url"), F.lit(4))
    labels = listed.where(part > 0).select("url", F.col("listed").alias("verdict")).distinct()
    said = url_filter.filter_urls(listed.where(part == 0), url_filter.listed_rules(spark).where("false"), labels).join(listed, "page_id")
    right, n = said.agg(F.avg((F.col("verdict") == F.col("listed")).cast("double")), F.count(F.lit(1))).first()
    assert n > 20 and right > 0.9


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.near_copies_stage(spark, docs, sf)
    groups = brute.components(rows.items(), 5, "0.8")
    assert {r.doc_id for r in kept.collect()} == {d for d, g in groups.items() if g[1] == d} and kept.columns == docs.columns
    cut = corpus_pipeline.repeats_stage(spark, docs, sf)
    sizes = brute.repeats(rows.items())
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and all(texts.get(d) == rows[d] for d, x in sizes.items() if not x[1])
    assert all(len(t.encode()) <= sizes[d][0] - sizes[d][1] for d, t in texts.items())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = corpus_pipeline.benchmark_stage(spark, docs, sf)
    assert {r.doc_id for r in clean.collect()} == {d for d, x in brute.contamination(rows.items(), items).items() if not x[4]}
    mix = corpus_pipeline.mix_stage(spark, docs, sf)
    want = brute.mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {r.doc_id: r.taken for r in mix.collect()} == {d: x[3] for d, x in want.items() if x[3]}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources"]


def test_pipeline_run(spark, sf):
    """The whole of run() against brute force; only the classifier's tails are taken from the operator, which test_quality_scores checks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect() if r.doc_id in good}
    groups = brute.components([(d, t) for d, (t, _) in rows.items()], 5, "0.8")
    rows = {d: x for d, x in rows.items() if groups[d][1] == d}
    cut = {d: t for d, t in brute.without_repeats((d, t) for d, (t, _) in rows.items()).items() if not (rows[d][0] or "").strip() or t.strip()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, x in brute.contamination(cut.items(), items).items() if not x[4]}
    taken = {d: x for d, x in brute.mixed([(d, cut[d], rows[d][1]) for d in clean]).items() if x[3]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: (r.size, r.source_size, r.taken) for d, r in got.items()} == {d: (x[0], x[1], x[3]) for d, x in taken.items()} and len(got) > 20
    assert all(r.text == cut[d] and r.n_chars == len(r.text) and abs(r.target - taken[d][2]) < 1e-6 for d, r in got.items())


def test_pipeline_stages_cases(spark, sf):
    """Empty tables, nulls, empty texts, rows that repeat an id with equal and with differing texts, extra columns with clashing names."""
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words = lambda k: " ".join(f"word{k}n{i}" for i in range(60))
    odd = [(1, None), (1, None), (None, words(1)), (3, ""), (4, words(2)), (4, item), (None, item), (None, words(3)), (5, words(1) + " end"), (6, words(4)), (6, words(4)), (6, words(5))]
    names = ["size", "taken", "target", "version", "component", "runs", "row", "key", "grade", "f", "__had", "keep"]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], empty.schema).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        assert stage(spark, odd, sf).columns[: len(odd.columns)] == odd.columns
    everything = rows(odd)
    assert set(rows(corpus_pipeline.quality_stage(spark, odd, sf))) <= set(everything)
    near = [(1, None), (3, ""), (4, words(2)), (4, item), (None, words(3)), (5, words(1) + " end"), (6, words(4)), (6, words(5))]
    assert rows(corpus_pipeline.near_copies_stage(spark, odd, sf)) == sorted(near, key=str)
    assert rows(corpus_pipeline.benchmark_stage(spark, odd, sf)) == [x for x in everything if x[1] != item]
    cut = rows(corpus_pipeline.repeats_stage(spark, odd, sf))
    assert (None, words(1)) in cut and (5, words(1) + " end") not in cut and [x for x in cut if x[0] in (1, 3)] == [(1, None), (1, None), (3, "")]
    mixed = corpus_pipeline.mix_stage(spark, odd, sf)
    assert mixed.columns == [*odd.columns, "mix_size", "source_size", "mix_target", "mix_taken"]
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= set(everything) - {(1, None), (3, "")} and mixed.agg(F.sum("mix_taken")).first()[0] > 400
