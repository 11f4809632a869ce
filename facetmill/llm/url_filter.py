"""URL filter: listed rules first, then association rules over URL tokens, in DataFrame functions and Spark's FP-growth.

Labels.  URLs with a known verdict teach the miner; by default these are the URLs that the listed rules judge.  Each distinct URL
is a transaction of its tokens and its verdict.  Token combinations on at least min_support of them (and on MIN_COUNT URLs) that
point to one verdict with sufficient confidence become rules, unless a part of the combination does it as well.

Mining stays bounded by method, whatever the URLs look like.  Tokens below the support can be in no rule.  A token that always stands beside
one verdict is a rule, and every combination with it is beaten by it, so it needs no further mining.  What is left of a URL
is cut into overlapping stretches of WINDOW tokens in the URL's order, which FP-growth mines: a stretch has at most 2 ** WINDOW combinations.
Pairs of undecided tokens are counted over whole URLs, so only a rule of three tokens or more needs them within WINDOW undecided tokens of each other.
All combinations found are then counted on the whole URLs.

Matching.  An inverted index posts each rule under its rarest token; a URL looks up its tokens, and a rule fits if
the URL has all its tokens.  Of several the most confident wins, then the one with more support, then more tokens, then
the last in order of its tokens.  Without any the verdict is `allow`.

Defined cases: a null url or one without :// has an empty host and path, no tokens, no listed rule, and is allowed;
an empty table gives an empty result; urls of any length keep all their tokens; repeated pages are judged each; without labels or frequent combinations everything unlisted is allowed; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import host_of
from .shared import broadcast_if_small, materialize

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
MIN_COUNT = 5  # URLs that a rule stands on at least
WINDOW = 10
MAX_RULES_BROADCAST = 50_000
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
VERDICT = "verdict="


def path_of(url):
    """Path of a url column: what follows the host, up to ? # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url):
    """Distinct tokens in the order of the URL: the host's domain suffixes and words, the path's parts and the query's keys."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, n - i + 1, i), "."))))
    words = F.transform(F.filter(F.split(host_of(url), r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (suffixes, words, parts, keys)])
    return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def listed_rules(spark: SparkSession, rules=LISTED) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "listed string, rule_host string, rule_path string")


def judge_listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path) with the longest listed rule that fits: rule, listed (both null without one)."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    fits = urls.where("host <> ''").select("url", "path", F.explode(tails).alias("rule_host")).join(broadcast_if_small(rules, MAX_RULES_BROADCAST), "rule_host")
    fits = fits.where(F.col("path").startswith(F.col("rule_path"))).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "listed")).alias("best")).select(F.col("url").alias("_u"), "best.rule", "best.listed")
    return urls.join(best, F.col("url") == F.col("_u"), "left").drop("_u")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, window: int = WINDOW) -> DataFrame:
    """labelled (tokens, verdict), one row for each labelled URL -> (antecedent, verdict, confidence, support)."""
    spark = labelled.sparkSession
    rows = materialize(labelled.select("tokens", "verdict").where("size(tokens) > 0 and verdict is not null").withColumn("url_id", F.monotonically_increasing_id()))
    n = rows.count()
    need = max(min_count, int(min_support * n) + (int(min_support * n) < min_support * n))
    if n < need:
        return spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    single = rows.select(F.explode("tokens").alias("token"), "verdict").groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("freq"))
    single = materialize(single.groupBy("token").agg(F.sum("freq").alias("all"), F.max("freq").alias("freq"), F.max_by("verdict", "freq").alias("verdict")).where(F.col("all") >= need))
    # tokens that decide alone need no mining; the undecided ones, in the order of the URL
    undecided = broadcast_if_small(single.where("all > freq").select("token"), MAX_RULES_BROADCAST)
    left = rows.select("url_id", "verdict", F.posexplode("tokens").alias("at", "token")).join(undecided, "token").groupBy("url_id", "verdict").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    left = left.select("url_id", "verdict", F.col("t.token").alias("t")).where("size(t) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - window + 1, F.lit(1)))
    stretches = materialize(left.select("verdict", F.explode(F.transform(starts, lambda i: F.slice("t", i, window))).alias("t")).select(F.array_append("t", F.concat(F.lit(VERDICT), "verdict")).alias("items")))
    n_stretches = stretches.count()
    decided = single.where("all = freq").select(F.array("token").alias("antecedent"), "verdict", F.lit(1.0).alias("confidence"), (F.col("freq") / n).alias("support"))
    if not n_stretches:
        return decided
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n_stretches)).fit(stretches)
    rest = F.array_sort(F.filter("items", lambda x: ~x.startswith(VERDICT)))
    mined = model.freqItemsets.where(F.exists("items", lambda x: x.startswith(VERDICT))).select(rest.alias("antecedent")).where("size(antecedent) > 0")
    # pairs of undecided tokens, however far apart in the URL
    both = F.expr("flatten(transform(t, (a, i) -> transform(slice(t, i + 2, size(t)), b -> array_sort(array(a, b)))))")
    pairs = left.select("verdict", F.explode(both).alias("antecedent")).groupBy("antecedent", "verdict").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("antecedent")
    combinations = materialize(mined.unionByName(pairs).distinct())
    # counted exactly, on whole URLs
    index = post(combinations, single.select("token", F.col("all").alias("count")))
    looked = rows.select("tokens", "verdict", F.explode("tokens").alias("token")).join(broadcast_if_small(index, MAX_RULES_BROADCAST), "token")
    counted = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("antecedent", "verdict").agg(F.count(F.lit(1)).alias("freq"))
    total = counted.groupBy("antecedent").agg(F.sum("freq").alias("all"))
    rules = counted.where(F.col("freq") >= need).join(total, "antecedent").select("antecedent", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / n).alias("support"))
    rules = materialize(rules.where(F.col("confidence") >= min_confidence))
    # a rule goes if one of its parts, one token smaller, says the same with at least its confidence
    smaller = rules.where("size(antecedent) > 1").select(
        F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("own"), F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("antecedent")
    )
    beaten = smaller.join(rules.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"]).where("confidence >= own").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti").unionByName(decided)


def post(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The rules with the token under which an inverted index lists each: its rarest by counts (token, count)."""
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"]
    return materialize(posted.groupBy(*rules.columns).agg(rarest.alias("token")))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens) -> (url, mined, mined_rule, confidence) of those that a mined rule fits."""
    rules = materialize(rules)
    named = rules.select(F.explode("antecedent").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(broadcast_if_small(named, MAX_RULES_BROADCAST), "token", "left_semi").groupBy("token").count()
    index = post(rules, seen)
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(index, MAX_RULES_BROADCAST), "token")
    fits = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("antecedent").alias("size"), F.array_join("antecedent", " ").alias("mined_rule"), "verdict")
    return fits.groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.mined_rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined_rule, confidence) of every page.

    labels (url, verdict), one row for each URL, teach the miner; without them the URLs that a listed rule judges do.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    urls = pages.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    judged = materialize(judge_listed(urls, rules))
    taught = judged.where("listed is not null").select("tokens", F.col("listed").alias("verdict")) if labels is None else labels.select(tokens(F.col("url")).alias("tokens"), "verdict")
    mined = match(judged.where("listed is null").select("url", "tokens"), mine(taught, min_support, min_confidence))
    found = judged.join(mined, "url", "left").withColumnRenamed("url", "_u")
    out = pages.join(found, F.col("url") == F.col("_u"), "left")
    return out.select(
        "page_id",
        "url",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_rules(spark))
