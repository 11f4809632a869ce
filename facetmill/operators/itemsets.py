"""Maximal frequent itemsets over `column___value` items: mining, scores, ranks, supporting rows, patterns.

Mining counts level by level: a row keeps only the codes of its frequent items, rows with the same codes become one with a count, and each task counts pairs and
candidates over batches of these (functions.incidence) and gives one number for each.  When a level has too many candidates for that, Spark's FP-growth takes over.
"""

from __future__ import annotations

from itertools import combinations

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.functions.incidence import COUNTS, PAIRS, index_rows, pair_counts, set_counts
from facetmill.functions.items import SEP, item, item_column, item_key, item_value, literal_map, quoted
from facetmill.operators.prepare import _plain, apply_buckets, blank_nulls, normalize_nulls
from facetmill.sources.work import materialize

MAX_CANDIDATES = 2_000
FEW = 500  # candidates that are counted together with the unions of their groups


def to_transactions(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, items): an item for each non-null cell, the row id excluded; a row without cells has an empty array."""
    cells = [item(c) for c in _plain(df) if c != row_id]
    items = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<string>")
    return df.select(quoted(row_id).alias("row_id"), items.alias("items"))


def min_count(n: int, min_support: float) -> int:
    """Smallest frequency that is frequent: ceil(min_support * n) as doubles give it, one at least."""
    product = min_support * n
    return max(1, int(product) + (int(product) < product))


def frequent_itemsets(tx: DataFrame, min_support: float = 0.1, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(items, freq): all frequent itemsets; items sorted."""
    return counted_itemsets(tx, min_support, max_candidates)[0]


class Counted:
    """Rows as codes of their frequent items, each different set of codes once with its number of rows, and counts of sets of these codes.

    Codes stand in the order of rising frequency, so that what is common comes last.  stored: tx is read from a work table, and is not persisted.
    """

    def __init__(self, tx: DataFrame, min_support: float, stored: bool = False):
        self.tx, self.stored = tx if stored else tx.persist(StorageLevel.MEMORY_AND_DISK), stored  # for two passes: items, then codes
        self.n = self.tx.count()
        self.need = min_count(self.n, min_support)
        ones = self.tx.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
        first = ones.where(F.col("freq") >= self.need).collect()  # at most 1 / min_support for each column
        first = sorted((r["freq"], r["item"]) for r in first)
        self.names, self.freq = [x for _, x in first], [f for f, _ in first]
        self.column = [x.split(SEP)[0] for x in self.names]
        self.coded = None
        if len(first) > 1:
            code = F.create_map(*[F.lit(x) for i, a in enumerate(self.names) for x in (a, i)])
            coded = self.tx.select(F.array_compact(F.transform("items", lambda x: code[x])).alias("codes"))  # a filter here would work the codes out twice
            # columns have few frequent values: rows with the same codes are one row from here on
            self.coded = materialize(coded.groupBy("codes").agg(F.count(F.lit(1)).alias("n")))

    def pairs(self) -> dict[tuple[int, int], int]:
        """Frequent pairs of codes."""
        if self.coded is None:
            return {}
        both = self.coded.mapInArrow(pair_counts, PAIRS).where("i < j").groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= self.need)
        return {(r["i"], r["j"]): r["n"] for r in both.collect()}  # frequent ones only

    def sets(self, candidates: list[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
        """The number of rows that hold each candidate."""
        if not candidates:
            return {}
        least = min(map(len, candidates))
        counts = self.coded.where(F.size("codes") >= least).mapInArrow(set_counts(candidates, len(self.names)), COUNTS).groupBy("place").agg(F.sum("n").alias("n")).collect()  # one for each candidate
        got = {r["place"]: r["n"] for r in counts}
        return {c: got.get(k, 0) for k, c in enumerate(candidates)}

    def close(self) -> None:
        if not self.stored:
            self.tx.unpersist()

    def frame(self, found: dict[tuple[int, ...], int]) -> DataFrame:
        rows = [(sorted(self.names[i] for i in c), f) for c, f in found.items()]
        return self.tx.sparkSession.createDataFrame(rows, "items array<string>, freq long")


def counted_itemsets(tx: DataFrame, min_support: float, max_candidates: int = MAX_CANDIDATES) -> tuple[DataFrame, int]:
    """All frequent itemsets (items, freq), and the number of rows."""
    data = Counted(tx, min_support)
    try:
        found = {(i,): f for i, f in enumerate(data.freq)} | data.pairs()
        level = sorted(c for c in found if len(c) == 2)
        while level:
            known, size = set(level), len(level[0])
            starts: dict[tuple, list[tuple]] = {}
            for s in level:
                starts.setdefault(s[:-1], []).append(s)
            candidates = [a + (b[-1],) for group in starts.values() for a, b in combinations(sorted(group), 2)]
            candidates = [c for c in candidates if len({data.column[i] for i in c}) == size + 1 and all(c[:i] + c[i + 1 :] in known for i in range(size + 1))]
            if len(candidates) > max_candidates:
                return frequent_itemsets_fpgrowth(tx, min_support), data.n
            counted = data.sets(candidates)
            level = sorted(c for c in candidates if counted[c] >= data.need)
            found |= {c: counted[c] for c in level}
        return data.frame(found), data.n
    finally:
        data.close()


def frequent_itemsets_fpgrowth(tx: DataFrame, min_support: float = 0.1) -> DataFrame:
    """The same by Spark's FP-growth, for dense tables and low supports."""
    n = tx.count()
    if not n:
        return tx.sparkSession.createDataFrame([], "items array<string>, freq long")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support)).fit(tx.select("items"))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq").where(F.col("freq") >= min_count(n, min_support))


def maximal_frequent_itemsets(tx: DataFrame, min_support: float = 0.1, max_candidates: int = MAX_CANDIDATES, stored: bool = False) -> DataFrame:
    """(items, freq, support) of the frequent itemsets without a frequent superset.

    Looked for by groups of a head and the items that may follow it.  Before the members of a group are counted, the union of its head and the most
    frequent followers, one a column, is: if that is frequent and the whole group, none of its subsets needs to be looked at, nor any other group that lies in
    it.  So tables with columns that go together do not enumerate all their subsets.  With too many candidates FP-growth takes over.  stored: see Counted.
    """
    data = Counted(tx, min_support, stored)
    try:
        found = _maximal(data, max_candidates)
        if found is not None:
            return data.frame(found).select("items", "freq", (F.col("freq") / F.lit(data.n)).alias("support"))
    finally:
        data.close()
    every = frequent_itemsets_fpgrowth(tx, min_support)  # by closure, one item larger is enough
    smaller = every.where("size(items) > 1").select(F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items")).distinct()
    return every.join(smaller, "items", "left_anti").select("items", "freq", (F.col("freq") / F.lit(data.n)).alias("support"))


def _maximal(data: Counted, max_candidates: int) -> dict[tuple[int, ...], int] | None:
    """Maximal sets of codes with their counts; None if a level has too many candidates."""
    pairs = data.pairs()
    after: dict[int, list[int]] = {i: [] for i in range(len(data.names))}
    for a, b in sorted(pairs):
        after[a].append(b)
    found: dict[tuple[int, ...], int] = {}
    supersets = Supersets()
    groups = [((i,), data.freq[i], after[i]) for i in after]
    known = dict(pairs)

    def record(s: tuple[int, ...], n: int) -> None:
        if s not in found:
            found[s] = n
            supersets.add(s)

    def union(head, tail):
        best = {data.column[t]: t for t in tail}  # the last, most frequent one of each column
        return tuple(sorted({*head, *best.values()}))

    while groups:
        groups = [g for g in groups if not supersets.cover((*g[0], *g[2]))]
        unions = {union(h, t) for h, _, t in groups if len(t) > 1} - known.keys()
        members = {(*h, t) for h, _, tail in groups for t in tail} - known.keys()
        together = len(unions) + len(members) <= FEW
        if max(len(unions), len(members)) > max_candidates:
            return None
        counted = data.sets(sorted(unions | members if together else unions))
        known |= counted
        for s in unions:
            if known[s] >= data.need:
                record(s, known[s])
        groups = [g for g in groups if not supersets.cover((*g[0], *g[2]))]
        if not together:
            known |= data.sets(sorted({(*h, t) for h, _, tail in groups for t in tail} - known.keys()))
        deeper = []
        for head, n, tail in groups:
            follow = [t for t in tail if known[(*head, t)] >= data.need]
            if not follow:
                record(head, n)
            for k, t in enumerate(follow):
                deeper.append(((*head, t), known[(*head, t)], [u for u in follow[k + 1 :] if (t, u) in pairs]))
        groups = deeper
    return {s: n for s, n in found.items() if not supersets.cover(s, proper=True)}


class Supersets:
    """Which recorded sets hold a given one, by the recorded sets of each code."""

    def __init__(self):
        self.by_code: dict[int, set[int]] = {}
        self.size: list[int] = []

    def add(self, s: tuple[int, ...]) -> None:
        for i in s:
            self.by_code.setdefault(i, set()).add(len(self.size))
        self.size.append(len(s))

    def cover(self, s: tuple[int, ...], proper: bool = False) -> bool:
        lists = sorted((self.by_code.get(i, set()) for i in s), key=len)
        held = set.intersection(*lists) if lists else set()
        return any(self.size[k] > len(s) for k in held) if proper else bool(held)


def score_itemsets(itemsets: DataFrame, weights: dict[str, float], gamma: float = 0.5) -> DataFrame:
    """score = gamma * support + (1 - gamma) * cohesion; cohesion: the items' weights over the sum of all |weights|.

    A column without a weight counts 1; a sum of 0 leaves the cohesion as it is.
    """
    table = literal_map(weights)
    total = sum(abs(w) for w in weights.values())
    own = F.aggregate(F.array_sort("items"), F.lit(0.0), lambda s, x: s + F.coalesce(table[item_column(x)], F.lit(1.0)))
    return itemsets.withColumn("score", F.lit(gamma) * F.col("support") + F.lit(1 - gamma) * (own / F.lit(float(total)) if total else own))


def rank_itemsets(itemsets: DataFrame, max_collection: int = 10) -> DataFrame:
    """itemset_id from 0: by score (12 digits) descending, then by items; all for -1, else the first max_collection."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 12)), item_key(F.col("items")))  # only the mined result
    ranked = itemsets.withColumn("itemset_id", F.row_number().over(order) - 1)
    return ranked if max_collection < 0 else ranked.where(F.col("itemset_id") < max_collection)


def with_unique_id(itemsets: DataFrame) -> DataFrame:
    """md5 of the sorted col:val pairs joined by a pipe; values `nan` are left out."""
    pairs = F.transform("items", lambda x: F.concat(item_column(x), F.lit(":"), item_value(x)))
    kept = F.filter(pairs, lambda p: ~p.endswith(":nan"))
    return itemsets.withColumn("unique_id", F.md5(F.array_join(F.array_sort(kept), "|")))


def matches(tx: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(row_id, matches): the ids of the itemsets that each row holds, as an array in the row; no shuffle of the table.

    Each task asks an inverted index over items (functions.incidence) with the items of its rows, whatever the number of itemsets.
    """
    rows = itemsets.select("itemset_id", "items").orderBy("itemset_id").collect()  # the mined result
    names = sorted({x for r in rows for x in r["items"]})
    place = {x: i for i, x in enumerate(names)}
    sets = [tuple(sorted(place[x] for x in r["items"])) for r in rows]
    return tx.select("row_id", "items").mapInArrow(index_rows(names, sets, [r["itemset_id"] for r in rows]), f"row_id {tx.schema['row_id'].dataType.simpleString()}, matches array<int>")


def has_matches(rows: DataFrame) -> bool:
    """Whether rows are (row_id, matches), one for each row id, or (itemset_id, row_id).  The first form needs no shuffle by row id."""
    return "matches" in rows.columns


def membership(tx: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(itemset_id, row_id), one record for each supporting row; ids repeat if the row id does."""
    return membership_of(matches(tx, itemsets))


def membership_of(matched: DataFrame) -> DataFrame:
    return matched.select(F.explode("matches").alias("itemset_id"), "row_id")


def itemset_pairs(itemsets: DataFrame) -> DataFrame:
    """(itemset_id, col, val)."""
    x = itemsets.select("itemset_id", F.explode("items").alias("x"))
    return x.select("itemset_id", item_column(F.col("x")).alias("col"), item_value(F.col("x")).alias("val"))


def items_to_map(items):
    return F.map_from_entries(F.transform(F.array_sort(items), lambda x: F.struct(item_column(x).alias("key"), item_value(x).alias("value"))))


def strip_common_pairs(itemsets: DataFrame) -> DataFrame:
    """(itemset_id, details): the itemsets as maps without the pairs that all of them hold; may be empty."""
    pairs = itemset_pairs(itemsets)
    k = itemsets.agg(F.count(F.lit(1)).alias("k"))
    common = pairs.groupBy("col", "val").agg(F.count_distinct("itemset_id").alias("n")).crossJoin(F.broadcast(k)).where("n = k").select("col")  # k is one row
    left = pairs.join(common, "col", "left_anti").groupBy("itemset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "val")))).alias("details"))
    empty = F.expr("cast(map() as map<string,string>)")
    return itemsets.select("itemset_id").join(left, "itemset_id", "left").select("itemset_id", F.coalesce("details", empty).alias("details"))


def group_by_pattern(details: DataFrame) -> DataFrame:
    """(pattern, n_itemsets, level, itemset_ids): itemsets by the columns that are left of them."""
    pattern = F.array_join(F.array_sort(F.map_keys("details")), "|")
    g = details.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n_itemsets"), F.array_sort(F.collect_list("itemset_id")).alias("itemset_ids"))
    level = F.when(F.col("n_itemsets") == 1, "very interesting").when(F.col("n_itemsets") == 2, "mildly interesting").otherwise("uninteresting")
    return g.select("pattern", "n_itemsets", level.alias("level"), "itemset_ids")


def unassigned_rows(df: DataFrame, members: DataFrame, row_id: str) -> DataFrame:
    """(row_id): row ids in no ranked itemset; members as for has_matches."""
    if has_matches(members):
        return members.where(F.size("matches") == 0).select("row_id")
    return df.select(quoted(row_id).alias("row_id")).distinct().join(members.select("row_id").distinct(), "row_id", "left_anti")


def supporting_rows(members: DataFrame, examples: int = 5) -> DataFrame:
    """(itemset_id, n_rows, example_rows): the number of rows and the smallest row ids; members as for has_matches.

    Each task keeps the first few rows of an itemset only (Spark's window group limit), so what is shuffled is bounded by itemsets and tasks.
    """
    each, once = (membership_of(members),) * 2 if has_matches(members) else (members, members.distinct())
    counts = each.groupBy("itemset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    first = W.partitionBy("itemset_id").orderBy("row_id")
    some = once.withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples).groupBy("itemset_id").agg(F.array_sort(F.collect_list("row_id")).alias("example_rows"))
    return counts.join(some, "itemset_id")


def rank_listing(details: DataFrame, members: DataFrame, examples: int = 5) -> DataFrame:
    """(itemset_id, pattern, details, n_rows, example_rows) for a reviewer; the smallest row ids are the examples."""
    out = details.join(supporting_rows(members, examples), "itemset_id", "left")
    return out.select("itemset_id", F.array_join(F.array_sort(F.map_keys("details")), "|").alias("pattern"), "details", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "example_rows")


def rank_maximal_itemsets(
    df: DataFrame, row_id: str, weights: dict[str, float] | None = None, min_support: float = 0.1, max_collection: int = 10, gamma: float = 0.5, plan: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(transactions, ranked itemsets with itemset_id, items, freq, support, score, unique_id).

    Cells that spell a null are null first, so that no bucket counts them; then high-cardinality columns are bucketed by their own
    types (see prepare.apply_buckets), then everything is text.
    """
    bucketed = normalize_nulls(apply_buckets(blank_nulls(df, row_id), plan, row_id), row_id)
    columns = [c for c in bucketed.columns if c != row_id]
    weights = {c: 1 / len(columns) for c in columns} if weights is None else weights
    tx = materialize(to_transactions(bucketed, row_id))  # read for items, codes and matches
    ranked = rank_itemsets(score_itemsets(maximal_frequent_itemsets(tx, min_support, stored=True), weights, gamma), max_collection)
    return tx, with_unique_id(ranked).select("itemset_id", "items", "freq", "support", "score", "unique_id")
