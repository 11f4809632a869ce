"""Learning column weights and gamma from rankings of itemsets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetmill.functions.items import item_column, item_key
from facetmill.operators.clusters import small
from facetmill.operators.itemsets import group_by_pattern, matches, membership_of, rank_itemsets, rank_maximal_itemsets, score_itemsets, strip_common_pairs, unassigned_rows
from facetmill.sources.tables import CONFIG, save_config
from facetmill.sources.work import materialize

# The learning rates that are tried
RATES_WEIGHTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RATES_GAMMA = [0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
LEARNED = "session string, lr_weights double, lr_gamma double, gamma double, weights map<string,double>"


def valid_rankings(rankings: DataFrame, k: int) -> DataFrame:
    """(session, ranking): the rankings that are permutations of 0 .. k - 1; an empty one is no feedback."""
    r = F.col("ranking")
    return rankings.where((F.size(r) == k) & (F.size(r) > 0) & (F.size(F.array_distinct(r)) == k) & (F.array_min(r) == 0) & (F.array_max(r) == k - 1))


def preference_pairs(rankings: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(session, step, a, b, supp_a, supp_b): each better and worse itemset of a session, in order of their places."""
    places = rankings.select("session", F.posexplode("ranking").alias("place", "itemset_id"))
    a = places.select("session", F.col("place").alias("place_a"), F.col("itemset_id").alias("a"))
    b = places.select(F.col("session").alias("s"), F.col("place").alias("place_b"), F.col("itemset_id").alias("b"))
    pairs = a.join(b, (F.col("session") == F.col("s")) & (F.col("place_a") < F.col("place_b"))).drop("s")
    supports = small(itemsets.select("itemset_id", "support"))
    pairs = pairs.join(supports.select(F.col("itemset_id").alias("a"), F.col("support").alias("supp_a")), "a").join(supports.select(F.col("itemset_id").alias("b"), F.col("support").alias("supp_b")), "b")
    order = W.partitionBy("session").orderBy("place_a", "place_b")
    return pairs.select("session", (F.row_number().over(order) - 1).alias("step"), "a", "b", "supp_a", "supp_b")


def one_update(weights: dict[str, float], gamma, better: list[str], worse: list[str], supp_a: float, supp_b: float, lr_weights: float, lr_gamma):
    """One pairwise logistic step: changes the weights in place and gives the new gamma.

    better and worse are lists of columns; the sum of |w| is that before the step.  Weights, gamma and rates may be arrays, one place for each setting.
    """
    total = sum(abs(w) for w in weights.values())
    total = np.where(total == 0, 1.0, total)
    cohesion_a, cohesion_b = (sum(weights[c] for c in columns) / total for columns in (better, worse))
    delta = gamma * (supp_a - supp_b) + (1 - gamma) * (cohesion_a - cohesion_b)
    slope = -1 / (1 + np.exp(np.minimum(700.0, delta)))  # -(1 - sigmoid(delta))
    step = lr_weights * (1 - gamma) / total * slope
    for c in better:
        weights[c] = weights[c] - step
    for c in worse:
        weights[c] = weights[c] + step
    return np.clip(gamma - lr_gamma * slope * ((supp_a - cohesion_a) - (supp_b - cohesion_b)), 0.0, 1.0)


def update_weights(rankings: DataFrame, itemsets: DataFrame, weights: dict[str, float], gamma: float, rates: DataFrame, in_a_row: bool = False) -> DataFrame:
    """The learned weights and gamma of every session under every setting of rates (lr_weights, lr_gamma).

    rankings: as from valid_rankings; a place of a ranking travels once for each lr_weights, and each task builds the pairs of better and worse from the k places it gets.
    Steps follow one another inside a session, all lr_gamma of a task side by side; sessions and lr_weights run apart.  in_a_row: each session goes on from what the sessions
    before it (by name) have learnt, and there is one result, named by the last.  Every column needs a weight.
    """
    columns = small(itemsets.select("itemset_id", "support", F.transform("items", item_column).alias("cols")))
    places = rankings.select("session", F.posexplode("ranking").alias("place", "itemset_id")).join(columns, "itemset_id")
    tried = rates.groupBy("lr_weights").agg(F.sort_array(F.collect_set("lr_gamma")).alias("lr_gammas"))
    steps = places.crossJoin(F.broadcast(tried))  # a few settings

    def learn(p: pd.DataFrame) -> pd.DataFrame:
        lr_w, lr_g = float(p["lr_weights"].iloc[0]), np.array(p["lr_gammas"].iloc[0], float)
        w, g = {c: np.full(len(lr_g), v, float) for c, v in weights.items()}, np.full(len(lr_g), gamma, float)
        for _, one in p.sort_values(["session", "place"]).groupby("session", sort=True, dropna=False):
            cols, support = [list(c) for c in one["cols"]], one["support"].tolist()
            for a in range(len(cols)):
                for b in range(a + 1, len(cols)):
                    g = one_update(w, g, cols[a], cols[b], support[a], support[b], lr_w, lr_g)
        learnt = [{c: float(v[i]) for c, v in w.items()} for i in range(len(lr_g))]
        return pd.DataFrame({"session": p["session"].max(), "lr_weights": lr_w, "lr_gamma": lr_g, "gamma": g, "weights": learnt})

    keys = ["lr_weights"] if in_a_row else ["session", "lr_weights"]
    return steps.groupBy(*keys).applyInPandas(learn, LEARNED)  # k places of a session


def setting(spark, lr_weights: float = 0.12, lr_gamma: float = 0.8) -> DataFrame:
    return spark.createDataFrame([(lr_weights, lr_gamma)], "lr_weights double, lr_gamma double")


def learning_rate_grid(itemsets: DataFrame, ranking: DataFrame, weights: dict[str, float], gamma: float = 0.7) -> DataFrame:
    """A row for each of 10 x 10 rates: mean |change of weight|, |change of gamma|, gamma, and two rank distances.

    itemsets: ranked, with unique ids; ranking: one session.  rank_distance compares the learned order with the
    wanted one by itemset; rank_distance_ref compares places with the wanted list only, whatever was learned.
    """
    spark = itemsets.sparkSession
    rates = spark.createDataFrame([(a, b) for a in RATES_WEIGHTS for b in RATES_GAMMA], "lr_weights double, lr_gamma double")
    learned = update_weights(ranking, itemsets, weights, gamma, rates)
    w = F.col("weights")
    old = F.create_map(*[F.lit(x) for c, v in sorted(weights.items()) for x in (c, float(v))])
    change = F.aggregate(F.map_entries(w), F.lit(0.0), lambda s, e: s + F.abs(e["value"] - old[e["key"]])) / F.lit(len(weights))
    total = F.aggregate(F.map_values(w), F.lit(0.0), lambda s, x: s + F.abs(x))
    ideal = ranking.select("session", F.posexplode("ranking").alias("wanted", "itemset_id"))
    scored = learned.join(small(itemsets.select("itemset_id", "items", "support")), F.lit(True))  # the mined result for each setting
    own = F.aggregate(F.array_sort("items"), F.lit(0.0), lambda s, x: s + F.coalesce(w[item_column(x)], F.lit(1.0)))
    scored = scored.withColumn("score", F.col("gamma") * F.col("support") + (1 - F.col("gamma")) * F.when(total > 0, own / total).otherwise(own))
    order = W.partitionBy("session", "lr_weights", "lr_gamma").orderBy(F.desc(F.round("score", 12)), item_key(F.col("items")))
    placed = scored.withColumn("place", F.row_number().over(order) - 1).join(small(ideal), ["session", "itemset_id"])
    metrics = placed.groupBy("session", "lr_weights", "lr_gamma").agg(F.sum(F.abs(F.col("place") - F.col("wanted"))).alias("rank_distance"), F.sum(F.abs(F.col("itemset_id") - F.col("wanted"))).alias("rank_distance_ref"))
    out = learned.join(metrics, ["session", "lr_weights", "lr_gamma"])
    return out.select("session", "lr_weights", "lr_gamma", change.alias("mean_weight_change"), F.abs(F.col("gamma") - gamma).alias("gamma_change"), "gamma", "rank_distance", "rank_distance_ref").orderBy("rank_distance", "lr_weights", "lr_gamma")


def train(
    df: DataFrame, row_id: str, rankings: DataFrame, weights: dict[str, float] | None = None, min_support: float = 0.1, max_collection: int = -1, gamma: float = 0.7, lr_weights: float = 0.12, lr_gamma: float = 0.8, plan: dict[str, str] | None = None,
    table_name: str = "table", path: str | None = None, unique_ids: bool = False,
) -> dict[str, DataFrame]:
    """Mine once, learn from the rankings, rank again with the learned weights, and list what a reviewer sees.

    Sessions are learnt from one after another, by name, each going on from the last one's weights.  The unpruned itemsets are rescored.  config is the table's new configuration; with a path
    it is saved there (see sources.tables.save_config) and load_config finds it under table_name.  unique_ids: no row id repeats, so rows are not shuffled by it.
    """
    columns = [c for c in df.columns if c != row_id]
    weights = {c: 1 / len(columns) for c in columns} if weights is None else weights
    tx, itemsets = rank_maximal_itemsets(df, row_id, weights, min_support, -1, gamma, plan)
    itemsets = materialize(itemsets)
    shown = itemsets if max_collection < 0 else itemsets.where(F.col("itemset_id") < max_collection)
    good = valid_rankings(rankings, shown.count())
    learned = materialize(update_weights(good, shown, weights, gamma, setting(df.sparkSession, lr_weights, lr_gamma), in_a_row=True))
    last = learned.first()
    new_weights, new_gamma = (dict(last["weights"]), last["gamma"]) if last else (weights, gamma)
    ranked = rank_itemsets(score_itemsets(itemsets.drop("itemset_id", "score"), new_weights, new_gamma), max_collection)
    ranked = materialize(ranked)
    held = matches(tx, ranked)
    members = membership_of(held)
    details = strip_common_pairs(ranked)
    config = df.sparkSession.createDataFrame([(table_name, new_weights, min_support, max_collection, new_gamma, lr_weights, lr_gamma)], CONFIG)
    if path is not None:
        save_config(config, path)
    unassigned = unassigned_rows(df, held if unique_ids else members, row_id)
    return {"itemsets": ranked, "learned": learned, "details": details, "patterns": group_by_pattern(details), "unassigned": unassigned, "members": members, "held": held, "config": config}
