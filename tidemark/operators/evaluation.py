"""Full-ranking evaluation: masking, top-k, metrics, slices."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.scale import unbounded

K = 20


def targets_of(split: DataFrame, mode: str) -> DataFrame:
    """(user, item) the model has to find."""
    return split.filter(F.col("part") == mode).select("user", "item").distinct()


def seen_of(split: DataFrame, mode: str) -> DataFrame:
    """(user, item) hidden from the ranking: train for val, train and val for test."""
    parts = ["train"] if mode == "val" else ["train", "val"]
    return split.filter(F.col("part").isin(parts)).select("user", "item").distinct()


def mask_seen(scores: DataFrame | Callable[..., DataFrame], split: DataFrame, mode: str) -> DataFrame:
    """Scores of unseen items for users that have a target.

    `scores` may be the operator that forms them, with `users` and `hidden` still to be given: then seen pairs are left out
    where the scores are, and no table of all scored pairs is moved.
    """
    users = targets_of(split, mode).select("user").distinct()
    if callable(scores):
        return scores(users=users, hidden=seen_of(split, mode))
    return scores.join(users, "user", "left_semi").join(
        seen_of(split, mode), ["user", "item"], "left_anti"
    )


def comparable(score: Column | str, digits: int = 9) -> Column:
    """Score on a grid of `digits` decimals: what counts as equal when lists are ordered."""
    return F.rint((F.col(score) if isinstance(score, str) else score) * float(10**digits))


def topk(scores: DataFrame, k: int = K, by: tuple[str, ...] = ("user",)) -> DataFrame:
    """Best `k` rows per group by score, ties by item; `rank` starts at 1."""
    w = Window.partitionBy(*by).orderBy(comparable("score").desc(), F.col("item"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank.cast("double") + 1.0)


def ideal_gain(n: Column, k: int) -> Column:
    """Best reachable gain with `n` targets: a table of k running sums."""
    sums, total = [], 0.0
    for r in range(1, k + 1):
        total += 1.0 / math.log2(r + 1)
        sums.append(total)
    table = F.array(*[F.lit(s) for s in sums])
    return F.element_at(table, F.least(n, F.lit(k)).cast("int"))


def placed(targets: DataFrame, top: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """`targets` with the `rank` of the item in the list of its group, null without one.

    A list moves as one row, to its group's targets, and not as a row for each of its items. A null item is no target's.
    """
    lists = top.filter((F.col("rank") <= k) & F.col("item").isNotNull()).groupBy(*keys).agg(F.collect_list("item").alias("_items"), F.collect_list("rank").alias("_ranks"))
    joined = targets.join(unbounded(lists), keys, "left")
    found = F.filter("_ranks", lambda _, i: F.col("_items")[i] == F.col("item"))
    return joined.select("*", F.explode_outer(found).alias("rank")).drop("_items", "_ranks")


def ranking_metrics(
    top: DataFrame, targets: DataFrame, k: int = K, by: tuple[str, ...] = ("user",)
) -> DataFrame:
    """Recall, NDCG and hit per group; groups without a hit count 0.

    One full-outer-free pass: targets and lists meet in a left join that keeps every
    target, then a single aggregate per group.
    """
    keys = list(by)
    joined = placed(targets.select(*keys, "item"), top, k, keys)
    return (
        joined.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("rank").alias("hits"),
            F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0)).alias("dcg"),
        )
        .select(
            *keys,
            (F.col("hits") / F.col("n")).alias("recall"),
            (F.col("dcg") / ideal_gain(F.col("n"), k)).alias("ndcg"),
            (F.col("hits") > 0).cast("double").alias("hit"),
        )
    )


def list_quality(top: DataFrame, pop: DataFrame, heads: DataFrame, n_items: int, k: int = K) -> DataFrame:
    """One row: catalog coverage, mean train count and tail share over the filled slots."""
    slots = (
        top.filter(F.col("rank") <= k)
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("m"))
        .join(unbounded(pop), "item")
        .join(unbounded(heads.select("item", "is_head")), "item")
    )
    total = F.sum("m")
    return slots.agg(
        (F.count(F.lit(1)) / F.lit(n_items)).alias("coverage"),
        (F.sum(F.col("m") * F.col("pop")) / total).alias("avg_pop"),
        (F.sum(F.when(~F.col("is_head"), F.col("m")).otherwise(0)) / total).alias("long_tail_share"),
    )


def sliced_targets(targets: DataFrame, heads: DataFrame) -> DataFrame:
    """(slice, user, item): a target is in head or tail, and in cold when its item has no train row."""
    names = F.array_compact(
        F.array(
            F.when(F.col("is_head"), "head").otherwise("tail"), F.when(F.col("pop") == 0, "cold")
        )
    )
    return targets.join(unbounded(heads), "item").select(F.explode(names).alias("slice"), "user", "item")


def slice_metrics(top: DataFrame, targets: DataFrame, heads: DataFrame, k: int = K) -> DataFrame:
    """(slice, user, recall, ndcg, hit) over users with a target in the slice."""
    joined = placed(sliced_targets(targets, heads), top, k, ["user"])
    return (
        joined.groupBy("slice", "user")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("rank").alias("hits"),
            F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0)).alias("dcg"),
        )
        .select(
            "slice",
            "user",
            (F.col("hits") / F.col("n")).alias("recall"),
            (F.col("dcg") / ideal_gain(F.col("n"), k)).alias("ndcg"),
            (F.col("hits") > 0).cast("double").alias("hit"),
        )
    )


def per_user_table(top: DataFrame, targets: DataFrame, heads: DataFrame, k: int = K) -> DataFrame:
    """(user, recall, ndcg, hit, cold_recall, cold_ndcg); cold values are null without a cold target."""
    cold = slice_metrics(top, targets, heads, k).filter(F.col("slice") == "cold")
    cold = cold.select("user", F.col("recall").alias("cold_recall"), F.col("ndcg").alias("cold_ndcg"))
    return ranking_metrics(top, targets, k).join(cold, "user", "left")


def evaluate(
    top: DataFrame, targets: DataFrame, heads: DataFrame, n_items: int, k: int = K
) -> DataFrame:
    """(part, metric, value): overall metrics, list quality and slices in long form."""

    def long(df: DataFrame, part: str | Column, *metrics: str) -> DataFrame:
        part_col = F.lit(part) if isinstance(part, str) else part
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return df.select(part_col.alias("part"), F.explode(pairs).alias("p")).select(
            "part", "p.metric", "p.value"
        )

    means = [F.avg(m).alias(m) for m in ("recall", "ndcg", "hit")]
    n_users = F.count(F.lit(1)).alias("n_users")
    overall = ranking_metrics(top, targets, k).agg(*means, n_users)
    quality = list_quality(top, heads.select("item", "pop"), heads, n_items, k)
    slices = slice_metrics(top, targets, heads, k).groupBy("slice").agg(*means[:2], n_users)
    return (
        long(overall, "overall", "recall", "ndcg", "hit", "n_users")
        .unionByName(long(quality, "overall", "coverage", "avg_pop", "long_tail_share"))
        .unionByName(long(slices, F.col("slice"), "recall", "ndcg", "n_users"))
    )
