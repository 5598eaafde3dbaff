"""Item popularity, head items and the most-popular recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.scale import count_up, global_index, unbounded

HEAD_PREFIX = 2_000  # ranks held in a broadcast table; deeper ranks are joined by shuffle


def item_popularity(train: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item, pop): distinct users per item; items of `items` without train rows count 0."""
    pop = (
        train.select("user", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("pop"))
    )
    if items is None:
        return pop
    return (
        items.select("item").distinct().join(unbounded(pop), "item", "left").select("item", F.coalesce("pop", F.lit(0)).alias("pop"))
    )


def ranked_items(pop: DataFrame) -> tuple[DataFrame, int]:
    """((item, pop, rank) with rank 0 = most popular, ties by item; number of items)."""
    return global_index(pop, [F.col("pop").desc(), F.col("item")], "rank")


def head_items(pop: DataFrame, fraction: float = 0.2) -> DataFrame:
    """(item, pop, is_head): head = the top ceil(fraction * items)."""
    ranked, n = ranked_items(pop)
    n_head = -(-int(round(fraction * n * 1_000_000)) // 1_000_000)
    return ranked.select("item", "pop", (F.col("rank") < n_head).alias("is_head"))


def popularity_topk(users: DataFrame, seen: DataFrame, ranked: DataFrame, k: int = 20) -> DataFrame:
    """(user, item, score, rank): the `k` most popular items a user has not seen.

    A user with s seen items finds them among the first k + s ranks, so each user is matched with
    that prefix only and the whole job is linear in users * k + seen rows. The first ranks, which
    every user needs, come from a broadcast table of HEAD_PREFIX rows; deeper ranks are joined by
    shuffle.
    """
    seen = seen.select("user", "item").distinct()
    need = (
        users.select("user")
        .distinct()
        .join(seen.groupBy("user").agg(F.count(F.lit(1)).alias("s")), "user", "left")
        .select("user", (F.coalesce("s", F.lit(0)) + k).alias("need"))
    )
    slots = count_up(need, "need", "rank").select("user", "rank")
    head = F.broadcast(ranked.filter(F.col("rank") < HEAD_PREFIX))
    tail = ranked.filter(F.col("rank") >= HEAD_PREFIX)
    found = slots.filter(F.col("rank") < HEAD_PREFIX).join(head, "rank").unionByName(
        slots.filter(F.col("rank") >= HEAD_PREFIX).join(tail, "rank")
    )
    unseen = found.join(unbounded(seen), ["user", "item"], "left_anti")
    w = Window.partitionBy("user").orderBy("rank")
    return (
        unseen.withColumn("slot", F.row_number().over(w))
        .filter(F.col("slot") <= k)
        .select("user", "item", F.col("pop").cast("double").alias("score"), F.col("slot").alias("rank"))
    )


def warm_items(train: DataFrame) -> DataFrame:
    """(item): items with at least one train pair."""
    return train.select("item").distinct()
