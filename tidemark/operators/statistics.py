"""Statistics of a split: sizes, density, popularity concentration, timestamp ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scale import cut, exact_quantiles


def dataset_stats(split: DataFrame, heads: DataFrame) -> DataFrame:
    """One row describing a split; `heads` is (item, pop, is_head) over all items."""
    pairs = split.select("part", "user", "item").distinct()
    per_user = pairs.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")],
    )
    users = per_user.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.sum("n").alias("n_pairs"),
        F.min("n").alias("min_per_user"),
        F.expr("percentile(n, 0.5)").alias("median_per_user"),
        F.max("n").alias("max_per_user"),
        *[F.sum(p).alias(f"n_{p}") for p in ("train", "val", "test")],
        F.count_if(F.col("val") > 0).alias("users_with_val"),
        F.count_if(F.col("test") > 0).alias("users_with_test"),
    )
    items = heads.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("is_head").alias("n_head_items"),
        F.count_if(~F.col("is_head")).alias("n_tail_items"),
        (F.sum(F.when(F.col("is_head"), F.col("pop"))) / F.sum("pop")).alias("head_share"),
        F.count_if(F.col("pop") == 0).alias("items_without_train"),
    )
    both = users.crossJoin(F.broadcast(items))  # one row each
    return both.withColumn("density", F.col("n_pairs") / (F.col("n_users") * F.col("n_items")))


def tie_stats(split: DataFrame) -> DataFrame:
    """One row: how often rows of a user share a time and how often a boundary falls in a tie."""
    stamps = split.groupBy("user", "ts").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")],
    )

    def seen(column: str, part: str):
        return F.when(F.col(part) > 0, F.col(column))

    tied = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    per_user = stamps.groupBy("user").agg(
        F.sum(tied).alias("tied"),
        F.sum("n").alias("rows"),
        F.max(seen("ts", "train")).alias("train_max"),
        F.min(seen("ts", "val")).alias("val_min"),
        F.max(seen("ts", "val")).alias("val_max"),
        F.min(seen("ts", "test")).alias("test_min"),
    )
    share = F.col("tied") / F.col("rows")
    tv = F.coalesce(F.col("train_max") == F.col("val_min"), F.lit(False))
    vt = F.coalesce(F.col("val_max") == F.col("test_min"), F.lit(False))
    users = cut(per_user.select("tied", "rows", share.alias("share"), tv.alias("tv"), vt.alias("vt")), "ties")
    median = exact_quantiles(users, [], "share", [0.5])
    rest = users.agg(
        (F.sum("tied") / F.sum("rows")).alias("share_tied"),
        F.avg("share").alias("user_share_mean"),
        F.avg((F.col("share") > 0).cast("double")).alias("users_with_tie_share"),
        F.count_if("tv").alias("train_val_boundary"),
        F.count_if("vt").alias("val_test_boundary"),
        F.count_if(F.col("tv") | F.col("vt")).alias("any_boundary"),
    )
    # one row each
    return rest.crossJoin(F.broadcast(median.select(F.col("q")[0].alias("user_share_median")))).select(
        "share_tied", "user_share_mean", "user_share_median", "users_with_tie_share", "train_val_boundary", "val_test_boundary", "any_boundary"
    )
