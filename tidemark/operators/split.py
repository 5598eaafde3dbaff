"""Chronological order and train / val / test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.interactions import k_core
from tidemark.scale import HOT_ROWS, cut, ordinal, unbounded

PARTS = ("train", "val", "test")


def hash_key(seed: int, *columns: str) -> Column:
    """Text hash that orders rows at random but the same way for one seed."""
    return F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def chronological_order(df: DataFrame, seed: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `seq`: position in the user's history by time, ties in a seeded random order."""
    tied = df.withColumn("_tie", hash_key(seed, "user", "ts", "item"))
    # time followed by the leading 16 bits of the tie hash: grows along the order
    key = F.col("ts") * 65536 + F.conv(F.substring("_tie", 1, 4), 16, 10).cast("long")
    order = [F.col("ts"), F.col("_tie"), F.col("item")]
    return ordinal(tied, ["user"], order, "seq", key, hot_rows).drop("_tie")


def split_sizes(n: Column, val: float = 0.1, test: float = 0.1) -> tuple[Column, Column, Column]:
    """(n_train, n_val, n_test) for a history of `n` rows; short ones fill train, test, val."""

    def share(ratio: float) -> Column:
        return F.greatest(F.lit(1), F.floor(n * F.lit(ratio) + 0.5)).cast("long")

    short = n < 3
    one = F.least(n, F.lit(1)).cast("long")
    n_train = F.when(short, one).otherwise(n - share(test) - share(val))
    n_test = F.when(short, F.least(n - one, F.lit(1))).otherwise(share(test))
    n_val = F.when(short, n - one - F.least(n - one, F.lit(1))).otherwise(share(val))
    return n_train.cast("long"), n_val.cast("long"), n_test.cast("long")


def chronological_split(
    df: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `seq` and `part`: oldest rows to train, then val, newest to test."""
    n_train, n_val, _ = split_sizes(F.col("n"), val, test)
    sizes = df.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("user", n_train.alias("_tr"), n_val.alias("_va"))
    part = (
        F.when(F.col("seq") < F.col("_tr"), "train")
        .when(F.col("seq") < F.col("_tr") + F.col("_va"), "val")
        .otherwise("test")
    )
    ordered = chronological_order(df, seed, hot_rows).join(unbounded(sizes), "user")
    return ordered.withColumn("part", part).select(*df.columns, "seq", "part")


def short_users(df: DataFrame) -> DataFrame:
    """Number of users with too few rows for all three parts."""
    sizes = df.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") < 3).alias("n_short_users"))


def sample_users(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """`n` distinct users, uniform without replacement, the same ones for one seed."""
    users = df.select("user").distinct()
    return users.orderBy(hash_key(seed, "user"), "user").limit(n)


def global_temporal_split(
    df: DataFrame,
    val_start: int,
    test_start: int,
    k: int = 5,
    cold_items: DataFrame | None = None,
    max_users: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """One cutoff pair for everyone; the core is taken on train rows only.

    Val and test keep core users, items of the core or of `cold_items`, and no pair that is in
    train. With `max_users` a sample of the core users is kept and the core is taken again.
    """
    part = (
        F.when(F.col("ts") < val_start, "train").when(F.col("ts") < test_start, "val").otherwise("test")
    )
    dated = cut(df.withColumn("part", part), "dated")
    train = k_core(dated.filter(F.col("part") == "train"), k)
    if max_users is not None and train.select("user").distinct().count() > max_users:
        train = k_core(train.join(sample_users(train, max_users, seed), "user", "left_semi"), k)
    items = train.select("item")
    if cold_items is not None:
        items = items.unionByName(cold_items.select("item"))
    later = (
        dated.filter(F.col("part") != "train")
        .join(train.select("user").distinct(), "user", "left_semi")
        .join(items.distinct(), "item", "left_semi")
        .join(train.select("user", "item"), ["user", "item"], "left_anti")
    )
    return train.unionByName(later.select(*train.columns))


def ordered_histories(df: DataFrame, piece: int = 10_000) -> DataFrame:
    """(user, piece, items): item arrays in `seq` order.

    An ordinary history is one row; a longer one continues in rows piece = 1, 2, ... so that no
    array grows without bound.
    """
    tagged = df.withColumn("piece", F.floor(F.col("seq") / piece))
    rows = F.array_sort(F.collect_list(F.struct("seq", "item")))
    return (
        tagged.groupBy("user", "piece")
        .agg(rows.alias("r"))
        .select("user", "piece", F.transform("r", lambda x: x["item"]).alias("items"))
    )


def recent_history(df: DataFrame, length: int) -> DataFrame:
    """(user, items): the last `length` items in `seq` order."""
    w = Window.partitionBy("user").orderBy(F.col("seq").desc())
    last = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= length)
    rows = F.array_sort(F.collect_list(F.struct("seq", "item")))
    return (
        last.groupBy("user")
        .agg(rows.alias("r"))
        .select("user", F.transform("r", lambda x: x["item"]).alias("items"))
    )
