"""Ratings to implicit interactions: thresholds, cores, contiguous ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scale import cut, global_index, unbounded

FEW_KEYS = 200_000  # key lists up to this size are broadcast


def first_rating(ratings: DataFrame) -> DataFrame:
    """One rating per (user, item): the earliest, the higher one on equal times."""
    first = F.min(F.struct("ts", (-F.col("rating")).alias("neg"))).alias("f")
    return (
        ratings.groupBy("user", "item")
        .agg(first)
        .select("user", "item", (-F.col("f.neg")).alias("rating"), F.col("f.ts").alias("ts"))
    )


def to_implicit(ratings: DataFrame, threshold: float = 4) -> DataFrame:
    """Keep ratings at or above the threshold as positive pairs."""
    return ratings.filter(F.col("rating") >= threshold).select("user", "item", "ts")


def _listed(rows: DataFrame, keys: dict[str, DataFrame], few: bool) -> DataFrame:
    """`rows` with `round`: the first round that listed one of the row's keys, null if none did.

    `keys`: by column, key and round. `few`: the lists are short enough to be broadcast.
    """
    for column, listed in keys.items():
        listed = listed.withColumnRenamed("round", f"_{column}")
        rows = rows.join(F.broadcast(listed) if few else unbounded(listed), column, "left")
    marks = [f"_{c}" for c in keys]
    return rows.withColumn("round", F.least(*marks)).drop(*marks)


def k_core(df: DataFrame, k: int = 5) -> DataFrame:
    """Drop rows of users or items with fewer than `k` rows until every count is at least `k`.

    Both counts of a pass are taken before the pass drops anything. All rows are counted once; a later pass
    counts only what the pass before dropped and takes it off. Rows are marked by the lists of *rare* keys,
    which by definition have few rows each, so a frequent key never meets a match. Rows are written again
    to the shared folder only when a quarter of them are gone or the lists are long; until then a pass reads them and moves
    nothing but the keys and rows it drops.
    """
    columns = ("user", "item")
    one = F.count(F.lit(1))
    rows = cut(df, "core")
    n_rows, n_gone, r = rows.count(), 0, 0
    # a row without a key is never dropped for that key
    counts = {c: cut(rows.filter(F.col(c).isNotNull()).groupBy(c).agg(one.alias("n")), f"{c}-counts") for c in columns}
    listed: dict[str, DataFrame] = {}
    while True:
        rare = {c: cut(d.filter(F.col("n") < k).select(c, F.lit(r).alias("round")), f"rare-{c}") for c, d in counts.items()}
        if not sum(d.count() for d in rare.values()):
            return rows if not listed else cut(_listed(rows, listed, True).filter("round is null").select(*df.columns), "core")
        listed = {c: listed[c].unionByName(d) if listed else d for c, d in rare.items()}
        few = sum(d.count() for d in listed.values()) <= FEW_KEYS
        marked = _listed(rows, listed, few)
        dropped = cut(marked.filter(F.col("round") == r).select(*columns), "dropped")
        n_gone += dropped.count()
        for c in columns:
            off = dropped.groupBy(c).agg(one.alias("off"))
            left = counts[c].join(unbounded(off), c, "left").select(c, (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"))
            counts[c] = cut(left.filter("n > 0"), f"{c}-counts")
        if 4 * n_gone > n_rows or not few:
            rows = cut(marked.filter("round is null").select(*df.columns), "core")
            n_rows, n_gone, listed = n_rows - n_gone, 0, {}
        r += 1


def id_map(df: DataFrame, column: str) -> DataFrame:
    """(raw_id, <column>): contiguous ids from 0 in raw id order."""
    distinct = df.select(F.col(column).alias("raw_id")).distinct()
    return global_index(distinct, [F.col("raw_id")], column)[0]


def remap_ids(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(df with contiguous user and item ids, user map, item map)."""
    users, items = id_map(df, "user"), id_map(df, "item")
    out = (
        df.withColumnsRenamed({"user": "_u", "item": "_i"})
        .join(users.withColumnRenamed("raw_id", "_u"), "_u")
        .join(items.withColumnRenamed("raw_id", "_i"), "_i")
        .drop("_u", "_i")
    )
    return out.select(*df.columns), users, items


def remap_split(split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`remap_ids` over the parts of a split together; `part` and the rest stay."""
    return remap_ids(split)


def drop_heavy_users(df: DataFrame, max_items: int, val_start: int) -> DataFrame:
    """Remove users with more than `max_items` rows before `val_start`, everywhere."""
    heavy = (
        df.filter(F.col("ts") < val_start)
        .groupBy("user")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > max_items)
    )
    return df.join(heavy.select("user"), "user", "left_anti").select(*df.columns)
