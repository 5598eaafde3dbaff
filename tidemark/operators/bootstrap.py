"""Paired bootstrap over users, seed averages and activity groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.scale import HOT_ROWS, cut, ordinal

PRIME = 2_147_483_647
BLOCK_USERS = 1 << 20  # users whose draws are counted in one task
CELLS = 1 << 20  # draw counts held at once
PIECE = 1 << 16  # values of a series in one row


def mixed(seed: int, b: np.ndarray, slot: np.ndarray, block: int = 0) -> np.ndarray:
    """Pseudo-random integers below PRIME from (seed, resample, slot), plain 64-bit arithmetic."""
    x0 = (b * 1_000_003 + slot * 7_919 + (seed * 15_485_863 + block * 104_729 + 12_345)) % PRIME
    x1 = (x0 * x0 + 1_013_904_223) % PRIME
    x2 = (x1 * x1 + x0 * 48_271 + 69_069) % PRIME
    return (x2 * x2 + x1) % PRIME


def _steps(first: int, last: int, width: int) -> Iterator[np.ndarray]:
    """Resample numbers in columns, as many at once as CELLS allows for `width` draws each."""
    step = max(1, CELLS // max(1, width))
    for a in range(first, last, step):
        yield np.arange(a, min(a + step, last), dtype=np.int64)[:, None]


def _sizes_of_blocks(slots: DataFrame, keys: list[str], n_resamples: int, seed: int, block: int) -> DataFrame:
    """(keys..., block, draws): how many draws of each resample fall into each block of a large group.

    A draw is a slot of the group; what is exchanged is one array per block and block of slots.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        n, slot = int(group["n"].iloc[0]), group["slot"].to_numpy(np.int64)
        n_blocks = -(-n // block)
        total = np.zeros((n_resamples, n_blocks), np.int64)
        for b in _steps(0, n_resamples, len(slot)):
            to = mixed(seed, b, slot[None, :]) % n // block
            total[b[:, 0]] += np.bincount((to + (b - b[0]) * n_blocks).ravel(), minlength=len(b) * n_blocks).reshape(len(b), n_blocks)
        out = pd.DataFrame({"block": np.arange(n_blocks), "draws": list(total.T)})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slots.select(*keys).schema.fields)
    large = slots.filter(F.col("n") > block).select(*keys, "n", "slot", F.floor(F.col("slot") / block).alias("from"))
    found = large.groupBy(*keys, "from").applyInPandas(count, f"block long, draws array<long>, {kinds}")
    each = found.select(*keys, "block", F.posexplode("draws").alias("b", "draws"))
    summed = each.groupBy(*keys, "block", "b").agg(F.sum("draws").alias("draws"))
    # one array of resamples for each block of users
    return summed.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "draws"))), lambda x: x["draws"]).alias("draws"))


def resample_means(
    values: DataFrame,
    by: Sequence[str] = (),
    n_resamples: int = 1_000,
    seed: int = 0,
    block: int = BLOCK_USERS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(by..., series, b, mean): means of resamples of users with replacement.

    `values`: by..., series, user, value. All series of a group are drawn with the same user indices.
    The users of a group are numbered and cut into blocks of `block`. A task holds the values of a block
    as a (users x series) matrix and the draw counts of some resamples as a (resamples x users) matrix,
    which it forms itself; their product is all that leaves it. A group of one block has as many draws
    as users. In a larger one the draws of all users are dealt to the blocks first.
    """
    by = list(by)
    keys = by or ["_g"]
    values = values.select(*by, "series", "user", "value")
    values = cut(values if by else values.withColumn("_g", F.lit(0)), "values")
    users = values.select(*keys, "user").distinct()
    sizes = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    slots = ordinal(users, keys, [F.col("user")], "slot", F.col("user"), hot_rows).join(sizes, keys)
    slots = cut(slots, "slots")
    placed = values.join(slots, [*keys, "user"]).select(
        *keys, F.floor(F.col("slot") / block).alias("block"), (F.col("slot") % block).cast("int").alias("slot"), "n", "series", F.col("value").cast("double").alias("value")
    )
    # a task holds arrays of numbers, not a row of objects for each value
    entry = F.collect_list(F.struct("slot", "value")).alias("e")
    placed = placed.groupBy(*keys, "block", "n", "series", F.floor(F.col("slot") / PIECE).alias("piece")).agg(entry)
    placed = placed.select(*keys, "block", "n", "series", F.col("e")["slot"].alias("slot"), F.col("e")["value"].alias("value"))
    spread = sizes.agg(F.sum(F.ceil(F.col("n") / block)), F.max("n")).head()
    if not spread[0]:
        return values.select(*by, "series", F.lit(0).alias("b"), F.col("value").cast("double").alias("mean"))
    parallel = values.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, min(n_resamples, -(-2 * parallel // spread[0])))
    edges = [n_resamples * c // chunks for c in range(chunks + 1)]
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    several = spread[1] > block
    if several:
        draws = _sizes_of_blocks(slots, keys, n_resamples, seed, block)
        placed = placed.join(draws, [*keys, "block"], "left")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        first, last = edges[int(group["chunk"].iloc[0])], edges[int(group["chunk"].iloc[0]) + 1]
        at, n = int(group["block"].iloc[0]), int(group["n"].iloc[0])
        m = min(block, n - at * block)
        codes, names = pd.factorize(group["series"], sort=True)
        table, held = np.zeros((m, len(names))), np.zeros((m, len(names)), bool)
        for code, slot, value in zip(codes, group["slot"], group["value"], strict=True):
            value = np.asarray(value, float)
            known = ~np.isnan(value)
            table[np.asarray(slot)[known], code] = value[known]
            held[np.asarray(slot)[known], code] = True
        whole = held.all(axis=0)  # a series of all users needs no product to know how many of its values are drawn
        held = held[:, ~whole].astype(float)
        # a group of one block has no row of draws
        dealt = group["draws"].iloc[0] if several else None
        sums, times = np.zeros((last - first, len(names))), np.zeros((last - first, len(names)))
        most = m if dealt is None else int(np.max(dealt))
        for b in _steps(first, last, max(m, most)):
            to = mixed(seed, b, np.arange(most, dtype=np.int64)[None, :], at) % m
            to += (b - b[0]) * m
            if dealt is not None:
                to = to[np.arange(most)[None, :] < np.asarray(dealt)[b]]
            counts = np.bincount(to.ravel(), minlength=len(b) * m).reshape(len(b), m).astype(float)
            sums[b[:, 0] - first] = counts @ table
            times[b[:, 0] - first] = counts.sum(axis=1)[:, None]
            if not whole.all():
                times[np.ix_(b[:, 0] - first, ~whole)] = counts @ held
        out = pd.DataFrame(
            {
                "series": np.tile(names, last - first),
                "b": np.repeat(np.arange(first, last, dtype=np.int32), len(names)),
                "total": sums.ravel(),
                "times": times.ravel(),
            }
        )
        for k in keys:
            out[k] = group[k].iloc[0]
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keys, "series").schema.fields)
    found = placed.groupBy(*keys, "block", "chunk").applyInPandas(product, f"{kinds}, b int, total double, times double")
    mean = F.try_divide(F.sum("total"), F.sum("times")).alias("mean")
    return found.groupBy(*by, "series", "b").agg(mean).filter("mean is not null")


def series_means(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return values.groupBy(*by, "series").agg(
        F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_users")
    )


def paired_intervals(
    values: DataFrame,
    pairs: DataFrame,
    by: Sequence[str] = (),
    n_resamples: int = 1_000,
    ci: float = 0.95,
    seed: int = 0,
    **limits: int,
) -> DataFrame:
    """(by..., a, b, diff, ci_low, ci_high, p_not_positive, n_users) for pairs of series.

    `pairs`: by..., a, b. Every series of a group must cover the same users. The mean of the
    differences is the difference of the means, so each series is resampled once however many
    pairs it takes part in.
    """
    by = list(by)
    means = cut(resample_means(values, by, n_resamples, seed, **limits), "means")
    left = means.select(*by, F.col("series").alias("a"), F.col("b").alias("r"), F.col("mean").alias("ma"))
    right = means.select(*by, F.col("series").alias("b"), F.col("b").alias("r"), F.col("mean").alias("mb"))
    alpha = (1.0 - ci) / 2.0
    delta = F.round(F.col("ma") - F.col("mb"), 12)
    spread = (
        pairs.select(*by, "a", "b")
        .join(left, [*by, "a"])
        .join(right, [*by, "b", "r"])
        .groupBy(*by, "a", "b")
        .agg(
            F.percentile(delta, [alpha, 1.0 - alpha]).alias("q"),
            F.avg((delta <= 0).cast("double")).alias("p_not_positive"),
        )
    )
    base = series_means(values, by)
    base_a = base.select(*by, F.col("series").alias("a"), F.col("mean").alias("_a"), "n_users")
    base_b = base.select(*by, F.col("series").alias("b"), F.col("mean").alias("_b"))
    return (
        spread.join(base_a, [*by, "a"])
        .join(base_b, [*by, "b"])
        .select(
            *by,
            "a",
            "b",
            F.round(F.col("_a") - F.col("_b"), 12).alias("diff"),
            F.col("q")[0].alias("ci_low"),
            F.col("q")[1].alias("ci_high"),
            "p_not_positive",
            "n_users",
        )
    )


def seed_average(runs: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """(by..., series, user, value): metric averaged over the seeds of a model.

    `runs`: by..., series, seed, user, value. Raises when the seeds of a model cover different
    users: every user must then have as many rows as the model has seeds.
    """
    keys = [*by, "series"]
    per_user = runs.groupBy(*keys, "user").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_seeds")
    )
    counts = per_user.groupBy(*keys).agg(
        F.min("n_seeds").alias("lo"), F.max("n_seeds").alias("hi")
    )
    uneven = counts.filter(F.col("lo") < F.col("hi")).select("series").limit(1).collect()
    if uneven:
        raise ValueError(f"runs of {uneven[0]['series']} cover different users")
    return per_user.drop("n_seeds")


def ranked_pairs(values: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """(by..., a, b, adjacent): all pairs of models of a group, `a` with the higher mean.

    Works on one row per model, so the self join is as small as the list of models.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.col("mean").desc(), F.col("series"))
    ranked = series_means(values, by).withColumn("rank", F.row_number().over(w))
    a = ranked.select(*by, F.col("series").alias("a"), F.col("rank").alias("ra"))
    b = ranked.select(*by, F.col("series").alias("b"), F.col("rank").alias("rb"))
    pairs = a.join(b, by).filter(F.col("ra") < F.col("rb"))
    return pairs.select(*by, "a", "b", (F.col("rb") == F.col("ra") + 1).alias("adjacent"))


def pairwise_cis(
    values: DataFrame, by: Sequence[str] = ("dataset",), n_resamples: int = 1_000, ci: float = 0.95, seed: int = 0
) -> DataFrame:
    """Intervals for every pair of models, with flags for neighbours in the ranking and for
    intervals that leave out 0."""
    pairs = ranked_pairs(values, by)
    out = paired_intervals(values, pairs, by, n_resamples, ci, seed)
    return out.join(pairs, [*by, "a", "b"]).withColumn(
        "excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    )


def activity_groups(lengths: DataFrame, n_groups: int = 4) -> DataFrame:
    """(user, n, group, label): groups by quantiles of `n`; label = smallest-largest member."""
    inner = [i / n_groups for i in range(1, n_groups)]
    edges = lengths.agg(F.percentile("n", inner)).scalar()
    grouped = lengths.withColumn("_edges", edges).withColumn(
        "group", F.size(F.filter("_edges", lambda e: F.col("n") >= e))
    )
    labels = grouped.groupBy("group").agg(
        F.concat_ws("-", F.min("n").cast("long"), F.max("n").cast("long")).alias("label")
    )
    return grouped.drop("_edges").join(F.broadcast(labels), "group").select("user", "n", "group", "label")


def group_table(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(series, group, label, n_users, mean): mean metric per model and activity group."""
    return (
        values.join(groups, "user")
        .groupBy("series", "group", "label")
        .agg(F.count(F.lit(1)).alias("n_users"), F.avg("value").alias("mean"))
    )


def group_cis(
    values: DataFrame, groups: DataFrame, pairs: DataFrame, n_resamples: int = 1_000, ci: float = 0.95, seed: int = 0
) -> DataFrame:
    """Intervals of `pairs` (a, b) inside every activity group."""
    grouped = values.join(groups.select("user", "group"), "user")
    kinds = groups.select("group").distinct()
    # the list of pairs is as short as the list of models; the groups are a handful
    each = pairs.crossJoin(F.broadcast(kinds))
    return paired_intervals(grouped, each, ["group"], n_resamples, ci, seed)
