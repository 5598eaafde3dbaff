"""Run records: final runs, leaderboard, rater agreement, latency summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scale import exact_quantiles
from pyspark.sql.window import Window

# fixed value: order of the models in reports
MODEL_ORDER = ("popularity", "itemknn", "mf_bpr", "ncf_gmf", "ncf_mlp", "ncf_neumf", "two_tower", "sasrec", "lightgcn")


def select_final_runs(runs: DataFrame) -> DataFrame:
    """Per (dataset, model): runs of the configuration that finished last, newest run per seed.

    `runs`: dataset, model, config_hash, seed, finished_at and any metric columns.
    """
    model = Window.partitionBy("dataset", "model")
    config = Window.partitionBy("dataset", "model", "config_hash")
    newest = F.struct(F.max("finished_at").over(config), F.col("config_hash"))
    latest = (
        runs.withColumn("_c", newest)
        .withColumn("_m", F.max("_c").over(model))
        .filter(F.col("_c") == F.col("_m"))
    )
    per_seed = Window.partitionBy("dataset", "model", "seed").orderBy(F.col("finished_at").desc())
    return (
        latest.withColumn("_r", F.row_number().over(per_seed))
        .filter(F.col("_r") == 1)
        .drop("_c", "_m", "_r")
    )


def leaderboard(
    runs: DataFrame, metrics: Sequence[str], order: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """Mean and sample deviation of every metric per (dataset, model) over the final runs.

    `position` follows `order`, unknown models come last; tie-break datasets (`..._tb...`) are
    flagged so that a report can list them apart.
    """
    final = select_final_runs(runs)
    values = []
    for m in metrics:
        values += [
            F.avg(m).alias(f"{m}_mean"),
            F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"),
        ]
    known = F.array(*[F.lit(m) for m in order])
    place = F.array_position(known, F.col("model"))
    return (
        final.groupBy("dataset", "model")
        .agg(F.count(F.lit(1)).alias("n_seeds"), F.max("config_hash").alias("config_hash"), *values)
        .withColumn("position", F.when(place > 0, place - 1).otherwise(len(order)))
        .withColumn("is_variant", F.col("dataset").contains("_tb"))
    )


def cold_item_table(per_user: DataFrame) -> DataFrame:
    """(dataset, model, cold_ndcg, cold_recall, n_users) over users with a cold target."""
    return (
        per_user.filter(F.col("cold_ndcg").isNotNull())
        .groupBy("dataset", "model")
        .agg(
            F.avg("cold_ndcg").alias("cold_ndcg"),
            F.avg("cold_recall").alias("cold_recall"),
            F.countDistinct("user").alias("n_users"),
        )
    )


def rank_agreement(ratings: DataFrame, k: int = 3) -> DataFrame:
    """One row of agreement between raters `a` and `b` (integers 0..k-1).

    Exact agreement, kappa, quadratically weighted kappa, and how often each rater gives the top
    rating or at least 1. Works on the k * k table of counts.
    """
    rated = ratings.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    cells = rated.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # the expected part needs every (a, b) combination: at most k * k rows from the marginals
    marg_a = cells.groupBy("a").agg(F.sum("n").alias("na"))
    marg_b = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = marg_a.crossJoin(F.broadcast(marg_b))  # a row per rating value on either side
    grid = expected.join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = (F.col("a") - F.col("b")).cast("double")
    miss = (F.col("a") != F.col("b")).cast("double")
    square = gap * gap / float((k - 1) ** 2)
    exp = F.col("na").cast("double") * F.col("nb")
    top = k - 1
    return grid.agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(miss == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("exact_agreement"),
        (1.0 - F.sum(miss * F.col("n")) * F.sum("n") / F.sum(miss * exp)).alias("kappa"),
        (1.0 - F.sum(square * F.col("n")) * F.sum("n") / F.sum(square * exp)).alias("kappa_quadratic"),
        (F.sum(F.when(F.col("a") == top, F.col("n")).otherwise(0)) / F.sum("n")).alias("a_good"),
        (F.sum(F.when(F.col("b") == top, F.col("n")).otherwise(0)) / F.sum("n")).alias("b_good"),
        (F.sum(F.when(F.col("a") >= 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("a_partly"),
        (F.sum(F.when(F.col("b") >= 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("b_partly"),
    )


def latency_percentiles(log: DataFrame, approximate: bool = False) -> DataFrame:
    """(stage, n, p50, p95) of a timing log: stage, ms."""
    points = [0.5, 0.95]
    counts = log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    if approximate:
        quantiles = log.groupBy("stage").agg(F.percentile_approx("ms", points, 10_000).alias("q"))
    else:
        quantiles = exact_quantiles(log, ["stage"], "ms", points)
    return counts.join(quantiles, "stage", "left").select("stage", "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))
