"""Choosing the repository set: beginner, broad and cold groups, README as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import is_beginner_label, scrub_text


def _top(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col("repo_id")).limit(n)


def beginner_repos(
    activity: DataFrame,
    labels: DataFrame,
    issues: DataFrame,
    train_start: int,
    val_start: int,
    min_contrib: int = 10,
    max_candidates: int = 30_000,
    max_beginner: int = 6_000,
) -> DataFrame:
    """(repo_id, n_contrib, n_issues): most contributed repositories with a used newcomer label.

    `labels`: repo_id, is_fork, label. `issues`: repo_id, label, created (seconds).
    """
    candidates = _top(activity.filter(F.col("n_contrib") >= min_contrib), "n_contrib", max_candidates)
    wanted = labels.filter(is_beginner_label(F.col("label"))).select("repo_id", "label").distinct()
    used = (
        issues.filter((F.col("created") >= train_start) & (F.col("created") < val_start))
        .join(wanted, ["repo_id", "label"], "left_semi")
        .groupBy("repo_id")
        .agg(F.count(F.lit(1)).alias("n_issues"))
    )
    forks = labels.filter("is_fork").select("repo_id").distinct()
    kept = candidates.join(used, "repo_id").join(forks, "repo_id", "left_anti")
    return _top(kept.select("repo_id", "n_contrib", "n_issues"), "n_contrib", max_beginner)


def cold_repos(
    later: DataFrame, train: DataFrame, meta: DataFrame, val_start: int, min_actors: int = 20
) -> DataFrame:
    """(repo_id, n_actors): active in val or test only, newer than every train repository.

    `meta`: repo_id, is_fork, created (seconds).
    """
    newest = train.agg(F.max("repo_id")).scalar()
    fresh = meta.filter((F.col("created") >= val_start) & ~F.col("is_fork")).select("repo_id")
    return (
        later.filter((F.col("n_actors") >= min_actors) & (F.col("repo_id") > newest))
        .join(train.select("repo_id").distinct(), "repo_id", "left_anti")
        .join(fresh.distinct(), "repo_id", "left_semi")
        .select("repo_id", "n_actors")
    )


def repo_set(
    beginner: DataFrame,
    broad: DataFrame,
    cold: DataFrame,
    max_broad: int = 3_000,
    max_cold: int = 500,
) -> DataFrame:
    """(repo_id, group): each repository once, beginner before broad before cold."""
    first = beginner.select("repo_id", F.lit(0).alias("p"))
    rest = broad.join(beginner.select("repo_id"), "repo_id", "left_anti")
    second = _top(rest, "n_shared", max_broad).select("repo_id", F.lit(1).alias("p"))
    third = _top(cold, "n_actors", max_cold).select("repo_id", F.lit(2).alias("p"))
    names = F.array(F.lit("beginner"), F.lit("broad"), F.lit("cold"))
    return (
        first.unionByName(second)
        .unionByName(third)
        .groupBy("repo_id")
        .agg(F.min("p").alias("p"))
        .select("repo_id", F.element_at(names, F.col("p") + 1).alias("group"))
    )


def text_as_of(commits: DataFrame, cutoff: Column | int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(repo_id, committed, text): the last commit before one cutoff for all repositories.

    `commits`: repo_id, ts, text. Equal times are ordered by text.
    """
    limit = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return (
        commits.filter(F.col("ts") < limit)
        .groupBy("repo_id", *extra)
        .agg(F.max(F.struct("ts", "text")).alias("last"))
        .select("repo_id", *extra, F.col("last.ts").alias("committed"), F.col("last.text").alias("text"))
    )


def text_as_of_each(
    commits: DataFrame, cutoffs: DataFrame, bucket_seconds: int = 86_400
) -> DataFrame:
    """As-of join: for every (repo_id, cutoff) row the last commit before its own cutoff.

    Commits and cutoffs form one stream, cut into time buckets per repository. Inside a bucket the
    last commit seen so far is carried forward; a bucket starts from the last commit of the
    buckets before it. No pair of commit and cutoff is formed and no repository is sorted as a
    whole.
    """
    bucket = F.floor(F.col("ts") / bucket_seconds)
    dated = commits.select("repo_id", "ts", "text").withColumn("bucket", bucket)
    asked = (
        cutoffs.select("repo_id", F.col("cutoff").alias("ts")).distinct().withColumn("bucket", bucket)
    )
    closing = dated.groupBy("repo_id", "bucket").agg(F.max(F.struct("ts", "text")).alias("closing"))
    marks = closing.unionByName(
        asked.select("repo_id", "bucket").distinct(), allowMissingColumns=True
    )
    marks = marks.groupBy("repo_id", "bucket").agg(F.max("closing").alias("closing"))
    w = Window.partitionBy("repo_id").orderBy("bucket")
    opening = marks.select(
        "repo_id",
        "bucket",
        F.last("closing", ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, -1))
        .alias("opening"),
    )
    stream = dated.select(
        "repo_id", "bucket", "ts", F.lit(1).alias("side"), F.struct("ts", "text").alias("commit")
    ).unionByName(
        asked.select("repo_id", "bucket", "ts", F.lit(0).alias("side")), allowMissingColumns=True
    )
    # a cutoff sorts before commits of the same second: only earlier commits count
    w = Window.partitionBy("repo_id", "bucket").orderBy("ts", "side", F.col("commit.text"))
    inside = F.last("commit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        stream.withColumn("inside", inside)
        .filter(F.col("side") == 0)
        .join(opening, ["repo_id", "bucket"])
        .withColumn("last", F.coalesce("inside", "opening"))
        .filter(F.col("last").isNotNull())
        .select(
            "repo_id",
            F.col("ts").alias("cutoff"),
            F.col("last.ts").alias("committed"),
            F.col("last.text").alias("text"),
        )
    )


def catalog(
    details: DataFrame, activity: DataFrame, groups: DataFrame, trained: DataFrame
) -> DataFrame:
    """One row per repository that is not archived, with summed activity, group and scrubbed text.

    `activity` may hold several windows per repository; `trained` lists repositories of the split.
    """
    sums = activity.groupBy("repo_id").agg(
        *[F.sum(c).alias(c) for c in ("n_contrib", "n_pr", "n_actors")]
    )
    zero = F.lit(0)
    return (
        details.filter(~F.col("is_archived"))
        .join(sums, "repo_id", "left")
        .join(groups.select("repo_id", "group"), "repo_id", "left")
        .join(
            trained.select("repo_id").distinct().withColumn("trained", F.lit(True)), "repo_id", "left"
        )
        .select(
            "repo_id",
            "name",
            scrub_text(F.col("description"), 300).alias("description"),
            "language",
            "group",
            F.coalesce("trained", F.lit(False)).alias("trained"),
            F.coalesce("n_contrib", zero).alias("n_contrib"),
            F.coalesce("n_pr", zero).alias("n_pr"),
            F.coalesce("n_actors", zero).alias("n_actors"),
        )
    )
