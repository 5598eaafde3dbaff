"""Event tables partitioned by day or month: idempotent appends and pruned range reads."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.privacy import anonymise
from tidemark.operators.eventlog import day_events
from tidemark.scale import cut

DAY_SCHEMA = "kind STRING, user STRING, repo_id BIGINT, first_us BIGINT, n BIGINT, day DATE"


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The day table, empty when nothing was published yet."""
    try:
        return spark.read.schema(DAY_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DAY_SCHEMA)


def _log(path: str) -> str:
    """Table of the days that were ingested, with those that had no events."""
    return path.rstrip("/") + ".published"


def published_days(spark: SparkSession, path: str) -> set[str]:
    """Days that have a published folder or were found empty; a run that died left neither, so it is redone."""
    days = read_days(spark, path).select(F.col("day").cast("string").alias("day"))
    try:
        days = days.union(spark.read.schema("day STRING").parquet(_log(path)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return {r["day"] for r in days.distinct().collect()}


def created_within(start: str, end: str) -> Column:
    """`created_us` in the days [start, end): a plain range that is pushed down to the files."""
    micros = [86_400_000_000 * (date.fromisoformat(d) - date(1970, 1, 1)).days for d in (start, end)]
    return (F.col("created_us") >= micros[0]) & (F.col("created_us") < micros[1])


def day_range(start: str, end: str) -> list[str]:
    """Days of [start, end)."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [str(first + timedelta(days=i)) for i in range((last - first).days)]


def missing_days(spark: SparkSession, path: str, start: str, end: str) -> list[str]:
    done = published_days(spark, path)
    return [d for d in day_range(start, end) if d not in done]


def publish_days(rows: DataFrame, path: str) -> None:
    """Write whole days: each day's folder is replaced as a whole, other days stay."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def ingest_days(
    raw: DataFrame, repos: DataFrame, path: str, start: str, end: str, salt: bytes
) -> list[str]:
    """Publish the days of [start, end) that are not there yet; returns them.

    `raw`: type, actor_id, login, repo_id, repo_name, created_us. Days are cut out of the raw log
    by time, folded per type, actor and repository, anonymised and written by day.
    """
    spark = raw.sparkSession
    todo = missing_days(spark, path, start, end)
    if not todo:
        return []
    day = F.to_date(F.timestamp_micros("created_us"))
    after_last = str(date.fromisoformat(todo[-1]) + timedelta(days=1))
    wanted = raw.filter(created_within(todo[0], after_last)).filter(day.isin([date.fromisoformat(d) for d in todo]))
    folded = day_events(wanted, repos).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    folded = cut(folded, "folded")  # read by the checks of the anonymised rows as well
    hashed = anonymise(folded.drop("repo_name"), salt)
    publish_days(hashed.select("kind", "user", "repo_id", "first_us", "n", "day"), path)
    spark.createDataFrame([(d,) for d in todo], "day STRING").coalesce(1).write.mode("append").parquet(_log(path))
    return todo


def write_months(events: DataFrame, path: str) -> None:
    """Event table partitioned by yyyymm (UTC) of `created_us`."""
    month = F.date_format(F.timestamp_micros("created_us"), "yyyyMM").cast("int")
    events.withColumn("yyyymm", month).write.mode("overwrite").partitionBy("yyyymm").parquet(path)


def read_month_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Months [start, end] as yyyymm; only their folders are listed and read."""
    return spark.read.parquet(path).filter(F.col("yyyymm").between(start, end))
