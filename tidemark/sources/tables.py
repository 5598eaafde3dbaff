"""Rating files, JSON-lines scans, split tables, exports and reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.interactions import first_rating
from tidemark.operators.split import PARTS
from tidemark.scale import ordinal

# fixed value: column names and types of an exported interaction file
EXPORT_HEADER = ("user_id:token", "item_id:token", "timestamp:float")


def read_ratings_dat(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """Rating file without a header: user, item, rating, ts separated by `sep`."""
    schema = "user BIGINT, item BIGINT, rating BIGINT, ts BIGINT"
    return spark.read.schema(schema).csv(path, sep=sep, mode="FAILFAST")


def day_start(date: str) -> int:
    return int(datetime.fromisoformat(date).replace(tzinfo=UTC).timestamp())


def read_ratings_csv(
    spark: SparkSession,
    path: str,
    min_date: str | None = None,
    user: str = "user_id",
    item: str = "parent_asin",
) -> DataFrame:
    """Ratings with a header and millisecond times: seconds, first rating per pair, from `min_date`."""
    raw = spark.read.schema(f"{user} STRING, {item} STRING, rating DOUBLE, timestamp BIGINT").csv(
        path, header=True, mode="FAILFAST", enforceSchema=False
    )
    return clean_ratings(
        raw.select(F.col(user).alias("user"), F.col(item).alias("item"), "rating", "timestamp"), min_date
    )


def clean_ratings(raw: DataFrame, min_date: str | None = None) -> DataFrame:
    """user, item, rating, ts from millisecond rows."""
    df = raw.withColumn("ts", F.floor(F.col("timestamp") / 1000)).drop("timestamp")
    if min_date is not None:
        df = df.filter(F.col("ts") >= day_start(min_date))
    return first_rating(df)


def scan_jsonl(spark: SparkSession, path: str, schema: str, keep: DataFrame, key: str) -> DataFrame:
    """Records whose `key` is in `keep` (column raw_id). Any corrupt line fails the whole scan."""
    records = spark.read.schema(schema).json(path, mode="FAILFAST")
    wanted = keep.select(F.col("raw_id").alias(key)).distinct()
    return records.join(wanted, key, "left_semi")


def write_split(split: DataFrame, users: DataFrame, items: DataFrame, path: str) -> None:
    """Parts as a table partitioned by `part`, and the id maps."""
    split.write.mode("overwrite").partitionBy("part").parquet(f"{path}/interactions")
    users.write.mode("overwrite").parquet(f"{path}/user_map")
    items.write.mode("overwrite").parquet(f"{path}/item_map")


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split, user map, item map); a filter on `part` reads only its folder."""
    return (
        spark.read.parquet(f"{path}/interactions"),
        spark.read.parquet(f"{path}/user_map"),
        spark.read.parquet(f"{path}/item_map"),
    )


def atomic_rows(split: DataFrame) -> DataFrame:
    """(part, user, item, position): one running order per user over train, val, test.

    Train keeps the history order; val and test continue the count with items by id. The position
    is the row's rank by (part, place in part), where the place of val and test rows is their rank
    among the part's items, shifted by the sizes of the parts before.
    """
    number = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("part"))
    sizes = split.groupBy("user").agg(
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in PARTS[:2]]
    )
    later = split.filter(F.col("part") != "train").select("user", "item", "part")
    numeric = isinstance(split.schema["item"].dataType, T.NumericType)
    key = F.col("item") if numeric else None
    later = ordinal(later, ["user", "part"], [F.col("item")], "place", key)
    train = split.filter(F.col("part") == "train").select("user", "item", "part", F.col("seq").alias("place"))
    before = F.when(number == 1, F.lit(0)).when(number == 2, F.col("n_train")).otherwise(
        F.col("n_train") + F.col("n_val")
    )
    return (
        train.unionByName(later)
        .join(sizes, "user")
        .select("part", "user", "item", (before + F.col("place")).alias("position"))
    )


def export_atomic(split: DataFrame, path: str) -> None:
    """Tab-separated files with a typed header, one folder per part."""
    rows = atomic_rows(split).select(
        "part",
        F.col("user").alias(EXPORT_HEADER[0]),
        F.col("item").alias(EXPORT_HEADER[1]),
        F.col("position").alias(EXPORT_HEADER[2]),
    )
    rows.write.mode("overwrite").partitionBy("part").csv(path, sep="\t", header=True)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Gzip JSON lines, one folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def report_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as text with a fixed number of decimals, the way reports are printed."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        fixed = f.dataType.simpleString() in ("double", "float")
        out.append((F.format_string(f"%.{digits}f", c) if fixed else c).alias(f.name))
    return df.select(*out)


def write_report_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """A small report as one CSV file."""
    report_rows(df, digits).coalesce(1).write.mode("overwrite").csv(path, header=True)


def month_usage(ledger: DataFrame, month: str) -> DataFrame:
    """One row: bytes used in a month (YYYY-MM); the dry-run size counts where nothing was billed.

    `ledger`: at (ISO text), bytes_billed, bytes_dry_run.
    """
    billed = F.coalesce(F.nullif(F.col("bytes_billed"), F.lit(0)), F.col("bytes_dry_run"))
    return ledger.filter(F.col("at").startswith(month)).agg(F.coalesce(F.sum(billed), F.lit(0)).alias("used"))

