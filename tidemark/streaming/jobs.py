"""The daily append, first touches and daily counts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.scale import cut
from tidemark.sources.days import publish_days, read_days


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are picked up once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def received(path: str) -> str:
    """The ledger of a day table: every different row that its files delivered."""
    return path.rstrip("/") + ".received"


def stream_ingest_daily(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge day rows (with a `day` column) into the day table.

    A day may come in several files and batches; the counts of a key add up over them and the earliest time
    stays. Rows are delivered once: a row equal in all columns to one in the ledger of its day (`first_us`
    is the microsecond of its first event) is the same delivery, so a batch, file or row that comes again,
    under whatever name, adds nothing. Only the days of a batch are read, summed from their ledger and
    their folders replaced as a whole; a batch that died on the way does the same when it is repeated.
    Ends when the input is used up.
    """
    keys = ["day", "kind", "user", "repo_id"]
    rows = [*keys, "first_us", "n"]

    def publish(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch.select(*rows), "batch")
        days = [r["day"] for r in batch.select("day").distinct().collect()]
        if not days:
            return
        ledger = read_days(spark, received(path)).filter(F.col("day").isin(days))
        # days that were published without a ledger start with what they hold
        stored = read_days(spark, path).filter(F.col("day").isin(days))
        stored = stored.join(ledger.select("day").distinct(), "day", "left_anti")
        known = ledger.select(*rows).unionByName(stored.select(*rows))
        # written aside first: a day's folder is both read and replaced
        known = cut(known.unionByName(batch).distinct(), "ledger")
        publish_days(known, received(path))
        merged = known.groupBy(*keys).agg(F.min("first_us").alias("first_us"), F.sum("n").alias("n"))
        publish_days(merged.select("kind", "user", "repo_id", "first_us", "n", "day"), path)

    return (
        stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_touch(stream: DataFrame, horizon: str | None = None) -> DataFrame:
    """One row per (user, repo_id), the first time the pair is seen.

    Without a horizon the state holds every pair ever seen, which is what exactness costs. With
    one ('30 days'; needs a `ts` timestamp), a pair is forgotten after the horizon and reported
    again if it comes back.
    """
    if horizon is None:
        return stream.dropDuplicates(["user", "repo_id"])
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["user", "repo_id"])


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB and checkpoints only what changed."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stream_first_touch(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The first touch of each pair, appended to a table when the pair first comes up.

    The seen pairs are keyed operator state: an aggregate per pair that also holds the times of the
    pair's first and last batch. A batch looks up its own pairs only and writes those whose first batch
    it is, each with its earliest row; it reads neither the table nor the pairs of other batches. A
    batch writes its own folder, so a repeated batch replaces what it wrote before.
    """
    now = F.current_timestamp()  # one value per batch, the same when the batch is repeated
    pairs = (
        stream.withColumn("_now", now)
        .groupBy("user", "repo_id")
        .agg(F.min(F.struct("ts", "kind")).alias("f"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    )

    def append(batch: DataFrame, number: int) -> None:
        new = batch.filter(F.col("_first") == F.col("_last"))
        rows = new.select("user", "repo_id", "f.ts", "f.kind", F.lit(number).alias("batch"))
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(table)
        )

    with _state_on_disk(stream.sparkSession):
        return (
            pairs.writeStream.outputMode("update")
            .foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def activity_counts(stream: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """(day, user, count) per tumbling window; rows later than `lateness` are dropped."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width), "user")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("day"), "user", "count")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to a parquet folder until its input is used up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
