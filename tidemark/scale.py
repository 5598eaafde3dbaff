"""Building blocks that stay valid when one key holds a large share of all rows.

Joins are left to adaptive skew splitting, aggregates to map-side partial results and per-group
top-k to the window group limit. What Spark has no operator for is a *position* inside a huge group
or in a whole table: a plain ``row_number`` sends such a group to one task. ``ordinal`` and
``global_index`` split it by value range first.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_ROWS = 5_000_000  # a group above this size is split over several tasks
PIECES = 256  # value ranges a hot group is split into
SMALL_ROWS = 200_000  # a table up to this size may be numbered in one task
BROADCAST_KEYS = 10_000  # hot-key tables above this size are joined by shuffle

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut tables: the session's ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="tidemark-")
        root = _local_scratch[app]
    return root.rstrip("/")


def cut(df: DataFrame, label: str = "cut", rows_per_file: int = 0) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back.

    Ends the lineage (a lost executor re-reads files, it does not replay the loop), gives the
    optimizer real sizes and lets several consumers share one computation. Runs a job. With `rows_per_file`
    few large rows are dealt to as many files, so that they are read by as many tasks without a shuffle.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/{app}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def array_bytes(values: pa.Array) -> bytes:
    """An array of any type as bytes, for rows that hold a whole block."""
    batch = pa.record_batch([values], ["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def bytes_array(data: bytes | pa.Buffer) -> pa.Array:
    """What `array_bytes` was given, read without a copy."""
    return pa.ipc.open_stream(pa.py_buffer(data)).read_next_batch().column(0)


def unbounded(df: DataFrame) -> DataFrame:
    """`df` as a join side that is never broadcast.

    Spark guesses a table's size from its files. Lists and ids compress many times, so tables of millions of
    rows pass for a few megabytes and would be collected at the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """`df` hashed by `keys` to a few tasks for each core, before work that takes far longer than moving the rows."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism, *keys)


def portions(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` hashed by `keys` to tasks of about `rows` rows, or as it is if one task could take it. Counts `df`."""
    n = df.count()
    return df if n <= rows else df.repartition(min(-(-n // rows), 100_000), *keys)


def count_up(df: DataFrame, n: str, name: str, step: int = 100_000) -> DataFrame:
    """Each row once per number 0 .. n - 1 (n > 0), counted in steps so that no array is long."""
    pieces = df.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))))
    last = F.least(F.col(n).cast("long"), (F.col("_p") + 1) * step) - 1
    return pieces.withColumn(name, F.explode(F.sequence(F.col("_p") * step, last))).drop("_p")


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows; at most rows / hot_rows of them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > hot_rows)


def _offsets(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each piece of a group; a group has at most PIECES pieces."""
    w = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(*by, "_piece", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    key: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position of each row inside its `by` group, in `order`.

    `key` is a number that never decreases along `order`. With it, groups above `hot_rows` rows
    are cut at quantiles of the key; each piece is numbered alone and shifted by the rows before
    it. Runs one counting job to see whether any group is that large; without one the plan is a
    plain window.
    """
    by = list(by)
    if key is not None:
        hot = hot_keys(df, by, hot_rows)
        n_hot = hot.count()
        if n_hot:
            return _split_ordinal(df, by, order, name, key, hot, n_hot)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long") - 1)


def _split_ordinal(
    df: DataFrame,
    by: list[str],
    order: Sequence[Column],
    name: str,
    key: Column,
    hot: DataFrame,
    n_hot: int,
) -> DataFrame:
    small = n_hot <= BROADCAST_KEYS
    hint = F.broadcast if small else (lambda d: d)
    cuts = [(i + 1) / PIECES for i in range(PIECES - 1)]
    keyed = df.withColumn("_key", key)
    splits = (
        keyed.join(hint(hot.select(*by)), by, "left_semi")
        .groupBy(*by)
        .agg(F.percentile_approx("_key", cuts, 10_000).alias("_cuts"))
    )
    tagged = keyed.join(hint(splits), by, "left").withColumn(
        "_piece",
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_key"))), F.lit(0)),
    )
    tagged = tagged.drop("_cuts", "_key")
    before = _offsets(
        tagged.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n")), by
    )
    w = Window.partitionBy(*by, "_piece").orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(w).cast("long") - 1)
        .join(before, [*by, "_piece"])
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_piece", "_rn", "_before")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(by..., q): linearly interpolated quantiles of a column per group; nulls are left out.

    Values are numbered within their group (a huge group by pieces, see `ordinal`) and only the two
    neighbours of each point are read; no group's values are held together anywhere.
    """
    keys = list(by) or ["_all"]
    values = df if by else df.withColumn("_all", F.lit(0))
    values = cut(values.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"), "quantiles")
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordinal(values, keys, [F.col("_v")], "_at", F.col("_v"), hot_rows).join(sizes, keys)
    places = [F.lit(p) * (F.col("_n") - 1) for p in points]
    wanted = F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])
    near = placed.filter(F.array_contains(wanted, F.col("_at")))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_at") == place.cast("long"), F.col("_v")))

    ends = near.groupBy(*keys, "_n").agg(
        *[at(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(places)],
        *[at(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(places)],
    )
    q = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in enumerate(places)
    ]
    return ends.select(*by, F.array(*q).alias("q"))


def global_index(
    df: DataFrame, order: Sequence[Column], name: str, small_rows: int = SMALL_ROWS
) -> tuple[DataFrame, int]:
    """(`df` with its 0-based position in `order` over the whole table, number of rows).

    `order` must be unique. Tables up to `small_rows` rows are numbered by one window; larger
    ones are range partitioned, written once, numbered per range and shifted by the size of the
    ranges before.
    """
    table = cut(df, "index")
    n = table.count()
    if n <= small_rows:
        w = Window.orderBy(*order)
        return table.withColumn(name, F.row_number().over(w).cast("long") - 1), n
    ranged = table.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    sizes = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, so the running sum is over at most a few thousand rows
    w = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_piece", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_piece").orderBy(*order)
    indexed = (
        ranged.withColumn("_rn", F.row_number().over(w).cast("long") - 1)
        .join(before, "_piece")
        .withColumn(name, F.col("_rn") + F.col("_before"))
        .drop("_piece", "_rn", "_before")
    )
    return indexed, n
