"""Exact deduplication: a tree merge of sorted digest runs.

Every partition of the input is a run: its rows as (digest, SHA-256), sorted, with one entry for each
different text. Runs are then exchanged in binomial rounds. In a round, every `FAN` neighbouring runs
split the digests among them by the next bits, each takes its share of all `FAN` runs and merges them,
so after log_FAN(partitions) rounds the run with number d holds exactly the digests that start with
the bits of d. At every level an entry keeps the preferred row of its text and the number of rows below
it; a text that a third of all rows hold is one entry of each run, so no task ever meets its rows.

A digest orders the runs; whether two entries are one text is verified by the SHA-256 of the whole
text, so texts whose digests collide stay apart. The results go back by the runs the rows came from.

`keep` says which row of a text stays: the one with the largest or the smallest doc_id. A null doc_id
is preferred to none. Rows with equal text and doc_id are told apart by their place in the input, so
exactly one row of a text stays. A null text is an empty one. An empty table gives no rows. Very long
texts are hashed where they are read and never moved. Other columns are not read by `groups`;
`dedup` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat
from tidemark.scale import cut

FAN_BITS = 4  # runs that meet in a round: 2 ** FAN_BITS
RUN = "part long, digest long, sha binary, keep_id long, keep_row long, size long"
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def _joined_runs(batch: pa.RecordBatch | pa.Table, largest: bool) -> pa.Table:
    """One entry for each stretch of equal (part, digest, sha): the preferred row and the sum of sizes."""
    n = batch.num_rows
    part, digest, row, size = [batch.column(k).to_numpy() for k in (0, 1, 4, 5)]
    raw, _ = flat(batch.column(2))
    sha = raw.reshape(n, 32)
    other = (part[1:] != part[:-1]) | (digest[1:] != digest[:-1]) | (sha[1:] != sha[:-1]).any(axis=1)
    head = np.flatnonzero(np.concatenate(([True], other)))
    if len(head) == n:
        return pa.table(batch.columns, names=_NAMES)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    ids = batch.column(3)
    known = ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy()
    turn = (lambda x: x) if largest else np.invert  # order turned round without overflow
    rank = np.where(known, turn(value), np.iinfo(np.int64).min)
    named = np.maximum.reduceat(known, head)
    best = np.maximum.reduceat(rank, head)
    wins = (known == named[group]) & (rank == best[group])
    first = np.maximum.reduceat(np.where(wins, turn(row), np.iinfo(np.int64).min), head)
    return pa.table(
        [
            pa.array(part[head]),
            pa.array(digest[head]),
            batch.column(2).take(pa.array(head)),
            pa.array(turn(best), pa.int64(), mask=~named),
            pa.array(turn(first)),
            pa.array(np.add.reduceat(size, head)),
        ],
        names=_NAMES,
    )


def merge(runs: DataFrame, largest: bool) -> DataFrame:
    """Entries of sorted runs that follow one another, joined; reads a partition as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch.columns, names=_NAMES)  # all columns as nullable ones
            if last is not None:
                table = pa.concat_tables([last, table])
            table = _joined_runs(table.combine_chunks(), largest)
            last = table.slice(table.num_rows - 1)
            yield from table.slice(0, table.num_rows - 1).to_batches()
        if last is not None:
            yield from last.to_batches()

    return runs.select(*_NAMES).mapInArrow(work, RUN)


def rows_of(docs: DataFrame, normalise: Callable[[Column], Column] | None, *columns: Column) -> DataFrame:
    """`columns` and each row's doc_id, digest, sha and its place: (part, row). Sorted runs, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if normalise is not None:
        text = normalise(text)
    table = docs.select(
        *columns,
        F.col("doc_id").cast("long").alias("keep_id"),
        F.xxhash64(text).alias("digest"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.spark_partition_id().cast("long").alias("part"),
        F.monotonically_increasing_id().alias("keep_row"),
    )
    return cut(table.sortWithinPartitions("digest", "sha"), "digest-runs")


def merged(rows: DataFrame, largest: bool, fan_bits: int = FAN_BITS) -> DataFrame:
    """part, digest, sha -> keep_id, keep_row, size of the whole table, for each run that has the text."""
    order = ["part", "digest", "sha"]
    leaves = merge(rows.withColumn("size", F.lit(1).cast("long")).sortWithinPartitions(*order), largest)
    level, width = leaves, 0
    last = rows.agg(F.max("part")).head()[0] or 0
    while last >> width or not width:
        width += fan_bits
        bits = F.expr(f"shiftrightunsigned(digest, {64 - width})")
        level = level.withColumn("part", F.shiftleft(F.shiftright("part", width), width) + bits)
        level = merge(level.repartition("part").sortWithinPartitions(*order), largest)
        # the number of the group of runs stays in the high bits, for the next round
        level = level.withColumn("part", F.shiftleft(F.shiftright("part", width), width))
    answers = level.select("digest", "sha", "keep_id", "keep_row", "size")
    return leaves.select("part", "digest", "sha").distinct().join(answers, ["digest", "sha"])


def groups(
    docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None, fan_bits: int = FAN_BITS
) -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of every row.

    `normalise` turns the text into the form in which equal texts are identical; none by default.
    """
    rows = rows_of(docs, normalise)
    found = merged(rows, keep == "largest", fan_bits)
    mine = rows.select(F.col("keep_id").alias("doc_id"), F.col("keep_row").alias("row"), "part", "digest", "sha")
    return mine.join(found, ["part", "digest", "sha"]).select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(
    docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, fan_bits: int = FAN_BITS
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Writes `docs` to the shared folder once."""
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = rows_of(docs, normalise, F.struct(*[F.col(c) for c in names]).alias("doc"))
    found = merged(rows.drop("doc"), keep == "largest", fan_bits).select("part", "digest", "sha", F.col("keep_row").alias("row"))
    mine = rows.select("doc", F.col("keep_row").alias("row"), "part", "digest", "sha")
    return mine.join(found, ["part", "digest", "sha", "row"]).select("doc.*")


def oracle_sql() -> str:
    return """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)"""
