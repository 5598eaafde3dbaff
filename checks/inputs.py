"""The given tables in the roles the operators expect, in Spark and as SQL prefixes.

ratings: order lines (rating = quantity in tens, rounded up). events: the event table with the
repository id read from `props`. items: parts. vectors: embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.interactions import first_rating, to_implicit
from tidemark.operators.split import chronological_split
from tidemark.scale import cut, unbounded

DAY = 86_400
VAL_START, TEST_START, TEST_END = 1_705_795_200, 1_706_227_200, 1_706_659_200
TRAIN_START = 1_704_067_200
KINDS = {"view": "star", "click": "fork", "purchase": "pr", "error": "comment", "signup": "push"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def raw_ratings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(unbounded(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.ceil(F.col("l_quantity") / 10).alias("rating"),
        epoch("o_orderdate").alias("ts"),
    )


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return first_rating(raw_ratings(spark, sf))


def implicit(spark: SparkSession, sf: str) -> DataFrame:
    return to_implicit(ratings(spark, sf), 4)


def split(spark: SparkSession, sf: str, seed: int = 0) -> DataFrame:
    """Chronological split of the implicit pairs, written once for all its consumers."""
    return cut(chronological_split(cut(implicit(spark, sf), "pairs"), seed=seed), "split")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """kind, user, repo_id, ts (seconds), n."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf, "events").select(
        kind.alias("kind"),
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("repo_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"),
        F.lit(1).cast("long").alias("n"),
    )


# SQL twins -----------------------------------------------------------------------------------
RAW_RATINGS = """raw_ratings AS (
  SELECT o_custkey AS "user", l_partkey AS item, CAST(ceil(l_quantity / 10) AS BIGINT) AS rating,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = (
    RAW_RATINGS
    + """, ratings AS (
  SELECT "user", item, rating, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY ts, rating DESC) AS rn
    FROM raw_ratings) WHERE rn = 1)"""
)
IMPLICIT = RATINGS + """, implicit AS (SELECT "user", item, ts FROM ratings WHERE rating >= 4)"""


def split_sql(seed: int = 0, source: str = "implicit", out: str = "split") -> str:
    return f"""{out}_o AS (
  SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts,
      md5('{seed},' || "user" || ',' || ts || ',' || item), item) - 1 AS seq,
      count(*) OVER (PARTITION BY "user") AS n FROM {source}),
{out}_s AS (
  SELECT *, CASE WHEN n < 3 THEN least(n, 1) ELSE n - 2 * greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE) + 0.5) AS BIGINT)) END AS n_train,
    CASE WHEN n < 3 THEN 0 ELSE greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE) + 0.5) AS BIGINT)) END AS n_val
  FROM {out}_o),
{out} AS (
  SELECT "user", item, ts, seq, CASE WHEN seq < n_train THEN 'train'
    WHEN seq < n_train + n_val THEN 'val' ELSE 'test' END AS part FROM {out}_s)"""


SPLIT = IMPLICIT + ", " + split_sql()
EVENTS = """ev AS (
  SELECT CASE event_type WHEN 'view' THEN 'star' WHEN 'click' THEN 'fork' WHEN 'purchase' THEN 'pr'
           WHEN 'error' THEN 'comment' WHEN 'signup' THEN 'push' END AS kind,
         user_id AS "user", CAST(props->>'$.k' AS BIGINT) AS repo_id,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, CAST(1 AS BIGINT) AS n
  FROM events)"""
POP = """pop AS (SELECT i.item, count(t.item) AS pop FROM (SELECT DISTINCT item FROM split) i
  LEFT JOIN (SELECT DISTINCT "user", item FROM split WHERE part = 'train') t USING (item) GROUP BY 1)"""
IDCG = """idcg AS (SELECT r AS n, sum(1.0 / log2(CAST(r AS DOUBLE) + 1)) OVER (ORDER BY r) AS ideal
  FROM range(1, 21) x(r))"""
METRICS = (
    IDCG
    + """, met0 AS (
  SELECT t."user", count(*) AS nt, count(t2.rank) AS hits,
    coalesce(sum(1.0 / log2(CAST(t2.rank AS DOUBLE) + 1)), 0) AS dcg
  FROM tgt t LEFT JOIN top t2 USING ("user", item) GROUP BY 1),
met AS (SELECT "user", CAST(hits AS DOUBLE) / nt AS recall, dcg / ideal AS ndcg,
    CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit FROM met0 JOIN idcg ON idcg.n = least(nt, 20))"""
)
