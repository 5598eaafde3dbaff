"""Sources, sinks and streams, fed with files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_events import RAW_SQL, KEPT, raw_events
from checks.q_text import SALT, hash_sql
from checks.registry import query
from tidemark.scale import cut, scratch_root
from tidemark.sources import days as dy
from tidemark.sources import tables as tb
from tidemark.streaming import jobs as st


def scratch(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(
    "read_ratings_dat",
    f'WITH {I.RAW_RATINGS} SELECT "user", item, rating, ts FROM raw_ratings',
)
def _(spark, sf):
    path = scratch(spark, "dat")
    line = F.concat_ws("::", "user", "item", "rating", "ts")
    I.raw_ratings(spark, sf).select(line.alias("value")).write.text(path)
    return tb.read_ratings_dat(spark, path)


MIN_DATE = "1997-06-01"


@query(
    "read_ratings_csv",
    f"""WITH {I.RAW_RATINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY ts, rating DESC) AS rn FROM raw_ratings WHERE ts >= {tb.day_start(MIN_DATE)})
    SELECT 'u' || "user" AS "user", 'i' || item AS item, CAST(rating AS DOUBLE) AS rating, ts FROM r WHERE rn = 1""",
)
def _(spark, sf):
    path = scratch(spark, "csv")
    I.raw_ratings(spark, sf).select(
        F.concat(F.lit("u"), "user").alias("user_id"),
        F.concat(F.lit("i"), "item").alias("parent_asin"),
        F.col("rating").cast("double").alias("rating"),
        (F.col("ts") * 1000 + 999).alias("timestamp"),
    ).write.csv(path, header=True)
    return tb.read_ratings_csv(spark, path, MIN_DATE)


@query(
    "scan_jsonl",
    """SELECT p_partkey AS raw_id, p_name AS title, p_brand AS store FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(spark, sf):
    path = scratch(spark, "jsonl")
    I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("raw_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), "p_type"
    ).write.json(path)
    keep = I.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("raw_id"))
    return tb.scan_jsonl(spark, path, "raw_id BIGINT, title STRING, store STRING", keep, "raw_id")


@query("write_read_split", f'WITH {I.SPLIT} SELECT "user", item, part, seq FROM split')
def _(spark, sf):
    path = scratch(spark, "split")
    s = I.split(spark, sf)
    users, items = s.select("user").distinct(), s.select("item").distinct()
    tb.write_split(s, users, items, path)
    return tb.read_split(spark, path)[0].select("user", "item", F.col("part").cast("string").alias("part"), "seq")


@query(
    "export_atomic",
    f"""WITH {I.SPLIT}, c AS (SELECT "user", count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'val') AS b FROM split GROUP BY 1),
    p AS (SELECT *, CASE WHEN part = 'train' THEN seq ELSE row_number() OVER (PARTITION BY "user", part ORDER BY item) - 1 END AS place FROM split)
    SELECT part, "user", item, place + CASE part WHEN 'train' THEN 0 WHEN 'val' THEN a ELSE a + b END AS position FROM p JOIN c USING ("user")""",
)
def _(spark, sf):
    path = scratch(spark, "atomic")
    tb.export_atomic(I.split(spark, sf), path)
    header = [f"`{c}` BIGINT" for c in tb.EXPORT_HEADER]
    rows = spark.read.schema(", ".join([*header, "part STRING"])).csv(path, sep="\t", header=True, enforceSchema=False)
    names = tb.EXPORT_HEADER
    return rows.select(
        "part", F.col(f"`{names[0]}`").alias("user"), F.col(f"`{names[1]}`").alias("item"), F.col(f"`{names[2]}`").alias("position")
    )


DAYS_SQL = f"""{RAW_SQL}, {KEPT}, d AS (SELECT CAST(floor(created_us / 86400000000) AS BIGINT) AS day,
  CASE type WHEN 'WatchEvent' THEN 'star' WHEN 'ForkEvent' THEN 'fork' WHEN 'PullRequestEvent' THEN 'pr' WHEN 'IssuesEvent' THEN 'issue' ELSE 'push' END AS kind,
  {hash_sql('CAST(actor_id AS VARCHAR)')} AS "user", repo_id, min(created_us) AS first_us, count(*) AS n FROM kept WHERE repo_id IN (SELECT p_size FROM part) GROUP BY 1, 2, 3, 4)"""
DAY_OUT = 'SELECT day, kind, "user", repo_id, first_us, n FROM d'


def day_number(df):
    return df.select(F.unix_date("day").cast("long").alias("day"), "kind", "user", "repo_id", "first_us", "n")


@query("ingest_days", f"WITH {DAYS_SQL} {DAY_OUT} WHERE day < 19742")
def _(spark, sf):
    """Two overlapping ranges: the second run publishes only what the first left out."""
    path = scratch(spark, "days")
    raw = cut(raw_events(spark, sf), "raw")
    repos = I.table(spark, sf, "part").select(F.col("p_size").alias("repo_id"))
    dy.ingest_days(raw, repos, path, "2024-01-01", "2024-01-11", SALT)
    dy.ingest_days(raw, repos, path, "2024-01-06", "2024-01-20", SALT)
    return day_number(dy.read_days(spark, path))


@query(
    "read_month_range",
    """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INT) AS yyyymm FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199611' AND '199802'""",
)
def _(spark, sf):
    path = scratch(spark, "months")
    o = I.table(spark, sf, "orders").select("o_orderkey", (I.epoch("o_orderdate") * 1_000_000).alias("created_us"))
    dy.write_months(o.repartition("o_orderkey"), path)
    return dy.read_month_range(spark, path, 199_611, 199_802).select("o_orderkey", "yyyymm")


@query(
    "month_usage",
    """WITH l AS (SELECT strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS stamp, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_totalprice AS BIGINT) END AS b, CAST(o_totalprice / 2 AS BIGINT) AS d FROM orders),
    u AS (SELECT CAST(sum(coalesce(nullif(b, 0), d)) AS BIGINT) AS used FROM l WHERE stamp LIKE '1997-05%')
    SELECT used FROM u""",
)
def _(spark, sf):
    o = I.table(spark, sf, "orders")
    price = F.round("o_totalprice").cast("long")
    status = F.col("o_orderstatus")
    billed = F.when(status == "F", 0).when(status == "O", None).otherwise(price)
    ledger = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00").alias("at"),
        billed.cast("long").alias("bytes_billed"),
        F.bround(F.col("o_totalprice") / 2).cast("long").alias("bytes_dry_run"),
    )
    path = scratch(spark, "ledger")
    ledger.write.json(path)
    ledger = spark.read.schema("at STRING, bytes_billed BIGINT, bytes_dry_run BIGINT").json(path)
    return tb.month_usage(ledger, "1997-05")


@query(
    "report_csv",
    """SELECT event_type AS stage, count(*) AS n, printf('%.4f', avg(value)) AS mean FROM events GROUP BY 1""",
)
def _(spark, sf):
    path = scratch(spark, "report")
    d = I.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    tb.write_report_csv(d, path)
    return spark.read.schema("stage STRING, n BIGINT, mean STRING").csv(path, header=True)


@query(
    "write_snapshot",
    """SELECT doc_id, lang, source FROM documents""",
)
def _(spark, sf):
    path = scratch(spark, "snapshot")
    tb.write_snapshot({"documents": I.table(spark, sf, "documents").select("doc_id", "lang", "source")}, path)
    return spark.read.schema("doc_id BIGINT, lang STRING, source STRING").json(f"{path}/documents")


# streams ---------------------------------------------------------------------------------------------------
@query("stream_ingest_daily", f"WITH {DAYS_SQL} {DAY_OUT}")
def _(spark, sf):
    """Day files arrive one batch at a time, some twice; the table holds every day once."""
    incoming, path = scratch(spark, "incoming"), scratch(spark, "days")
    raw = cut(raw_events(spark, sf), "raw")
    repos = I.table(spark, sf, "part").select(F.col("p_size").alias("repo_id"))
    ready = scratch(spark, "ready")
    dy.ingest_days(raw, repos, ready, "2024-01-01", "2024-02-01", SALT)
    whole = cut(dy.read_days(spark, ready), "whole")
    cols = ["kind", "user", "repo_id", "first_us", "n", "day"]
    whole.select(*cols).repartition(6, "day").write.parquet(incoming)
    whole.select(*cols).repartition(3, "day").write.mode("append").parquet(incoming)
    stream = st.file_stream(spark, incoming, dy.DAY_SCHEMA, files_per_batch=2)
    st.stream_ingest_daily(stream, path, scratch(spark, "checkpoint")).awaitTermination()
    return day_number(dy.read_days(spark, path))


@query(
    "stream_first_touch",
    f"""WITH {I.EVENTS} SELECT "user", repo_id, ts, kind FROM ev QUALIFY row_number() OVER (PARTITION BY "user", repo_id ORDER BY ts, kind) = 1""",
)
def _(spark, sf):
    """One file per day in time order; pairs seen on an earlier day are not reported again."""
    incoming, table = scratch(spark, "incoming"), scratch(spark, "touches")
    ev = cut(I.events(spark, sf).drop("n").withColumn("day", F.floor(F.col("ts") / I.DAY)), "events")
    schema = "kind STRING, user BIGINT, repo_id BIGINT, ts BIGINT"
    edges = ev.agg(F.min("day"), F.max("day")).first()
    width = (edges[1] - edges[0]) // 5 + 1
    for i in range(5):
        low = edges[0] + i * width
        part = ev.filter((F.col("day") >= low) & (F.col("day") < low + width)).drop("day")
        part.write.mode("append").parquet(incoming)
        stream = st.file_stream(spark, incoming, schema)
        st.stream_first_touch(stream, table, f"{table}-checkpoint").awaitTermination()
    return spark.read.parquet(table).select("user", "repo_id", "ts", "kind")


@query(
    "stream_activity_counts",
    """SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, user_id AS "user", count(*) AS count FROM events
    WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    """Closed days of an in-order stream; the days the watermark has not passed stay open."""
    incoming, path = scratch(spark, "incoming"), scratch(spark, "counts")
    ev = I.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"))
    ev.write.parquet(incoming)
    stream = st.file_stream(spark, incoming, "ts TIMESTAMP, user BIGINT")
    st.run_to_table(st.activity_counts(stream), path, scratch(spark, "checkpoint")).awaitTermination()
    d = spark.read.parquet(path)
    return d.select(F.floor(F.unix_micros("day") / 86_400_000_000).alias("day"), "user", "count")
