"""Bootstrap, leaderboard, grid and agreement queries.

Per-user metric rows come from order lines: a model is a way to score a line, a seed shifts it a
little, a dataset is a market segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_benchmark import CO
from checks.registry import query
from tidemark.operators import bootstrap as bs
from tidemark.operators import leaderboard as lb
from tidemark.operators.interactions import id_map
from tidemark.plans import gridsearch as gs
from tidemark.scale import cut

N = 1_000  # resamples in the checked queries
MODELS = ("popularity", "itemknn", "itemknn_long", "lightgcn")
RUNS_FROM = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
VALUE = "avg(CASE WHEN l_linenumber <= 2 + m THEN l_discount * 5 ELSE l_tax * 5 END) + s * 0.01 * avg(l_tax)"
RUNS_SQL = f"""runs AS MATERIALIZED (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY_tb1' ELSE c_mktsegment END AS dataset, ['popularity', 'itemknn', 'itemknn_long', 'lightgcn'][m + 1] AS model,
  s AS seed, c_custkey AS "user",
  avg(CASE WHEN l_linenumber <= 2 + m THEN CAST(l_discount AS DOUBLE) * 5 ELSE CAST(l_tax AS DOUBLE) * 5 END) + s * CAST(0.01 AS DOUBLE) * avg(CAST(l_tax AS DOUBLE)) AS value,
  CASE WHEN count(*) FILTER (l_returnflag = 'R') > 14 THEN avg(CASE WHEN l_linenumber <= 2 + m THEN CAST(l_tax AS DOUBLE) * 4 ELSE CAST(l_discount AS DOUBLE) * 3 END) END AS cold_ndcg,
  CASE WHEN count(*) FILTER (l_returnflag = 'R') > 14 THEN avg(CAST(l_tax AS DOUBLE) * (m + 1)) END AS cold_recall, count(*) AS n_lines
  {RUNS_FROM}, range(0, 4) x(m), range(0, 3) y(s) GROUP BY 1, 2, 3, 4, m)"""


def runs(spark, sf):
    lines = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag"
    )
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = I.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    base = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        cust, F.col("o_custkey") == F.col("c_custkey")
    )
    sums = []
    for m in range(len(MODELS)):
        near = F.col("l_linenumber") <= 2 + m
        sums += [
            F.avg(F.when(near, F.col("l_discount") * 5).otherwise(F.col("l_tax") * 5)).alias(f"v{m}"),
            F.avg(F.when(near, F.col("l_tax") * 4).otherwise(F.col("l_discount") * 3)).alias(f"c{m}"),
        ]
    per_user = base.groupBy(F.when(F.col("c_mktsegment") == "BUILDING", "MACHINERY_tb1").otherwise(F.col("c_mktsegment")).alias("dataset"), F.col("c_custkey").alias("user")).agg(
        *sums,
        F.avg("l_tax").alias("tax"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    cold = F.col("r") > 14
    cells = F.array(
        *[
            F.struct(
                F.lit(MODELS[m]).alias("model"),
                F.lit(s).cast("long").alias("seed"),
                (F.col(f"v{m}") + s * 0.01 * F.col("tax")).alias("value"),
                F.when(cold, F.col(f"c{m}")).alias("cold_ndcg"),
                F.when(cold, F.col("tax") * (m + 1)).alias("cold_recall"),
            )
            for m in range(len(MODELS))
            for s in range(3)
        ]
    )
    return per_user.select("dataset", "user", "n_lines", F.explode(cells).alias("c")).select(
        "dataset", "user", "n_lines", "c.*"
    )


def averaged(spark, sf, value="value"):
    r = runs(spark, sf).filter(F.col(value).isNotNull())
    r = r.select("dataset", F.col("model").alias("series"), "seed", "user", F.col(value).alias("value"))
    return cut(bs.seed_average(cut(r, "runs")), "averaged")


AVERAGED = RUNS_SQL + """, val AS MATERIALIZED (SELECT dataset, model AS series, "user", avg(value) AS value, any_value(n_lines) AS n_lines FROM runs GROUP BY 1, 2, 3)"""


@query("seed_average", f'WITH {AVERAGED} SELECT dataset, series, "user", round(value, 9) AS value FROM val')
def _(spark, sf):
    return averaged(spark, sf).withColumn("value", F.round("value", 9))


def boot_sql(source: str, by: str, n: int = N) -> str:
    """Resample means bm(by, series, b, mean) of source(by, series, user, value)."""
    p = bs.PRIME
    return f"""bu AS (SELECT {by}, "user", row_number() OVER (PARTITION BY {by} ORDER BY "user") - 1 AS slot, count(*) OVER (PARTITION BY {by}) AS n
  FROM (SELECT DISTINCT {by}, "user" FROM {source})),
b0 AS (SELECT {by}, n, b, (b * 1000003 + slot * 7919 + 12345) % {p} AS x0 FROM bu, range(0, {n}) r(b)),
b1 AS (SELECT *, (x0 * x0 + 1013904223) % {p} AS x1 FROM b0),
b2 AS (SELECT *, (x1 * x1 + x0 * 48271 + 69069) % {p} AS x2 FROM b1),
bd AS (SELECT {by}, b, ((x2 * x2 + x1) % {p}) % n AS slot FROM b2),
bm AS MATERIALIZED (SELECT {by}, series, b, avg(value) AS mean FROM bd JOIN bu USING ({by}, slot) JOIN {source} v USING ({by}, "user") GROUP BY ALL),
sm AS (SELECT {by}, series, avg(value) AS mean, count(*) AS n_users FROM {source} GROUP BY ALL)"""


def interval_sql(by: str, pairs: str) -> str:
    return f"""ci AS (SELECT {by}, p.a, p.b, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS p_not_positive
  FROM (SELECT {by}, p.a, p.b, round(x.mean - y.mean, 12) AS d FROM {pairs} p JOIN bm x USING ({by}) JOIN bm y USING ({by}) WHERE x.series = p.a AND y.series = p.b AND x.b = y.b) p GROUP BY ALL),
pci AS (SELECT {by}, ci.a, ci.b, round(x.mean - y.mean, 6) + 0.0 AS diff, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_not_positive, 6) AS p_not_positive, x.n_users
  FROM ci JOIN sm x USING ({by}) JOIN sm y USING ({by}) WHERE x.series = ci.a AND y.series = ci.b)"""


def rounded(df):
    names = ("diff", "ci_low", "ci_high", "p_not_positive")
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in names})


ONE_PAIR = "pr AS (SELECT DISTINCT dataset, 'lightgcn' AS a, 'popularity' AS b FROM val)"


@query(
    "paired_bootstrap",
    f"WITH {AVERAGED}, {boot_sql('val', 'dataset')}, {ONE_PAIR}, {interval_sql('dataset', 'pr')} SELECT * FROM pci",
)
def _(spark, sf):
    v = averaged(spark, sf)
    pairs = v.select("dataset", F.lit("lightgcn").alias("a"), F.lit("popularity").alias("b")).distinct()
    return rounded(bs.paired_intervals(v, pairs, ["dataset"], N))


RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, series) AS r FROM sm),
pr AS (SELECT x.dataset, x.series AS a, y.series AS b, y.r = x.r + 1 AS adjacent FROM rk x JOIN rk y ON x.dataset = y.dataset AND x.r < y.r)"""


@query(
    "pairwise_cis",
    f"""WITH {AVERAGED}, {boot_sql('val', 'dataset')}, {RANKED}, {interval_sql('dataset', 'pr')}
    SELECT pci.*, adjacent, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM pci JOIN pr USING (dataset, a, b)""",
)
def pairwise_cis(spark, sf):
    return rounded(bs.pairwise_cis(averaged(spark, sf), n_resamples=N))


GROUPS = f"""{AVERAGED}, len AS (SELECT DISTINCT "user", n_lines AS n FROM runs),
ed AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.25) AS e1, quantile_cont(CAST(n AS DOUBLE), 0.5) AS e2, quantile_cont(CAST(n AS DOUBLE), 0.75) AS e3 FROM len),
g0 AS (SELECT "user", n, CASE WHEN n >= e3 THEN 3 WHEN n >= e2 THEN 2 WHEN n >= e1 THEN 1 ELSE 0 END AS "group" FROM len, ed),
grp AS (SELECT *, min(n) OVER (PARTITION BY "group") || '-' || max(n) OVER (PARTITION BY "group") AS label FROM g0)"""


def groups(spark, sf):
    lengths = runs(spark, sf).select("user", F.col("n_lines").alias("n")).distinct()
    return cut(bs.activity_groups(lengths), "groups")


@query("activity_groups", f'WITH {GROUPS} SELECT "user", n, "group", label FROM grp')
def _(spark, sf):
    return groups(spark, sf)


@query(
    "group_table",
    f"""WITH {GROUPS} SELECT series, "group", label, count(*) AS n_users, round(avg(value), 9) AS mean FROM val JOIN grp USING ("user") GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = bs.group_table(averaged(spark, sf), groups(spark, sf))
    return d.withColumn("mean", F.round("mean", 9))


@query(
    "group_cis",
    f"""WITH {GROUPS}, gv AS (SELECT "group", series, "user", value FROM val JOIN grp USING ("user")), {boot_sql('gv', '"group"')},
    pr AS (SELECT DISTINCT "group", 'lightgcn' AS a, 'itemknn' AS b FROM gv), {interval_sql('"group"', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    v = averaged(spark, sf)
    pairs = v.select(F.lit("lightgcn").alias("a"), F.lit("itemknn").alias("b")).distinct()
    return rounded(bs.group_cis(v, groups(spark, sf), pairs, N))


@query(
    "activity_group_medians",
    f"""WITH {GROUPS} SELECT "group", label, CAST(quantile_cont(CAST(n AS DOUBLE), 0.5) AS DOUBLE) AS median_len, count(*) AS n_users FROM grp GROUP BY 1, 2""",
)
def _(spark, sf):
    return groups(spark, sf).groupBy("group", "label").agg(
        F.median("n").alias("median_len"), F.count(F.lit(1)).alias("n_users")
    )


# run records: two configurations, one seed of the newer one run twice ---------------------------
RECORDS = f"""{RUNS_SQL}, rec AS (SELECT dataset, model, c AS config_hash, seed + z AS seed, seed * 10 + t + z AS finished_at, m + z * CAST(0.001 AS DOUBLE) AS ndcg, m / 2 + z AS recall
  FROM (SELECT dataset, model, seed, avg(value) AS m FROM runs GROUP BY 1, 2, 3), (VALUES ('cfg_a', 100, 0), ('cfg_b', 200, 0), ('cfg_b', 300, 1)) v(c, t, z))"""


def records(spark, sf):
    base = runs(spark, sf).groupBy("dataset", "model", "seed").agg(F.avg("value").alias("v"))
    kinds = F.array(
        *[
            F.struct(F.lit(c).alias("config_hash"), F.lit(t).alias("t"), F.lit(z).alias("z"))
            for c, t, z in (("cfg_a", 100, 0), ("cfg_b", 200, 0), ("cfg_b", 300, 1))
        ]
    )
    return base.select("*", F.explode(kinds).alias("k")).select(
        "dataset",
        "model",
        "k.config_hash",
        (F.col("seed") + F.col("k.z")).alias("seed"),
        (F.col("seed") * 10 + F.col("k.t") + F.col("k.z")).alias("finished_at"),
        (F.col("v") + F.col("k.z") * 0.001).alias("ndcg"),
        (F.col("v") / 2 + F.col("k.z")).alias("recall"),
    )


FINAL = f"""{RECORDS}, cf AS (SELECT dataset, model, config_hash, max(finished_at) AS f FROM rec GROUP BY ALL),
lf AS (SELECT dataset, model, arg_max(config_hash, f) AS config_hash FROM cf GROUP BY ALL),
fin AS (SELECT * EXCLUDE (rn) FROM (SELECT rec.*, row_number() OVER (PARTITION BY dataset, model, seed ORDER BY finished_at DESC) AS rn FROM rec JOIN lf USING (dataset, model, config_hash)) WHERE rn = 1)"""


@query(
    "select_final_runs",
    f"WITH {FINAL} SELECT dataset, model, config_hash, seed, finished_at, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall FROM fin",
)
def _(spark, sf):
    d = lb.select_final_runs(records(spark, sf))
    return d.withColumns({c: F.round(c, 9) for c in ("ndcg", "recall")})


@query(
    "leaderboard",
    f"""WITH {FINAL} SELECT dataset, model, count(*) AS n_seeds, max(config_hash) AS config_hash, round(avg(ndcg), 6) AS ndcg_mean, round(stddev_samp(ndcg), 6) AS ndcg_std,
    round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std,
    CASE model WHEN 'popularity' THEN 0 WHEN 'itemknn' THEN 1 WHEN 'lightgcn' THEN 8 ELSE 9 END AS position, contains(dataset, '_tb') AS is_variant FROM fin GROUP BY 1, 2""",
)
def _(spark, sf):
    d = lb.leaderboard(records(spark, sf), ["ndcg", "recall"])
    names = [f"{m}_{s}" for m in ("ndcg", "recall") for s in ("mean", "std")]
    return d.withColumns({c: F.round(c, 6) for c in names}).withColumn("position", F.col("position").cast("int"))


@query(
    "cold_item_table",
    f"""WITH {RUNS_SQL} SELECT dataset, model, round(avg(cold_ndcg), 6) AS cold_ndcg, round(avg(cold_recall), 6) AS cold_recall, count(DISTINCT "user") AS n_users
    FROM runs WHERE cold_ndcg IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    d = lb.cold_item_table(runs(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("cold_ndcg", "cold_recall")})


@query(
    "cold_item_cis",
    f"""WITH {RUNS_SQL}, val AS MATERIALIZED (SELECT dataset, model AS series, "user", avg(cold_ndcg) AS value FROM runs WHERE cold_ndcg IS NOT NULL GROUP BY 1, 2, 3),
    {boot_sql('val', 'dataset')}, {ONE_PAIR}, {interval_sql('dataset', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    v = averaged(spark, sf, "cold_ndcg")
    pairs = v.select("dataset", F.lit("lightgcn").alias("a"), F.lit("popularity").alias("b")).distinct()
    return rounded(bs.paired_intervals(v, pairs, ["dataset"], N))


# grid search of the neighbour model --------------------------------------------------------------
GRID = [{"k": k, "shrink": s} for k in (20, 50, 100, 200) for s in (0.0, 10.0, 50.0, 100.0)]


def grid_sql() -> str:
    rows = ", ".join(f"({i}, {c['k']}, CAST({c['shrink']} AS DOUBLE))" for i, c in enumerate(GRID))
    return f"""{CO}, deg AS (SELECT item, count(*) AS n FROM tr GROUP BY 1), cfg AS (SELECT * FROM (VALUES {rows}) v(config, k, shrink)),
  s0 AS (SELECT c.j AS item, c.i AS neighbour, shrink, c.co / (sqrt(CAST(least(a.n, b.n) AS DOUBLE)) * sqrt(CAST(greatest(a.n, b.n) AS DOUBLE)) + shrink + CAST(1e-12 AS DOUBLE)) AS sim
    FROM co c JOIN deg a ON a.item = c.i JOIN deg b ON b.item = c.j, (SELECT DISTINCT shrink FROM cfg)),
  s1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shrink, item ORDER BY sim DESC, neighbour) AS r FROM s0) WHERE r <= 200),
  tgt AS (SELECT DISTINCT "user", item FROM split WHERE part = 'val'), us AS (SELECT DISTINCT "user" FROM tgt),
  sc AS (SELECT config, t."user", s.item, sum(sim) AS score FROM tr t JOIN us USING ("user") JOIN s1 s ON s.neighbour = t.item JOIN cfg USING (shrink) WHERE r <= k GROUP BY ALL),
  fs AS (SELECT cfg.config, u."user", i.item, coalesce(round(score, 9), 0) AS score FROM cfg CROSS JOIN us u CROSS JOIN (SELECT DISTINCT item FROM split) i
    LEFT JOIN sc ON sc.config = cfg.config AND sc."user" = u."user" AND sc.item = i.item ANTI JOIN tr ON tr."user" = u."user" AND tr.item = i.item),
  tp AS (SELECT *, row_number() OVER (PARTITION BY config, "user" ORDER BY score DESC, item) AS rank FROM fs),
  {I.IDCG}, nd AS (SELECT config, "user", dcg / ideal AS ndcg FROM (SELECT config, "user", count(*) AS nt, sum(CASE WHEN rank <= 20 THEN 1.0 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0 END) AS dcg
    FROM tp JOIN tgt USING ("user", item) GROUP BY 1, 2) JOIN idcg ON n = least(nt, 20)),
  tb AS (SELECT config, avg(ndcg) AS ndcg FROM nd GROUP BY 1)
  SELECT config, k, shrink, round(ndcg, 6) AS ndcg, config = (SELECT config FROM tb ORDER BY round(ndcg, 9) DESC, config LIMIT 1) AS best FROM tb JOIN cfg USING (config)"""


@query("grid_search_itemknn", f"WITH {grid_sql()}")
def grid_search(spark, sf):
    s = I.split(spark, sf)
    ids = id_map(s, "item").select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    d = gs.tune_itemknn(s, ids, GRID)
    return d.withColumn("ndcg", F.round("ndcg", 6)).withColumn("k", F.col("k").cast("int"))


# agreement and latency ----------------------------------------------------------------------------
RATED = "r AS (SELECT quality + toxic AS a, quality + (CASE WHEN n_chars > 900 THEN toxic ELSE 0 END) AS b FROM labels JOIN documents USING (doc_id))"


@query(
    "rank_agreement",
    f"""WITH {RATED}, t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r), c AS (SELECT a, b, count(*) AS k FROM r GROUP BY 1, 2),
    ma AS (SELECT a, count(*) AS na FROM r GROUP BY 1), mb AS (SELECT b, count(*) AS nb FROM r GROUP BY 1),
    e AS (SELECT sum(CASE WHEN a <> b THEN na * nb END) AS u, sum((a - b) * (a - b) / CAST(4 AS DOUBLE) * na * nb) AS q FROM ma, mb),
    o AS (SELECT sum(CASE WHEN a <> b THEN k ELSE 0 END) AS u, sum((a - b) * (a - b) / CAST(4 AS DOUBLE) * k) AS q FROM c)
    SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS exact_agreement,
      round(1 - (SELECT o.u * n / e.u FROM o, e, t), 6) AS kappa, round(1 - (SELECT o.q * n / e.q FROM o, e, t), 6) AS kappa_quadratic,
      round(avg(CASE WHEN a = 2 THEN 1.0 ELSE 0.0 END), 6) AS a_good, round(avg(CASE WHEN b = 2 THEN 1.0 ELSE 0.0 END), 6) AS b_good,
      round(avg(CASE WHEN a >= 1 THEN 1.0 ELSE 0.0 END), 6) AS a_partly, round(avg(CASE WHEN b >= 1 THEN 1.0 ELSE 0.0 END), 6) AS b_partly FROM r""",
)
def _(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "n_chars")
    second = F.when(F.col("n_chars") > 900, F.col("toxic")).otherwise(0)
    r = I.table(spark, sf, "labels").join(docs, "doc_id")
    d = lb.rank_agreement(r.select((F.col("quality") + F.col("toxic")).alias("a"), (F.col("quality") + second).alias("b")))
    return d.select("n", *[F.round(c, 6).alias(c) for c in d.columns if c != "n"])


@query(
    "latency_percentiles",
    """SELECT event_type AS stage, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95 FROM events GROUP BY 1""",
)
def _(spark, sf):
    log = I.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return lb.latency_percentiles(log).select("stage", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
