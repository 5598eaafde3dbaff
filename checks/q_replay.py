"""Point-in-time replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import inputs as I
from checks.q_statistics import boot_sql, interval_sql, rounded
from checks.registry import query
from tidemark.functions import labels as lf
from tidemark.operators import issues as iss
from tidemark.operators import replay as rp
from tidemark.operators import vectorscore as vs
from tidemark.operators.bootstrap import paired_intervals
from tidemark.operators.recommend import zscore
from tidemark.scale import cut, unbounded

DIM = 64
TUNE = (I.VAL_START, I.TEST_START)
REPORT = (I.TEST_START, I.TEST_END)
# catalog: repositories of the event log with an even fact row behind them (a part of that number)
CATALOG = """cat AS (SELECT p_partkey AS item, p_partkey AS repo_id, p_type AS lang, lower(p_brand) AS owner FROM part
  WHERE p_partkey IN (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) FROM events) AND p_size > 5)"""


def cohort_sql(name: str, start: int, end: int) -> str:
    return f"""{name} AS (SELECT "user", arg_min(repo_id, (ts, repo_id)) AS repo_id, min(ts) AS pr_ts FROM (
    SELECT pr.*, p.fp FROM (SELECT "user", repo_id, min(ts) AS ts FROM ev WHERE kind = 'pr' GROUP BY ALL) pr
    LEFT JOIN (SELECT "user", repo_id, min(ts) AS fp FROM ev WHERE kind = 'push' GROUP BY ALL) p USING ("user", repo_id))
  WHERE (fp IS NULL OR fp > ts) AND ts >= {start} AND ts < {end} AND repo_id IN (SELECT repo_id FROM cat) GROUP BY 1)"""


def profile_sql(name: str, cohort: str) -> str:
    return f"""{name}_e AS (SELECT e.* FROM ev e JOIN {cohort} q USING ("user") WHERE e.ts < q.pr_ts),
{name} AS (SELECT "user", repo_id, min(ts) AS ts, arg_min(kind, (ts, kind)) AS kind FROM {name}_e e
  LEFT JOIN (SELECT "user", repo_id, min(ts) AS fp FROM {name}_e WHERE kind = 'push' GROUP BY ALL) USING ("user", repo_id)
  WHERE kind <> 'push' AND (fp IS NULL OR fp > ts) GROUP BY 1, 2)"""


BASE = f"{I.EVENTS}, {CATALOG}"
CO = f"{BASE}, {cohort_sql('co', *TUNE)}"
PROF = f"{CO}, {profile_sql('prof', 'co')}"
Q = f"""{PROF}, q AS (SELECT co."user", co.repo_id AS target, pr_ts, count(p.repo_id) AS n_history, count(cat.item) AS n_profile,
  coalesce(bool_or(cat.item = co.repo_id), false) AS target_in_profile FROM co LEFT JOIN prof p ON p."user" = co."user" LEFT JOIN cat ON cat.repo_id = p.repo_id GROUP BY 1, 2, 3)"""


def catalog(spark, sf):
    seen = I.events(spark, sf).select("repo_id").distinct()
    return (
        I.table(spark, sf, "part")
        .filter("p_size > 5")
        .select(
            F.col("p_partkey").alias("item"),
            F.col("p_partkey").alias("repo_id"),
            F.col("p_type").alias("language"),
            F.lower("p_brand").alias("owner"),
        )
        .join(seen, "repo_id", "left_semi")
    )


def queries_of(spark, sf, window):
    ev = I.events(spark, sf)
    cat = cut(catalog(spark, sf), "catalog")
    co = cut(rp.cohort(ev, cat, *window), "cohort")
    prof = rp.profiles(ev, co)
    queries, items = rp.build_queries(co, prof, cat.select("repo_id", "item"))
    return cat, cut(queries, "queries"), cut(items, "items")


@query("cohort", f'WITH {CO} SELECT "user", repo_id, pr_ts FROM co')
def _(spark, sf):
    return rp.cohort(I.events(spark, sf), catalog(spark, sf), *TUNE)


@query("profiles", f'WITH {PROF} SELECT "user", repo_id, ts, kind FROM prof')
def _(spark, sf):
    ev = I.events(spark, sf)
    return rp.profiles(ev, rp.cohort(ev, catalog(spark, sf), *TUNE))


@query("build_queries", f"WITH {Q} SELECT * FROM q")
def _(spark, sf):
    return queries_of(spark, sf, TUNE)[1]


# scores: mean of the profile items' vectors plus a small popularity term -------------------------
VEC = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT count(*) AS n FROM embeddings),
pop AS (SELECT repo_id AS item, count(*) AS pop FROM ev GROUP BY 1),
iv AS MATERIALIZED (SELECT cat.item, lang, owner, a.v AS mv, b.v AS tv, CAST(1e-6 AS DOUBLE) * coalesce(pop, 0) / (SELECT max(pop) FROM pop) AS tie
  FROM cat CROSS JOIN m JOIN e a ON a.vec_id = cat.item % n JOIN e b ON b.vec_id = (cat.item * 7 + 3) % n LEFT JOIN pop USING (item))"""


def scores_sql(tag: str) -> str:
    """Raw model and text scores sc_<tag>("user", item, sm, st) of cohort tag's profiles."""
    return f"""pi_{tag} AS (SELECT p."user", cat.item FROM prof_{tag} p JOIN cat USING (repo_id)),
me_{tag} AS (SELECT "user", d, avg(x) AS x, avg(y) AS y FROM (SELECT p."user", generate_subscripts(mv, 1) AS d, unnest(mv) AS x, unnest(tv) AS y FROM pi_{tag} p JOIN iv USING (item)) GROUP BY 1, 2),
mu_{tag} AS MATERIALIZED (SELECT "user", list(x ORDER BY d) AS um, list(y ORDER BY d) AS ut FROM me_{tag} GROUP BY 1),
sc_{tag} AS MATERIALIZED (SELECT c."user", iv.item, lang, owner, tie, coalesce(list_dot_product(um, mv), 0) + tie AS sm, coalesce(list_dot_product(ut, tv), 0) + tie AS st
  FROM co_{tag} c LEFT JOIN mu_{tag} USING ("user") CROSS JOIN iv)"""


def cohorts_sql() -> str:
    parts = [BASE, VEC]
    for tag, window in (("t", TUNE), ("r", REPORT)):
        parts += [cohort_sql(f"co_{tag}", *window), profile_sql(f"prof_{tag}", f"co_{tag}"), scores_sql(tag)]
    return ", ".join(parts)


def metrics_sql(top: str, co: str, keys: str) -> str:
    """Replay metrics of a top list (keys..., user, item, rank, lang, owner)."""
    return f"""SELECT {keys}{',' if keys else ''} c."user", max(CASE WHEN t.item = c.repo_id THEN 1.0 ELSE 0.0 END) AS hit,
      max(CASE WHEN t.item = c.repo_id THEN 1.0 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0.0 END) AS ndcg,
      CASE WHEN max(CASE WHEN t.item = c.repo_id THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN t.lang = x.lang AND x.lang <> '' THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END AS near_lang,
      CASE WHEN max(CASE WHEN t.item = c.repo_id THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN t.owner = x.owner THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END AS near_org
    FROM {co} c JOIN {top} t ON t."user" = c."user" JOIN cat x ON x.item = c.repo_id GROUP BY ALL"""


def top_sql(tag: str, score: str, model: str) -> str:
    return f"""SELECT '{model}' AS model, "user", item, lang, owner, row_number() OVER (PARTITION BY "user" ORDER BY round({score}, 12) DESC, item) AS rank FROM sc_{tag} QUALIFY rank <= 20"""


POPSCORE = "tie * 1e6 * (SELECT max(pop) FROM pop) + tie"
PER_USER = f"""{cohorts_sql()}, top_t AS (SELECT * FROM ({top_sql('t', 'sm', 'mean')}) UNION ALL SELECT * FROM ({top_sql('t', 'tie', 'popularity')})),
top_r AS (SELECT * FROM ({top_sql('r', 'sm', 'mean')}) UNION ALL SELECT * FROM ({top_sql('r', 'tie', 'popularity')})),
pu AS MATERIALIZED (SELECT 'tune' AS cohort, * FROM ({metrics_sql('top_t', 'co_t', 't.model')}) UNION ALL SELECT 'report', * FROM ({metrics_sql('top_r', 'co_r', 't.model')}))"""


def vectors(cat, spark, sf):
    """item, model_vec, text_vec, language, tie and the popularity of the catalog."""
    pop = I.events(spark, sf).groupBy(F.col("repo_id").alias("item")).agg(F.count(F.lit(1)).alias("pop"))
    emb = I.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    n = emb.agg(F.count(F.lit(1))).scalar()
    a = emb.select(F.col("vec_id").alias("va"), F.col("vec").alias("model_vec"))
    b = emb.select(F.col("vec_id").alias("vb"), F.col("vec").alias("text_vec"))
    top = pop.agg(F.max("pop")).scalar()
    numbered = cat.select("item", "language", (F.col("item") % n).alias("va"), ((F.col("item") * 7 + 3) % n).alias("vb"))
    joined = numbered.join(a, "va").join(b, "vb").join(pop, "item", "left")
    return cut(
        joined.select(
            "item", "language", "model_vec", "text_vec", (F.lit(1e-6) * F.coalesce("pop", F.lit(0)) / top).alias("tie")
        ),
        "vectors",
    ), pop


def per_user(spark, sf, window):
    """(model, user, metrics) of the mean-vector model and of popularity."""
    cat, queries, items = queries_of(spark, sf, window)
    vec, pop = vectors(cat, spark, sf)
    users, catalog_vec = vs.fold_in_user_mean(
        queries.select("user"),
        items,
        vec.select("item", F.col("model_vec").alias("vec")),
        pop,
        DIM,
    )
    top = vs.blocked_topk(users, catalog_vec, 20).withColumnRenamed("query", "user")
    best = vec.orderBy(F.col("tie").desc(), "item").limit(20)
    w = Window.orderBy(F.col("tie").desc(), "item")  # 20 rows
    best = best.select("item", F.row_number().over(w).alias("rank"), F.lit(1).alias("one"))
    popular = queries.select("user", F.lit(1).alias("one")).join(F.broadcast(best), "one")
    both = (
        top.select(F.lit("mean").alias("model"), "user", "item", "rank")
        .unionByName(popular.select(F.lit("popularity").alias("model"), "user", "item", "rank"))
    )
    models = F.explode(F.array(F.lit("mean"), F.lit("popularity"))).alias("model")
    asked = queries.select("*", models)
    return rp.replay_metrics(both, asked, cat, by=("model",)), queries


METRICS = ("hit", "ndcg", "near_lang", "near_org")


def both_cohorts(spark, sf):
    frames = [per_user(spark, sf, w) for w in (TUNE, REPORT)]
    users = [f[0].withColumn("cohort", F.lit(c)) for f, c in zip(frames, ("tune", "report"), strict=True)]
    asked = [f[1].withColumn("cohort", F.lit(c)) for f, c in zip(frames, ("tune", "report"), strict=True)]
    return cut(users[0].unionByName(users[1]), "per_user"), cut(asked[0].unionByName(asked[1]), "asked")


@query(
    "replay_metrics",
    f"""WITH {PER_USER} SELECT cohort, model, "user", hit, round(ndcg, 6) AS ndcg, near_lang, near_org FROM pu""",
)
def _(spark, sf):
    return both_cohorts(spark, sf)[0].withColumn("ndcg", F.round("ndcg", 6))


@query(
    "history_bins",
    f"""WITH {Q} SELECT "user", CASE WHEN n_history = 0 THEN '0' WHEN n_history <= 5 THEN '1-5' WHEN n_history <= 20 THEN '6-20' ELSE '20+' END AS bin FROM q""",
)
def _(spark, sf):
    q = queries_of(spark, sf, TUNE)[1]
    return q.select("user", rp.history_bin(F.col("n_history")).alias("bin"))


def query_rows_sql(tag: str, name: str) -> str:
    return f"""SELECT '{name}' AS cohort, c."user", count(p.repo_id) AS n_history, NOT coalesce(bool_or(cat.item = c.repo_id), false) AS is_new
  FROM co_{tag} c LEFT JOIN prof_{tag} p ON p."user" = c."user" LEFT JOIN cat ON cat.repo_id = p.repo_id GROUP BY 1, 2"""


REPORT_ROWS = f"""{PER_USER}, qs AS (SELECT *, CASE WHEN n_history = 0 THEN '0' WHEN n_history <= 5 THEN '1-5' WHEN n_history <= 20 THEN '6-20' ELSE '20+' END AS bin FROM (
  {query_rows_sql('t', 'tune')} UNION ALL {query_rows_sql('r', 'report')})),
sub AS (SELECT cohort, "user", unnest(CASE WHEN is_new THEN ['all', 'new repo', 'history ' || bin, 'new repo, history ' || bin] ELSE ['all', 'history ' || bin] END) AS queries FROM qs)"""


@query(
    "replay_report",
    f"""WITH {REPORT_ROWS} SELECT cohort, model, queries, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg,
    round(avg(near_lang), 6) AS near_lang, round(avg(near_org), 6) AS near_org FROM pu JOIN sub USING (cohort, "user") GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    users, asked = both_cohorts(spark, sf)
    d = rp.replay_report(users, asked)
    return d.withColumns({m: F.round(m, 6) for m in METRICS})


@query(
    "replay_cis",
    f"""WITH {REPORT_ROWS}, val AS MATERIALIZED (SELECT cohort, queries, model AS series, "user", ndcg AS value FROM pu JOIN sub USING (cohort, "user") WHERE queries IN ('all', 'new repo')),
    {boot_sql('val', 'cohort, queries')}, pr AS (SELECT DISTINCT cohort, queries, 'mean' AS a, 'popularity' AS b FROM val), {interval_sql('cohort, queries', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    v = rp.interval_values(*both_cohorts(spark, sf))
    by = ["cohort", "queries"]
    pairs = v.select(*by, F.lit("mean").alias("a"), F.lit("popularity").alias("b")).distinct()
    return rounded(paired_intervals(v, pairs, by, 1_000))


# serving ladder -----------------------------------------------------------------------------------
def ladder_sql(tag: str) -> str:
    ks = ", ".join(f"(CAST({k} AS BIGINT))" for k in rp.LADDER_K)
    bs = ", ".join(f"(CAST({b} AS DOUBLE))" for b in rp.LADDER_BETA)
    return f"""z_{tag} AS (SELECT *, (sm - avg(sm) OVER u) / (stddev_pop(sm) OVER u + 1e-9) AS zm, (st - avg(st) OVER u) / (stddev_pop(st) OVER u + 1e-9) AS zt
  FROM sc_{tag} WINDOW u AS (PARTITION BY "user")),
la_{tag} AS (SELECT DISTINCT p."user", lang FROM pi_{tag} p JOIN cat USING (item) WHERE lang <> ''), nn_{tag} AS (SELECT "user", count(*) AS n FROM pi_{tag} GROUP BY 1),
ls_{tag} AS (SELECT k, beta, z."user", z.item, z.lang, z.owner, round(least(1.0, coalesce(n, 0) / CAST(k AS DOUBLE)) * zm + (1 - least(1.0, coalesce(n, 0) / CAST(k AS DOUBLE))) * zt
    + beta * (CASE WHEN la.lang IS NOT NULL THEN 1 ELSE 0 END) + tie, 12) AS score
  FROM z_{tag} z LEFT JOIN nn_{tag} USING ("user") LEFT JOIN la_{tag} la ON la."user" = z."user" AND la.lang = z.lang, (VALUES {ks}) a(k), (VALUES {bs}) b(beta)),
lt_{tag} AS (SELECT *, row_number() OVER (PARTITION BY k, beta, "user" ORDER BY score DESC, item) AS rank FROM ls_{tag} QUALIFY rank <= 20),
lm_{tag} AS MATERIALIZED ({metrics_sql(f'lt_{tag}', f'co_{tag}', 't.k, t.beta')})"""


LADDER = f"{cohorts_sql()}, {ladder_sql('t')}, {ladder_sql('r')}"


def ladder(spark, sf, window):
    cat, queries, items = queries_of(spark, sf, window)
    vec, _ = vectors(cat, spark, sf)
    mean = lambda c: vs.history_mean(items, vec.select("item", F.col(c).alias("vec")), DIM)
    languages = items.join(cat.select("item", "language"), "item").select("user", "language")
    top = rp.ladder_topk(
        queries.select("user", F.col("n_profile").alias("n")), mean("model_vec"), mean("text_vec"), languages, vec, DIM, DIM
    )
    rungs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(b)).alias("beta")) for k in rp.LADDER_K for b in rp.LADDER_BETA]))
    asked = queries.withColumn("r", rungs).select("r.k", "r.beta", *queries.columns)
    return rp.replay_metrics(cut(top, "rungs"), asked, cat, by=("k", "beta"))


@query(
    "ladder_grid",
    f"""WITH {LADDER} SELECT k, beta, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg, round(avg(near_lang), 6) AS near_lang,
    round(avg(near_org), 6) AS near_org FROM lm_t GROUP BY 1, 2""",
)
def ladder_grid(spark, sf):
    d = ladder(spark, sf, TUNE).groupBy("k", "beta")
    return d.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


@query(
    "ladder_choice",
    f"""WITH {LADDER}, g AS (SELECT t.k, t.beta, a, b FROM (SELECT k, beta, avg(ndcg) AS a FROM lm_t GROUP BY 1, 2) t JOIN (SELECT k, beta, avg(ndcg) AS b FROM lm_r GROUP BY 1, 2) r USING (k, beta)),
    o AS (SELECT *, row_number() OVER (ORDER BY round(a, 9) DESC, k, beta) = 1 AS is_best FROM g)
    SELECT k, beta, round(a, 6) AS tune_ndcg, round(b, 6) AS report_ndcg, is_best FROM o WHERE is_best OR (k = 3 AND beta = CAST(0.15 AS DOUBLE))""",
)
def _(spark, sf):
    frames = [ladder(spark, sf, w).withColumn("cohort", F.lit(c)) for w, c in ((TUNE, "tune"), (REPORT, "report"))]
    d = rp.choose_rung(frames[0].unionByName(frames[1]))
    return d.withColumns({c: F.round(c, 6) for c in ("tune_ndcg", "report_ndcg")})


@query(
    "ladder_ci",
    f"""WITH {LADDER}, g AS (SELECT k, beta, avg(ndcg) AS a FROM lm_t GROUP BY 1, 2),
    o AS (SELECT k, beta FROM g ORDER BY round(a, 9) DESC, k, beta LIMIT 1),
    val AS MATERIALIZED (SELECT 'report' AS cohort, 'tuned' AS series, "user", ndcg AS value FROM lm_r JOIN o USING (k, beta)
      UNION ALL SELECT 'report', 'serving', "user", ndcg FROM lm_r WHERE k = 3 AND beta = CAST(0.15 AS DOUBLE)),
    {boot_sql('val', 'cohort')}, pr AS (SELECT 'report' AS cohort, 'tuned' AS a, 'serving' AS b), {interval_sql('cohort', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    frames = [ladder(spark, sf, w).withColumn("cohort", F.lit(c)) for w, c in ((TUNE, "tune"), (REPORT, "report"))]
    v = rp.tuned_values(cut(frames[0].unionByName(frames[1]), "rungs"))
    pairs = spark.createDataFrame([("report", "tuned", "serving")], "cohort string, a string, b string")
    return rounded(paired_intervals(v, pairs, ["cohort"], 1_000))


@query(
    "ladder_report",
    f"""WITH {PER_USER}, {ladder_sql('t')}, {ladder_sql('r')}, g AS (SELECT t.k, t.beta, a, b FROM (SELECT k, beta, avg(ndcg) AS a FROM lm_t GROUP BY 1, 2) t JOIN (SELECT k, beta, avg(ndcg) AS b FROM lm_r GROUP BY 1, 2) r USING (k, beta)),
    best AS (SELECT * FROM g ORDER BY round(a, 9) DESC, k, beta LIMIT 1),
    rep AS (SELECT 'serving' AS ladder, k, beta, a, b FROM g WHERE k = 3 AND beta = CAST(0.15 AS DOUBLE) UNION ALL SELECT 'tuned', k, beta, a, b FROM best
      UNION ALL SELECT 'model alone', NULL, NULL, avg(ndcg) FILTER (cohort = 'tune'), avg(ndcg) FILTER (cohort = 'report') FROM pu WHERE model = 'mean')
    SELECT ladder, coalesce(k, -1) AS k, coalesce(beta, -1) AS beta, round(a, 6) AS tune_ndcg, round(b, 6) AS report_ndcg FROM rep""",
)
def _(spark, sf):
    frames = [ladder(spark, sf, w).withColumn("cohort", F.lit(c)) for w, c in ((TUNE, "tune"), (REPORT, "report"))]
    d = rp.ladder_report(cut(frames[0].unionByName(frames[1]), "rungs"), both_cohorts(spark, sf)[0], "mean")
    missing = [F.coalesce(c, F.lit(-1).cast(t)).alias(c) for c, t in (("k", "long"), ("beta", "double"))]
    return d.select("ladder", *missing, *[F.round(c, 6).alias(c) for c in ("tune_ndcg", "report_ndcg")])


# issue replay: suppliers as repositories, order lines as issues ------------------------------------
LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
ISSUE_LABELS = """CASE o_orderpriority WHEN '1-URGENT' THEN ['good first issue', 'docs'] WHEN '2-HIGH' THEN ['Level: Medium', 'python']
  WHEN '3-MEDIUM' THEN ['hard', 'ci/test'] WHEN '4-NOT SPECIFIED' THEN ['enhancement'] ELSE ['Easy', 'sql', 'docs'] END"""
ISSUES = f"""iss AS (SELECT l_suppkey AS repo_id, l_orderkey * 10 + l_linenumber AS number, CAST(epoch(o_orderdate) AS BIGINT) AS created,
  CASE WHEN l_returnflag <> 'N' THEN CAST(epoch(l_shipdate) AS BIGINT) ELSE CAST(epoch(l_shipdate) AS BIGINT) + 7776000 END AS closed, {ISSUE_LABELS} AS labels {LINES}),
cases AS (SELECT l_suppkey AS repo_id, l_orderkey * 10 + l_linenumber AS "case", o_custkey AS "user", CAST(epoch(l_shipdate) AS BIGINT) - 43200 AS t {LINES} WHERE l_linenumber = 1 AND l_returnflag = 'R'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey) = 1)"""
OPEN = f"""{ISSUES}, op AS MATERIALIZED (SELECT c."case", c."user", c.repo_id, c.t, i.number, i.created, i.closed, i.labels, i.number = c."case" AS is_linked
  FROM cases c JOIN iss i ON i.repo_id = c.repo_id AND i.created < c.t AND (i.closed IS NULL OR i.closed > c.t))"""


def issue_tables(spark, sf):
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    base = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    p = F.col("o_orderpriority")
    labels = (
        F.when(p == "1-URGENT", F.array(F.lit("good first issue"), F.lit("docs")))
        .when(p == "2-HIGH", F.array(F.lit("Level: Medium"), F.lit("python")))
        .when(p == "3-MEDIUM", F.array(F.lit("hard"), F.lit("ci/test")))
        .when(p == "4-NOT SPECIFIED", F.array(F.lit("enhancement")))
        .otherwise(F.array(F.lit("Easy"), F.lit("sql"), F.lit("docs")))
    )
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    shipped = I.epoch("l_shipdate")
    issues = base.select(
        F.col("l_suppkey").alias("repo_id"),
        number.alias("number"),
        I.epoch("o_orderdate").alias("created"),
        F.when(F.col("l_returnflag") != "N", shipped).otherwise(shipped + 7_776_000).alias("closed"),
        labels.alias("labels"),
    )
    cases = (
        base.filter("l_linenumber = 1 AND l_returnflag = 'R'")
        .groupBy(number.alias("case"), F.col("o_custkey").alias("user"))
        .agg(F.min(F.struct((shipped - 43_200).alias("t"), F.col("l_suppkey").alias("repo_id"))).alias("f"))
        .select("f.repo_id", "case", "user", "f.t")
    )
    return issues, cases


def candidates(spark, sf):
    issues, cases = issue_tables(spark, sf)
    return iss.open_at(cases, iss.label_features(issues)).withColumn("is_linked", F.col("number") == F.col("case"))


@query("open_issues_at", f'WITH {OPEN} SELECT "case", "user", repo_id, t, number, created, is_linked FROM op')
def _(spark, sf):
    return candidates(spark, sf).select("case", "user", "repo_id", "t", "number", "created", "is_linked")


SKILLS_OF = """CASE label WHEN 'docs' THEN 'documentation' WHEN 'python' THEN 'python' WHEN 'sql' THEN 'sql' WHEN 'ci' THEN 'ci' WHEN 'test' THEN 'testing' END"""
FEATURES = f"""{OPEN}, us AS (SELECT o_custkey AS "user", ['python', CASE WHEN o_custkey % 2 = 0 THEN 'documentation' ELSE 'sql' END, lower(c_mktsegment)] AS sk FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey),
rl AS (SELECT s_suppkey AS repo_id, CASE WHEN s_nationkey % 3 = 0 THEN 'Building' WHEN s_nationkey % 3 = 1 THEN 'SQL' ELSE '' END AS language FROM supplier),
fe0 AS (SELECT op.*, sk, list_distinct(list_filter(list_concat(CASE WHEN contains(labels[1], 'docs') OR list_contains(labels, 'docs') THEN ['documentation'] ELSE [] END,
    CASE WHEN list_contains(labels, 'python') THEN ['python'] ELSE [] END, CASE WHEN list_contains(labels, 'sql') THEN ['sql'] ELSE [] END,
    CASE WHEN list_contains(labels, 'ci/test') THEN ['ci', 'testing'] ELSE [] END, [lower(language)]), lambda x: x <> '')) AS skills,
  CASE WHEN list_contains(labels, 'hard') THEN 0.0 - 0.2 WHEN list_contains(labels, 'Level: Medium') THEN 0.4 WHEN list_contains(labels, 'enhancement') THEN 0.5 ELSE 1.0 END AS diff
  FROM op JOIN us USING ("user") JOIN rl USING (repo_id)),
fe AS MATERIALIZED (SELECT "case", t, number, created, is_linked, CAST(diff AS DOUBLE) AS diff, least(1.0, len(list_intersect(skills, sk)) / CAST(greatest(1, least(len(skills), 4)) AS DOUBLE)) AS skill,
  greatest(0, (t - created) / CAST(86400 AS DOUBLE)) AS age FROM fe0)"""


def featured(spark, sf):
    users = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user"),
        F.array(
            F.lit("python"),
            F.when(F.col("c_custkey") % 2 == 0, "documentation").otherwise("sql"),
            F.lower("c_mktsegment"),
        ).alias("user_skills"),
    )
    n = F.col("s_nationkey") % 3
    repos = I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("repo_id"), F.when(n == 0, "Building").when(n == 1, "SQL").otherwise("").alias("language")
    )
    issues, cases = issue_tables(spark, sf)
    # profile and language belong to the case: joined before the candidates, which are many times the cases
    told = cases.join(unbounded(users), "user").join(unbounded(repos), "repo_id")
    joined = iss.open_at(told, iss.label_features(issues)).withColumn("is_linked", F.col("number") == F.col("case"))
    columns = ("case", "t", "number", "created", "is_linked", "diff", "skill", "age")
    return iss.issue_features(joined).select(*columns)


@query(
    "issue_features",
    f"""WITH {FEATURES} SELECT "case", number, round(diff, 6) AS diff, round(skill, 6) AS skill, round(age, 6) AS age FROM fe""",
)
def _(spark, sf):
    d = featured(spark, sf)
    return d.select("case", "number", *[F.round(c, 6).alias(c) for c in ("diff", "skill", "age")])


def score_sql(w: dict, source: str) -> str:
    return f"""round(CAST({w['diff']} AS DOUBLE) * diff + CAST({w['skill']} AS DOUBLE) * skill + CAST({w['recent']} AS DOUBLE) * exp(-age / CAST({w['half_life']} AS DOUBLE)), 9)"""


@query(
    "score_issues_at",
    f"""WITH {FEATURES} SELECT "case", number, {score_sql(iss.WEIGHTS_NOW, 'fe')} AS score FROM fe""",
)
def _(spark, sf):
    d = featured(spark, sf)
    return d.select("case", "number", F.round(iss.issue_score(iss.WEIGHTS_NOW), 9).alias("score"))


USABLE = f"""{FEATURES}, ok AS (SELECT "case" FROM fe GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (is_linked) >= 1), u AS MATERIALIZED (SELECT fe.* FROM fe JOIN ok USING ("case"))"""


def ranked_sql(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS ranker, "case", 1.0 / min(r) AS rr, CASE WHEN min(r) <= 1 THEN 1.0 ELSE 0.0 END AS hit1, CASE WHEN min(r) <= 3 THEN 1.0 ELSE 0.0 END AS hit3 FROM (
    SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY {score} DESC, created DESC, number DESC) AS r FROM u) WHERE is_linked GROUP BY 2"""


RANKERS = f"""{USABLE}, re AS (
  SELECT 'random' AS ranker, "case", (SELECT sum(1.0 / x) FROM range(1, n + 1) t(x)) / n AS rr, 1.0 / n AS hit1, least(3, n) / CAST(n AS DOUBLE) AS hit3 FROM (SELECT "case", CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1)
  UNION ALL {ranked_sql('newest', 'created')} UNION ALL {ranked_sql('weights', score_sql(iss.WEIGHTS_NOW, 'u'))})"""


def usable(spark, sf):
    return cut(iss.usable_cases(cut(featured(spark, sf), "features")), "usable")


@query(
    "issue_rank_eval",
    f"""WITH {RANKERS} SELECT ranker, count(*) AS n_cases, round(avg(rr), 6) AS mrr, round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3 FROM re GROUP BY 1""",
)
def issue_rank_eval(spark, sf):
    u = usable(spark, sf)
    scored = u.withColumn("score", iss.issue_score(iss.WEIGHTS_NOW))
    frames = (("random", iss.random_eval(u)), ("newest", iss.newest_eval(u)), ("weights", iss.rank_eval(scored)))
    out = None
    for name, d in frames:
        d = d.select(F.lit(name).alias("ranker"), "rr", "hit1", "hit3")
        out = d if out is None else out.unionByName(d)
    return out.groupBy("ranker").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg("hit1"), 6).alias("hit1"),
        F.round(F.avg("hit3"), 6).alias("hit3"),
    )


SPLIT_T = 915_148_800


def tune_sql() -> str:
    rows = ", ".join(
        f"({i}, CAST({g['diff']} AS DOUBLE), CAST({g['skill']} AS DOUBLE), CAST({g['recent']} AS DOUBLE), CAST({g['half_life']} AS DOUBLE))"
        for i, g in enumerate(iss.weight_grid())
    )
    return f"""{USABLE}, g AS (SELECT * FROM (VALUES {rows}) v(config, wd, ws, wr, hl)),
  s AS (SELECT config, "case", is_linked, row_number() OVER (PARTITION BY config, "case" ORDER BY round(wd * diff + ws * skill + wr * exp(-age / hl), 9) DESC, created DESC, number DESC) AS r FROM u, g WHERE t < {SPLIT_T}),
  m AS (SELECT config, avg(rr) AS mrr, count(*) AS n_cases FROM (SELECT config, "case", 1.0 / min(r) AS rr FROM s WHERE is_linked GROUP BY 1, 2) GROUP BY 1)
  SELECT config, round(mrr, 6) AS mrr, n_cases, row_number() OVER (ORDER BY round(mrr, 9) DESC, config DESC) = 1 AS best FROM m"""


@query("tune_issue_weights", f"WITH {tune_sql()}")
def tune_issue_weights(spark, sf):
    d = iss.tune_weights(usable(spark, sf).filter(F.col("t") < SPLIT_T))
    return d.withColumn("mrr", F.round("mrr", 6))


def tuned_report_sql() -> str:
    """Rankers on both cohorts with the weights that won on the first one."""
    base = tune_sql().rsplit("SELECT config,", 1)[0]
    return f"""{base.rstrip()}, bw AS (SELECT wd, ws, wr, hl FROM m JOIN g USING (config) ORDER BY round(mrr, 9) DESC, config DESC LIMIT 1),
  sx AS (SELECT u.*, CASE WHEN t < {SPLIT_T} THEN 'tune' ELSE 'report' END AS cohort, {score_sql(iss.WEIGHTS_NOW, 'u')} AS s_now, round(wd * diff + ws * skill + wr * exp(-age / hl), 9) AS s_best FROM u, bw),
  rx AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY s_now DESC, created DESC, number DESC) AS r_now, row_number() OVER (PARTITION BY "case" ORDER BY s_best DESC, created DESC, number DESC) AS r_best,
    row_number() OVER (PARTITION BY "case" ORDER BY created DESC, number DESC) AS r_new FROM sx),
  lx AS (SELECT cohort, "case", min(r_now) AS r_now, min(r_best) AS r_best, min(r_new) AS r_new FROM rx WHERE is_linked GROUP BY 1, 2),
  val AS MATERIALIZED (SELECT cohort, 'weights in service' AS series, "case" AS "user", 1.0 / r_now AS value FROM lx UNION ALL SELECT cohort, 'tuned', "case", 1.0 / r_best FROM lx UNION ALL SELECT cohort, 'newest', "case", 1.0 / r_new FROM lx)"""


@query(
    "tuned_issue_report",
    f"""WITH {tuned_report_sql()}, {boot_sql('val', 'cohort')}, pr AS (SELECT DISTINCT cohort, 'tuned' AS a, x AS b FROM val, (VALUES ('newest'), ('weights in service')) v(x)), {interval_sql('cohort', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    u = usable(spark, sf)
    best = iss.tune_weights(u.filter(F.col("t") < SPLIT_T)).filter("best").first()["config"]
    weights = {"weights in service": iss.WEIGHTS_NOW, "tuned": iss.weight_grid()[best]}
    cohort = F.when(F.col("t") < SPLIT_T, "tune").otherwise("report")
    cases = u.select("case", cohort.alias("cohort")).distinct()
    frames = [(n, iss.rank_eval(u.withColumn("score", iss.issue_score(w)))) for n, w in weights.items()]
    frames.append(("newest", iss.newest_eval(u)))
    out = None
    for name, d in frames:
        d = d.select("case", F.lit(name).alias("series"), F.col("rr").alias("value"))
        out = d if out is None else out.unionByName(d)
    v = cut(out.join(cases, "case").withColumnRenamed("case", "user"), "values")
    against = F.explode(F.array(F.lit("newest"), F.lit("weights in service"))).alias("b")
    pairs = v.select("cohort", F.lit("tuned").alias("a")).distinct().select("cohort", "a", against)
    return rounded(paired_intervals(v, pairs, ["cohort"], 1_000))


PRS = f"""c AS (SELECT DISTINCT o_custkey AS "user", o_custkey % 40 AS repo_id, CAST(epoch(o_orderdate) AS BIGINT) AS pr_ts FROM orders),
p AS (SELECT o_custkey AS "user", o_custkey % 40 AS repo_id, CAST(epoch(l_shipdate) AS BIGINT) AS created, CASE WHEN l_returnflag = 'N' THEN [] ELSE list_sort([l_partkey, l_suppkey]) END AS issues {LINES})"""


@query(
    "match_linked_prs",
    f"""WITH {PRS}, j AS (SELECT c.*, p.created, p.issues, row_number() OVER (PARTITION BY c."user", c.repo_id, c.pr_ts ORDER BY p.created, p.issues) AS r
      FROM c JOIN p ON p."user" = c."user" AND p.repo_id = c.repo_id AND abs(p.created - c.pr_ts) < 172800 WHERE len(p.issues) > 0)
    SELECT "user", repo_id, pr_ts, created, array_to_string(issues, ',') AS linked FROM j WHERE r = 1""",
)
def _(spark, sf):
    orders = I.table(spark, sf, "orders")
    cases = orders.select(
        F.col("o_custkey").alias("user"), (F.col("o_custkey") % 40).alias("repo_id"), I.epoch("o_orderdate").alias("pr_ts")
    ).distinct()
    lines = I.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    refs = F.when(F.col("l_returnflag") == "N", F.array().cast("array<bigint>")).otherwise(F.array("l_partkey", "l_suppkey"))
    prs = lines.select(
        F.col("o_custkey").alias("user"), (F.col("o_custkey") % 40).alias("repo_id"), I.epoch("l_shipdate").alias("created"), refs.alias("issues")
    )
    d = iss.match_linked_prs(cases, prs)
    return d.withColumn("linked", F.array_join(F.transform("linked", lambda x: x.cast("string")), ","))


# small rules -----------------------------------------------------------------------------------------
@query(
    "difficulty_rules",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 3 THEN 'easy' WHEN l_quantity <= 8 THEN 'medium' ELSE 'hard' END AS target,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'easy' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'hard' ELSE '-' END AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    q AS (SELECT *, list_position(['easy', 'medium', 'hard'], level) AS a, list_position(['easy', 'medium', 'hard'], target) AS b FROM p)
    SELECT l_orderkey, l_linenumber, target, round(CAST(CASE WHEN level = '-' THEN 0.5 WHEN a < b THEN 1 - 0.25 * (b - a) ELSE 1 - 0.6 * (a - b) END AS DOUBLE), 6) AS match FROM q""",
)
def _(spark, sf):
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    lines = I.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "easy").when(p == "2-HIGH", "medium").when(p == "3-MEDIUM", "hard")
    d = lines.withColumn("target", lf.target_difficulty(F.col("l_quantity")))
    return d.select("l_orderkey", "l_linenumber", "target", F.round(lf.difficulty_match(level, F.col("target")), 6).alias("match"))


@query(
    "age_days",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'N' THEN 365 ELSE greatest(0, (epoch(o_orderdate) + 5000000 - epoch(l_shipdate)) / 86400) END, 6) AS age
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = I.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ts = F.when(F.col("l_returnflag") != "N", I.epoch("l_shipdate"))
    age = lf.age_days(ts, I.epoch("o_orderdate") + 5_000_000)
    return lines.select("l_orderkey", "l_linenumber", F.round(age, 6).alias("age"))


@query(
    "zscore_over_candidates",
    """WITH v AS (SELECT l_suppkey AS "user", l_orderkey * 10 + l_linenumber AS item, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)
    SELECT "user", item, round((x - avg(x) OVER u) / (stddev_pop(x) OVER u + 1e-9), 6) + 0.0 AS z FROM v WINDOW u AS (PARTITION BY "user")""",
)
def _(spark, sf):
    v = I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("user"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_extendedprice").alias("x")
    )
    d = zscore(v, ["user"], "x", "z")
    return d.select("user", "item", (F.round("z", 6) + 0.0).alias("z"))
