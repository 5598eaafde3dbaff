"""Ratings, splits, popularity and item-neighbour queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from tidemark.operators import evaluation as ev
from tidemark.operators import interactions as ia
from tidemark.operators import neighbours as nb
from tidemark.operators import popularity as pp
from tidemark.operators import split as sp
from tidemark.operators.statistics import dataset_stats, tie_stats
from tidemark.scale import cut


@query(
    "read_ratings_first_per_pair",
    f'WITH {I.RATINGS} SELECT "user", item, rating, ts FROM ratings',
)
def _(spark, sf):
    return I.ratings(spark, sf)


@query(
    "to_implicit",
    f'WITH {I.IMPLICIT} SELECT "user", item, ts FROM implicit',
)
def _(spark, sf):
    return I.implicit(spark, sf)


@query(
    "chronological_order",
    f'WITH {I.SPLIT} SELECT "user", item, ts, seq FROM split',
)
def _(spark, sf):
    return sp.chronological_order(I.implicit(spark, sf))


@query(
    "split_sizes",
    f"""WITH {I.SPLIT} SELECT "user", count(*) AS n, count(*) FILTER (part = 'train') AS n_train,
    count(*) FILTER (part = 'val') AS n_val, count(*) FILTER (part = 'test') AS n_test
    FROM split GROUP BY 1""",
)
def _(spark, sf):
    n = I.implicit(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    tr, va, te = sp.split_sizes(F.col("n"))
    return n.select("user", "n", tr.alias("n_train"), va.alias("n_val"), te.alias("n_test"))


@query(
    "chronological_split",
    f'WITH {I.SPLIT} SELECT "user", item, ts, seq, part FROM split',
)
def _(spark, sf):
    return sp.chronological_split(I.implicit(spark, sf))


@query("item_popularity", f"WITH {I.SPLIT}, {I.POP} SELECT item, pop FROM pop")
def _(spark, sf):
    s = I.split(spark, sf)
    return pp.item_popularity(s.filter("part = 'train'"), s)


@query(
    "head_items",
    f"""WITH {I.SPLIT}, {I.POP} SELECT item, pop,
    row_number() OVER (ORDER BY pop DESC, item) <= ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM pop)) AS is_head FROM pop""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    return pp.head_items(pp.item_popularity(s.filter("part = 'train'"), s))


POP_TOP = f"""{I.SPLIT}, {I.POP}, tgt AS (SELECT DISTINCT "user", item FROM split WHERE part = 'test'),
seen AS (SELECT DISTINCT "user", item FROM split WHERE part <> 'test'),
top AS (SELECT * FROM (
  SELECT u."user", p.item, p.pop AS score, row_number() OVER (PARTITION BY u."user" ORDER BY p.pop DESC, p.item) AS rank
  FROM (SELECT DISTINCT "user" FROM tgt) u CROSS JOIN pop p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = u."user" AND s.item = p.item)) WHERE rank <= 20)"""


def popularity_top(spark, sf, mode="test"):
    s = I.split(spark, sf)
    ranked, _ = pp.ranked_items(pp.item_popularity(s.filter("part = 'train'"), s))
    users = ev.targets_of(s, mode).select("user").distinct()
    return s, pp.popularity_topk(users, ev.seen_of(s, mode), ranked)


@query(
    "popularity_topk",
    f'WITH {POP_TOP} SELECT "user", item, CAST(score AS DOUBLE) AS score, rank FROM top',
)
def _(spark, sf):
    return popularity_top(spark, sf)[1].withColumn("rank", F.col("rank").cast("long"))


@query(
    "popularity_ranking_metrics",
    f"""WITH {POP_TOP}, {I.METRICS} SELECT round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg,
    round(avg(hit), 6) AS hit, count(*) AS n_users FROM met""",
)
def popularity_benchmark(spark, sf):
    s, top = popularity_top(spark, sf)
    per_user = ev.ranking_metrics(top, ev.targets_of(s, "test"))
    return per_user.agg(
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
        F.round(F.avg("hit"), 6).alias("hit"),
        F.count(F.lit(1)).alias("n_users"),
    )


# cores, ids, splits ---------------------------------------------------------------------------
def core_sql(source: str, k: int, passes: int) -> str:
    """Unrolled core passes over `source`; a converged pass repeats its input."""
    steps, prev = [], source
    for i in range(passes):
        steps.append(
            f"""core{i} AS MATERIALIZED (SELECT * EXCLUDE (nu, ni) FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS nu,
  count(*) OVER (PARTITION BY item) AS ni FROM {prev}) WHERE nu >= {k} AND ni >= {k})"""
        )
        prev = f"core{i}"
    return ", ".join(steps)


CORE_PASSES = 40
CORE = I.IMPLICIT + ", " + core_sql("implicit", 9, CORE_PASSES)
LAST = f"core{CORE_PASSES - 1}"


@query("k_core", f'WITH {CORE} SELECT "user", item, ts FROM {LAST}')
def _(spark, sf):
    return ia.k_core(I.implicit(spark, sf), 9)


@query(
    "remap_ids",
    f"""WITH {I.IMPLICIT} SELECT dense_rank() OVER (ORDER BY "user") - 1 AS "user",
    dense_rank() OVER (ORDER BY item) - 1 AS item, ts FROM implicit""",
)
def _(spark, sf):
    return ia.remap_ids(I.implicit(spark, sf))[0]


@query(
    "remap_split",
    f"""WITH {I.SPLIT} SELECT dense_rank() OVER (ORDER BY "user") - 1 AS "user",
    dense_rank() OVER (ORDER BY item) - 1 AS item, part, seq FROM split""",
)
def _(spark, sf):
    return ia.remap_split(I.split(spark, sf))[0].select("user", "item", "part", "seq")


HEAVY_START = 852_076_800  # 1997-01-01


@query(
    "drop_heavy_users",
    f"""WITH {I.IMPLICIT} SELECT "user", item, ts FROM implicit WHERE "user" NOT IN
    (SELECT "user" FROM implicit WHERE ts < {HEAVY_START} GROUP BY 1 HAVING count(*) > 6)""",
)
def _(spark, sf):
    return ia.drop_heavy_users(I.implicit(spark, sf), 6, HEAVY_START)


VAL_CUT, TEST_CUT = 946_684_800, 962_409_600  # 2000-01-01, 2000-07-01
GTS = (
    I.IMPLICIT
    + f""", dated AS (SELECT *, CASE WHEN ts < {VAL_CUT} THEN 'train' WHEN ts < {TEST_CUT} THEN 'val' ELSE 'test' END AS part FROM implicit),
g_train AS (SELECT * FROM dated WHERE part = 'train'), """
    + core_sql("g_train", 5, CORE_PASSES)
)


@query(
    "global_temporal_split",
    f"""WITH {GTS} SELECT "user", item, ts, part FROM {LAST} UNION ALL
    SELECT "user", item, ts, part FROM dated d WHERE part <> 'train'
    AND "user" IN (SELECT "user" FROM {LAST})
    AND (item IN (SELECT item FROM {LAST}) OR item IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO'))
    AND NOT EXISTS (SELECT 1 FROM {LAST} c WHERE c."user" = d."user" AND c.item = d.item)""",
)
def _(spark, sf):
    cold = I.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("item"))
    return sp.global_temporal_split(I.implicit(spark, sf), VAL_CUT, TEST_CUT, 5, cold)


@query(
    "sample_users",
    f"""WITH {I.IMPLICIT} SELECT "user" FROM (SELECT DISTINCT "user" FROM implicit)
    ORDER BY md5('0,' || "user"), "user" LIMIT 300""",
)
def _(spark, sf):
    return sp.sample_users(I.implicit(spark, sf), 300)


@query(
    "ordered_histories",
    f"""WITH {I.SPLIT} SELECT "user", CAST(0 AS BIGINT) AS piece, string_agg(CAST(item AS VARCHAR), ',' ORDER BY seq) AS items
    FROM split GROUP BY 1""",
)
def _(spark, sf):
    h = sp.ordered_histories(I.split(spark, sf))
    return h.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


HEADS = f"""heads AS (SELECT item, pop, row_number() OVER (ORDER BY pop DESC, item)
  <= ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM pop)) AS is_head FROM pop)"""


@query(
    "dataset_stats",
    f"""WITH {I.SPLIT}, {I.POP}, {HEADS}, pu AS (SELECT "user", count(*) AS n, count(*) FILTER (part = 'train') AS tr,
      count(*) FILTER (part = 'val') AS va, count(*) FILTER (part = 'test') AS te FROM split GROUP BY 1),
    it AS (SELECT count(*) AS n_items, count(*) FILTER (is_head) AS n_head_items, count(*) FILTER (NOT is_head) AS n_tail_items,
      CAST(sum(pop) FILTER (is_head) AS DOUBLE) / sum(pop) AS head_share, count(*) FILTER (pop = 0) AS items_without_train FROM heads)
    SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_pairs, min(n) AS min_per_user,
      CAST(quantile_cont(CAST(n AS DOUBLE), 0.5) AS DOUBLE) AS median_per_user, max(n) AS max_per_user,
      CAST(sum(tr) AS BIGINT) AS n_train, CAST(sum(va) AS BIGINT) AS n_val, CAST(sum(te) AS BIGINT) AS n_test,
      count(*) FILTER (va > 0) AS users_with_val, count(*) FILTER (te > 0) AS users_with_test,
      any_value(n_items) AS n_items, any_value(n_head_items) AS n_head_items, any_value(n_tail_items) AS n_tail_items,
      round(any_value(head_share), 6) AS head_share, any_value(items_without_train) AS items_without_train,
      round(sum(n) / (CAST(count(*) AS DOUBLE) * any_value(n_items)), 6) AS density FROM pu, it""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    d = dataset_stats(s, pp.head_items(pp.item_popularity(s.filter("part = 'train'"), s)))
    return d.withColumns({"head_share": F.round("head_share", 6), "density": F.round("density", 6)})


@query(
    "tie_stats",
    f"""WITH {I.SPLIT}, t AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY "user", ts) > 1 THEN 1.0 ELSE 0.0 END AS tied FROM split),
    pu AS (SELECT "user", avg(tied) AS share, coalesce(max(ts) FILTER (part = 'train') = min(ts) FILTER (part = 'val'), false) AS tv,
      coalesce(max(ts) FILTER (part = 'val') = min(ts) FILTER (part = 'test'), false) AS vt FROM t GROUP BY 1)
    SELECT round((SELECT avg(tied) FROM t), 6) AS share_tied, round(avg(share), 6) AS user_share_mean,
      round(quantile_cont(CAST(share AS DOUBLE), 0.5), 6) AS user_share_median,
      round(avg(CASE WHEN share > 0 THEN 1.0 ELSE 0.0 END), 6) AS users_with_tie_share,
      count(*) FILTER (tv) AS train_val_boundary, count(*) FILTER (vt) AS val_test_boundary,
      count(*) FILTER (tv OR vt) AS any_boundary FROM pu""",
)
def _(spark, sf):
    d = tie_stats(I.split(spark, sf))
    names = ("share_tied", "user_share_mean", "user_share_median", "users_with_tie_share")
    return d.withColumns({c: F.round(c, 6) for c in names})


# item neighbours ------------------------------------------------------------------------------
CO = f"""{I.SPLIT}, tr AS MATERIALIZED (SELECT DISTINCT "user", item FROM split WHERE part = 'train'),
co AS (SELECT a.item AS i, b.item AS j, count(*) AS co FROM tr a JOIN tr b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2)"""


def sim_sql(k: int, shrink: float) -> str:
    return f"""deg AS (SELECT item, count(*) AS n FROM tr GROUP BY 1),
sim0 AS (SELECT c.j AS item, c.i AS neighbour,
    c.co / (sqrt(CAST(least(a.n, b.n) AS DOUBLE)) * sqrt(CAST(greatest(a.n, b.n) AS DOUBLE)) + CAST({shrink} AS DOUBLE) + CAST(1e-12 AS DOUBLE)) AS sim
  FROM co c JOIN deg a ON a.item = c.i JOIN deg b ON b.item = c.j),
sim AS MATERIALIZED (SELECT *, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, neighbour) AS rank FROM sim0) WHERE rank <= {k})"""


@query("cooccurrence", f"WITH {CO} SELECT i, j, co FROM co WHERE i < j")
def _(spark, sf):
    return nb.cooccurrence(I.split(spark, sf).filter("part = 'train'"))


@query(
    "itemknn_fit",
    f"WITH {CO}, {sim_sql(100, 10)} SELECT item, neighbour, round(sim, 9) AS sim, rank FROM sim",
)
def _(spark, sf):
    d = nb.itemknn_fit(I.split(spark, sf).filter("part = 'train'"))
    return d.select("item", "neighbour", F.round("sim", 9).alias("sim"), F.col("rank").cast("long").alias("rank"))


KNN_SCORE = f"""{CO}, {sim_sql(100, 10)}, knn AS (SELECT c."user", s.item, sum(s.sim) AS score
  FROM tr c JOIN sim s ON s.neighbour = c.item GROUP BY 1, 2)"""


@query("itemknn_score", f'WITH {KNN_SCORE} SELECT "user", item, round(score, 6) AS score FROM knn')
def _(spark, sf):
    train = I.split(spark, sf).filter("part = 'train'")
    return nb.itemknn_score(train, nb.itemknn_fit(train)).withColumn("score", F.round("score", 6))


TGT = """tgt AS (SELECT DISTINCT "user", item FROM split WHERE part = 'test'),
seen AS (SELECT DISTINCT "user", item FROM split WHERE part <> 'test')"""


def full_top(scores: str) -> str:
    return f"""top AS MATERIALIZED (SELECT * FROM (SELECT u."user", i.item, coalesce(k.score, 0) AS score,
    row_number() OVER (PARTITION BY u."user" ORDER BY round(coalesce(k.score, 0), 9) DESC, i.item) AS rank
  FROM (SELECT DISTINCT "user" FROM tgt) u CROSS JOIN (SELECT DISTINCT item FROM split) i
  LEFT JOIN {scores} k ON k."user" = u."user" AND k.item = i.item
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = u."user" AND s.item = i.item)) WHERE rank <= 20)"""


def knn_top(s, context_parts=("train",), mode="test"):
    """Masked full-catalog top 20 of the fitted neighbour model."""
    train = s.filter("part = 'train'")
    targets, seen = ev.targets_of(s, mode), ev.seen_of(s, mode)
    context = s.filter(F.col("part").isin(list(context_parts)))
    scores = nb.itemknn_topk(context, nb.itemknn_fit(train), targets, seen)
    index = ia.id_map(s, "item").select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    return cut(nb.fill_topk(scores, targets, seen, index), "top")


@query(
    "mask_seen",
    f"""WITH {KNN_SCORE}, {TGT} SELECT "user", item, round(score, 6) AS score FROM knn k
    WHERE "user" IN (SELECT "user" FROM tgt) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = k."user" AND s.item = k.item)""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    train = s.filter("part = 'train'")
    scores = partial(nb.itemknn_score, train, nb.itemknn_fit(train))
    return ev.mask_seen(scores, s, "test").select("user", "item", F.round("score", 6).alias("score"))


KNN_TOP = f"{KNN_SCORE}, {TGT}, {full_top('knn')}"


@query(
    "itemknn_topk",
    f'WITH {KNN_TOP} SELECT "user", item, round(score, 6) AS score, rank FROM top',
)
def _(spark, sf):
    top = knn_top(I.split(spark, sf))
    return top.select("user", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


EVAL_SQL = f"""{I.POP}, {HEADS}, {I.METRICS},
slots AS (SELECT t.item, pop, is_head FROM top t JOIN heads USING (item)),
st AS (SELECT CASE WHEN is_head THEN 'head' ELSE 'tail' END AS slice, "user", item FROM tgt JOIN heads USING (item)
  UNION ALL SELECT 'cold', "user", item FROM tgt JOIN heads USING (item) WHERE pop = 0),
sm AS (SELECT slice, "user", CAST(hits AS DOUBLE) / nt AS recall, dcg / ideal AS ndcg FROM (
  SELECT st.slice, st."user", count(*) AS nt, count(rank) AS hits, coalesce(sum(1.0 / log2(CAST(rank AS DOUBLE) + 1)), 0) AS dcg
  FROM st LEFT JOIN top USING ("user", item) GROUP BY 1, 2) JOIN idcg ON idcg.n = least(nt, 20)),
ov AS (SELECT avg(recall) AS recall, avg(ndcg) AS ndcg, avg(hit) AS hit, count(*) AS n_users FROM met),
q AS (SELECT CAST(count(DISTINCT item) AS DOUBLE) / (SELECT count(*) FROM pop) AS coverage, avg(pop) AS avg_pop,
  avg(CASE WHEN is_head THEN 0.0 ELSE 1.0 END) AS lts FROM slots),
sl AS (SELECT slice, avg(recall) AS recall, avg(ndcg) AS ndcg, count(*) AS n_users FROM sm GROUP BY 1),
ev_out AS (
SELECT 'overall' AS part, 'recall' AS metric, recall AS value FROM ov UNION ALL SELECT 'overall', 'ndcg', ndcg FROM ov
UNION ALL SELECT 'overall', 'hit', hit FROM ov UNION ALL SELECT 'overall', 'n_users', n_users FROM ov
UNION ALL SELECT 'overall', 'coverage', coverage FROM q UNION ALL SELECT 'overall', 'avg_pop', avg_pop FROM q
UNION ALL SELECT 'overall', 'long_tail_share', lts FROM q
UNION ALL SELECT slice, 'recall', recall FROM sl UNION ALL SELECT slice, 'ndcg', ndcg FROM sl UNION ALL SELECT slice, 'n_users', n_users FROM sl)"""


def heads_of(s):
    return cut(pp.head_items(pp.item_popularity(s.filter("part = 'train'"), s)), "heads")


def rounded_eval(s, top):
    heads = heads_of(s)
    d = ev.evaluate(top, ev.targets_of(s, "test"), heads, heads.count())
    return d.select("part", "metric", F.round("value", 6).alias("value"))


@query(
    "evaluate_popularity",
    f"WITH {POP_TOP}, {EVAL_SQL.replace(I.POP + ', ', '')} SELECT part, metric, round(CAST(value AS DOUBLE), 6) AS value FROM ev_out",
)
def _(spark, sf):
    s, top = popularity_top(spark, sf)
    return rounded_eval(s, cut(top, "top"))


@query(
    "evaluate_itemknn",
    f"WITH {KNN_TOP}, {EVAL_SQL} SELECT part, metric, round(CAST(value AS DOUBLE), 6) AS value FROM ev_out",
)
def _(spark, sf):
    s = I.split(spark, sf)
    return rounded_eval(s, knn_top(s))


FOLD_TOP = KNN_TOP.replace("FROM tr c JOIN sim", "FROM seen c JOIN sim").replace(
    f", {TGT}", ""
).replace(", knn AS", f", {TGT}, knn AS")


@query(
    "fold_in_itemknn",
    f"""WITH {FOLD_TOP}, {EVAL_SQL} SELECT part, metric, round(CAST(value AS DOUBLE), 6) AS value FROM ev_out""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    return rounded_eval(s, knn_top(s, ("train", "val")))


PER_USER_SQL = f"""{EVAL_SQL}, per_user AS (SELECT m."user", m.recall, m.ndcg, m.hit, c.recall AS cold_recall, c.ndcg AS cold_ndcg
  FROM met m LEFT JOIN (SELECT * FROM sm WHERE slice = 'cold') c USING ("user"))"""


@query(
    "per_user_metrics",
    f"""WITH {KNN_TOP}, {PER_USER_SQL} SELECT "user", round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, hit,
    round(coalesce(cold_recall, -1), 6) AS cold_recall, round(coalesce(cold_ndcg, -1), 6) AS cold_ndcg FROM per_user""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    d = ev.per_user_table(knn_top(s), ev.targets_of(s, "test"), heads_of(s))
    none = F.lit(-1.0)
    return d.select(
        "user",
        F.round("recall", 6).alias("recall"),
        F.round("ndcg", 6).alias("ndcg"),
        "hit",
        F.round(F.coalesce("cold_recall", none), 6).alias("cold_recall"),
        F.round(F.coalesce("cold_ndcg", none), 6).alias("cold_ndcg"),
    )


@query(
    "slice_metrics",
    f"""WITH {KNN_TOP}, {EVAL_SQL} SELECT slice, "user", round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM sm""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    d = ev.slice_metrics(knn_top(s), ev.targets_of(s, "test"), heads_of(s))
    return d.select("slice", "user", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query(
    "costar_neighbours",
    f"""WITH {I.IMPLICIT}, tr AS MATERIALIZED (SELECT DISTINCT "user", item FROM implicit),
    co AS (SELECT a.item AS i, b.item AS j, count(*) AS co FROM tr a JOIN tr b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
    deg AS (SELECT item, count(*) AS n FROM tr GROUP BY 1),
    s AS (SELECT c.j AS item, c.i AS neighbour, co, row_number() OVER (PARTITION BY c.j ORDER BY
      c.co / (sqrt(CAST(least(a.n, b.n) AS DOUBLE)) * sqrt(CAST(greatest(a.n, b.n) AS DOUBLE)) + CAST(30 AS DOUBLE)) DESC, c.i) AS rank
      FROM co c JOIN deg a ON a.item = c.i JOIN deg b ON b.item = c.j)
    SELECT item, neighbour, co, rank FROM s WHERE rank <= 10 AND co >= 2""",
)
def _(spark, sf):
    d = nb.costar_neighbours(cut(I.implicit(spark, sf)))
    return d.select("item", "neighbour", "co", F.col("rank").cast("long").alias("rank"))


@query(
    "warm_items",
    f"WITH {I.SPLIT} SELECT DISTINCT item FROM split WHERE part = 'train'",
)
def _(spark, sf):
    return pp.warm_items(I.split(spark, sf).filter("part = 'train'"))
