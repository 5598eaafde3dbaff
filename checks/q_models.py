"""Graph, vector, sampling and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_benchmark import EVAL_SQL, TGT, heads_of, rounded_eval
from checks.registry import query
from tidemark.operators import evaluation as ev
from tidemark.operators import graph as gr
from tidemark.operators import interactions as ia
from tidemark.operators import popularity as pp
from tidemark.operators import textvectors as tv
from tidemark.operators import training as tr
from tidemark.operators import vectorindex as vi
from tidemark.operators import vectorscore as vs
from tidemark.scale import cut

DIM = 64
TRAIN = f"""{I.SPLIT}, tr AS MATERIALIZED (SELECT DISTINCT "user", item FROM split WHERE part = 'train')"""
ADJ = f"""{TRAIN}, adj AS MATERIALIZED (SELECT "user", item, 1.0 / sqrt(CAST(du AS DOUBLE) * di) AS w FROM tr
  JOIN (SELECT "user", count(*) AS du FROM tr GROUP BY 1) USING ("user") JOIN (SELECT item, count(*) AS di FROM tr GROUP BY 1) USING (item))"""


def embeddings(spark, sf):
    return I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def vectors_for(ids, column, spark, sf):
    """Ids with the embedding whose number is the id modulo the number of embeddings."""
    emb = embeddings(spark, sf)
    n = emb.agg(F.count(F.lit(1))).scalar()
    return (
        ids.select(column)
        .distinct()
        .withColumn("vec_id", F.pmod(F.col(column), n))
        .join(emb, "vec_id")
        .select(column, "vec")
    )


def train_pairs(spark, sf):
    return I.split(spark, sf).filter("part = 'train'")


@query(
    "normalized_adjacency",
    f"""WITH {ADJ} SELECT 'u' AS src_side, "user" AS src, 'i' AS dst_side, item AS dst, round(w, 9) AS w FROM adj
    UNION ALL SELECT 'i', item, 'u', "user", round(w, 9) FROM adj""",
)
def _(spark, sf):
    d = gr.normalized_adjacency(train_pairs(spark, sf))
    return d.withColumn("w", F.round("w", 9))


# long form (side, node, position, value) of vectors, one row per element
EMB_LONG = """embl AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
nemb AS (SELECT count(*) AS n FROM embeddings)"""


def layer_sql(k: int) -> str:
    return f"""l{k} AS MATERIALIZED (SELECT 'i' AS side, item AS node, d, sum(w * v) AS v FROM adj JOIN l{k - 1} ON side = 'u' AND node = "user" GROUP BY 1, 2, 3
  UNION ALL SELECT 'u', "user", d, sum(w * v) FROM adj JOIN l{k - 1} ON side = 'i' AND node = item GROUP BY 1, 2, 3)"""


PROPAGATE = f"""{ADJ}, {EMB_LONG}, l0 AS MATERIALIZED (SELECT 'u' AS side, "user" AS node, d, v FROM (SELECT DISTINCT "user" FROM tr) CROSS JOIN nemb JOIN embl ON vec_id = "user" % n
  UNION ALL SELECT 'i', item, d, v FROM (SELECT DISTINCT item FROM tr) CROSS JOIN nemb JOIN embl ON vec_id = item % n),
{layer_sql(1)}, {layer_sql(2)}, {layer_sql(3)},
fin AS MATERIALIZED (SELECT side, node, d, sum(v) / 4 AS v FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1, 2, 3)"""


def start_vectors(pairs, spark, sf):
    side = lambda c, s: vectors_for(pairs, c, spark, sf).select(
        F.lit(s).alias("side"), F.col(c).alias("node"), "vec"
    )
    return side("user", "u").unionByName(side("item", "i"))


def propagated(pairs, spark, sf, layers=3):
    edges = cut(gr.normalized_adjacency(pairs), "edges")
    return gr.graph_propagate(edges, start_vectors(pairs, spark, sf), layers, DIM)


@query(
    "graph_propagate",
    f"""WITH {PROPAGATE} SELECT side, node, d AS position, round(v, 7) + 0.0 AS value FROM fin""",
)
def _(spark, sf):
    d = propagated(train_pairs(spark, sf), spark, sf)
    d = d.select("side", "node", F.posexplode("vec").alias("position", "value"))
    return d.select("side", "node", F.col("position").cast("long").alias("position"), (F.round("value", 7) + 0.0).alias("value"))


GRAPH_TOP = f"""{PROPAGATE}, {TGT}, uv AS (SELECT node AS "user", list(v ORDER BY d) AS vec FROM fin WHERE side = 'u' GROUP BY 1),
iv AS (SELECT node AS item, list(v ORDER BY d) AS vec FROM fin WHERE side = 'i' GROUP BY 1),
top AS MATERIALIZED (SELECT * FROM (SELECT "user", item, score, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 12) DESC, item) AS rank FROM (
  SELECT "user", item, list_dot_product(uv.vec, iv.vec) AS score FROM uv CROSS JOIN iv WHERE "user" IN (SELECT "user" FROM tgt)) x
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s."user" = x."user" AND s.item = x.item)) WHERE rank <= 20)"""


def graph_top(s, spark, sf):
    fin = cut(propagated(s.filter("part = 'train'"), spark, sf), "vectors")
    users = fin.filter("side = 'u'").select(F.col("node").alias("query"), "vec")
    items = fin.filter("side = 'i'").select(F.col("node").alias("item"), "vec")
    targets = ev.targets_of(s, "test").select(F.col("user").alias("query")).distinct()
    seen = ev.seen_of(s, "test").withColumnRenamed("user", "query")
    seen = seen.join(targets, "query", "left_semi")
    top = vs.blocked_topk(users.join(targets, "query", "left_semi"), items, 20, seen)
    return top.withColumnRenamed("query", "user")


@query("score_dot_topk", f'WITH {GRAPH_TOP} SELECT "user", item, round(score, 6) AS score, rank FROM top')
def _(spark, sf):
    d = graph_top(I.split(spark, sf), spark, sf)
    return d.select("user", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "evaluate_graph",
    f"""WITH {GRAPH_TOP}, {EVAL_SQL} SELECT part, metric, round(CAST(value AS DOUBLE), 6) AS value FROM ev_out""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    return rounded_eval(s, cut(graph_top(s, spark, sf), "top"))


@query("implicit_mf")
def implicit_mf(spark, sf):
    s, users_map, items_map = ia.remap_split(I.split(spark, sf))
    s = cut(s, "split")
    users, items = tr.implicit_mf(s.filter("part = 'train'"), rank=64, iterations=10)
    targets = ev.targets_of(s, "test").select(F.col("user").alias("query")).distinct()
    seen = ev.seen_of(s, "test").withColumnRenamed("user", "query").join(targets, "query", "left_semi")
    queries = users.withColumnRenamed("user", "query").join(targets, "query", "left_semi")
    top = cut(vs.blocked_topk(queries, items, 20, seen).withColumnRenamed("query", "user"), "top")
    heads = heads_of(s)
    return ev.evaluate(top, ev.targets_of(s, "test"), heads, heads.count())


N_NEG = 2
NEG = f"""{TRAIN}, ix AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS rank FROM (SELECT DISTINCT item FROM split)),
dr AS (SELECT "user", item, d AS draw, CAST('0x' || substr(md5('0,' || "user" || ',' || item || ',' || d), 1, 15) AS BIGINT)
    % (SELECT count(*) FROM ix) AS rank FROM tr, range(0, 40) x(d)),
neg AS (SELECT * EXCLUDE (slot) FROM (SELECT dr."user", dr.item, ix.item AS negative, draw, row_number() OVER (PARTITION BY dr."user", dr.item ORDER BY draw) AS slot
  FROM dr JOIN ix USING (rank) WHERE NOT EXISTS (SELECT 1 FROM tr p WHERE p."user" = dr."user" AND p.item = ix.item)) WHERE slot <= {N_NEG})"""


def negatives(s, n_neg=N_NEG):
    ids = cut(ia.id_map(s, "item"), "ids")
    index = ids.select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    return tr.sample_negatives(s.filter("part = 'train'"), index, ids.count(), n_neg)


@query("sample_negatives", f'WITH {NEG} SELECT "user", item, negative, draw FROM neg')
def _(spark, sf):
    d = negatives(I.split(spark, sf))
    return d.withColumn("draw", F.col("draw").cast("long"))


@query(
    "pointwise_examples",
    f"""WITH {NEG} SELECT "user", item, CAST(1 AS DOUBLE) AS label FROM tr UNION ALL SELECT "user", negative, 0 FROM neg""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    return tr.pointwise_examples(s.filter("part = 'train'"), negatives(s))


@query(
    "bpr_loss",
    f"""WITH {NEG}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT count(*) AS n FROM embeddings),
    x AS (SELECT list_dot_product(u.v, i.v) - list_dot_product(u.v, j.v) AS x, list_dot_product(u.v, u.v) + list_dot_product(i.v, i.v) + list_dot_product(j.v, j.v) AS sq
      FROM neg CROSS JOIN m JOIN e u ON u.vec_id = "user" % n JOIN e i ON i.vec_id = item % n JOIN e j ON j.vec_id = negative % n)
    SELECT round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) AS bpr, round(avg(sq) / 2, 6) AS l2,
      round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))) + CAST(0.01 AS DOUBLE) * avg(sq) / 2, 6) AS loss FROM x""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    users, items = vectors_for(s, "user", spark, sf), vectors_for(s, "item", spark, sf)
    d = tr.bpr_loss(negatives(s), users, items, 0.01)
    return d.select(*[F.round(c, 6).alias(c) for c in ("bpr", "l2", "loss")])


LEN = 10
PAD = f"list_resize(CAST([] AS BIGINT[]), {LEN} - len(x), 0) || x"


@query(
    "sequence_examples",
    f"""WITH {I.SPLIT}, h AS (SELECT "user", list(item + 1 ORDER BY seq) AS full_s FROM split WHERE part = 'train' GROUP BY 1),
    t AS (SELECT "user", full_s[greatest(len(full_s) - {LEN}, 1):] AS s, full_s[greatest(len(full_s) - {LEN} + 1, 1):] AS q FROM h)
    SELECT "user", CASE WHEN len(s) < 2 THEN '-' ELSE array_to_string(list_resize(CAST([] AS BIGINT[]), {LEN} + 1 - len(s), 0) || s[:len(s) - 1], ',') END AS inputs,
      CASE WHEN len(s) < 2 THEN '-' ELSE array_to_string(list_resize(CAST([] AS BIGINT[]), {LEN} + 1 - len(s), 0) || s[2:], ',') END AS targets,
      array_to_string(list_resize(CAST([] AS BIGINT[]), {LEN} - len(q), 0) || q, ',') AS query FROM t""",
)
def _(spark, sf):
    d = tr.sequence_examples(train_pairs(spark, sf), LEN)
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("-")).alias(c)
    return d.select("user", text("inputs"), text("targets"), text("query"))


@query(
    "shuffle_histories",
    f"""WITH {TRAIN} SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY md5('3,' || "user" || ',' || item), item) - 1 AS seq FROM tr""",
)
def _(spark, sf):
    return tr.shuffle_histories(train_pairs(spark, sf), 3)


@query(
    "log_q",
    f"""WITH {TRAIN} SELECT item, round(ln(count(*) / CAST((SELECT count(*) FROM tr) AS DOUBLE) + 1e-12), 6) AS log_q FROM tr GROUP BY 1""",
)
def _(spark, sf):
    return tr.log_q(train_pairs(spark, sf)).withColumn("log_q", F.round("log_q", 6))


@query(
    "history_mean",
    f"""WITH {TRAIN}, {EMB_LONG} SELECT "user", d AS position, round(avg(v), 6) + 0.0 AS value FROM tr CROSS JOIN nemb JOIN embl ON vec_id = item % n GROUP BY 1, 2""",
)
def _(spark, sf):
    train = train_pairs(spark, sf)
    d = vs.history_mean(train, vectors_for(train, "item", spark, sf), DIM)
    d = d.select("user", F.posexplode("vec").alias("position", "value"))
    return d.select("user", F.col("position").cast("long").alias("position"), (F.round("value", 6) + 0.0).alias("value"))


@query(
    "history_mean_without_target",
    f"""WITH {TRAIN}, {EMB_LONG}, x AS (SELECT "user", item, d, v FROM tr CROSS JOIN nemb JOIN embl ON vec_id = item % n),
    y AS (SELECT "user", item, d, (sum(v) OVER (PARTITION BY "user", d) - v) / greatest(count(*) OVER (PARTITION BY "user", d) - 1, 1) AS m FROM x)
    SELECT "user", item, round(sum(m * m), 6) AS squares, round(sum(m * (d + 1)), 6) AS weighted FROM y GROUP BY 1, 2""",
)
def _(spark, sf):
    train = train_pairs(spark, sf)
    d = vs.history_mean_without(train, vectors_for(train, "item", spark, sf), DIM)
    places = F.sequence(F.lit(1), F.lit(DIM))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return d.select(
        "user",
        "item",
        F.round(add(F.transform("vec", lambda x: x * x)), 6).alias("squares"),
        F.round(add(F.zip_with("vec", places, lambda x, p: x * p)), 6).alias("weighted"),
    )


FOLD_USER = f"""{I.SPLIT}, {I.POP}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT count(*) AS n FROM embeddings),
iv AS MATERIALIZED (SELECT item, v, pop, CAST(1e-6 AS DOUBLE) * pop / (SELECT max(pop) FROM pop) AS tie FROM pop CROSS JOIN m JOIN e ON vec_id = item % n),
pr AS MATERIALIZED (SELECT "user", d, avg(x) AS x FROM (SELECT s."user", generate_subscripts(v, 1) AS d, unnest(v) AS x FROM split s JOIN iv USING (item) WHERE part <> 'test') GROUP BY 1, 2),
uv AS MATERIALIZED (SELECT "user", list(x ORDER BY d) AS v FROM pr GROUP BY 1),
us AS (SELECT DISTINCT "user" FROM split WHERE part = 'test'),
sc AS (SELECT us."user", iv.item, coalesce(list_dot_product(uv.v, iv.v), 0) + tie AS score FROM us LEFT JOIN uv USING ("user") CROSS JOIN iv),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 12) DESC, item) AS rank FROM sc) WHERE rank <= 20)"""


def fold_in(s, spark, sf):
    pop = pp.item_popularity(s.filter("part = 'train'"), s)
    items = vectors_for(s, "item", spark, sf)
    users = s.filter("part = 'test'")
    return vs.fold_in_user_mean(users, s.filter("part <> 'test'"), items, pop, DIM)


@query("fold_in_user_mean", f'WITH {FOLD_USER} SELECT "user", item, round(score, 6) AS score, rank FROM ft')
def _(spark, sf):
    s = I.split(spark, sf)
    queries, items = fold_in(s, spark, sf)
    d = vs.blocked_topk(queries, items, 20)
    return d.select(F.col("query").alias("user"), "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# exact and approximate vector search ------------------------------------------------------------
SEARCH = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
hits AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, item) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS item, list_dot_product(a.v, b.v) AS score FROM e a CROSS JOIN e b))"""


def search(spark, sf, k=100):
    e = embeddings(spark, sf)
    queries, items = e.withColumnRenamed("vec_id", "query"), e.withColumnRenamed("vec_id", "item")
    return queries, items, vs.blocked_topk(queries, items, k)


@query("vector_topk", f"WITH {SEARCH} SELECT query, item, round(score, 6) AS score, rank FROM hits WHERE rank <= 100")
def _(spark, sf):
    d = search(spark, sf)[2]
    return d.select("query", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "vector_topk_approximate_recall",
    """SELECT count(*) AS queries, least(100, count(*)) AS least_rows, least(100, count(*)) AS most_rows, true AS recall_reached FROM embeddings""",
)
def vector_recall(spark, sf):
    """Every vector asks the inverted-list index: rows of each answer, and recall over all answers."""
    queries, items, exact = search(spark, sf)
    index = vi.build_index(items)
    found = cut(vi.index_topk(index, queries, 100, vi.probes_for(index, queries, 100)), "found")
    rows = queries.join(found.groupBy("query").count(), "query", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.min(F.coalesce("count", F.lit(0))).alias("least_rows"), F.max("count").alias("most_rows")
    )
    recall = vs.vector_recall(found, exact).select((F.col("recall") >= 0.9).alias("recall_reached"))
    return rows.crossJoin(recall)  # one row each


@query("text_vectors")
def text_vectors(spark, sf):
    """Vectors of half of the documents are stored; only the other texts are computed."""
    docs = I.table(spark, sf, "documents")
    model = tv.fit_text_model(docs)
    stored = cut(tv.text_vectors(docs.filter("doc_id % 2 = 0"), model), "stored")
    new = tv.text_vectors(docs, model, stored)
    return stored.unionByName(new).select("key", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squares"))
