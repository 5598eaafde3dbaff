"""Batch recommendation and serving-table queries.

Repositories are parts, stars the implicit pairs, issues the order lines that are unshipped at
NOW, topics the market segments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.q_text import collapse_sql, scrub_sql, truncate_sql
from checks.registry import query
from tidemark.functions import labels as lf
from tidemark.functions.text import tokens
from tidemark.operators import neighbours as nb
from tidemark.operators import recommend as rc
from tidemark.operators import serving as sv
from tidemark.scale import cut
from tidemark.sources import responses as rs

DIM = 64
NOW = 946_684_800  # 2000-01-01
SEGMENTS = {
    "AUTOMOBILE": ("gear", "bolt", "rod"),
    "BUILDING": ("plate", "bolt", "large", "old"),
    "FURNITURE": ("small", "red", "blue"),
    "HOUSEHOLD": ("ring", "hot", "cold", "new"),
    "MACHINERY": ("anvil", "gizmo", "widget", "gear"),
}
# SQL: repositories, open issues, topics
REPOS = """emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ne AS (SELECT count(*) AS n FROM embeddings),
repo AS MATERIALIZED (SELECT p_partkey AS repo_id, p_brand || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS name, lower(p_brand) AS owner, p_type AS language,
  string_split(p_name, ' ') AS topics, CASE WHEN p_size > 25 THEN [upper(p_type), 'Size' || p_size] ELSE [] END AS fskills, p_size * 10 AS n_contrib, a.v AS tv, b.v AS mv
  FROM part CROSS JOIN ne JOIN emb a ON a.vec_id = p_partkey % n JOIN emb b ON b.vec_id = (p_partkey * 7 + 3) % n)"""
ISSUE_LABELS = """CASE o_orderpriority WHEN '1-URGENT' THEN ['good first issue', 'docs'] WHEN '2-HIGH' THEN ['Level: Medium', 'Python']
  WHEN '3-MEDIUM' THEN ['hard', 'ci/test', 'ci'] WHEN '4-NOT SPECIFIED' THEN ['enhancement'] ELSE ['Easy', 'sql', 'docs'] END"""
ISSUES = f"""iss AS MATERIALIZED (SELECT l_partkey AS repo_id, l_orderkey * 10 + l_linenumber AS number, CAST(epoch(o_orderdate) AS BIGINT) AS created, CAST(epoch(o_orderdate) AS BIGINT) + CAST(l_quantity AS BIGINT) * 864000 AS updated,
  CAST(l_quantity AS BIGINT) % 20 AS n_comments, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS n_assignees,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'easy' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'hard' END AS difficulty,
  CASE WHEN l_linenumber <= 3 THEN [l_returnflag || '-flag', 'Promo'] ELSE [] END AS skills, {ISSUE_LABELS} AS labels,
  'Fix  ' || o_orderpriority || ' for @user' || o_custkey AS title, 'See https://example.org/' || l_orderkey || ' and mail a' || l_suppkey || '@example.org <b>now</b>' AS body
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch(o_orderdate) < {NOW} AND epoch(l_shipdate) > {NOW})"""
TOPIC_ROWS = ", ".join(
    f"('{name}', {i}, [{', '.join(repr(w) for w in kw)}])" for i, (name, kw) in enumerate(SEGMENTS.items())
)
TOPICS = f"""top0 AS (SELECT * FROM (VALUES {TOPIC_ROWS}) v(topic, position, kw)),
topv AS (SELECT label % 5 AS position, d, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM emb) GROUP BY 1, 2),
topic AS MATERIALIZED (SELECT topic, position, kw, v FROM top0 JOIN (SELECT position, list(x ORDER BY d) AS v FROM topv GROUP BY 1) USING (position))"""


def repos(spark, sf):
    emb = I.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = emb.agg(F.count(F.lit(1))).scalar()
    a = emb.select(F.col("vec_id").alias("va"), F.col("v").alias("text_vec"))
    b = emb.select(F.col("vec_id").alias("vb"), F.col("v").alias("model_vec"))
    part = I.table(spark, sf, "part")
    skills = F.when(
        F.col("p_size") > 25, F.array(F.upper("p_type"), F.concat(F.lit("Size"), "p_size"))
    ).otherwise(F.array().cast("array<string>"))
    return (
        part.withColumns({"va": F.col("p_partkey") % n, "vb": (F.col("p_partkey") * 7 + 3) % n})
        .join(a, "va")
        .join(b, "vb")
        .select(
            F.col("p_partkey").alias("repo_id"),
            F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey").alias("name"),
            F.lower("p_brand").alias("owner"),
            F.col("p_type").alias("language"),
            F.array("p_type").alias("languages"),
            F.split("p_name", " ").alias("topics"),
            skills.alias("feature_skills"),
            (F.col("p_size") * 10).alias("n_contrib"),
            "p_size",
            "text_vec",
            "model_vec",
        )
    )


def open_issues(spark, sf):
    orders = I.table(spark, sf, "orders")
    base = I.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = base.filter((I.epoch("o_orderdate") < NOW) & (I.epoch("l_shipdate") > NOW))
    p = F.col("o_orderpriority")
    text = lambda *w: F.array(*[F.lit(x) for x in w])
    labels = (
        F.when(p == "1-URGENT", text("good first issue", "docs"))
        .when(p == "2-HIGH", text("Level: Medium", "Python"))
        .when(p == "3-MEDIUM", text("hard", "ci/test", "ci"))
        .when(p == "4-NOT SPECIFIED", text("enhancement"))
        .otherwise(text("Easy", "sql", "docs"))
    )
    quantity = F.col("l_quantity").cast("long")
    return base.select(
        F.col("l_partkey").alias("repo_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"),
        I.epoch("o_orderdate").alias("created"),
        (I.epoch("o_orderdate") + quantity * 864_000).alias("updated"),
        (quantity % 20).alias("n_comments"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("n_assignees"),
        F.when(p == "1-URGENT", "easy").when(p == "2-HIGH", "medium").when(p == "3-MEDIUM", "hard").alias("difficulty"),
        F.when(F.col("l_linenumber") <= 3, F.array(F.concat("l_returnflag", F.lit("-flag")), F.lit("Promo")))
        .otherwise(F.array().cast("array<string>"))
        .alias("skills"),
        labels.alias("labels"),
        F.concat(F.lit("Fix  "), p, F.lit(" for @user"), "o_custkey").alias("title"),
        F.concat(
            F.lit("See https://example.org/"), "l_orderkey", F.lit(" and mail a"), "l_suppkey", F.lit("@example.org <b>now</b>")
        ).alias("body"),
    )


def topics(spark, sf):
    rows = [(t, i, list(kw)) for i, (t, kw) in enumerate(SEGMENTS.items())]
    named = spark.createDataFrame(rows, "topic string, position int, kw array<string>")
    from tidemark.functions.vectors import mean_vector

    emb = I.table(spark, sf, "embeddings")
    vec = emb.groupBy((F.col("label") % 5).alias("position")).agg(mean_vector("embedding", DIM).alias("vec"))
    return cut(named.join(vec, "position"), "topics")


def with_skills(r):
    return r.withColumn("skills", rc.repo_skills("feature_skills", "languages", "topics"))


REPO_SKILLS = "list_distinct(list_transform(list_concat(fskills, [language], topics), lambda x: lower(x)))"


@query(
    "repo_skills",
    f"""WITH {REPOS} SELECT repo_id, array_to_string(list_sort({REPO_SKILLS}), ',') AS skills FROM repo""",
)
def _(spark, sf):
    r = with_skills(repos(spark, sf))
    return r.select("repo_id", F.array_join(F.array_sort("skills"), ",").alias("skills"))


@query(
    "candidates",
    f"WITH {REPOS}, {ISSUES} SELECT repo_id, name FROM repo WHERE repo_id IN (SELECT repo_id FROM iss)",
)
def _(spark, sf):
    return rc.candidates(repos(spark, sf).select("repo_id", "name"), open_issues(spark, sf))


# profiles: customers with a language, interests and hours ------------------------------------------
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
SEG_LIST = "[" + ", ".join(f"'{t}'" for t in SEGMENTS) + "]"
PERSONAS = f"""persona AS (SELECT c_custkey AS "user", [{TYPE_LIST}[c_custkey % 6 + 1]] AS languages, CASE WHEN c_nationkey % 2 = 0 THEN [c_mktsegment] ELSE [c_mktsegment, {SEG_LIST}[c_custkey % 5 + 1]] END AS interests,
  c_custkey % 12 + 1 AS hours FROM customer)"""


def personas(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % n + 1).cast("int"))
    seg = F.col("c_mktsegment")
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user"),
        F.array(pick(TYPES, 6)).alias("languages"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(seg)).otherwise(F.array(seg, pick(list(SEGMENTS), 5))).alias("interests"),
        (F.col("c_custkey") % 12 + 1).alias("hours"),
    )


@query(
    "interest_vectors",
    f"""WITH {REPOS}, {TOPICS}, {PERSONAS}, ui AS (SELECT DISTINCT "user", unnest(interests) AS topic FROM persona),
    x AS (SELECT "user", d, avg(x) AS x FROM (SELECT "user", generate_subscripts(v, 1) AS d, unnest(v) AS x FROM ui JOIN topic USING (topic)) GROUP BY 1, 2),
    n AS (SELECT "user", sqrt(sum(x * x)) + 1e-12 AS l FROM x GROUP BY 1)
    SELECT "user", d - 1 AS position, round(x / l, 6) + 0.0 AS value FROM x JOIN n USING ("user")""",
)
def _(spark, sf):
    u = personas(spark, sf).select("user", F.explode("interests").alias("topic"))
    d = rc.interest_vectors(u, topics(spark, sf), DIM).select("user", F.posexplode("vec").alias("position", "value"))
    return d.select("user", F.col("position").cast("long").alias("position"), (F.round("value", 6) + 0.0).alias("value"))


@query(
    "infer_interests",
    f"""WITH {I.IMPLICIT}, {REPOS}, {TOPICS}, w AS (SELECT DISTINCT "user", unnest(topics) AS word FROM implicit JOIN repo ON repo_id = item),
    k AS (SELECT topic, position, unnest(kw) AS word FROM topic), h AS (SELECT "user", topic, position, count(*) AS hits FROM w JOIN k USING (word) GROUP BY 1, 2, 3)
    SELECT "user", topic, hits, row_number() OVER (PARTITION BY "user" ORDER BY hits DESC, position) AS rank FROM h QUALIFY rank <= 3""",
)
def _(spark, sf):
    words = (
        I.implicit(spark, sf)
        .join(repos(spark, sf).select(F.col("repo_id").alias("item"), "topics"), "item")
        .select("user", F.explode("topics").alias("word"))
    )
    d = rc.infer_interests(words, topics(spark, sf))
    return d.withColumn("rank", F.col("rank").cast("long"))


def score_issue_sql() -> str:
    """Score of issue i with repository r (language, n_contrib) for profile p (us, hours)."""
    sk = "list_distinct(list_concat(list_transform(skills, lambda x: lower(x)), [lower(language)]))"
    goal = "CASE WHEN hours <= 3 THEN 1 WHEN hours <= 8 THEN 2 ELSE 3 END"
    lvl = "list_position(['easy', 'medium', 'hard'], difficulty)"
    match = f"CAST(CASE WHEN difficulty IS NULL THEN 0.5 WHEN {lvl} < {goal} THEN 1 - 0.25 * ({goal} - {lvl}) ELSE 1 - 0.6 * ({lvl} - {goal}) END AS DOUBLE)"
    return f"""0.35::DOUBLE * {match} + 0.25::DOUBLE * least(1.0, len(list_intersect({sk}, us)) / CAST(greatest(1, least(len({sk}), 4)) AS DOUBLE))
  + 0.2::DOUBLE * exp(-greatest(0, ({NOW} - updated) / 86400::DOUBLE) / 30::DOUBLE) + (CASE WHEN n_assignees > 0 THEN -0.3 ELSE 0.1 END)::DOUBLE
  + 0.1::DOUBLE * least(1.0, ln(1 + n_contrib::DOUBLE) / ln(501::DOUBLE)) - (CASE WHEN n_comments > 10 THEN 0.1 ELSE 0 END)::DOUBLE"""


KWS = "(SELECT list(DISTINCT w) FROM (SELECT unnest(kw) AS w, topic FROM topic) WHERE list_contains(interests, topic))"
PROFILE_SKILLS = f"""prof AS MATERIALIZED (SELECT p.*, list_distinct(list_concat(list_transform(languages, lambda x: lower(x)), k.kws)) AS us FROM persona p
  JOIN (SELECT "user", list(DISTINCT w) AS kws FROM (SELECT "user", unnest(kw) AS w FROM (SELECT "user", unnest(interests) AS topic FROM persona) JOIN topic USING (topic)) GROUP BY 1) k USING ("user"))"""


def profile_skills(p, t):
    words = (
        p.select("user", F.explode("interests").alias("topic"))
        .join(t.select("topic", F.explode("kw").alias("word")), "topic")
        .groupBy("user")
        .agg(F.collect_set("word").alias("kws"))
    )
    skills = F.array_distinct(F.concat(rc.lowered("languages"), F.coalesce("kws", F.array().cast("array<string>"))))
    return p.join(words, "user", "left").withColumn("user_skills", skills).drop("kws")


# every customer looks at the issues of the part that carries their number
@query(
    "score_and_pick_issues",
    f"""WITH {REPOS}, {ISSUES}, {TOPICS}, {PERSONAS}, {PROFILE_SKILLS}, s AS (SELECT "user", r.repo_id, number, {score_issue_sql()} AS score
      FROM prof JOIN repo r ON r.repo_id = "user" JOIN iss USING (repo_id))
    SELECT "user", repo_id, number, round(score, 6) AS score, row_number() OVER (PARTITION BY "user", repo_id ORDER BY round(score, 9) DESC, number DESC) AS rank FROM s QUALIFY rank <= 3""",
)
def _(spark, sf):
    p = profile_skills(personas(spark, sf), topics(spark, sf)).withColumn("repo_id", F.col("user"))
    d = rc.pick_issues(p, open_issues(spark, sf), repos(spark, sf), F.lit(NOW))
    return d.select("user", "repo_id", "number", F.round("issue_score", 6).alias("score"), F.col("issue_rank").cast("long").alias("rank"))


PROFILE_LIST = f"""{REPOS}, {ISSUES}, {TOPICS}, {PERSONAS}, {PROFILE_SKILLS},
pk AS MATERIALIZED (SELECT *, array_to_string(list_sort(list_distinct(languages)), ',') || '|' || array_to_string(list_sort(list_distinct(interests)), ',') AS pk FROM prof),
dp AS (SELECT pk, any_value(us) AS us, any_value(languages) AS languages, any_value(interests) AS interests FROM pk GROUP BY 1),
pv0 AS (SELECT pk, d, avg(x) AS x FROM (SELECT pk, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM (SELECT DISTINCT pk, unnest(interests) AS topic FROM dp) JOIN topic USING (topic)) GROUP BY 1, 2),
pv AS (SELECT pk, list(x ORDER BY d) AS v, sqrt(sum(x * x)) + 1e-12 AS l FROM pv0 GROUP BY 1),
cand AS (SELECT *, {REPO_SKILLS} AS rsk, ln(1 + n_contrib::DOUBLE) AS lc FROM repo WHERE repo_id IN (SELECT repo_id FROM iss)),
cs AS (SELECT *, (lc - avg(lc) OVER ()) / (stddev_pop(lc) OVER () + 1e-9) AS zc FROM cand),
sc AS (SELECT pk, repo_id, owner, list_dot_product(pv.v, tv) / l AS dot, zc, list_contains(list_transform(languages, lambda x: lower(x)), lower(language)) AS lm, len(list_intersect(rsk, us)) AS ns FROM dp JOIN pv USING (pk) CROSS JOIN cs),
ss AS (SELECT pk, repo_id, owner, 0.6::DOUBLE * (dot - avg(dot) OVER u) / (stddev_pop(dot) OVER u + 1e-9) + CASE WHEN lm THEN 0.6::DOUBLE ELSE 0 END + 0.2::DOUBLE * least(ns, 3) / 3::DOUBLE + 0.1::DOUBLE * zc AS score FROM sc WINDOW u AS (PARTITION BY pk)),
so AS (SELECT *, row_number() OVER (PARTITION BY pk, owner ORDER BY round(score, 9) DESC, repo_id) AS o FROM ss QUALIFY o <= 2),
sl AS (SELECT pk, repo_id, score, row_number() OVER (PARTITION BY pk ORDER BY round(score, 9) DESC, repo_id) AS rank FROM so QUALIFY rank <= 10),
plist AS (SELECT "user", repo_id, score, rank FROM pk JOIN sl USING (pk))"""


@query(
    "recommend_from_profile",
    f"""WITH {PROFILE_LIST} SELECT "user", repo_id, round(score, 6) AS score, rank FROM plist""",
)
def recommend_from_profile(spark, sf):
    r = with_skills(repos(spark, sf))
    d = rc.recommend_from_profile(personas(spark, sf), r, open_issues(spark, sf), topics(spark, sf), DIM)
    return d.select("user", "repo_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SHARED_SKILLS = "list_distinct(list_concat(list_transform(skills, lambda x: lower(x)), [lower(language)]))"


@query(
    "profile_cards",
    f"""WITH {PROFILE_LIST}, j AS (SELECT "user", repo_id, rank, rsk, us, interests, number, {score_issue_sql()} AS s, array_to_string(list_sort(list_intersect({SHARED_SKILLS}, us)), ',') AS matched
      FROM plist JOIN prof USING ("user") JOIN (SELECT repo_id, rsk, language, n_contrib FROM cand) USING (repo_id) JOIN iss USING (repo_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY "user", repo_id ORDER BY round(s, 9) DESC, number DESC) AS issue_rank FROM j QUALIFY issue_rank <= 3),
    ti AS (SELECT DISTINCT x.interests, x.rsk, string_agg(t.topic, ',' ORDER BY t.position) AS told FROM (SELECT DISTINCT interests, rsk FROM p) x JOIN topic t ON list_contains(x.interests, t.topic) AND len(list_intersect(t.kw, x.rsk)) > 0 GROUP BY 1, 2)
    SELECT "user", repo_id, rank, number, issue_rank, round(s, 6) AS issue_score, matched, array_to_string(list_sort(list_intersect(p.rsk, us))[1:5], ',') AS matched_skills, coalesce(told, '') AS matched_interests
    FROM p LEFT JOIN ti ON ti.interests = p.interests AND ti.rsk = p.rsk""",
)
def _(spark, sf):
    """Recommendations for stated profiles with their issues and what matches."""
    r, issues, t = with_skills(repos(spark, sf)), open_issues(spark, sf), topics(spark, sf)
    people = personas(spark, sf)
    listed = cut(rc.recommend_from_profile(people, r, issues, t, DIM), "listed")
    d = rc.profile_cards(listed, profile_skills(people, t), r, issues, t, F.lit(NOW))
    names = {c: F.array_join(c, ",") for c in ("matched", "matched_skills", "matched_interests")}
    return d.withColumns(names).select(
        "user", "repo_id", F.col("rank").cast("long").alias("rank"), "number", F.col("issue_rank").cast("long").alias("issue_rank"),
        F.round("issue_score", 6).alias("issue_score"), *names,
    )


def star_table(spark, sf):
    r = repos(spark, sf).select("repo_id", "language", "topics")
    return I.implicit(spark, sf).select("user", F.col("item").alias("repo_id"), "ts").join(r, "repo_id")


def own_repos(spark, sf):
    """Customers own the repositories of one brand."""
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user"), F.concat(F.lit("brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("owner")
    )


def history_picks(spark, sf):
    r = with_skills(repos(spark, sf))
    stars = cut(star_table(spark, sf), "stars")
    ranked, users, words = rc.history_scores(
        stars, r, open_issues(spark, sf), topics(spark, sf), own_repos(spark, sf), DIM
    )
    return rc.select_diverse(cut(ranked, "ranked")), users, words, stars, r


@query("select_diverse")
def select_diverse(spark, sf):
    return history_picks(spark, sf)[0]


@query("recommend_from_history")
def recommend_from_history(spark, sf):
    picks, users, words, stars, r = history_picks(spark, sf)
    pairs = stars.select("user", F.col("repo_id").alias("item"))
    co = nb.costar_neighbours(pairs).select(F.col("item").alias("repo_id"), "neighbour", "rank")
    d = rc.history_signals(cut(picks, "picks"), stars, words, r, co).join(users, "user")
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return d.select("user", "repo_id", "rank", "starred", "mode", F.round("score", 6).alias("score"), text("co_starred"), text("matched_skills"))


# young repositories: parts of a small size, described by a document ---------------------------------
FRESH = f"""fr AS (SELECT p_partkey AS repo_id, lower(p_brand) AS owner, 'a ' || p_name || ' tool' AS description, [lower(p_type) || '-kit'] AS topics, p_type AS language,
  {NOW} - p_size * 259200 AS created, p_partkey % 4 AS n_issues FROM part WHERE p_size <= 6)"""


@query(
    "new_projects",
    f"""WITH {REPOS}, {TOPICS}, {PERSONAS}, {PROFILE_SKILLS}, {FRESH},
    x AS (SELECT "user", f.*, list_intersect(us, list_distinct(list_concat(string_split(substr(description, 3), ' '), topics, [lower(language)]))) AS ov,
      list_contains(list_transform(languages, lambda x: lower(x)), lower(language)) AS lm FROM prof CROSS JOIN fr f WHERE owner <> 'brand#' || ("user" % 25 + 1)),
    y AS (SELECT *, len(ov) + CASE WHEN lm THEN 2 ELSE 0 END + exp(-(({NOW} - created) / 86400::DOUBLE) / 60::DOUBLE) AS score FROM x WHERE len(ov) > 0 OR lm),
    z AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(score, 9) DESC, repo_id DESC) AS rank FROM y QUALIFY rank <= 3)
    SELECT "user", repo_id, round(score, 6) AS score, array_to_string(list_sort(ov), ',') AS overlap, rank FROM z WHERE n_issues > 0""",
)
def _(spark, sf):
    fresh = I.table(spark, sf, "part").filter("p_size <= 6").select(
        F.col("p_partkey").alias("repo_id"),
        F.lower("p_brand").alias("owner"),
        F.concat(F.lit("a "), "p_name", F.lit(" tool")).alias("description"),
        F.array(F.concat(F.lower("p_type"), F.lit("-kit"))).alias("topics"),
        F.col("p_type").alias("language"),
        (F.lit(NOW) - F.col("p_size") * 259_200).alias("created"),
        (F.col("p_partkey") % 4).alias("n_issues"),
    )
    u = profile_skills(personas(spark, sf), topics(spark, sf)).withColumnRenamed("user_skills", "skills")
    d = rc.new_projects(u, fresh, F.lit(NOW), own_repos(spark, sf))
    return d.select("user", "repo_id", F.round("score", 6).alias("score"), F.array_join("overlap", ",").alias("overlap"), F.col("rank").cast("long").alias("rank"))


LABELS = f"""lab AS (SELECT o_orderkey AS id, {ISSUE_LABELS} AS labels FROM orders)"""


def label_arrays(spark, sf):
    d = I.table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    text = lambda *w: F.array(*[F.lit(x) for x in w])
    labels = (
        F.when(p == "1-URGENT", text("good first issue", "docs"))
        .when(p == "2-HIGH", text("Level: Medium", "Python"))
        .when(p == "3-MEDIUM", text("hard", "ci/test", "ci"))
        .when(p == "4-NOT SPECIFIED", text("enhancement"))
        .otherwise(text("Easy", "sql", "docs"))
    )
    color = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, (F.col("o_orderkey") % 3 + 4).cast("int"))
    return d.select(F.col("o_orderkey").alias("id"), labels.alias("labels"), F.upper(color).alias("color"))


@query(
    "label_rules",
    f"""WITH {LABELS}, w AS (SELECT id, pos, wi, w FROM (SELECT id, pos, generate_subscripts(ws, 1) AS wi, unnest(ws) AS w FROM (
        SELECT id, generate_subscripts(labels, 1) AS pos, string_split(regexp_replace(lower(unnest(labels)), '[:/-]', ' ', 'g'), ' ') AS ws FROM lab))),
      k AS (SELECT id, pos, wi, CASE w WHEN 'docs' THEN 'documentation' WHEN 'test' THEN 'testing' WHEN 'ci' THEN 'ci' WHEN 'sql' THEN 'sql' WHEN 'python' THEN 'python' END AS s FROM w),
      f AS (SELECT id, s, min(pos * 100 + wi) AS place FROM k WHERE s IS NOT NULL GROUP BY 1, 2),
      sk AS (SELECT id, string_agg(s, ',' ORDER BY place) AS skills FROM f GROUP BY 1)
    SELECT id, coalesce(CASE WHEN list_contains(labels, 'hard') THEN 'hard' WHEN list_contains(labels, 'Level: Medium') THEN 'medium' WHEN list_contains(labels, 'enhancement') THEN NULL ELSE 'easy' END, '-') AS difficulty,
      coalesce(skills, '') AS skills, CASE WHEN id % 3 = 2 THEN labels[1] || '=#' || substr(md5(CAST(id AS VARCHAR)), 1, 6) ELSE '' END AS colors FROM lab LEFT JOIN sk USING (id)""",
)
def _(spark, sf):
    d = label_arrays(spark, sf)
    colors = F.create_map(F.get("labels", F.lit(0)), "color")
    shown = F.transform(F.map_entries(lf.label_colors(F.col("labels"), colors)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select(
        "id",
        F.coalesce(lf.label_difficulty(F.col("labels")), F.lit("-")).alias("difficulty"),
        F.array_join(lf.label_skills(F.col("labels")), ",").alias("skills"),
        F.array_join(shown, ",").alias("colors"),
    )


RULE_SKILLS = """CASE labels[1] WHEN 'good first issue' THEN ['documentation'] WHEN 'Level: Medium' THEN ['python'] WHEN 'hard' THEN ['ci', 'testing'] WHEN 'Easy' THEN ['sql', 'documentation'] ELSE [] END"""
RULE_DIFF = """CASE labels[1] WHEN 'good first issue' THEN 'easy' WHEN 'Level: Medium' THEN 'medium' WHEN 'hard' THEN 'hard' WHEN 'Easy' THEN 'easy' END"""
FEATS = """ft AS (SELECT repo_id, number, CASE WHEN number % 2 = 0 THEN difficulty END AS fd, CASE WHEN number % 3 = 0 THEN skills ELSE [] END AS fs FROM iss WHERE n_comments > 5)"""


@query(
    "issue_records",
    f"""WITH {ISSUES}, {FEATS}, r AS (SELECT iss.*, fd, fs, {RULE_DIFF} AS rd, {RULE_SKILLS} AS rk FROM iss LEFT JOIN ft USING (repo_id, number))
    SELECT repo_id, number, {truncate_sql(scrub_sql('title'), 200)} AS title, array_to_string(labels, ',') AS labels, coalesce(fd, rd, '-') AS difficulty,
      CASE WHEN fd IS NOT NULL THEN 'llm' WHEN rd IS NOT NULL THEN 'labels' ELSE '-' END AS difficulty_source,
      array_to_string(CASE WHEN len(coalesce(fs, [])) > 0 THEN fs[1:4] ELSE rk[1:4] END, ',') AS skills, {truncate_sql(scrub_sql('body'), 300)} AS snippet FROM r""",
)
def _(spark, sf):
    i = open_issues(spark, sf)
    features = i.filter("n_comments > 5").select(
        "repo_id",
        "number",
        F.when(F.col("number") % 2 == 0, F.col("difficulty")).alias("difficulty"),
        F.when(F.col("number") % 3 == 0, F.col("skills")).otherwise(F.array().cast("array<string>")).alias("skills"),
    )
    raw = i.withColumns({"label_colors": F.create_map(F.lit("docs"), F.lit("00FF00")), "created_at": F.col("created"), "updated_at": F.col("updated")})
    d = sv.issue_records(raw, features)
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return d.select("repo_id", "number", "title", F.array_join("labels", ",").alias("labels"), dash("difficulty"), dash("difficulty_source"), F.array_join("skills", ",").alias("skills"), "snippet")


HITS = f"""hit AS (SELECT iss.repo_id, number, p_brand || '/' || p_name AS name, 'by @' || p_brand || ' a ' || p_name AS description, p_type AS language, p_size AS stars, p_size % 7 = 0 AS is_fork, p_size % 11 = 0 AS is_archived,
  {NOW} - (p_partkey % 400) * 86400 AS repo_created FROM iss JOIN part ON p_partkey = iss.repo_id)"""


def search_hits(spark, sf):
    part = I.table(spark, sf, "part").withColumnRenamed("p_partkey", "repo_id")
    return open_issues(spark, sf).select("repo_id", "number").join(part, "repo_id").select(
        "repo_id",
        "number",
        F.concat("p_brand", F.lit("/"), "p_name").alias("name"),
        F.concat(F.lit("by @"), "p_brand", F.lit(" a "), "p_name").alias("description"),
        F.col("p_type").alias("language"),
        F.split("p_name", " ").alias("topics"),
        F.col("p_size").alias("stars"),
        (F.col("p_size") % 7 == 0).alias("is_fork"),
        (F.col("p_size") % 11 == 0).alias("is_archived"),
        (F.lit(NOW) - (F.col("repo_id") % 400) * 86_400).alias("repo_created"),
    )


@query(
    "fresh_pool",
    f"""WITH {ISSUES}, {HITS}, g AS (SELECT * FROM hit WHERE NOT is_fork AND NOT is_archived AND stars >= 10 AND repo_created >= {NOW} - 180 * 86400
      AND repo_id NOT IN (SELECT s_suppkey FROM supplier))
    SELECT repo_id, any_value(name) AS name, any_value({scrub_sql('description')}) AS description, any_value(language) AS language, any_value(stars) AS stars, count(DISTINCT number) AS n_issues
    FROM g GROUP BY 1 ORDER BY stars DESC, repo_id LIMIT 300""",
)
def _(spark, sf):
    listed = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo_id"))
    pool, _ = sv.fresh_pool(search_hits(spark, sf), listed, NOW)
    return pool.select("repo_id", "name", "description", "language", "stars", "n_issues")


@query(
    "star_activity",
    """WITH s AS (SELECT user_id AS "user", CASE WHEN event_type = 'error' THEN 'bad date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events)
    SELECT "user", strftime(TRY_CAST(substr(stamp, 1, 10) AS DATE), '%Y-%m-%d') AS day, count(*) AS count FROM s WHERE TRY_CAST(substr(stamp, 1, 10) AS DATE) IS NOT NULL
      AND date_diff('day', TRY_CAST(substr(stamp, 1, 10) AS DATE), DATE '2024-01-28') BETWEEN 0 AND 20 GROUP BY 1, 2""",
)
def _(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    s = I.table(spark, sf, "events").select(
        F.col("user_id").alias("user"), F.when(F.col("event_type") == "error", "bad date").otherwise(at).alias("starred_at")
    )
    return rc.star_activity(s, "2024-01-28", 21).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "top_languages",
    f"""WITH {REPOS}, {ISSUES} SELECT language, count(*) AS n_repos FROM repo WHERE repo_id IN (SELECT repo_id FROM iss) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16""",
)
def _(spark, sf):
    return rc.top_languages(repos(spark, sf), open_issues(spark, sf))


@query(
    "catalog_stats",
    f"""WITH {ISSUES} SELECT 'repos' AS metric, count(*) AS value FROM part UNION ALL SELECT 'repos_with_issues', count(DISTINCT repo_id) FROM iss
    UNION ALL SELECT 'open_issues', count(*) FROM iss UNION ALL SELECT 'repos_with_features', count(*) FROM part WHERE p_size > 25""",
)
def _(spark, sf):
    r = repos(spark, sf)
    return rc.catalog_stats(r, open_issues(spark, sf), r.filter("p_size > 25"))


@query(
    "snapshot_manifest",
    f"""WITH {ISSUES}, {HITS} SELECT 'open_issues' AS metric, count(*) AS value FROM iss UNION ALL SELECT 'repos_with_issues', count(DISTINCT repo_id) FROM iss
    UNION ALL SELECT 'repos_with_features', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'issues_with_features', count(*) FROM iss WHERE n_comments > 5
    UNION ALL SELECT 'fresh_repos', least(300, count(DISTINCT repo_id)) FROM hit WHERE NOT is_fork AND NOT is_archived AND stars >= 10 AND repo_created >= {NOW} - 180 * 86400 AND repo_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf):
    i = open_issues(spark, sf)
    listed = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo_id"))
    pool, _ = sv.fresh_pool(search_hits(spark, sf), listed, NOW)
    return sv.snapshot_manifest(i, pool, repos(spark, sf).filter("p_size > 25"), i.filter("n_comments > 5"))


# facts: the best issue of every repository with a few claims of the user -----------------------------
FACT_SQL = f"""WITH {I.IMPLICIT}, {REPOS}, {ISSUES}, {TOPICS}, {PERSONAS}, {PROFILE_SKILLS}, mx AS (SELECT repo_id, max(number) AS number FROM iss GROUP BY 1),
pk AS (SELECT p."user", p."user" AS repo_id, coalesce(mx.number, 0) AS number, us, ['r' || ("user" + 1), 'r' || ("user" + 2), 'r' || ("user" + 3)] AS claimed FROM prof p LEFT JOIN mx ON mx.repo_id = p."user"),
cn AS (SELECT DISTINCT l_suppkey AS repo_id, 'r' || (l_suppkey + l_linenumber) AS nm FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2),
f AS (SELECT pk."user", pk.repo_id, pk.number, 'Repository: ' || split_part(name, '/', 2) || ' (main language: ' || language || ').' AS f1,
  CASE WHEN len(fskills) > 0 THEN 'README summary: uses ' || fskills[1] ELSE 'Description: a ' || language || ' part' END AS f2,
  list_filter(claimed, lambda c: list_contains(coalesce(nn.ns, []), c)) AS sh,
  list_sort(list_filter(us, lambda s: list_contains(list_concat(list_transform(fskills, lambda x: lower(x)), [lower(language)], topics), s)))[1:5] AS ms, i.number AS inum, i.labels, i.difficulty, i.title
  FROM pk JOIN repo USING (repo_id) LEFT JOIN (SELECT repo_id, list(nm) AS ns FROM cn GROUP BY 1) nn USING (repo_id) LEFT JOIN iss i ON i.repo_id = pk.repo_id AND i.number = pk.number),
g AS (SELECT "user", repo_id, number, list_filter([f1, f2, CASE WHEN len(sh) > 0 THEN 'People who starred ' || array_to_string(sh, ', ') || ' (which you starred) also starred this repository.' END,
  CASE WHEN len(ms) > 0 THEN 'Skills you have that the project uses: ' || array_to_string(ms, ', ') || '.' END,
  CASE WHEN inum IS NOT NULL THEN 'Suggested issue: "' || title || '" (labels: ' || array_to_string(labels[1:4], ', ') || ').' END,
  CASE WHEN difficulty IS NOT NULL THEN 'Estimated difficulty: ' || difficulty || '.' END], lambda x: x IS NOT NULL) AS facts FROM f)"""


@query(
    "collect_facts",
    f"""{FACT_SQL} SELECT "user", repo_id, number, array_to_string(facts, ' | ') AS facts, array_to_string(facts[2:4], ' ') AS explanation FROM g""",
)
def _(spark, sf):
    r = repos(spark, sf)
    i = open_issues(spark, sf)
    best = i.groupBy("repo_id").agg(F.max("number").alias("number"))
    p = profile_skills(personas(spark, sf), topics(spark, sf))
    name = lambda k: F.concat(F.lit("r"), (F.col("user") + k).cast("string"))
    picks = (
        p.withColumn("repo_id", F.col("user"))
        .join(best, "repo_id", "left")
        .select(
            "user", "repo_id", F.coalesce("number", F.lit(0)).alias("number"), F.array_sort("user_skills").alias("user_skills"), F.array(name(1), name(2), name(3)).alias("claimed")
        )
    )
    described = r.select(
        "repo_id",
        "name",
        "language",
        F.when(F.size("feature_skills") > 0, F.concat(F.lit("uses "), F.get("feature_skills", F.lit(0)))).alias("summary"),
        F.concat(F.lit("a "), "language", F.lit(" part")).alias("description"),
        "topics",
        F.col("feature_skills").alias("skills"),
    )
    near = I.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_linenumber <> 2").select(
        F.col("l_suppkey").alias("repo_id"), F.concat(F.lit("r"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string")).alias("neighbour_name")
    )
    d = sv.collect_facts(picks, described, i, near)
    return d.select("user", "repo_id", "number", F.array_join("facts", " | ").alias("facts"), sv.explanation(F.col("facts")).alias("explanation"))


# nested documents ------------------------------------------------------------------------------------
DOC = """'{"data":{"nodes":[' || CASE WHEN p_size % 9 = 0 THEN 'null' ELSE '{"databaseId":' || p_partkey || ',"nameWithOwner":"' || p_brand || '/' || p_name || '","createdAt":"2020-01-01T00:00:00Z","isFork":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"isArchived":false,"stargazerCount":' || p_size || ',"forkCount":3,"description":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"a ' || p_name || '"' END || ',"primaryLanguage":{"name":"' || p_type || '"},"languages":{"nodes":[{"name":"' || p_type || '"},{"name":"C"}]},"labels":{"nodes":[{"name":"bug"},{"name":"'
  || p_type || '"}]},"repositoryTopics":{"nodes":[{"topic":{"name":"' || p_brand || '"}}]},"defaultBranchRef":{"target":{"history":{"nodes":[{"committedDate":"2024-02-01","f0":{"object":{"text":"binary","isBinary":true}},"f1":null,"f2":{"object":{"text":"'
  || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'about ' || p_name END || '","isBinary":false}},"f3":{"object":{"text":"rst ' || p_partkey || '","isBinary":false}}}]}}}}' END || ']}}'"""


def documents(spark, sf):
    return I.table(spark, sf, "part").selectExpr(f"{DOC} AS body")


@query(
    "flatten_repo_json",
    """SELECT p_partkey AS repo_id, p_brand || '/' || p_name AS name, p_size % 2 = 0 AS is_fork, CAST(p_size AS BIGINT) AS stars, 'bug,' || p_type AS labels FROM part WHERE p_size % 9 <> 0""",
)
def _(spark, sf):
    d = rs.flatten_repo_labels(documents(spark, sf))
    return d.select("repo_id", "name", "is_fork", "stars", F.array_join("labels", ",").alias("labels"))


@query(
    "flatten_repo_details_json",
    """SELECT p_partkey AS repo_id, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'a ' || p_name END AS description, p_type AS language, p_type || ',C' AS languages, p_brand AS topics, '2024-02-01' AS readme_commit_date,
    CASE WHEN p_size % 4 = 0 THEN 'rst ' || p_partkey ELSE 'about ' || p_name END AS readme, CAST(3 AS BIGINT) AS forks FROM part WHERE p_size % 9 <> 0""",
)
def _(spark, sf):
    d = rs.flatten_repo_details(documents(spark, sf))
    return d.select("repo_id", "description", "language", F.array_join("languages", ",").alias("languages"), F.array_join("topics", ",").alias("topics"), "readme_commit_date", "readme", "forks")


ISSUE_DOC = """'{"data":{"r0":{"databaseId":' || o_custkey || ',"issues":{"nodes":[{"number":' || o_orderkey || ',"title":"t ' || o_orderpriority || '","body":null,"createdAt":"' || o_orderstatus || '","updatedAt":"u","labels":{"nodes":[{"name":"bug","color":"FF00aa"},{"name":"'
  || o_orderpriority || '","color":null}]},"comments":{"totalCount":' || (o_orderkey % 7) || '},"assignees":{"totalCount":0}},null]}},"r1":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '{"databaseId":' || (o_custkey + 1) || ',"issues":{"nodes":[]}}' END || '}}'"""


@query(
    "flatten_issue_json",
    """SELECT o_custkey AS repo_id, o_orderkey AS number, 't ' || o_orderpriority AS title, '' AS body, 'bug,' || o_orderpriority AS labels, o_orderkey % 7 AS n_comments, 'FF00aa' AS bug_color FROM orders""",
)
def _(spark, sf):
    d = rs.flatten_issues(I.table(spark, sf, "orders").selectExpr(f"{ISSUE_DOC} AS body"))
    return d.select("repo_id", "number", "title", "body", F.array_join("labels", ",").alias("labels"), "n_comments", F.col("label_colors")["bug"].alias("bug_color"))


@query("flatten_issue_dates_json", "SELECT o_custkey AS repo_id, o_orderstatus AS created_at FROM orders")
def _(spark, sf):
    return rs.flatten_issue_dates(I.table(spark, sf, "orders").selectExpr(f"{ISSUE_DOC} AS body"))


HIT_DOC = """'{"data":{"search":{"nodes":[{"number":' || o_orderkey || ',"title":"t","body":"b ' || o_orderpriority || '","createdAt":"c","updatedAt":"u","labels":{"nodes":[{"name":"easy","color":"00ff00"}]},"comments":{"totalCount":1},"assignees":{"totalCount":2},"repository":'
  || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{"databaseId":' || o_custkey || ',"nameWithOwner":"o/r","description":null,"createdAt":"2024-01-01","stargazerCount":' || (o_orderkey % 50) || ',"isFork":false,"isArchived":false,"primaryLanguage":null,"repositoryTopics":{"nodes":[]}}' END || '},{}]}}}'"""


@query(
    "flatten_fresh_json",
    """SELECT o_custkey AS repo_id, o_orderkey AS number, o_orderkey % 50 AS stars, 'b ' || o_orderpriority AS body, 'easy' AS labels, CAST(2 AS BIGINT) AS n_assignees FROM orders WHERE o_orderkey % 5 <> 0""",
)
def _(spark, sf):
    d = rs.flatten_fresh_hits(I.table(spark, sf, "orders").selectExpr(f"{HIT_DOC} AS body"))
    return d.select("repo_id", "number", "stars", "body", F.array_join("labels", ",").alias("labels"), "n_assignees")


@query(
    "batch_issues",
    f"""WITH {ISSUES}, r AS (SELECT repo_id, number, row_number() OVER (PARTITION BY repo_id ORDER BY created DESC, number DESC) - 1 AS rn FROM iss)
    SELECT repo_id, number, CAST(floor(rn / 2) AS BIGINT) AS batch, rn % 2 + 1 AS position FROM r WHERE rn < 5""",
)
def _(spark, sf):
    d = sv.newest_batches(open_issues(spark, sf), 5, 2)
    return d.select("repo_id", "number", "batch", F.col("position").cast("long").alias("position"))


# the repositories that are paid for first, and the batches of their newest issues
@query(
    "priority_issue_batches",
    f"""WITH {REPOS}, {ISSUES}, pr AS (SELECT repo_id, row_number() OVER (ORDER BY n_contrib DESC, repo_id) AS priority FROM repo WHERE repo_id IN (SELECT repo_id FROM iss) QUALIFY priority <= 200),
    r AS (SELECT repo_id, number, row_number() OVER (PARTITION BY repo_id ORDER BY created DESC, number DESC) - 1 AS rn FROM iss JOIN pr USING (repo_id))
    SELECT priority, repo_id, number, CAST(floor(rn / 2) AS BIGINT) AS batch, rn % 2 + 1 AS position FROM r JOIN pr USING (repo_id) WHERE rn < 5""",
)
def _(spark, sf):
    issues = open_issues(spark, sf)
    first = sv.priority_repos(repos(spark, sf), issues, 200).select("repo_id", "priority")
    d = sv.newest_batches(issues.join(first, "repo_id"), 5, 2)
    return d.select(F.col("priority").cast("long").alias("priority"), "repo_id", "number", "batch", F.col("position").cast("long").alias("position"))
