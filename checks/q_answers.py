"""Queries over tables of model answers. Answers are written from the given tables, so that some
are grounded, some are not and some cannot be parsed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import inputs as I
from checks.inputs import IDCG
from checks.q_benchmark import KNN_SCORE, TGT, full_top
from checks.q_statistics import boot_sql, interval_sql, rounded
from checks.q_text import scrub_sql, truncate_sql
from checks.registry import query
from tidemark.functions import prompts as pr
from tidemark.operators import answers as an
from tidemark.operators import evaluation as ev
from tidemark.operators import neighbours as nb
from tidemark.operators.bootstrap import paired_intervals
from tidemark.operators.interactions import id_map
from tidemark.operators.popularity import item_popularity
from tidemark.scale import cut, spread, unbounded

NL = "chr(10)"


# prompts ---------------------------------------------------------------------------------------------
def sql_template(template: str, **values: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2:
            out.append(f"({values[p]})")
        elif p:
            out.append("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(out)


def title_list_sql() -> str:
    return f"""h AS (SELECT "user", string_agg(rn || '. ' || {truncate_sql('p_name', 8)}, chr(10) ORDER BY rn) AS titles FROM (
      SELECT "user", p_name, row_number() OVER (PARTITION BY "user" ORDER BY seq) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY seq DESC) AS back FROM split WHERE part = 'train') JOIN part ON p_partkey = item WHERE back <= 5) GROUP BY 1)"""


def titles_of(spark, sf, n=5):
    s = I.split(spark, sf).filter("part = 'train'")
    names = I.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("user").orderBy(F.col("seq").desc())
    last = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).join(names, "item")
    rows = F.array_sort(F.collect_list(F.struct("seq", "title")))
    return last.groupBy("user").agg(F.transform(rows, lambda x: x["title"]).alias("titles"))


@query(
    "history_prompts",
    f"""WITH {I.SPLIT}, {title_list_sql()} SELECT "user", {sql_template(pr.HISTORY, titles='titles')} AS prompt FROM h""",
)
def _(spark, sf):
    return titles_of(spark, sf).select("user", pr.history_prompt(F.col("titles"), 5, 8).alias("prompt"))


@query(
    "rerank_prompts",
    f"""WITH {I.SPLIT}, {title_list_sql()}, c AS (SELECT "user", string_agg('[' || rn || '] ' || p_name || ' (recommender score: ' || printf('%.2f', (6 - rn) / CAST(4 AS DOUBLE)) || ')', chr(10) ORDER BY rn) AS cands, count(*) AS n FROM (
      SELECT "user", p_name, row_number() OVER (PARTITION BY "user" ORDER BY seq) AS rn FROM split JOIN part ON p_partkey = item WHERE part <> 'train') WHERE rn <= 5 GROUP BY 1)
    SELECT "user", {sql_template(pr.RERANK, history='titles', n='n', candidates='cands')} AS prompt FROM h JOIN c USING ("user")""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    s = I.split(spark, sf).filter("part <> 'train'")
    names = I.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))
    w = Window.partitionBy("user").orderBy("seq")
    first = s.join(names, "item").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5)
    rows = F.array_sort(F.collect_list(F.struct("rn", "title")))
    cands = first.groupBy("user").agg(rows.alias("r")).select(
        "user",
        F.transform("r", lambda x: x["title"]).alias("cand"),
        F.transform("r", lambda x: (6 - x["rn"]) / F.lit(4.0)).alias("scores"),
    )
    d = titles_of(spark, sf).join(cands, "user")
    # every title is shorter than the cut except in the history, which is cut at 8
    prompt = pr.fill(
        pr.RERANK,
        history=pr.numbered(F.col("titles"), 8),
        n=F.size("cand"),
        candidates=pr.numbered(
            F.zip_with("cand", "scores", lambda t, x: F.concat(t, F.format_string(" (recommender score: %.2f)", x))), None, True
        ),
    )
    return d.select("user", prompt.alias("prompt"))


REPO_PROMPT = sql_template(pr.REPOSITORY, text="text")


@query(
    "repo_prompts",
    f"SELECT doc_id, {REPO_PROMPT} AS prompt FROM (SELECT doc_id, {scrub_sql('text')} AS text FROM documents)",
)
def _(spark, sf):
    from tidemark.functions.text import scrub_text

    d = I.table(spark, sf, "documents")
    return d.select("doc_id", pr.fill(pr.REPOSITORY, text=scrub_text(F.col("text"))).alias("prompt"))


@query(
    "product_prompts",
    f"""SELECT p_partkey AS item, {sql_template(pr.PRODUCT, text="'Title: ' || p_name || chr(10) || 'Brand: ' || p_brand")} AS prompt FROM part""",
)
def _(spark, sf):
    from tidemark.functions.text import lines

    p = I.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("item"), pr.fill(pr.PRODUCT, text=lines(("Title", F.col("p_name")), ("Brand", F.col("p_brand")))).alias("prompt")
    )


@query(
    "issue_batch_prompts",
    f"""WITH b AS (SELECT conv_id, turn, '[' || (turn + 1) || '] Title: ' || {scrub_sql("role || ' of ' || conv_id")} || chr(10) || 'Labels: ' || role || ', turn ' || turn || chr(10) || 'Text: ' ||
      CASE WHEN s = '' THEN '(empty)' ELSE {truncate_sql('s', 200)} END AS block FROM (SELECT *, {scrub_sql('text')} AS s FROM conversations)),
    g AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS issues FROM b GROUP BY 1)
    SELECT conv_id, {sql_template(pr.ISSUE_BATCH, repo="'conv-' || conv_id", language="'unknown'", issues='issues')} AS prompt FROM g""",
)
def _(spark, sf):
    c = I.table(spark, sf, "conversations")
    block = pr.issue_block(
        F.col("turn") + 1,
        F.concat("role", F.lit(" of "), "conv_id"),
        F.array(F.col("role"), F.concat(F.lit("turn "), "turn")),
        F.col("text"),
        200,
    )
    rows = c.select("conv_id", "turn", block.alias("block")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("r")
    )
    text = F.array_join(F.transform("r", lambda x: x["block"]), "\n\n")
    return rows.select(
        "conv_id",
        pr.fill(pr.ISSUE_BATCH, repo=F.concat(F.lit("conv-"), "conv_id"), language=F.lit("unknown"), issues=text).alias("prompt"),
    )


@query(
    "judge_prompts",
    f"""WITH i AS (SELECT c_custkey, p_partkey, row_number() OVER (PARTITION BY c_custkey ORDER BY p_partkey) AS rn, p_name, p_type, p_brand FROM customer JOIN part ON p_partkey % (SELECT count(*) FROM customer) = c_custkey),
    g AS (SELECT c_custkey, string_agg('[' || rn || '] ' || p_name || ' (' || p_type || '): made by ' || p_brand || chr(10) || '    First issue: "fix ' || p_partkey || '" (difficulty: unknown)', chr(10) ORDER BY rn) AS items FROM i GROUP BY 1)
    SELECT c_custkey AS persona, {sql_template(pr.JUDGE, bio='c_name', languages="'SQL'", interests='c_mktsegment', hours="c_nationkey", items='items')} AS prompt FROM customer JOIN g USING (c_custkey)""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    c = I.table(spark, sf, "customer")
    p = I.table(spark, sf, "part").withColumn("c_custkey", F.col("p_partkey") % c.count())
    w = Window.partitionBy("c_custkey").orderBy("p_partkey")
    rows = p.join(c.select("c_custkey"), "c_custkey").withColumn("rn", F.row_number().over(w))
    none = F.lit(None).cast("string")
    item = pr.judge_item(
        F.col("rn"), F.col("p_name"), F.col("p_type"), F.concat(F.lit("made by "), "p_brand"), F.concat(F.lit("fix "), "p_partkey"), none
    )
    lists = rows.select("c_custkey", "rn", item.alias("t")).groupBy("c_custkey").agg(
        F.array_sort(F.collect_list(F.struct("rn", "t"))).alias("r")
    )
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    d = c.join(lists, "c_custkey")
    prompt = pr.fill(
        pr.JUDGE, bio=F.col("c_name"), languages=F.lit("SQL"), interests=F.col("c_mktsegment"), hours=F.col("c_nationkey"), items=text
    )
    return d.select(F.col("c_custkey").alias("persona"), prompt.alias("prompt"))


KEY = "sha256('groq' || chr(31) || 'm1' || chr(31) || '{\"temperature\": 0}' || chr(31) || {p})"


@query(
    "pending_prompts",
    f"""WITH p AS (SELECT conv_id, turn, text AS prompt, {KEY.replace('{p}', 'text')} AS key FROM conversations),
    c AS (SELECT DISTINCT {KEY.replace('{p}', 'text')} AS key FROM conversations WHERE role = 'assistant'),
    d AS (SELECT DISTINCT key FROM p WHERE key NOT IN (SELECT key FROM c))
    SELECT 'due' AS state, count(*) AS n, min(key) AS first_key FROM d UNION ALL SELECT 'answered', count(*), min(key) FROM p WHERE key IN (SELECT key FROM c)""",
)
def _(spark, sf):
    c = I.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))
    options = '{"temperature": 0}'
    cache = c.filter("role = 'assistant'").select(
        pr.prompt_key("groq", "m1", options, F.col("prompt")).alias("key"), F.col("prompt").alias("response")
    )
    due, done = an.due_prompts(c, cache, "groq", "m1", options)
    stats = [F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")]
    return due.agg(*stats).withColumn("state", F.lit("due")).unionByName(done.agg(*stats).withColumn("state", F.lit("answered")))


# answers about documents: skills are words of the text, one is made up ----------------------------------
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
DOC_ANSWER = f"""ans AS (SELECT doc_id, text, {WORDS} AS w, CASE WHEN doc_id % 10 = 7 THEN 'I cannot answer {{' ELSE 'Sure: {{"summary": " about ' || coalesce({WORDS}[1], 'x') || ' ", "skills": ["' || coalesce({WORDS}[1], 'x') || '", " '
  || coalesce({WORDS}[3], 'y') || ' ", "zzqq", 5], "domain": "d' || doc_id % 3 || '"}} done' END AS response FROM documents)"""


def doc_answers(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    word = lambda i, other: F.coalesce(F.get("w", F.lit(i)), F.lit(other))
    answer = F.concat(
        F.lit('Sure: {"summary": " about '), word(0, "x"), F.lit(' ", "skills": ["'), word(0, "x"), F.lit('", " '), word(2, "y"),
        F.lit(' ", "zzqq", 5], "domain": "d'), F.col("doc_id") % 3, F.lit('"} done'),
    )
    d = d.withColumn("w", words)
    return d.withColumn("response", F.when(F.col("doc_id") % 10 == 7, "I cannot answer {").otherwise(answer))


@query(
    "parse_json_object",
    f"""WITH {DOC_ANSWER}, x AS (SELECT doc_id, regexp_extract(response, '(?s)\\{{.*\\}}', 0) AS j FROM ans)
    SELECT doc_id, j <> '' AND json_valid(j) AS parsed, coalesce(CASE WHEN json_valid(j) THEN j->>'$.domain' END, '-') AS domain FROM x""",
)
def _(spark, sf):
    d = doc_answers(spark, sf).withColumn("v", an.parse_object(F.col("response")))
    return d.select(
        "doc_id", F.col("v").isNotNull().alias("parsed"), F.coalesce(F.try_variant_get("v", "$.domain", "string"), F.lit("-")).alias("domain")
    )


REPO_FEATS = f"""{DOC_ANSWER}, rf AS (SELECT doc_id, text, doc_id % 10 <> 7 AS parsed, CASE WHEN doc_id % 10 <> 7 THEN 'about ' || coalesce(w[1], 'x') ELSE '' END AS summary,
  CASE WHEN doc_id % 10 <> 7 THEN [coalesce(w[1], 'x'), coalesce(w[3], 'y'), 'zzqq', '5'] ELSE [] END AS skills, CASE WHEN doc_id % 10 <> 7 THEN 'd' || doc_id % 3 ELSE '' END AS domain FROM ans)"""


@query(
    "repo_features",
    f"""WITH {REPO_FEATS} SELECT doc_id AS repo_id, summary, array_to_string(skills, ',') AS skills, domain, parsed FROM rf""",
)
def _(spark, sf):
    d = an.repo_features(doc_answers(spark, sf).withColumnRenamed("doc_id", "repo_id"))
    return d.withColumn("skills", F.array_join("skills", ","))


# answers about conversations: one batch per conversation, its turns are the issues ------------------------
LEVEL = "CASE WHEN turn % 4 = 0 THEN 'Easy' WHEN turn % 4 = 1 THEN ' medium ' WHEN turn % 4 = 2 THEN 'hard' ELSE 'unsure' END"
EVID = "array_to_string(regexp_extract_all(lower(text), '[a-z]+')[2:8], ' ') || CASE WHEN conv_id % 3 = 0 THEN ' qqq www eee rrr ttt yyy uuu iii' ELSE '' END"
CONV_ANSWER = f"""cb AS (SELECT conv_id, turn, text, {LEVEL} AS lv, {EVID} AS ev, coalesce(regexp_extract_all(lower(text), '[a-z]+')[1], 'none') AS w1 FROM conversations),
resp AS (SELECT conv_id, CASE WHEN conv_id % 8 = 5 THEN 'no idea' ELSE 'Here: {{"issues": [' || string_agg('{{"id": ' || CASE WHEN turn % 2 = 0 THEN '' || (turn + 1) ELSE '"' || (turn + 1) || '"' END || ', "difficulty": "' || lv || '", "skills": ["' || w1 || '", "made up"], "evidence": "' || ev || '"}}', ', ' ORDER BY turn)
  || ', {{"id": "x"}}, 7]}}' END AS response FROM cb GROUP BY conv_id)"""


def conv_answers(spark, sf):
    c = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    level = F.element_at(F.array(*[F.lit(x) for x in ("Easy", " medium ", "hard", "unsure")]), (F.col("turn") % 4 + 1).cast("int"))
    tail = F.when(F.col("conv_id") % 3 == 0, " qqq www eee rrr ttt yyy uuu iii").otherwise("")
    evid = F.concat(F.array_join(F.slice("w", 2, 7), " "), tail)
    number = (F.col("turn") + 1).cast("string")
    ident = F.when(F.col("turn") % 2 == 0, number).otherwise(F.concat(F.lit('"'), number, F.lit('"')))
    entry = F.concat(
        F.lit('{"id": '), ident, F.lit(', "difficulty": "'), level, F.lit('", "skills": ["'), F.coalesce(F.get("w", F.lit(0)), F.lit("none")),
        F.lit('", "made up"], "evidence": "'), evid, F.lit('"}'),
    )
    rows = c.withColumn("w", words).select("conv_id", "turn", entry.alias("entry"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "entry"))).alias("r"))
    text = F.concat(F.lit('Here: {"issues": ['), F.array_join(F.transform("r", lambda x: x["entry"]), ", "), F.lit(', {"id": "x"}, 7]}'))
    responses = lists.select(
        F.col("conv_id").alias("batch"), F.when(F.col("conv_id") % 8 == 5, "no idea").otherwise(text).alias("response")
    )
    row = F.col("conv_id") * 1000 + F.col("turn")
    batches = c.select(F.col("conv_id").alias("batch"), (F.col("turn") + 1).cast("int").alias("position"), row.alias("issue_row"))
    return responses, batches, c.select(row.alias("issue_row"), F.col("text").alias("source"))


ISSUE_FEATS = f"""{CONV_ANSWER}, xf AS (SELECT conv_id * 1000 + turn AS issue_row, text, CASE WHEN conv_id % 8 <> 5 AND lower(trim(lv)) IN ('easy', 'medium', 'hard') THEN lower(trim(lv)) END AS difficulty,
  CASE WHEN conv_id % 8 <> 5 THEN [w1, 'made up'] ELSE [] END AS skills, CASE WHEN conv_id % 8 <> 5 THEN trim(ev) ELSE '' END AS evidence FROM cb)"""


@query(
    "issue_features_parsed",
    f"""WITH {ISSUE_FEATS} SELECT issue_row, coalesce(difficulty, '-') AS difficulty, array_to_string(skills, ',') AS skills, evidence FROM xf""",
)
def _(spark, sf):
    responses, batches, _src = conv_answers(spark, sf)
    d = an.issue_features(cut(responses, "responses"), batches)
    return d.select("issue_row", F.coalesce("difficulty", F.lit("-")).alias("difficulty"), F.array_join("skills", ",").alias("skills"), "evidence")


NORM = lambda e: f"trim(regexp_replace(lower({e}), '[^a-z0-9+#.]+', ' ', 'g'))"
EVID_OK = """CASE WHEN ne = '' THEN false WHEN len(ws) < 4 THEN contains(src, ne)
  ELSE len(list_filter(range(1, len(ws) - 2), lambda i: contains(src, array_to_string(ws[i:i + 3], ' ')))) / CAST(len(ws) - 3 AS DOUBLE) >= 0.5 END"""
GROUND = f"""gi AS (SELECT *, {EVID_OK} AS copied FROM (SELECT *, string_split(ne, ' ') AS ws FROM (SELECT *, {NORM('evidence')} AS ne, {NORM('text')} AS src FROM xf)))"""


@query(
    "grounding_checks",
    f"""WITH {ISSUE_FEATS}, {GROUND} SELECT issue_row, copied, CAST(len(list_filter(skills, lambda s: contains(src, s))) AS BIGINT) AS skills_found FROM gi""",
)
def _(spark, sf):
    responses, batches, src = conv_answers(spark, sf)
    d = an.issue_features(cut(responses, "responses"), batches).join(src, "issue_row")
    hits = F.filter("skills", lambda s: an.skill_grounded(s, F.col("source")))
    return d.select(
        "issue_row", an.evidence_grounded(F.col("evidence"), F.col("source")).alias("copied"), F.size(hits).cast("long").alias("skills_found")
    )


@query(
    "grounding_report",
    f"""WITH {REPO_FEATS}, {ISSUE_FEATS}, {GROUND}, rs AS (SELECT CASE WHEN contains({NORM('text')}, s) THEN 1.0 ELSE 0.0 END AS ok FROM (SELECT text, unnest(skills) AS s FROM rf)),
    gs AS (SELECT CASE WHEN contains(src, s) THEN 1.0 ELSE 0.0 END AS ok FROM (SELECT src, unnest(skills) AS s FROM gi))
    SELECT 'repo' AS kind, 'outputs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM rf UNION ALL SELECT 'repo', 'parse_rate', round(avg(CAST(parsed AS INT)), 6) FROM rf
    UNION ALL SELECT 'repo', 'skills_in_source', round(avg(ok), 6) FROM rs UNION ALL SELECT 'issue', 'outputs', count(*) FROM gi
    UNION ALL SELECT 'issue', 'difficulty_valid', round(avg(CASE WHEN difficulty IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM gi UNION ALL SELECT 'issue', 'skills_in_source', round(avg(ok), 6) FROM gs
    UNION ALL SELECT 'issue', 'evidence_copied', round(avg(CAST(copied AS INT)), 6) FROM gi
    UNION ALL SELECT 'issue', 'difficulty_' || difficulty, round(count(*) / CAST((SELECT count(difficulty) FROM gi) AS DOUBLE), 6) FROM gi WHERE difficulty IS NOT NULL GROUP BY difficulty""",
)
def _(spark, sf):
    docs = doc_answers(spark, sf).withColumnRenamed("doc_id", "repo_id")
    r = an.repo_features(docs).join(docs.select("repo_id", F.col("text").alias("source")), "repo_id")
    responses, batches, src = conv_answers(spark, sf)
    i = an.issue_features(cut(responses, "responses"), batches).join(src, "issue_row")
    return an.grounding_report(r, i).withColumn("value", F.round("value", 6))


# rankings: an order's lines rank the candidates 0..9 ------------------------------------------------------
RANK_TEXT = """rt AS (SELECT l_orderkey AS list, l_linenumber AS line, 'Answer: [' || (l_partkey % 12) || '] > [' || (l_suppkey % 12) || '] > [' || (l_partkey % 12) || '] > [x] [' || (CAST(l_quantity AS BIGINT) % 15) || ']' AS text FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)),
pv AS (SELECT list, line, min(seat) AS seat, k FROM (SELECT list, line, generate_subscripts(ks, 1) AS seat, CAST(unnest(ks) AS INT) - 1 AS k FROM (SELECT list, line, regexp_extract_all(text, '\\[([0-9]+)\\]', 1) AS ks FROM rt)) WHERE k >= 0 AND k < 10 GROUP BY list, line, k),
ro AS MATERIALIZED (SELECT list, line, k, row_number() OVER (PARTITION BY list, line ORDER BY coalesce(seat, 1000 + k)) - 1 AS pos FROM (SELECT rt.list, rt.line, x.k, pv.seat FROM rt CROSS JOIN range(0, 10) x(k) LEFT JOIN pv ON pv.list = rt.list AND pv.line = rt.line AND pv.k = x.k))"""


def rankings(spark, sf):
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("f")
    l = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "f.*")
    bracket = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    gt = F.lit(" > ")
    a, b, c = F.col("l_partkey") % 12, F.col("l_suppkey") % 12, F.col("l_quantity").cast("long") % 15
    text = F.concat(F.lit("Answer: "), bracket(a), gt, bracket(b), gt, bracket(a), gt, F.lit("[x] "), bracket(c))
    order, missing = an.parse_ranking(text, F.lit(10))
    return l.select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("line"), order.alias("order"), missing.alias("missing"))


@query(
    "parse_ranking",
    f"""WITH {RANK_TEXT}
    SELECT list, line, string_agg(CAST(k AS VARCHAR), ',' ORDER BY pos) AS "order", any_value(m) AS missing FROM ro JOIN (SELECT list, line, 10 - count(*) AS m FROM pv GROUP BY 1, 2) USING (list, line) GROUP BY 1, 2
    UNION ALL SELECT list, line, '0,1,2,3,4,5,6,7,8,9', 10 FROM rt ANTI JOIN pv USING (list, line)""",
)
def _(spark, sf):
    d = rankings(spark, sf)
    text = F.array_join(F.transform("order", lambda x: x.cast("string")), ",")
    return d.select("list", "line", text.alias("order"), F.col("missing").cast("long").alias("missing"))


@query(
    "borda",
    f"""WITH {RANK_TEXT},
    n AS (SELECT *, dense_rank() OVER (PARTITION BY list ORDER BY line) - 1 AS ranking FROM ro), b AS (SELECT list, k AS candidate, CAST(sum(10 - pos) AS BIGINT) AS points, min(pos) FILTER (ranking = 0) AS f FROM n GROUP BY 1, 2)
    SELECT list, candidate, points, row_number() OVER (PARTITION BY list ORDER BY points DESC, f, candidate) AS place FROM b""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("list").orderBy("line")
    r = rankings(spark, sf).withColumn("ranking", F.dense_rank().over(w) - 1)
    d = an.borda(r.dropDuplicates(["list", "ranking"]))
    return d.select("list", F.col("candidate").cast("long").alias("candidate"), "points", F.col("place").cast("long").alias("place"))


@query(
    "scaled_scores",
    """WITH s AS (SELECT l_orderkey AS list, l_partkey AS item, CAST(l_extendedprice AS DOUBLE) AS score FROM lineitem)
    SELECT list, item, round(score, 2) AS score, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY list)""",
)
def _(spark, sf):
    s = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("item"), F.col("l_extendedprice").alias("score")
    )
    d = an.scaled_scores(s)
    return d.select("list", "item", F.round("score", 2).alias("score"), F.round("scaled", 6).alias("scaled"))


RERANK = f"""{KNN_SCORE}, {TGT}, pop AS (SELECT i.item, count(t.item) AS pop FROM (SELECT DISTINCT item FROM split) i LEFT JOIN tr t USING (item) GROUP BY 1),
ix AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS rank FROM (SELECT DISTINCT item FROM split)),
ch AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY md5('0,' || "user" || ',' || item), item) AS r FROM tgt) WHERE r = 1),
dr AS (SELECT "user", item, min(d) AS draw FROM (SELECT "user", d, CAST('0x' || substr(md5('0,' || "user" || ',' || d), 1, 15) AS BIGINT) % (SELECT count(*) FROM ix) AS rank FROM ch, range(0, 240) x(d)) JOIN ix USING (rank) GROUP BY 1, 2),
ng AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY draw) AS r FROM dr WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s."user" = dr."user" AND s.item = dr.item)) WHERE r <= 19),
cs AS (SELECT "user", item, true AS t FROM ch UNION ALL SELECT "user", item, false FROM ng),
od AS (SELECT 'model_order' AS variant, c."user", t, row_number() OVER (PARTITION BY c."user" ORDER BY round(coalesce(k.score, 0), 9) DESC, c.item) AS rank FROM cs c LEFT JOIN knn k ON k."user" = c."user" AND k.item = c.item
  UNION ALL SELECT 'popularity_order', c."user", t, row_number() OVER (PARTITION BY c."user" ORDER BY pop DESC, c.item) FROM cs c JOIN pop USING (item))"""


@query(
    "rerank_eval",
    f"""WITH {RERANK} SELECT variant, count(*) AS n_users, round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0 END), 6) AS ndcg_10,
    round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(1.0 / log2(CAST(rank AS DOUBLE) + 1)), 6) AS ndcg_20 FROM od WHERE t GROUP BY 1""",
)
def rerank_eval(spark, sf):
    from pyspark.sql.window import Window

    s = I.split(spark, sf)
    train = s.filter("part = 'train'")
    ids = cut(id_map(s, "item"), "ids")
    index = ids.select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    sets = cut(an.random_candidate_sets(ev.targets_of(s, "test"), s.select("user", "item"), index, ids.count()), "sets")
    scores = nb.itemknn_pairs(train, nb.itemknn_fit(train), sets)
    known = sets.join(unbounded(scores), ["user", "item"], "left").join(unbounded(item_popularity(train, s)), "item")
    orders = {
        "model_order": [F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), F.col("item")],
        "popularity_order": [F.col("pop").desc(), F.col("item")],
    }
    known = cut(known, "known")
    out = None
    for name, order in orders.items():
        w = Window.partitionBy("user").orderBy(*order)
        d = known.select(F.lit(name).alias("variant"), "user", "is_target", F.row_number().over(w).alias("rank"))
        out = d if out is None else out.unionByName(d)
    one = sets.select("user").distinct().withColumn("n", F.lit(1))
    per = an.order_metrics(out, one)
    return per.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.round(F.avg("ndcg_k"), 6).alias("ndcg_10"),
        F.round(F.avg("recall_k"), 6).alias("recall_10"),
        F.round(F.avg("ndcg_full"), 6).alias("ndcg_20"),
    )


# both candidate sets: random items beside one target, and the model's own first 20
SETS = f"""{RERANK}, {full_top('knn')},
sets AS MATERIALIZED (SELECT 'random20' AS "set", "user", item, t FROM cs
  UNION ALL SELECT 'model20', "user", item, EXISTS (SELECT 1 FROM tgt g WHERE g."user" = top."user" AND g.item = top.item) FROM top),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "set", "user" ORDER BY item) - 1 AS c FROM sets),
said AS (SELECT *, row_number() OVER (PARTITION BY "set", "user", s ORDER BY md5(s || ',' || "user" || ',' || item)) - 1 AS pos FROM cand, range(0, 3) x(s)),
pts AS (SELECT "set", "user", c, t, sum(n - pos) AS points, min(pos) FILTER (s = 0) AS f FROM said JOIN (SELECT "set", "user", count(*) AS n FROM cand GROUP BY 1, 2) USING ("set", "user") GROUP BY ALL),
ords AS MATERIALIZED (
  SELECT "set", "set" || '_model_order' AS variant, a."user", t, row_number() OVER (PARTITION BY "set", a."user" ORDER BY round(coalesce(k.score, 0), 9) DESC, a.item) AS rank FROM cand a LEFT JOIN knn k ON k."user" = a."user" AND k.item = a.item
  UNION ALL SELECT "set", "set" || '_popularity_order', "user", t, row_number() OVER (PARTITION BY "set", "user" ORDER BY pop DESC, item) FROM cand JOIN pop USING (item)
  UNION ALL SELECT "set", "set" || '_text', "user", t, row_number() OVER (PARTITION BY "set", "user" ORDER BY points DESC, f, c) FROM pts),
nts AS (SELECT 'random20' AS "set", "user", 1 AS n FROM ch UNION ALL SELECT 'model20', "user", count(*) FROM tgt GROUP BY 2),
{IDCG},
per AS MATERIALIZED (SELECT o."set", variant, o."user", sum(CASE WHEN t AND rank <= 10 THEN 1.0 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0 END) / any_value(a.ideal) AS ndcg_10,
    CAST(count(*) FILTER (t AND rank <= 10) AS DOUBLE) / any_value(nts.n) AS recall_10, sum(CASE WHEN t AND rank <= 20 THEN 1.0 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0 END) / any_value(b.ideal) AS ndcg_20
  FROM ords o JOIN nts ON nts."set" = o."set" AND nts."user" = o."user" JOIN (SELECT n AS m, ideal FROM idcg) a ON a.m = least(nts.n, 10) JOIN (SELECT n AS m, ideal FROM idcg) b ON b.m = least(nts.n, 20) GROUP BY 1, 2, 3)"""
COMPARED = (("text", "model_order"), ("text", "popularity_order"))


def reranked(spark, sf):
    """set, variant, user and the metrics of both candidate sets in all their orders. An answer is a
    ranking of the candidates by the md5 of answer, user and item."""
    s = I.split(spark, sf)
    train, targets, seen = s.filter("part = 'train'"), ev.targets_of(s, "test"), ev.seen_of(s, "test")
    ids = cut(id_map(s, "item"), "ids")
    index = ids.select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    sims = cut(nb.itemknn_fit(train), "sims")
    drawn = an.random_candidate_sets(targets, s.select("user", "item"), index, ids.count())
    top = nb.fill_topk(nb.itemknn_topk(train, sims, targets, seen), targets, seen, index)
    hits = top.select("user", "item").join(unbounded(targets.withColumn("is_target", F.lit(True))), ["user", "item"], "left")
    model = hits.select(F.lit("model20").alias("set"), "user", "item", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    sets = cut(drawn.select(F.lit("random20").alias("set"), "user", "item", "is_target").unionByName(model), "sets")
    scores = nb.itemknn_pairs(train, sims, sets)
    said = sets.withColumn("candidate", F.row_number().over(Window.partitionBy("set", "user").orderBy("item")))
    key = lambda k: F.md5(F.concat_ws(",", F.lit(str(k)), F.col("user").cast("string"), F.col("item").cast("string")))
    lists = said.groupBy("set", "user").agg(*[F.array_sort(F.collect_list(F.struct(key(k).alias("key"), "candidate"))).alias(f"a{k}") for k in range(3)])
    each = lists.select("set", "user", F.posexplode(F.array("a0", "a1", "a2")).alias("ranking", "a"))
    text = F.array_join(F.transform("a", lambda x: F.concat(F.lit("["), x["candidate"].cast("string"), F.lit("]"))), " > ")
    orders = an.candidate_orders(sets, scores, item_popularity(train, s), each.select("set", "user", "ranking", text.alias("text")))
    n = targets.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    one = orders.filter("set = 'random20'").drop("set")
    several = orders.filter("set = 'model20'").drop("set")
    drawn_metrics = an.order_metrics(one, n.withColumn("n", F.lit(1).cast("long"))).withColumn("set", F.lit("random20"))
    return cut(drawn_metrics.unionByName(an.order_metrics(several, n).withColumn("set", F.lit("model20"))), "reranked")


@query(
    "rerank_sets",
    f"""WITH {SETS} SELECT "set", variant, count(*) AS n_users, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_20), 6) AS ndcg_20 FROM per GROUP BY 1, 2""",
)
def _(spark, sf):
    means = [F.round(F.avg(c), 6).alias(o) for c, o in (("ndcg_k", "ndcg_10"), ("recall_k", "recall_10"), ("ndcg_full", "ndcg_20"))]
    return reranked(spark, sf).groupBy("set", "variant").agg(F.count(F.lit(1)).alias("n_users"), *means)


@query(
    "rerank_cis",
    f"""WITH {SETS}, val AS MATERIALIZED (SELECT "set", variant AS series, "user", ndcg_10 AS value FROM per), {boot_sql('val', '"set"', 1_000)},
    pr AS (SELECT s AS "set", s || '_text' AS a, s || '_' || o AS b FROM (VALUES ('random20'), ('model20')) x(s), (VALUES {', '.join(f"('{b}')" for _, b in COMPARED)}) y(o)), {interval_sql('"set"', 'pr')} SELECT * FROM pci""",
)
def _(spark, sf):
    v = reranked(spark, sf).select("set", F.col("variant").alias("series"), "user", F.col("ndcg_k").alias("value"))
    pairs = spark.createDataFrame([(x, f"{x}_{a}", f"{x}_{b}") for x in ("random20", "model20") for a, b in COMPARED], "set string, a string, b string")
    return rounded(paired_intervals(v, pairs, ["set"], 1_000))


# explanations: claims about a part, facts that cover some of them ------------------------------------------
CLAIM = """'This ' || p_type || ' project by org' || p_size || '/' || replace(p_name, ' ', '-') || ' uses python and C++, is easy, "' || p_name || '." has ' || p_partkey || ' stars; people starred it'"""
CLAIM_FACTS = """['Repository: ' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN ' (main language: Python).' ELSE '.' END, CASE WHEN p_size % 3 = 0 THEN 'Estimated difficulty: easy. ' || p_partkey ELSE 'People who starred org' || p_size || '/' || replace(p_name, ' ', '-') END]"""


@query(
    "faithfulness_check",
    f"""WITH c AS (SELECT p_partkey, p_size, p_name, p_type, {CLAIM} AS t, {CLAIM_FACTS} AS f FROM part), n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(array_to_string(f, ' ')), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS fs FROM c),
    m AS (SELECT p_partkey, unnest(list_filter([CASE WHEN NOT contains(fs, 'python') THEN 'python' END, CASE WHEN NOT contains(fs, 'c++') THEN 'c++' END, CASE WHEN NOT contains(fs, 'easy') THEN 'easy' END, CASE WHEN p_type = 'MEDIUM' AND NOT contains(fs, 'medium') THEN 'medium' END,
      CASE WHEN NOT contains(fs, 'starred') THEN 'starred-claim' END, CASE WHEN NOT contains(fs, lower(replace('org' || p_size || '/' || replace(p_name, ' ', '-'), '-', ' '))) THEN 'org' || p_size || '/' || replace(p_name, ' ', '-') END,
      CASE WHEN NOT contains(fs, p_name) THEN p_name END, CASE WHEN NOT contains(fs, CAST(p_partkey AS VARCHAR)) THEN CAST(p_partkey AS VARCHAR) END], lambda x: x IS NOT NULL)) AS w FROM n)
    SELECT p_partkey, string_agg(w, '; ' ORDER BY w) AS unsupported FROM (SELECT DISTINCT p_partkey, w FROM m) GROUP BY 1""",
)
def _(spark, sf):
    # a table of few megabytes is read by few tasks, and the claims take far longer than the reading
    p = spread(I.table(spark, sf, "part"), "p_partkey")
    p = p.select("p_partkey", F.expr(CLAIM).alias("t"), F.expr(CLAIM_FACTS.replace("[", "array(").replace("]", ")")).alias("f"))
    bad = an.unsupported_claims(F.col("t"), F.col("f"))
    return p.select("p_partkey", F.array_join(bad, "; ").alias("unsupported")).filter("unsupported <> ''")


@query(
    "names_supported",
    f"""WITH c AS (SELECT p_partkey, p_size, p_name, {CLAIM_FACTS} AS f FROM part) SELECT p_partkey, contains(lower(array_to_string(f, ' ')), lower('org' || p_size || '/' || replace(p_name, ' ', '-'))) AS supported FROM c""",
)
def _(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", F.expr(CLAIM).alias("t"), F.expr(CLAIM_FACTS.replace("[", "array(").replace("]", ")")).alias("f"))
    return p.select("p_partkey", an.names_supported(F.col("t"), F.col("f")).alias("supported"))


# judge: ratings of an order's lines ---------------------------------------------------------------------------
RATED = """jr AS (SELECT l_orderkey AS persona, l_linenumber AS rank, l_partkey AS item FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
js AS (SELECT persona, rank, item, CASE WHEN persona % 9 <> 4 AND rank % 5 <> 0 THEN (persona + rank) % 3 END AS s FROM jr)"""


def judged(spark, sf):
    l = I.table(spark, sf, "lineitem")
    recs = l.groupBy(F.col("l_orderkey").alias("persona"), F.col("l_linenumber").alias("rank")).agg(F.min("l_partkey").alias("item"))
    recs = cut(recs, "recs")
    entry = F.concat(
        F.lit('{"id": '), F.when(F.col("rank") % 2 == 0, F.col("rank").cast("string")).otherwise(F.concat(F.lit('"'), "rank", F.lit('"'))),
        F.lit(', "score": '), (F.col("persona") + F.col("rank")) % 3, F.lit("}"),
    )
    lists = recs.filter("rank % 5 <> 0").groupBy("persona").agg(F.array_join(F.collect_list(entry), ", ").alias("t"))
    answer = F.when(F.col("persona") % 9 == 4, "sorry").otherwise(F.concat(F.lit('{"ratings": ['), "t", F.lit(', {"id": "n/a"}]}')))
    return an.judge_ratings(recs, lists.select("persona", answer.alias("response")))


@query(
    "judge_table",
    f"""WITH {RATED}, x AS (SELECT 'all' AS scope, s FROM js UNION ALL SELECT CAST(persona AS VARCHAR), s FROM js)
    SELECT scope, count(*) AS n, round(coalesce(avg(s), -1), 6) AS mean, round(avg(CASE WHEN s = 2 THEN 1.0 ELSE 0.0 END), 6) AS good, round(avg(CASE WHEN s >= 1 THEN 1.0 ELSE 0.0 END), 6) AS partly, count(*) FILTER (s IS NULL) AS unrated FROM x GROUP BY 1""",
)
def _(spark, sf):
    d = an.judge_summary(judged(spark, sf))
    return d.select(
        "scope", "n", F.round(F.coalesce("mean", F.lit(-1.0)), 6).alias("mean"), F.round("good", 6).alias("good"), F.round("partly", 6).alias("partly"), "unrated"
    )


@query(
    "judge_blind_sample",
    f"""WITH {RATED} SELECT persona, rank, item FROM js ORDER BY md5('0,' || persona || ',' || rank), persona, rank LIMIT 60""",
)
def _(spark, sf):
    return an.blind_sample(judged(spark, sf), 60)
