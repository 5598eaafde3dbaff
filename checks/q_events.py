"""Event-log queries: external activity, first touches, repository scoping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from tidemark.operators import eventlog as el
from tidemark.operators import scope as sc
from tidemark.scale import cut

WINDOWS = el.Windows(I.TRAIN_START, I.VAL_START, I.TEST_START, I.TEST_END)

# raw log: logins, renamed repositories and a payload made from the event row
RAW = f"""CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'click' THEN 'ForkEvent' WHEN 'purchase' THEN 'PullRequestEvent'
    WHEN 'error' THEN 'IssuesEvent' ELSE 'PushEvent' END AS type, user_id AS actor_id, us AS created_us, sec AS ts,
  CASE WHEN user_id % 23 = 0 THEN 'helper' || user_id || '[bot]' ELSE 'Org' || user_id END AS login,
  CASE WHEN sec >= {I.VAL_START} AND k >= 80 THEN k + 100 ELSE k END AS repo_id,
  'org' || k || '/repo' || k || CASE WHEN sec >= {I.TEST_START} THEN '-new' ELSE '' END AS repo_name,
  CASE event_type WHEN 'purchase' THEN '{{"action":"' || CASE WHEN value < 20 THEN 'opened' ELSE 'closed' END || '","pull_request":{{"number":' || event_id || '}}}}'
    WHEN 'error' THEN '{{"action":"' || CASE WHEN value < 20 THEN 'opened' ELSE 'closed' END || '","issue":{{"number":' || event_id
      || ',"user":{{"login":"ORG' || (user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) || '"}},"labels":[{{"name":"Bug"}},{{"name":"Level ' || k || '"}}]}}}}'
    ELSE '{{"number":' || event_id || ',"labels":[{{"name":"Top' || k || '"}}]}}' END AS payload"""
RAW_SQL = f"""raw AS (SELECT {RAW} FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, epoch_us(ts) AS us,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events))"""


def raw_events(spark, sf):
    base = I.table(spark, sf, "events").withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("long"),
            "us": F.unix_micros(F.col("ts").cast("timestamp")),
        }
    )
    base = base.withColumn("sec", F.floor(F.col("us") / 1_000_000)).drop("ts")
    return base.selectExpr(*_split_columns(RAW))


def _split_columns(text: str) -> list[str]:
    """Top-level comma pieces of a select list."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "(":
            depth += 1
        elif not quoted and ch in ")":
            depth -= 1
        elif ch == "," and not quoted and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


KEPT = """kept AS (SELECT * FROM raw WHERE NOT regexp_matches(lower(login), '(\\[bot\\]$|bot$|-ci$|^dependabot|^renovate|^github-actions)')
  AND lower(login) <> lower(split_part(repo_name, '/', 1)))"""
EXT = f"""{RAW_SQL}, {KEPT}, ext AS (SELECT * FROM kept k WHERE type <> 'PushEvent' AND NOT EXISTS
  (SELECT 1 FROM kept m WHERE m.type = 'PushEvent' AND m.actor_id = k.actor_id AND m.repo_id = k.repo_id))"""
RAW_COLUMNS = "type, actor_id, repo_id, repo_name, created_us"


@query("drop_bots_and_owners", f"WITH {RAW_SQL}, {KEPT} SELECT {RAW_COLUMNS}, login FROM kept")
def _(spark, sf):
    return el.drop_bots_and_owners(raw_events(spark, sf)).select(*RAW_COLUMNS.split(", "), "login")


@query("external_events", f"WITH {EXT} SELECT {RAW_COLUMNS} FROM ext")
def _(spark, sf):
    return el.external_events(raw_events(spark, sf)).select(*RAW_COLUMNS.split(", "))


def activity_sql(source: str, least: int) -> str:
    def did(cond: str) -> str:
        return f"count(DISTINCT CASE WHEN {cond} THEN actor_id END)"

    return f"""SELECT repo_id, arg_max(repo_name, created_us) AS repo_name, {did("type = 'WatchEvent'")} AS n_star,
    {did("type = 'ForkEvent'")} AS n_fork, {did("type = 'PullRequestEvent'")} AS n_pr, {did("type = 'IssuesEvent'")} AS n_issue,
    {did("type IN ('PullRequestEvent', 'IssuesEvent')")} AS n_contrib, count(DISTINCT actor_id) AS n_actors
    FROM {source} GROUP BY repo_id HAVING count(DISTINCT actor_id) >= {least}"""


@query("repo_activity", f"WITH {EXT} {activity_sql('ext', 20)}")
def _(spark, sf):
    return el.repo_activity(el.external_events(raw_events(spark, sf)), 20)


@query(
    "co_touch",
    f"""WITH {EXT}, seeds AS (SELECT DISTINCT p_size AS repo_id FROM part WHERE p_size <= 10)
    SELECT repo_id, arg_max(repo_name, created_us) AS repo_name, count(DISTINCT actor_id) AS n_shared FROM ext
    WHERE actor_id IN (SELECT actor_id FROM ext WHERE repo_id IN (SELECT repo_id FROM seeds))
      AND repo_id NOT IN (SELECT repo_id FROM seeds) GROUP BY 1 HAVING count(DISTINCT actor_id) >= 30""",
)
def _(spark, sf):
    seeds = I.table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_size").alias("repo_id"))
    ext = el.external_events(raw_events(spark, sf))
    return el.co_touch(ext, seeds, 30)


@query(
    "day_events",
    f"""WITH {RAW_SQL}, {KEPT} SELECT CAST(floor(created_us / 86400000000) AS BIGINT) AS day,
      CASE type WHEN 'WatchEvent' THEN 'star' WHEN 'ForkEvent' THEN 'fork' WHEN 'PullRequestEvent' THEN 'pr' WHEN 'IssuesEvent' THEN 'issue' ELSE 'push' END AS kind,
      actor_id, repo_id, min(created_us) AS first_us, count(*) AS n, arg_max(repo_name, created_us) AS repo_name
    FROM kept WHERE repo_id IN (SELECT p_size FROM part) GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    repos = I.table(spark, sf, "part").select(F.col("p_size").alias("repo_id"))
    return el.day_events(raw_events(spark, sf), repos)


FACTS = """facts AS (SELECT type, actor_id, repo_id, created_us, payload->>'$.action' AS action,
  coalesce(payload->>'$.pull_request.number', payload->>'$.issue.number', payload->>'$.number') AS number,
  lower(payload->>'$.issue.user.login') = lower(login) AS actor_is_issue_author,
  list_transform(coalesce(json_extract_string(payload, '$.issue.labels[*].name'), []) || CASE WHEN json_extract(payload, '$.issue.labels') IS NULL
    THEN coalesce(json_extract_string(payload, '$.labels[*].name'), []) ELSE [] END, lambda x: lower(x)) AS labels FROM raw)"""


@query(
    "payload_facts",
    f"""WITH {RAW_SQL}, {FACTS} SELECT type, actor_id, repo_id, created_us, coalesce(action, '-') AS action, number,
    coalesce(CAST(actor_is_issue_author AS VARCHAR), '-') AS author, array_to_string(labels, ',') AS labels FROM facts""",
)
def _(spark, sf):
    return el.payload_facts(raw_events(spark, sf)).select(
        "type",
        "actor_id",
        "repo_id",
        "created_us",
        F.coalesce("action", F.lit("-")).alias("action"),
        "number",
        F.coalesce(F.col("actor_is_issue_author").cast("string"), F.lit("-")).alias("author"),
        F.array_join("labels", ",").alias("labels"),
    )


INTERACTIONS = f"""{I.EVENTS}, win AS (SELECT *, CASE WHEN ts < {I.VAL_START} THEN {I.VAL_START} WHEN ts < {I.TEST_START} THEN {I.TEST_START} ELSE {I.TEST_END} END AS win_end
  FROM ev WHERE ts >= {I.TRAIN_START} AND ts < {I.TEST_END} AND repo_id IN (SELECT p_size FROM part)),
push AS (SELECT "user", repo_id, min(ts) AS fp FROM win WHERE kind = 'push' GROUP BY ALL),
kept AS (SELECT w.* FROM win w LEFT JOIN push p USING ("user", repo_id) WHERE kind <> 'push' AND (fp IS NULL OR fp >= win_end)),
ft AS (SELECT "user", repo_id, arg_min(struct_pack(ts := ts, kind := kind, win_end := win_end), struct_pack(ts := ts, kind := kind)) AS f FROM kept GROUP BY ALL),
con AS (SELECT DISTINCT "user", repo_id, win_end FROM kept WHERE kind IN ('pr', 'issue', 'comment', 'review')),
inter AS (SELECT f."user", f.repo_id AS item, f.f.ts AS ts, f.f.kind AS kind, c."user" IS NOT NULL AS contrib
  FROM ft f LEFT JOIN con c ON c."user" = f."user" AND c.repo_id = f.repo_id AND c.win_end = f.f.win_end)"""


def sized_repos(spark, sf):
    return I.table(spark, sf, "part").select(F.col("p_size").cast("long").alias("repo_id"))


@query("interactions", f'WITH {INTERACTIONS} SELECT "user", item, ts, kind, contrib FROM inter')
def _(spark, sf):
    return el.interactions(I.events(spark, sf), sized_repos(spark, sf), WINDOWS)


@query(
    "maintainer_share",
    f"""WITH {I.EVENTS}, e AS (SELECT * FROM ev WHERE repo_id IN (SELECT p_size FROM part)), m AS (SELECT DISTINCT "user", repo_id FROM e WHERE kind = 'push')
    SELECT kind, round(avg(CASE WHEN m."user" IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM e LEFT JOIN m USING ("user", repo_id)
    WHERE kind <> 'push' GROUP BY 1""",
)
def _(spark, sf):
    d = el.maintainer_share(I.events(spark, sf), sized_repos(spark, sf))
    return d.withColumn("share", F.round("share", 6))


@query(
    "attribution_check",
    f"""WITH {I.EVENTS}, {RAW_SQL}, {FACTS}, p AS (SELECT DISTINCT "user", repo_id FROM ev WHERE kind = 'push' AND ts < {I.TEST_END}),
    pairs AS (SELECT type, actor_id, f.repo_id, any_value(p."user" IS NOT NULL) AS maintainer,
      bool_or(CASE WHEN type = 'PullRequestEvent' THEN action = 'opened' ELSE action = 'opened' AND actor_is_issue_author END) AS authored, count(*) AS n
      FROM facts f LEFT JOIN p ON p."user" = f.actor_id AND p.repo_id = f.repo_id WHERE type IN ('PullRequestEvent', 'IssuesEvent') GROUP BY 1, 2, 3)
    SELECT type, maintainer, count(*) AS pairs, round(avg(CAST(authored AS INT)), 6) AS share_authored, CAST(sum(n) AS BIGINT) AS events FROM pairs GROUP BY 1, 2""",
)
def _(spark, sf):
    raw = raw_events(spark, sf).filter("type IN ('PullRequestEvent', 'IssuesEvent')")
    facts = el.payload_facts(raw).withColumnRenamed("actor_id", "user")
    d = el.attribution_check(facts, I.events(spark, sf), I.TEST_END)
    return d.withColumn("share_authored", F.round("share_authored", 6))


# scoping: newcomer labels are what a repository uses an even number of times --------------------
LABEL_OF = """CASE event_type WHEN 'view' THEN 'Good-First-Issue' WHEN 'click' THEN 'bug' WHEN 'purchase' THEN 'status: help wanted'
  WHEN 'error' THEN 'easyocr' ELSE 'documentation' END"""
LABELS = f"""lab AS (SELECT CAST(props->>'$.k' AS BIGINT) AS repo_id, {LABEL_OF} AS label,
  CAST(props->>'$.k' AS BIGINT) % 7 = 0 AS is_fork FROM events GROUP BY ALL HAVING count(*) % 2 = 0),
iss AS (SELECT CAST(props->>'$.k' AS BIGINT) AS repo_id, {LABEL_OF} AS label, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS created FROM events)"""
ACT_TRAIN = f"{EXT}, ext_t AS (SELECT * FROM ext WHERE ts < {I.VAL_START}), act AS ({activity_sql('ext_t', 5)})"
BEGINNER = f"""{ACT_TRAIN}, {LABELS}, cand AS (SELECT * FROM act WHERE n_contrib >= 10 ORDER BY n_contrib DESC, repo_id LIMIT 60),
used AS (SELECT repo_id, count(*) AS n_issues FROM iss JOIN lab USING (repo_id, label) WHERE created >= {I.TRAIN_START} AND created < {I.VAL_START}
  AND regexp_matches(label, '(?i)(^|[^a-z])(easy|good[\\s_-]*first[\\s_-]*issue|help[\\s_-]*wanted)([^a-z]|$)') GROUP BY 1),
beg AS (SELECT repo_id, n_contrib, n_issues FROM cand JOIN used USING (repo_id) WHERE repo_id NOT IN (SELECT repo_id FROM lab WHERE is_fork)
  ORDER BY n_contrib DESC, repo_id LIMIT 25)"""


def labels_and_issues(spark, sf):
    ev = I.table(spark, sf, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("repo_id"),
        F.expr(LABEL_OF).alias("label"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created"),
    )
    ev = cut(ev, "labelled")
    labels = (
        ev.groupBy("repo_id", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n % 2 = 0")
        .select("repo_id", "label", (F.col("repo_id") % 7 == 0).alias("is_fork"))
    )
    return labels, ev


def external(spark, sf):
    """(external events, creation of each repository); the log is parsed once for all that read them."""
    raw = cut(raw_events(spark, sf).select("type", "actor_id", "login", "repo_id", "repo_name", "ts", "created_us"), "raw")
    created = raw.groupBy("repo_id").agg(F.min("ts").alias("created"))
    return cut(el.external_events(raw), "external"), cut(created, "created")


def train_activity(ext):
    return cut(el.repo_activity(ext.filter(F.col("ts") < I.VAL_START), 5), "activity")


def beginner(spark, sf, activity=None):
    labels, issues = labels_and_issues(spark, sf)
    if activity is None:
        activity = train_activity(external(spark, sf)[0])
    return sc.beginner_repos(activity, labels, issues, I.TRAIN_START, I.VAL_START, 10, 60, 25)


@query("beginner_repos", f"WITH {BEGINNER} SELECT * FROM beg")
def _(spark, sf):
    return beginner(spark, sf)


COLD = f"""ext_l AS (SELECT * FROM ext WHERE ts >= {I.VAL_START}), later AS ({activity_sql('ext_l', 5)}),
meta AS (SELECT repo_id, repo_id % 7 = 0 AS is_fork, min(ts) AS created FROM raw GROUP BY 1),
cold AS (SELECT repo_id, n_actors FROM later WHERE repo_id NOT IN (SELECT repo_id FROM act) AND repo_id > (SELECT max(repo_id) FROM act)
  AND repo_id IN (SELECT repo_id FROM meta WHERE created >= {I.VAL_START} AND NOT is_fork))"""


def cold(ext, created, activity):
    later = el.repo_activity(ext.filter(F.col("ts") >= I.VAL_START), 5)
    meta = created.withColumn("is_fork", F.col("repo_id") % 7 == 0)
    return sc.cold_repos(later, activity, meta, I.VAL_START, 5)


@query("cold_repos", f"WITH {ACT_TRAIN}, {COLD} SELECT * FROM cold")
def _(spark, sf):
    ext, created = external(spark, sf)
    return cold(ext, created, train_activity(ext))


REPO_SET = f"""{BEGINNER}, {COLD}, broad AS (SELECT repo_id, count(DISTINCT actor_id) AS n_shared FROM ext_t
  WHERE actor_id IN (SELECT actor_id FROM ext_t WHERE repo_id IN (SELECT repo_id FROM beg)) AND repo_id NOT IN (SELECT repo_id FROM beg)
  GROUP BY 1 HAVING count(DISTINCT actor_id) >= 10),
rset AS (SELECT repo_id, 'beginner' AS "group" FROM beg UNION ALL
  SELECT repo_id, 'broad' FROM (SELECT * FROM broad ORDER BY n_shared DESC, repo_id LIMIT 30) UNION ALL
  SELECT repo_id, 'cold' FROM (SELECT * FROM cold ORDER BY n_actors DESC, repo_id LIMIT 10))"""


def chosen_repos(spark, sf):
    ext, created = external(spark, sf)
    activity = train_activity(ext)
    beg = cut(beginner(spark, sf, activity), "beginner")
    shared = el.co_touch(ext.filter(F.col("ts") < I.VAL_START), beg, 10)
    return sc.repo_set(beg, shared, cold(ext, created, activity), 30, 10)


@query("repo_set", f'WITH {REPO_SET} SELECT repo_id, "group" FROM rset')
def _(spark, sf):
    return chosen_repos(spark, sf)


COMMITS = """com AS (SELECT o_custkey AS repo_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority || ' ' || o_orderkey AS text FROM orders)"""


def commits(spark, sf):
    return I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("repo_id"),
        I.epoch("o_orderdate").alias("ts"),
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("text"),
    )


AS_OF = 915_148_800  # 1999-01-01


@query(
    "readme_as_of",
    f"""WITH {COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, text DESC) AS rn FROM com WHERE ts < {AS_OF})
    SELECT repo_id, ts AS committed, text FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return sc.text_as_of(commits(spark, sf), AS_OF)


@query(
    "readme_as_of_each",
    f"""WITH {COMMITS}, q AS (SELECT DISTINCT o_custkey AS repo_id, CAST(epoch(l_shipdate) AS BIGINT) AS cutoff FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT q.repo_id, q.cutoff, c.ts, c.text, row_number() OVER (PARTITION BY q.repo_id, q.cutoff ORDER BY c.ts DESC, c.text DESC) AS rn
      FROM q JOIN com c ON c.repo_id = q.repo_id AND c.ts < q.cutoff)
    SELECT repo_id, cutoff, ts AS committed, text FROM r WHERE rn = 1""",
)
def _(spark, sf):
    lines, orders = I.table(spark, sf, "lineitem"), I.table(spark, sf, "orders")
    cutoffs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("repo_id"), I.epoch("l_shipdate").alias("cutoff")
    )
    return sc.text_as_of_each(commits(spark, sf), cutoffs, 90 * I.DAY)


GROUPED = f"""{INTERACTIONS}, parted AS (SELECT *, CASE WHEN ts < {I.VAL_START} THEN 'train' WHEN ts < {I.TEST_START} THEN 'val' ELSE 'test' END AS part FROM inter),
imap AS (SELECT DISTINCT p_size AS item, CASE WHEN p_size % 3 = 0 THEN 'beginner' WHEN p_size % 3 = 1 THEN 'broad' ELSE 'cold' END AS "group" FROM part)"""


def parted(spark, sf):
    inter = el.interactions(I.events(spark, sf), sized_repos(spark, sf), WINDOWS)
    part = F.when(F.col("ts") < I.VAL_START, "train").when(F.col("ts") < I.TEST_START, "val").otherwise("test")
    return inter.withColumn("part", part)


@query(
    "source_stats",
    f"""WITH {GROUPED}, cold AS (SELECT item FROM imap WHERE item NOT IN (SELECT item FROM parted WHERE part = 'train'))
    SELECT part || '_kind_' || kind AS metric, CAST(count(*) AS DOUBLE) AS value FROM parted GROUP BY 1
    UNION ALL SELECT part || '_contrib_share', round(avg(CAST(contrib AS INT)), 6) FROM parted GROUP BY part
    UNION ALL SELECT part || '_users', count(DISTINCT "user") FROM parted GROUP BY part
    UNION ALL SELECT 'items_' || "group", count(*) FROM imap GROUP BY "group"
    UNION ALL SELECT 'cold_items', count(*) FROM cold
    UNION ALL SELECT 'test_pairs_on_cold_items', count(*) FROM parted WHERE part = 'test' AND item IN (SELECT item FROM cold)""",
)
def _(spark, sf):
    group = F.element_at(F.array(F.lit("beginner"), F.lit("broad"), F.lit("cold")), F.col("item") % 3 + 1)
    imap = sized_repos(spark, sf).distinct().select(F.col("repo_id").cast("int").alias("item"))
    d = el.source_stats(parted(spark, sf), imap.withColumn("group", group))
    return d.withColumn("value", F.round("value", 6))


@query(
    "contrib_variant",
    f"""WITH {GROUPED} SELECT "user", item, ts, kind, part FROM parted WHERE part = 'train' OR contrib""",
)
def _(spark, sf):
    return el.contrib_variant(parted(spark, sf)).drop("contrib")


@query(
    "catalog",
    f"""WITH {REPO_SET}, {INTERACTIONS.replace('kept AS', 'kept2 AS').replace('FROM kept', 'FROM kept2')},
    allact AS (SELECT repo_id, n_contrib, n_pr, n_actors FROM act UNION ALL SELECT repo_id, n_contrib, n_pr, n_actors FROM later),
    s AS (SELECT repo_id, CAST(sum(n_contrib) AS BIGINT) AS n_contrib, CAST(sum(n_pr) AS BIGINT) AS n_pr, CAST(sum(n_actors) AS BIGINT) AS n_actors FROM allact GROUP BY 1)
    SELECT p_partkey AS repo_id, p_name AS name, p_type || ' of ' || p_brand AS description, p_type AS language, coalesce("group", '-') AS "group",
      p_partkey IN (SELECT item FROM inter) AS trained, coalesce(n_contrib, 0) AS n_contrib, coalesce(n_pr, 0) AS n_pr, coalesce(n_actors, 0) AS n_actors
    FROM part LEFT JOIN s ON s.repo_id = p_partkey LEFT JOIN rset ON rset.repo_id = p_partkey WHERE p_size % 5 <> 0""",
)
def _(spark, sf):
    details = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("repo_id"),
        F.col("p_name").alias("name"),
        F.concat("p_type", F.lit(" of  "), "p_brand").alias("description"),
        F.col("p_type").alias("language"),
        (F.col("p_size") % 5 == 0).alias("is_archived"),
    )
    ext = cut(el.external_events(raw_events(spark, sf)), "external")
    activity = el.repo_activity(ext.filter(F.col("ts") < I.VAL_START), 5).unionByName(
        el.repo_activity(ext.filter(F.col("ts") >= I.VAL_START), 5)
    )
    trained = el.interactions(I.events(spark, sf), sized_repos(spark, sf), WINDOWS)
    d = sc.catalog(
        details, activity, chosen_repos(spark, sf), trained.select(F.col("item").alias("repo_id"))
    )
    return d.withColumn("group", F.coalesce("group", F.lit("-")))
