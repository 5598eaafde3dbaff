"""Privacy, text hygiene and item-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from tidemark.functions import privacy as pv
from tidemark.functions import text as tx
from tidemark.operators import items as it

SALT = b"check-salt"


def _pads(salt: bytes) -> tuple[str, str]:
    key = salt.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hash_sql(expr: str, salt: bytes = SALT) -> str:
    inner, outer = _pads(salt)
    return (
        f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({expr})))), 1, 16)"
    )


@query(
    "hash_ids",
    f"""SELECT c_custkey AS id, {hash_sql('CAST(c_custkey AS VARCHAR)')} AS hashed,
    {hash_sql('lower(c_name)')} AS hashed_name FROM customer""",
)
def _(spark, sf):
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        pv.hash_id(F.col("c_custkey"), SALT).alias("hashed"),
        pv.hash_id(F.col("c_name"), SALT, lower=True).alias("hashed_name"),
    )


@query(
    "hash_column",
    f"""SELECT event_id, {hash_sql('CAST(user_id AS VARCHAR)')} AS "user" FROM events""",
)
def _(spark, sf):
    ev = I.table(spark, sf, "events").select("event_id", "user_id")
    return pv.hash_column(ev, "user_id", SALT)


CONTACT = """SELECT c_custkey, c_name, c_mktsegment, 'seen by ' || upper(c_name) AS note, upper(c_name) AS alias,
  c_nationkey FROM customer"""


@query(
    "find_leaks",
    f"""WITH t AS ({CONTACT}), f AS (SELECT DISTINCT lower(c_name) AS v FROM customer UNION
      SELECT CAST(n_nationkey AS VARCHAR) FROM nation)
    SELECT 'all' AS scope, c AS "column" FROM (SELECT 'c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS v FROM t UNION ALL
      SELECT 'c_name', lower(c_name) FROM t UNION ALL SELECT 'c_mktsegment', lower(c_mktsegment) FROM t UNION ALL
      SELECT 'note', lower(note) FROM t UNION ALL SELECT 'alias', lower(alias) FROM t UNION ALL
      SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM t) WHERE v IN (SELECT v FROM f) GROUP BY 2
    UNION ALL
    SELECT 'text', c FROM (SELECT 'c_name' AS c, lower(c_name) AS v FROM t UNION ALL SELECT 'c_mktsegment', lower(c_mktsegment) FROM t UNION ALL
      SELECT 'note', lower(note) FROM t UNION ALL SELECT 'alias', lower(alias) FROM t) WHERE v IN (SELECT v FROM f) GROUP BY 2""",
)
def _(spark, sf):
    c = I.table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.concat(F.lit("seen by "), F.upper("c_name")).alias("note"),
        F.upper("c_name").alias("alias"),
        "c_nationkey",
    )
    bad = c.select(F.col("c_name").alias("value")).unionByName(
        I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("value"))
    )
    every = pv.find_leaks(c, bad).select(F.lit("all").alias("scope"), "column")
    return every.unionByName(
        pv.find_leaks(c, bad, text_only=True).select(F.lit("text").alias("scope"), "column")
    )


@query(
    "assert_hashed",
    f"""SELECT count(*) FILTER (NOT regexp_full_match(h, '[0-9a-f]{{16}}')) AS bad, count(*) AS total FROM (
      SELECT {hash_sql('CAST(user_id AS VARCHAR)')} AS h FROM events UNION ALL SELECT event_type FROM events)""",
)
def _(spark, sf):
    ev = I.table(spark, sf, "events")
    mixed = ev.select(pv.hash_id(F.col("user_id"), SALT).alias("h")).unionByName(
        ev.select(F.col("event_type").alias("h"))
    )
    return pv.hash_violations(mixed, "h")


@query(
    "anonymise",
    f"""SELECT event_type AS type, CAST(props->>'$.k' AS BIGINT) AS repo_id, {hash_sql('CAST(user_id AS VARCHAR)')} AS "user"
    FROM events""",
)
def _(spark, sf):
    ev = I.table(spark, sf, "events").select(
        F.col("event_type").alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("repo_id"),
        F.col("user_id").alias("actor_id"),
    )
    return pv.anonymise(ev, SALT)


W = r"[\p{L}\p{M}\p{Nd}\p{Pc}"  # an open class: word characters of any script
SP = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SP}', ' ', 'g'))"


def truncate_sql(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN regexp_replace(substr({expr}, 1, {n}), ' [^ ]*$', '') || ' ...' ELSE {expr} END"


def scrub_sql(expr: str) -> str:
    out = f"coalesce({expr}, '')"
    for pattern, to in (
        (r"(?s)```.*?```", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (rf"{W}.+-]+@{W}-]+\.{W}.-]+", "[email]"),
        (r"https?://[^\s\p{Z}]*|www\.[^\s\p{Z}]+", " "),
        (r"<[^>]+>", " "),
        (r"(^|[^\p{L}\p{M}\p{Nd}\p{Pc}.])@[A-Za-z0-9][A-Za-z0-9-]{0,38}", r"\1@user"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return collapse_sql(out)


@query(
    "scrub_documents",
    f"""WITH t AS (SELECT doc_id, {scrub_sql('text')} AS s FROM documents) SELECT doc_id, s AS scrubbed,
    {truncate_sql('s', 300)} AS short FROM t""",
)
def _(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", tx.scrub_text(F.col("text")).alias("scrubbed"))
    return d.withColumn("short", tx.truncate_words(F.col("scrubbed"), 300))


MARKED = """'see ![badge](' || url || ') and [page ' || page_id || '](' || url || ') by @reader-' || page_id || ' or mail reader'
  || page_id || '@example.org ' || chr(96) || chr(96) || chr(96) || 'code ' || page_id || chr(96) || chr(96) || chr(96) || ' ' || html"""


@query(
    "scrub_pages",
    f"""WITH t AS (SELECT page_id, {scrub_sql('m')} AS s FROM (SELECT page_id, {MARKED} AS m FROM pages))
    SELECT page_id, s AS scrubbed FROM t""",
)
def _(spark, sf):
    fence = F.lit("```")
    marked = F.concat(
        F.lit("see ![badge]("), "url", F.lit(") and [page "), "page_id", F.lit("]("), "url",
        F.lit(") by @reader-"), "page_id", F.lit(" or mail reader"), "page_id", F.lit("@example.org "),
        fence, F.lit("code "), "page_id", fence, F.lit(" "), "html",
    )
    return I.table(spark, sf, "pages").select("page_id", tx.scrub_text(marked).alias("scrubbed"))


@query(
    "truncate_words",
    f"""SELECT conv_id, turn, {truncate_sql('text', 80)} AS short FROM conversations""",
)
def _(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.truncate_words(F.col("text"), 80).alias("short")
    )


@query(
    "tokens",
    r"""SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS words FROM (SELECT DISTINCT doc_id, trim(t, '.') AS w
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9+#.]+')) AS t FROM documents)
    WHERE length(trim(t, '.')) > 1) GROUP BY 1""",
)
def _(spark, sf):
    d = I.table(spark, sf, "documents")
    words = F.sort_array(tx.tokens(F.col("text")))
    return d.select("doc_id", F.array_join(words, " ").alias("words")).filter("words <> ''")


# label text of an order: what its priority looks like on an issue tracker
LABEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Good-First-Issue :wave:' WHEN '2-HIGH' THEN 'bug'
  WHEN '3-MEDIUM' THEN 'status: help wanted' WHEN '4-NOT SPECIFIED' THEN 'easyocr' ELSE 'Easy' END"""
PHRASES = (
    "beginner|beginner[\\s_-]*friendly|easy|first[\\s_-]*timers[\\s_-]*only|good[\\s_-]*first[\\s_-]*contribution"
    "|good[\\s_-]*first[\\s_-]*issue|help[\\s_-]*wanted|starter"
)


@query(
    "match_beginner_labels",
    f"""SELECT o_orderkey, label, regexp_matches(label, '(?i)(^|[^a-z])({PHRASES})([^a-z]|$)') AS beginner
    FROM (SELECT o_orderkey, {LABEL} AS label FROM orders)""",
)
def _(spark, sf):
    d = I.table(spark, sf, "orders").select("o_orderkey", F.expr(LABEL).alias("label"))
    return d.withColumn("beginner", tx.is_beginner_label(F.col("label")))


# item texts: a part with two documents as description and README --------------------------------
PART_TEXT = """pt AS (SELECT p.*, d.text AS described, r.text AS readme FROM part p
  LEFT JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents) LEFT JOIN documents r ON r.doc_id = p_partkey + 7)"""


def part_text(spark, sf):
    p, d = I.table(spark, sf, "part"), I.table(spark, sf, "documents").select("doc_id", "text")
    described = d.select(F.col("doc_id").alias("d1"), F.col("text").alias("described"))
    readme = d.select(F.col("doc_id").alias("d2"), F.col("text").alias("readme"))
    return p.join(described, F.col("d1") == F.col("p_partkey") % d.count(), "left").join(
        readme, F.col("d2") == F.col("p_partkey") + 7, "left"
    )


PRODUCT_SQL = f"""concat_ws(chr(10), 'Title: ' || p_name, 'Brand: ' || p_brand, 'Category: ' || p_type || ' > ' || 'size ' || p_size,
  'Features: ' || array_to_string(string_split(p_name, ' ')[1:3], '; '),
  CASE WHEN descr <> '' THEN 'Description: ' || {truncate_sql('descr', 300)} END)"""


def product_records(spark, sf):
    return part_text(spark, sf).select(
        F.col("p_partkey").alias("raw_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("store"),
        F.array("p_type", F.concat(F.lit("size "), "p_size")).alias("categories"),
        F.concat(F.split("p_name", " "), F.array(F.lit(" "))).alias("features"),
        F.array("described").alias("description"),
    )


@query(
    "item_text_product",
    f"""WITH {PART_TEXT} SELECT raw_id, {PRODUCT_SQL} AS text FROM (SELECT *, p_partkey AS raw_id,
    {collapse_sql("coalesce(described, '')")} AS descr FROM pt)""",
)
def _(spark, sf):
    r = product_records(spark, sf)
    cols = ("title", "store", "categories", "features", "description")
    return r.select("raw_id", it.product_text(*[F.col(c) for c in cols]).alias("text"))


@query(
    "item_table",
    f"""WITH {PART_TEXT}, m AS (SELECT DISTINCT CASE WHEN l_partkey < 100 THEN -1 - l_partkey ELSE l_partkey END AS raw_id FROM lineitem),
    im AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS item FROM m)
    SELECT item, raw_id, coalesce(p_name, '') AS title, coalesce(CASE WHEN p_partkey IS NOT NULL THEN {PRODUCT_SQL} END, '') AS text
    FROM im LEFT JOIN (SELECT *, {collapse_sql("coalesce(described, '')")} AS descr FROM pt) ON p_partkey = raw_id""",
)
def _(spark, sf):
    from tidemark.operators.interactions import id_map

    raw = F.when(F.col("l_partkey") < 100, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    ids = id_map(I.table(spark, sf, "lineitem").select(raw.alias("item")), "item")
    return it.product_table(product_records(spark, sf), ids)


@query(
    "item_text_repo",
    f"""WITH {PART_TEXT}, t AS (SELECT *, {scrub_sql('described')} AS a, {scrub_sql('readme')} AS b FROM pt)
    SELECT p_partkey AS item, replace(p_name, ' ', '-') AS title, concat_ws(chr(10), 'Repository: ' || replace(p_name, ' ', '-'), 'Language: ' || p_type,
      CASE WHEN a <> '' THEN 'Description: ' || {truncate_sql('a', 300)} END, CASE WHEN b <> '' THEN 'README: ' || {truncate_sql('b', 1500)} END) AS text FROM t""",
)
def _(spark, sf):
    name = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    p = part_text(spark, sf)
    ids = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("raw_id"), F.col("p_partkey").alias("item"), name.alias("name")
    )
    details = p.select(
        F.col("p_partkey").alias("raw_id"),
        F.col("p_type").alias("language"),
        F.col("described").alias("description"),
        "readme",
    )
    return it.repo_table(ids, details).select("item", "title", "text")
