"""Event log, privacy, text rules and replay on hand-made rows."""

from __future__ import annotations

import hashlib
import hmac
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as lf
from tidemark.functions import privacy as pv
from tidemark.functions import text as tx
from tidemark.operators import eventlog as el
from tidemark.operators import issues as iss
from tidemark.operators import items as it
from tidemark.operators import replay as rp
from tidemark.operators import scope as sc


def at(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp())


WINDOWS = el.Windows(at("2025-03-01"), at("2025-09-01"), at("2025-10-01"), at("2025-11-01"))


def log(spark, rows):
    return spark.createDataFrame([(k, u, r, at(d), 1) for k, u, r, d in rows], "kind string, user string, repo_id long, ts long, n long")


def test_first_touches(spark):
    ev = log(
        spark,
        [
            ("star", "a", 1, "2025-04-01"),
            ("pr", "a", 1, "2025-10-05"),
            ("comment", "b", 1, "2025-09-10"),
            ("push", "m", 1, "2025-05-01"),
            ("pr", "m", 1, "2025-06-01"),
            ("issue", "m", 2, "2025-06-01"),
            ("pr", "b", 2, "2025-03-15"),
            ("push", "b", 2, "2025-10-20"),
            ("star", "a", 3, "2025-02-01"),
        ],
    )
    repos = spark.createDataFrame([(1,), (2,), (3,)], "repo_id long")
    got = {(r["user"], r["item"]): (r["kind"], r["contrib"]) for r in el.interactions(ev, repos, WINDOWS).collect()}
    assert got == {
        ("a", 1): ("star", False),
        ("b", 1): ("comment", True),
        ("m", 2): ("issue", True),
        ("b", 2): ("pr", True),
    }


def test_cohort_and_profile(spark):
    ev = log(
        spark,
        [
            ("star", "a", 1, "2025-08-01"),
            ("pr", "a", 1, "2025-09-10"),
            ("pr", "a", 2, "2025-09-20"),
            ("star", "a", 2, "2025-09-15"),
            ("push", "b", 1, "2025-09-01"),
            ("pr", "b", 1, "2025-09-05"),
            ("pr", "c", 9, "2025-09-05"),
        ],
    )
    catalog = spark.createDataFrame([(1,), (2,)], "repo_id long")
    co = rp.cohort(ev, catalog, *rp.month_bounds("2025-09"))
    assert [tuple(r) for r in co.collect()] == [("a", 1, at("2025-09-10"))]
    prof = rp.profiles(ev, co)
    assert [tuple(r) for r in prof.collect()] == [("a", 1, at("2025-08-01"), "star")]
    assert rp.month_bounds("2025-12") == (at("2025-12-01"), at("2026-01-01"))


def test_replay_metrics(spark):
    facts = spark.createDataFrame([(0, "py", "o1"), (1, "go", "o2"), (2, "go", "o1"), (3, "py", "o1")], "item long, language string, owner string")
    top = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 2, 1), (1, 3, 2)], "user long, item long, rank int")
    q = spark.createDataFrame([(0, 1), (1, 0)], "user long, target long")
    got = {r["user"]: r for r in rp.replay_metrics(top, q, facts, 2).collect()}
    assert (got[0]["hit"], got[1]["hit"]) == (1.0, 0.0)
    assert got[0]["ndcg"] == pytest.approx(0.6309297)
    assert (got[0]["near_lang"], got[1]["near_lang"], got[1]["near_org"]) == (0.0, 1.0, 1.0)


def test_history_bins(spark):
    d = spark.createDataFrame([(n,) for n in (0, 1, 5, 6, 20, 21)], "n long")
    got = [r[0] for r in d.orderBy("n").select(rp.history_bin(F.col("n"))).collect()]
    assert got == ["0", "1-5", "1-5", "6-20", "6-20", "20+"]


@pytest.mark.parametrize("salt", [b"short", b"x" * 80])
def test_hash_is_hmac(spark, salt):
    ids = [1, 42, 10**12]
    d = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["h"] for r in d.select("id", pv.hash_id(F.col("id"), salt).alias("h")).collect()}
    assert got == {i: hmac.new(salt, str(i).encode(), hashlib.sha256).hexdigest()[:16] for i in ids}


def test_anonymise_finds_leaks(spark):
    d = spark.createDataFrame([("t", 5, 7, 1), ("t", 6, 5, 2)], "type string, actor_id long, repo_id long, n long")
    assert set(pv.anonymise(d, b"s").columns) == {"type", "user", "repo_id", "n"}
    with pytest.raises(RuntimeError, match="other"):
        pv.anonymise(d.withColumn("other", F.col("actor_id")), b"s")
    f = spark.createDataFrame([("octocat",)], "value string")
    d = spark.createDataFrame([("Octocat", "octocat/hello"), ("x", "a/b")], "user string, repo string")
    assert [r[0] for r in pv.find_leaks(d, f).collect()] == ["user"]


def test_scrub_text(spark):
    fence = "```"
    text = f"Hi @ann-1 and @bob! mail a.b@c.org ![x](http://u/v) [docs](http://d) <b>bold</b> www.x.y {fence}code @z{fence}\n  End"
    d = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in d.select(tx.scrub_text(F.col("t"))).collect()]
    assert got == ["Hi @user and @user! mail [email] docs bold End", ""]
    cut = d.select(tx.scrub_text(F.col("t"), 12)).first()[0]
    assert cut == "Hi @user and ..." or cut.endswith(" ...")


def test_beginner_labels(spark):
    yes = ["Good-First-Issue", "good first issue :wave:", "status: help wanted", "Easy"]
    no = ["bug", "easyocr", "uneasy", "good first"]
    d = spark.createDataFrame([(x,) for x in yes + no], "l string")
    assert {r[0] for r in d.filter(tx.is_beginner_label(F.col("l"))).collect()} == set(yes)


def test_repo_text_without_facts(spark):
    d = spark.createDataFrame([("o/r", None, None, None)], "a string, b string, c string, d string")
    assert d.select(it.repo_text(*[F.col(c) for c in "abcd"])).first()[0] == "Repository: r"


def test_text_as_of(spark):
    commits = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 30, "c"), (2, 5, "z")], "repo_id long, ts long, text string")
    cutoffs = spark.createDataFrame([(1, 20), (1, 21), (1, 10), (1, 1000), (2, 6), (3, 9)], "repo_id long, cutoff long")
    got = sorted((r["repo_id"], r["cutoff"], r["text"]) for r in sc.text_as_of_each(commits, cutoffs, 7).collect())
    assert got == [(1, 20, "a"), (1, 21, "b"), (1, 1000, "c"), (2, 6, "z")]


def test_difficulty_rules(spark):
    d = spark.createDataFrame([("easy", "easy"), (None, "easy"), ("easy", "medium"), ("hard", "medium")], "i string, t string")
    got = [r[0] for r in d.select(lf.difficulty_match(F.col("i"), F.col("t"))).collect()]
    assert got[:2] == [1.0, 0.5] and got[2] > got[3]
    assert spark.range(1).select(lf.age_days(F.lit(None).cast("long"), F.lit(5))).first()[0] == 365.0


def test_issues_open_at_a_time(spark):
    cases = spark.createDataFrame([(1, 100 * 86_400), (1, 10 * 86_400)], "repo_id long, t long")
    days = [(1, 1, 0, None), (1, 2, 50, 90), (1, 3, 99, 101), (1, 4, 100, None), (2, 5, 0, None)]
    issues = spark.createDataFrame(
        [(r, n, a * 86_400, None if b is None else b * 86_400) for r, n, a, b in days], "repo_id long, number long, created long, closed long"
    )
    got = sorted((r["t"] // 86_400, r["number"]) for r in iss.open_at(cases, issues, 7 * 86_400).collect())
    assert got == [(10, 1), (100, 1), (100, 3)]


def test_leak_search_moves_only_suspects(spark):
    """Equal to comparing every cell, in any case, also where names hold dots; no exchange before the filter."""
    rows = [(i, f"Name{i}", f"text {i}", None if i % 3 else f"USER{i // 5}") for i in range(500)]
    d = spark.createDataFrame(rows, "n long, `a.b` string, free string, login string")
    bad = spark.createDataFrame([("name77",), ("uSer33",), ("nobody",), (None,)], "value string")
    cells = {(c, str(v).lower()) for r in d.collect() for c, v in r.asDict().items() if v is not None}
    want = {c for c, v in cells if v in {"name77", "user33", "nobody"}}
    assert want == {"a.b", "login"} == {r["column"] for r in pv.find_leaks(d, bad).collect()}
    assert pv.find_leaks(d, bad.filter("value is null")).count() == 0
    plan = pv.find_leaks(d, bad)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan
    # below the filter there is no exchange but the broadcast
    assert "Exchange hashpartitioning" not in plan[plan.index("BroadcastNestedLoopJoin") :].split("BroadcastExchange")[0]
    hashed = spark.createDataFrame([("0123456789abcdef", "x"), ("nope", "y")], "user string, other string")
    assert [tuple(r) for r in pv.audit(hashed, bad, "user").collect()] == [("user", "not hashed")]


def test_leak_search_without_arrow(spark):
    """The filter of forbidden values must not need Arrow to reach Spark."""
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        d = spark.createDataFrame([("Octocat", "octocat/hello"), ("x", "a/b")], "user string, repo string")
        bad = spark.createDataFrame([("octocat",)], "value string")
        assert [r[0] for r in pv.find_leaks(d, bad).collect()] == ["user"]
        raw = spark.createDataFrame([("t", 5, 7)], "type string, actor_id long, repo_id long")
        assert pv.anonymise(raw, b"s").count() == 1
    finally:
        spark.conf.set(name, before)


def test_open_issues_are_moved_once_for_each_wide_bucket(spark):
    from tidemark.operators import issues as iss

    day = 86_400
    issues = spark.createDataFrame([(1, n, n * day, (n + 100) * day) for n in range(50)] + [(1, 99, 0, None)], "repo_id int, number int, created long, closed long")
    cases = spark.createDataFrame([(1, 60 * day), (1, 700 * day)], "repo_id int, t long")
    d = iss.open_at(cases, issues)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "1.0368E7" in plan  # 120 days
    got = {(r["t"], r["number"]) for r in d.collect()}
    want = {(60 * day, n) for n in [*range(50), 99]} | {(700 * day, 99)}
    assert got == want
