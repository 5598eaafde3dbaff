"""Sources, sinks, streams and the driver's entry points."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import UTC, date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import scale
from tidemark.operators import leaderboard as lb
from tidemark.operators import recommend as rc
from tidemark.sources import days as dy
from tidemark.sources import tables as tb
from tidemark.streaming import jobs as st

DATA = "/root/testdata/sf0.001"


def test_ratings_csv(spark, tmp_path):
    ms = lambda s: s * 1000
    lines = ["user_id,parent_asin,rating,timestamp"]
    lines += [f"a,x,5.0,{ms(1_600_000_000)}", f"a,x,1.0,{ms(1_650_000_000)}", f"b,y,4.0,{ms(1_600_000_100)}", f"b,z,4.0,{ms(1_500_000_000)}"]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in tb.read_ratings_csv(spark, str(tmp_path / "r.csv"), "2020-01-01").collect())
    assert got == [("a", "x", 5.0, 1_600_000_000), ("b", "y", 4.0, 1_600_000_100)]


def test_jsonl_scan_is_all_or_nothing(spark, tmp_path):
    keep = spark.createDataFrame([("k1",)], "raw_id string")
    (tmp_path / "ok.jsonl").write_text('{"id": "k1", "t": "a"}\n{"id": "k2", "t": "b"}\n')
    got = tb.scan_jsonl(spark, str(tmp_path / "ok.jsonl"), "id string, t string", keep, "id")
    assert [tuple(r) for r in got.collect()] == [("k1", "a")]
    (tmp_path / "bad.jsonl").write_text('{"id": "k1", "t": "a"}\n{"id": "k2", "t"\n')
    with pytest.raises(Exception):
        tb.scan_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string, t string", keep, "id").collect()


def day_rows(spark, rows):
    cols = "kind string, user string, repo_id long, first_us long, n long, day date"
    return spark.createDataFrame([("star", u, r, 0, 1, date.fromisoformat(d)) for u, r, d in rows], cols)


def test_days_are_published_once(spark, tmp_path):
    path = str(tmp_path / "days")
    assert dy.missing_days(spark, path, "2024-01-01", "2024-01-04") == ["2024-01-01", "2024-01-02", "2024-01-03"]
    dy.publish_days(day_rows(spark, [("a", 1, "2024-01-01"), ("b", 2, "2024-01-02")]), path)
    assert dy.missing_days(spark, path, "2024-01-01", "2024-01-04") == ["2024-01-03"]
    dy.publish_days(day_rows(spark, [("c", 3, "2024-01-02")]), path)
    got = sorted((r["user"], str(r["day"])) for r in dy.read_days(spark, path).collect())
    assert got == [("a", "2024-01-01"), ("c", "2024-01-02")]


def test_month_range_reads_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "months")
    us = lambda s: int(datetime.fromisoformat(s).replace(tzinfo=UTC).timestamp()) * 1_000_000
    d = spark.createDataFrame([(us(f"2024-{m:02d}-15"),) for m in range(1, 7)], "created_us long")
    dy.write_months(d, path)
    got = dy.read_month_range(spark, path, 202_402, 202_404)
    assert sorted(r["yyyymm"] for r in got.collect()) == [202_402, 202_403, 202_404]
    assert "PartitionFilters: [isnotnull(yyyymm" in got._jdf.queryExecution().toString()


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = day_rows(spark, [("a", 1, "2024-01-01"), ("b", 2, "2024-01-02")])
    for _ in range(2):  # the same days arrive twice
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = st.file_stream(spark, src, dy.DAY_SCHEMA, 1)
        st.stream_ingest_daily(stream, out, str(tmp_path / "c1")).awaitTermination()
    assert dy.read_days(spark, out).count() == 2

    at = lambda s: datetime.fromisoformat(s)
    touches = [("a", 1, "2024-01-01T10:00:00"), ("a", 1, "2024-01-01T11:00:00"), ("b", 1, "2024-01-02T10:00:00")]
    late = [("z", 1, "2024-01-01T01:00:00"), ("a", 1, "2024-01-09T10:00:00")]
    src2 = str(tmp_path / "in2")
    schema = "user string, repo_id long, ts timestamp"
    counts, seen = str(tmp_path / "counts"), str(tmp_path / "seen")
    for batch in (touches, [("c", 1, "2024-01-07T00:00:00")], late):
        spark.createDataFrame([(u, r, at(t)) for u, r, t in batch], schema).coalesce(1).write.mode("append").parquet(src2)
        stream = st.file_stream(spark, src2, schema)
        st.run_to_table(st.activity_counts(stream), counts, str(tmp_path / "c2")).awaitTermination()
        st.run_to_table(st.first_touch(stream), seen, str(tmp_path / "c3")).awaitTermination()
    got = sorted((str(r["day"])[:10], r["user"], r["count"]) for r in spark.read.parquet(counts).collect())
    assert ("2024-01-01", "a", 2) in got and ("2024-01-02", "b", 1) in got
    assert all(u != "z" for _, u, _ in got)  # later than the watermark
    pairs = sorted((r["user"], r["repo_id"]) for r in spark.read.parquet(seen).collect())
    assert pairs == [("a", 1), ("b", 1), ("c", 1), ("z", 1)]


def test_counts_of_a_split_day_add_up_and_repeated_files_do_not(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def arrive(*rows):
        d = spark.createDataFrame([("star", u, 1, us, n, date(2024, 1, d)) for u, us, n, d in rows], dy.DAY_SCHEMA)
        d.coalesce(1).write.mode("append").parquet(src)
        st.stream_ingest_daily(st.file_stream(spark, src, dy.DAY_SCHEMA), out, check).awaitTermination()
        return sorted((r["user"], r["first_us"], r["n"], r["day"].day) for r in dy.read_days(spark, out).collect())

    assert arrive(("a", 10, 3, 1), ("b", 5, 1, 2)) == [("a", 10, 3, 1), ("b", 5, 1, 2)]
    both = [("a", 7, 5, 1), ("b", 5, 1, 2)]
    assert arrive(("a", 7, 2, 1)) == both
    assert arrive(("a", 7, 2, 1)) == both  # the same file again, under another name
    assert arrive(("b", 5, 1, 2), ("a", 10, 3, 1)) == both
    assert arrive(("c", 1, 1, 3), ("a", 9, 1, 1)) == [("a", 7, 6, 1), ("b", 5, 1, 2), ("c", 1, 1, 3)]


def test_first_touch_reads_only_its_batch(spark, tmp_path):
    src, check, schema = str(tmp_path / "in"), str(tmp_path / "c"), "kind string, user string, repo_id long, ts long"
    seen = []
    for k in range(3):
        old = [("push", f"u{i}", 1, 1000 + k) for i in range(20)]
        new = [(kind, f"n{k}", 2, at) for kind, at in (("star", 7), ("fork", 6), ("push", 8))]
        spark.createDataFrame(old + new, schema).coalesce(1).write.mode("append").parquet(src)
        # a new output folder each time: nothing that was written before can be read
        query = st.stream_first_touch(st.file_stream(spark, src, schema), str(tmp_path / f"t{k}"), check)
        query.awaitTermination()
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [23]
        seen.append(sorted((r["user"], r["ts"], r["kind"]) for r in spark.read.parquet(str(tmp_path / f"t{k}")).collect()))
    assert len(seen[0]) == 21 and seen[1:] == [[("n1", 6, "fork")], [("n2", 6, "fork")]]


def test_final_runs_and_leaderboard(spark):
    cols = "dataset string, model string, config_hash string, seed long, finished_at string, ndcg double"
    runs = spark.createDataFrame(
        [
            ("d", "itemknn", "old", 0, "2024-01-01", 0.9),
            ("d", "itemknn", "new", 0, "2024-01-02", 0.1),
            ("d", "itemknn", "new", 0, "2024-01-03", 0.2),
            ("d", "itemknn", "new", 1, "2024-01-02", 0.4),
            ("d", "popularity", "p", 0, "2024-01-01", 0.3),
        ],
        cols,
    )
    got = {r["model"]: r for r in lb.leaderboard(runs, ["ndcg"]).collect()}
    assert got["itemknn"]["ndcg_mean"] == pytest.approx(0.3) and got["itemknn"]["n_seeds"] == 2
    assert got["itemknn"]["ndcg_std"] == pytest.approx(0.1414213562)
    assert got["popularity"]["ndcg_std"] == 0.0


def test_issue_pick_prefers_easy_and_free(spark):
    repos = spark.createDataFrame([(100, "Python", 5)], "repo_id long, language string, n_contrib long")
    rows = [(100, k, ["easy", "medium", "hard"][k % 3], int(k == 3), ["documentation"] if k == 1 else []) for k in range(1, 5)]
    issues = spark.createDataFrame(rows, "repo_id long, number long, difficulty string, n_assignees int, skills array<string>")
    issues = issues.withColumns({"created": F.lit(0), "updated": F.lit(0), "n_comments": F.lit(1)})
    picks = spark.createDataFrame([(1, 100, ["documentation"], 1)], "user long, repo_id long, user_skills array<string>, hours int")
    got = [r["number"] for r in rc.pick_issues(picks, issues, repos, F.lit(86_400)).orderBy("issue_rank").collect()]
    assert got[0] == 1 and 3 not in got[:2]


def test_issue_shortlist_loses_no_pick(spark):
    """All profiles pick the same issues from the short lists as from all issues."""
    rng = random.Random(7)
    day = 86_400
    repos = spark.createDataFrame([(r, rng.choice(["Python", "Go", None]), 5 * r) for r in range(4)], "repo_id long, language string, n_contrib long")
    rows = []
    for k in range(900):
        repo = 0 if k % 2 else k % 4  # one repository holds most issues
        age = rng.choice([1, 5, 5, 400, 900 + k % 7]) * day + (k % 3) * (k % 5)
        skills = rng.sample(["python", "docs", "Go", "css"], rng.randrange(3))
        rows.append((repo, k, rng.choice(["easy", "medium", "hard", None]), rng.choice([0, 0, 1]), skills, 10**8 - age, rng.choice([0, 20, None])))
    issues = spark.createDataFrame(rows, "repo_id long, number long, difficulty string, n_assignees int, skills array<string>, updated long, n_comments int")
    issues = issues.withColumn("created", F.lit(0).cast("long"))
    now = F.lit(10**8)
    short = rc.issue_shortlist(issues, now)
    assert short.columns == issues.columns and 0 < short.count() < 600
    picks = spark.createDataFrame(
        [(u, r, s, h) for u, (s, h) in enumerate([([], 2), (["python"], 6), (["docs", "css"], 12), (["go", "python", "css"], 3)]) for r in range(4)],
        "user long, repo_id long, user_skills array<string>, hours int",
    )
    facts = repos.select("repo_id", "language", rc.activity_share(F.col("n_contrib")).alias("activity"))
    score, _ = rc.score_issue(now)
    every = defaultdict(list)
    for r in picks.join(facts, "repo_id").join(issues, "repo_id").withColumn("s", F.rint(score * 1e9)).collect():
        every[r["user"], r["repo_id"]].append((-r["s"], -r["number"]))
    got = defaultdict(list)
    for r in rc.pick_issues(picks, issues, repos, now).orderBy("issue_rank").collect():
        got[r["user"], r["repo_id"]].append(r["number"])
    assert dict(got) == {key: [-n for _, n in sorted(v)[:3]] for key, v in every.items()}


def test_scratch_folder_comes_from_the_session(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    assert scale.scratch_root(spark) == str(folder)
    before = sum(1 for _ in folder.rglob("*.parquet"))
    assert scale.cut(spark.range(3)).count() == 3
    assert sum(1 for _ in folder.rglob("*.parquet")) > before


def test_every_oracle_belongs_to_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    assert 0 < row["ndcg"] < 1 and row["n_users"] > 0


def test_popularity_plan(spark):
    """Column pruning reaches the scan and the per-user cut happens before its shuffle."""
    q = entry.queries()["read_ratings_first_per_pair"](spark, DATA)
    plan = q._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    top = entry.queries()["popularity_topk"](spark, DATA)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_new_projects_share_rankings_of_equal_profiles(spark, monkeypatch):
    """One list per profile, long enough for users who own its best repositories; equal to a search per user."""
    import math
    import random

    from tidemark.operators import recommend as rc

    rng = random.Random(3)
    kinds = [(["bolt", "Gear"], ["Sql"]), (["rod"], []), ([], ["python"])]
    users = [(u, *kinds[u % 3]) for u in range(24)]
    names = ["bolt rod", "gear", "rod old gear", "new"]
    fresh = [(r, f"o{r % 5}", rng.choice(names), [rng.choice(["bolt", "old"])], rng.choice(["SQL", "Python", None]), 86_400 * rng.randrange(5), r % 3) for r in range(60)]
    fresh += [(7, "o9", "gear rod", [], "SQL", 0, 1), (60, None, "rod gear bolt", [], "Python", 86_400 * 4, 1)]
    own = [(u, f"o{(u + k) % 5}") for u in range(24) for k in range(u % 4)] + [(1, "o9")]
    sizes = {}

    def kept(df, label="cut"):
        out = scale_cut(df, label)
        if label == "listed":
            sizes.update({r["profile"]: r["count"] for r in out.groupBy("profile").count().collect()})
        return out

    scale_cut = rc.cut
    monkeypatch.setattr(rc, "cut", kept)
    u = spark.createDataFrame(users, "user long, skills array<string>, languages array<string>")
    f = spark.createDataFrame(fresh, "repo_id long, owner string, description string, topics array<string>, language string, created long, n_issues int")
    o = spark.createDataFrame(own, "user long, owner string")
    now = 86_400 * 10
    got = {}
    for r in rc.new_projects(u, f, F.lit(now), o).collect():
        got.setdefault(r["user"], []).append((r["rank"], r["repo_id"], round(r["score"], 9), tuple(r["overlap"])))
    assert len(sizes) == 3 and all(0 < n <= 3 * 5 for n in sizes.values())
    mine = set(own)
    for who, skills, langs in users:
        found = []
        for repo in {x[0] for x in fresh}:
            lists = [x for x in fresh if x[0] == repo]
            words, lang = set(), 0
            for _, owner, text, topics, language, _, _ in lists:
                if (who, owner) in mine:
                    continue
                told = set(text.split()) | set(topics) | {(language or "").lower()} - {""}
                words |= told & {s.lower() for s in skills}
                lang |= (language or "").lower() in {x.lower() for x in langs}
            if words or lang:
                found += [(len(words) + 2 * lang + math.exp(-(now - x[5]) / 86_400 / 60), repo, tuple(sorted(words)), x[6]) for x in lists]
        found = sorted(found, key=lambda x: (-round(x[0], 9), -x[1]))[:3]
        assert sorted(got.get(who, [])) == [(k + 1, x[1], round(x[0], 9), x[2]) for k, x in enumerate(found) if x[3] > 0]


def test_issue_features_join_profiles_before_candidates(spark, tmp_path):
    """Profile and language are joined to the cases; the candidates are not moved again for them."""
    from datetime import datetime

    from checks.q_replay import featured

    day = lambda d: datetime(1995, 1, d)
    tables = {
        "lineitem": ([(k, 1, k % 2, day(10 + k), "R") for k in range(6)], "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp, l_returnflag string"),
        "orders": ([(k, k % 3, day(1 + k), "1-URGENT") for k in range(6)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(0, "DOCS"), (1, "SQL"), (1, "SQL")], "c_custkey long, c_mktsegment string"),
        "supplier": ([(0, 1), (1, 2)], "s_suppkey long, s_nationkey int"),
    }
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = featured(spark, str(tmp_path))
    joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert "_bucket" in joins[0]
    # orders of customers 0 and 1 (listed twice); an issue is open from its order until it is shipped
    cases = [(k, m) for k in range(6) for m in range(6) if k % 3 < 2 and k % 2 == m % 2 and m >= k for _ in range(1 + (k % 3 == 1))]
    assert sorted((r["case"] // 10, r["number"] // 10) for r in d.collect()) == sorted(c for c in cases if 1 + c[1] < 10 + c[0])
