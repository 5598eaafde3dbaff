"""Sizes, splits and odd rows that must not change results."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import mean_vector
from tidemark.operators.answers import grounding_report, random_candidate_sets
from tidemark.operators.bootstrap import PRIME, paired_intervals, resample_means
from tidemark.operators.serving import priority_repos
from tidemark.operators.training import sample_negatives
from tidemark.scale import exact_quantiles
from tidemark.sources.days import created_within, ingest_days, missing_days, read_days
from tidemark.streaming.jobs import file_stream, stream_ingest_daily

DAY = "kind string, user string, repo_id long, first_us long, n long, day date"


def days(spark, path):
    return sorted((r["user"], r["n"], str(r["day"])) for r in read_days(spark, path).collect())


def test_day_over_two_files_and_batches(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = lambda *users: spark.createDataFrame([("star", u, 1, 5, 1) for u in users], DAY.rsplit(",", 1)[0]).withColumn("day", F.lit("2024-01-01").cast("date"))
    rows("a", "b").coalesce(1).write.mode("append").parquet(source)
    rows("c", "d").coalesce(1).write.mode("append").parquet(source)
    stream_ingest_daily(file_stream(spark, source, DAY, 1), table, f"{tmp_path}/c").awaitTermination()
    assert [u for u, _, _ in days(spark, table)] == ["a", "b", "c", "d"]
    # the same rows again, twice in one batch, and an earlier batch as a whole
    rows("a", "d").union(rows("a", "d")).write.mode("append").parquet(source)
    stream_ingest_daily(file_stream(spark, source, DAY), table, f"{tmp_path}/c").awaitTermination()
    stream_ingest_daily(file_stream(spark, source, DAY), table, f"{tmp_path}/again").awaitTermination()
    assert days(spark, table) == [(u, 1, "2024-01-01") for u in "abcd"]


def test_empty_days_are_published_once(spark, tmp_path):
    raw = spark.createDataFrame([("WatchEvent", 1, "u", 7, "o/r", 1_704_100_000_000_000)], "type string, actor_id long, login string, repo_id long, repo_name string, created_us long")
    repos = spark.createDataFrame([(7,)], "repo_id long")
    path = f"{tmp_path}/days"
    assert len(ingest_days(raw, repos, path, "2024-01-01", "2024-01-04", b"salt")) == 3
    assert missing_days(spark, path, "2024-01-01", "2024-01-05") == ["2024-01-04"]


def test_day_range_is_pushed_to_the_files(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("created_us")).write.parquet(f"{tmp_path}/raw")
    plan = spark.read.parquet(f"{tmp_path}/raw").filter(created_within("2024-01-01", "2024-01-03"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_us,1704067200000000)" in plan and "LessThan(created_us,1704" in plan


def test_user_who_holds_nearly_everything(spark):
    n = 3_000
    held = spark.range(n - 3).select(F.lit(1).cast("long").alias("user"), F.col("id").alias("item"))
    index = spark.range(n).select(F.col("id").alias("item"), F.col("id").alias("rank"))
    few = held.filter("item < 40").unionByName(held.filter("item >= 40"))
    drawn = sample_negatives(few, index, n, n_neg=2)
    per_row = drawn.groupBy("item").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert tuple(per_row) == (2, 2, n - 3)
    assert {r["negative"] for r in drawn.select("negative").distinct().collect()} == {n - 3, n - 2, n - 1}
    sets = random_candidate_sets(held.filter("item = 5"), held, index, n, n=20)
    assert sorted(r["item"] for r in sets.collect()) == [5, n - 3, n - 2, n - 1]


def test_vectors_of_another_size_are_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "vec array<double>")
    with pytest.raises(Exception, match="does not have 2 elements"):
        df.agg(mean_vector("vec", 2)).collect()
    assert df.agg(mean_vector("vec", 3).alias("m")).first()["m"] == [1.0, 2.0, 3.0]


def plain_resamples(n, m, n_resamples, seed=0):
    """Slots drawn by each resample: all draws dealt to blocks of `m`, then to the slots of a block."""

    def mix(b, slot, block):
        x0 = (b * 1_000_003 + slot * 7_919 + seed * 15_485_863 + block * 104_729 + 12_345) % PRIME
        x1 = (x0 * x0 + 1_013_904_223) % PRIME
        x2 = (x1 * x1 + x0 * 48_271 + 69_069) % PRIME
        return (x2 * x2 + x1) % PRIME

    for b in range(n_resamples):
        dealt = Counter(mix(b, i, 0) % n // m for i in range(n)) if n > m else {0: n}
        yield [at * m + mix(b, t, at) % min(m, n - at * m) for at, k in sorted(dealt.items()) for t in range(k)]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_bootstrap_means_equal_drawn_slots(spark, block):
    rng = np.random.default_rng(0)
    rows = [(g, s, u, float(rng.random())) for g, n in (("small", 3), ("large", 200)) for u in range(n) for s in ("a", "b")]
    values = spark.createDataFrame(rows, "dataset string, series string, user long, value double")
    got = {(r["dataset"], r["series"], r["b"]): r["mean"] for r in resample_means(values, ["dataset"], 20, block=block).collect()}
    held = {(g, s, u): v for g, s, u, v in rows}
    want = {
        (g, s, b): np.mean([held[g, s, i] for i in slots])
        for g, n in (("small", 3), ("large", 200))
        for b, slots in enumerate(plain_resamples(n, block, 20))
        for s in ("a", "b")
    }
    assert all(len(s) == 200 for s in plain_resamples(200, block, 3))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    pairs = spark.createDataFrame([("small", "a", "b"), ("large", "a", "b")], "dataset string, a string, b string")
    intervals = paired_intervals(values, pairs, ["dataset"], 50, block=block)
    assert intervals.count() == 2


def test_bootstrap_has_no_row_per_user_and_resample(spark):
    values = spark.createDataFrame([("a", u, 1.0) for u in range(50)], "series string, user long, value double")
    plan = resample_means(values, n_resamples=1_000)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and "sequence(0, 999" not in plan


@pytest.mark.parametrize("hot_rows", [5_000_000, 20])
def test_quantiles_equal_numpy_also_in_split_groups(spark, hot_rows):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.normal(size=500).round(1), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.95], hot_rows).collect()}
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, [0.1, 0.5, 0.95]))
    whole = exact_quantiles(df, [], "v", [0.5], hot_rows).first()["q"]
    assert np.allclose(whole, np.quantile(np.concatenate(list(groups.values())), [0.5]))


def test_language_grounds_skills_but_not_evidence(spark):
    repos = spark.createDataFrame([(True, ["rust", "sql"], "a tool with sql", "Rust")], "parsed boolean, skills array<string>, source string, language string")
    issues = spark.createDataFrame([("easy", ["rust"], "rust", "nothing here", "Rust")], "difficulty string, skills array<string>, evidence string, source string, language string")
    got = {(r["kind"], r["metric"]): r["value"] for r in grounding_report(repos, issues).collect()}
    assert got["repo", "skills_in_source"] == 1.0 and got["issue", "skills_in_source"] == 1.0
    assert got["issue", "evidence_copied"] == 0.0


def test_priority_follows_contributors(spark):
    repos = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 100)], "repo_id long, n_contrib long")
    issues = spark.createDataFrame([(1,), (2,), (3,)], "repo_id long")
    got = [(r["priority"], r["repo_id"]) for r in priority_repos(repos, issues, 2).orderBy("priority").collect()]
    assert got == [(1, 2), (2, 3)]


def test_thousands_of_languages_in_the_block_product(spark):
    from tidemark.operators.vectorscore import blocked_topk

    n = 5_000
    items = spark.range(n).select(F.col("id").alias("item"), F.array(F.lit(0.0)).alias("vec"), F.concat(F.lit("lang"), "id").alias("tag"))
    queries = spark.createDataFrame([(1, [1.0], ["lang4321", "lang17", "none"], 2.0), (2, [1.0], None, 1.0)], "query long, vec array<double>, tags array<string>, boost double")
    got = [(r["query"], r["item"], r["score"]) for r in blocked_topk(queries, items, 3).orderBy("query", "rank").collect()]
    assert got == [(1, 17, 2.0), (1, 4321, 2.0), (1, 0, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]


def test_owner_cap_keeps_the_lower_id_of_ties():
    from tidemark.operators.vectorscore import _owner_best

    owners, ids = np.array(["a", "a", "a", "b", "c"]), np.array([5, 6, 7, 1, 2])
    scores = np.array([[1.0, 1.0, 1.0, 1.0, 1.0], [3.0, 2.0, 1.0, -np.inf, 0.0]])
    rows, cols = _owner_best(scores, owners, ids, 2, 3)
    assert list(zip(rows, ids[cols])) == [(0, 1), (0, 2), (0, 5), (1, 5), (1, 6), (1, 2)]


def test_ranked_lists_are_not_broadcast(spark):
    """Lists compress so well that their files pass for small tables."""
    from tidemark.operators import evaluation as ev

    top = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "user long, item long, rank int")
    targets = spark.createDataFrame([(1, 6), (2, 5)], "user long, item long")
    heads = spark.createDataFrame([(5, 3, True), (6, 0, False)], "item long, pop long, is_head boolean")
    for d, rows in ((ev.ranking_metrics(top, targets), 2), (ev.slice_metrics(top, targets, heads), 3), (ev.list_quality(top, heads.select("item", "pop"), heads, 2), 1)):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
        assert d.count() == rows


def test_candidate_sets_are_not_broadcast(spark, monkeypatch):
    """The draws of a user are many more rows than the file of users tells: they were one broadcast table."""
    from tidemark.operators import answers as an

    plans = []
    whole = an.cut

    def noted(df, label="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, label)

    monkeypatch.setattr(an, "cut", noted)
    held = spark.createDataFrame([(u, i) for u in range(9) for i in range(u, u + 3)], "user long, item long")
    index = spark.range(50).select(F.col("id").alias("item"), F.col("id").alias("rank"))
    sets = an.random_candidate_sets(held, held, index, 50)
    assert sets.groupBy("user").count().filter("count = 20").count() == 9
    scores = sets.select("user", "item", F.lit(0.5).alias("score"))
    orders = an.candidate_orders(sets.withColumn("set", F.lit("s")), scores, index.select("item", F.lit(1).alias("pop")))
    metrics = an.order_metrics(orders.drop("set"), held.groupBy("user").agg(F.count("*").alias("n")))
    plans.append(metrics._jdf.queryExecution().executedPlan().toString())
    assert metrics.count() == 18
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_resamples_hold_arrays_of_values(spark):
    """A task got one row for each user and series; now one for each series and piece, with the same means."""
    n = 200
    rows = [(f"s{k}", u, None if (k, u % 7) == (1, 0) else float((u * 7919 + k) % 101)) for k in range(2) for u in range(n)]
    values = spark.createDataFrame(rows, "series string, user long, value double")
    got = {(r["series"], r["b"]): r["mean"] for r in resample_means(values, (), 20).collect()}
    draws = list(plain_resamples(n, n, 20))
    for (s, b), mean in got.items():
        of = {u: v for name, u, v in rows if name == s}
        drawn = [of[u] for u in draws[b] if of[u] is not None]
        assert abs(mean - sum(drawn) / len(drawn)) < 1e-9
    assert len(got) == 40
    plan = resample_means(values, (), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(slot" in plan


def test_places_are_counted_in_bounded_tasks(spark, monkeypatch):
    from tidemark.operators import answers as an

    rows = [(n, r, [0, 1, 2] if r else [2, 1, 0]) for n in range(40) for r in range(2)]
    monkeypatch.setattr(an, "PORTION", 10)
    d = an.borda(spark.createDataFrame(rows, "list long, ranking int, order array<int>"))
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()
    got = {(r["list"], r["candidate"]): (r["points"], r["place"]) for r in d.collect()}
    assert got == {(n, c): (4, 3 - c) for n in range(40) for c in range(3)}


def test_sources_are_normalised_once(spark):
    from tidemark.operators import answers as an

    text = "a b c d e f g h " * 20
    d = spark.createDataFrame([("x", text, "a b c d e f x y"), ("y", text, "")], "id string, source string, evidence string")
    d = d.select("id", an.evidence_grounded(d["evidence"], d["source"]).alias("copied"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(source") == 1 and plan.count("regexp_replace(lower(evidence") == 2
    assert {r["id"]: r["copied"] for r in d.collect()} == {"x": True, "y": False}


def test_texts_without_a_sign_are_not_searched(spark):
    import re

    from pyspark.sql import functions as F

    from tidemark.functions import text as tx

    texts = ["plain words", "a@b.co and @me", "see ```x``` ![i](u) [l](u)", "http:/ no, https://h/p and www.x", "<b>bold</b> a < b", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    plain = F.coalesce("t", F.lit(""))
    for pattern, replacement, signs in tx.SCRUB_STEPS:
        plain = F.regexp_replace(plain, pattern, replacement)
        for t in filter(None, texts):
            java = pattern.replace("(?U)", "")
            assert not re.search(java, t) or any(s in t for s in signs)
    rows = d.select(tx.scrub_text(F.col("t")).alias("a"), tx.collapse(plain).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_repository_set_parses_the_log_once(spark, monkeypatch):
    from checks import q_events

    calls = []
    real = q_events.raw_events
    monkeypatch.setattr(q_events, "raw_events", lambda *a: calls.append(a) or real(*a))
    q_events.chosen_repos(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1


def test_index_moves_no_vector_to_its_candidates(spark):
    import numpy as np

    from tidemark.operators import vectorindex as vi

    m = np.random.default_rng(0).normal(size=(300, 4))
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "item long, vec array<double>")
    index = vi.build_index(items, 4)
    d = vi.index_topk(index, items.withColumnRenamed("item", "query"), 5, 4)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Join") == plan.count("BroadcastHashJoin") == 1
    got = {(r["query"], r["rank"]): r["item"] for r in d.collect()}
    best = np.argsort(-(m @ m.T), axis=1)[:, :5]
    assert got == {(q, r + 1): best[q, r] for q in range(300) for r in range(5)}


def test_best_rows_are_kept_by_slices(monkeypatch):
    import numpy as np
    from pyspark.sql import Row

    from tidemark.operators import vectorscore as vs

    monkeypatch.setattr(vs, "SLICE", 7)
    monkeypatch.setattr(vs, "TILE_CELLS", 60)
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(30, 4)), rng.normal(size=(40, 4))
    none = {"tags": [None] * 30, "boost": [0.0] * 30, "words": [None] * 30, "gone_query": [3], "gone_item": [int(np.argmax(v @ q[3]))]}
    best = vs._Best(Row(query=list(range(30)), cells=q.tobytes(), **none), 5, None, False)
    for a in (0, 20):
        some = {"item": list(range(a, a + 20)), "owner": [None] * 20, "tag": [None] * 20, "words": [None] * 20}
        best.add(Row(cells=v[a : a + 20].tobytes(), **some))
    assert max(len(d) for d in best.kept.values()) <= 7 * 5
    got = {(a, b) for x in best.lists() for a, b in zip(x[0], x[1], strict=True)}
    scores = q @ v.T
    scores[3, np.argmax(scores[3])] = -np.inf
    assert got == {(a, int(b)) for a in range(30) for b in np.argsort(-scores[a])[:5]}
