"""Bootstrap, vectors, graph, recommendation and model answers."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.operators import answers as an
from tidemark.operators import bootstrap as bs
from tidemark.operators import graph as gr
from tidemark.operators import recommend as rc
from tidemark.operators import training as tr
from tidemark.operators import vectorscore as vs
from tidemark.plans import gridsearch as gs


def values_of(spark, n=400):
    rng = np.random.default_rng(1)
    a, b = rng.random(n), rng.random(n) * 0.9
    rows = [(s, u, float(v)) for s, x in (("a", a), ("b", b), ("c", a)) for u, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, user long, value double"), a, b


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_bootstrap_interval_is_like_numpy(spark, block):
    v, a, b = values_of(spark)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {r["b"]: r for r in bs.paired_intervals(v, pairs, n_resamples=600, block=block).collect()}
    d = a - b
    idx = np.random.default_rng(0).integers(0, len(d), (600, len(d)))
    lo, hi = np.quantile(d[idx].mean(1), [0.025, 0.975])
    assert got["b"]["diff"] == pytest.approx(d.mean())
    assert got["b"]["ci_low"] == pytest.approx(lo, abs=0.012) and got["b"]["ci_high"] == pytest.approx(hi, abs=0.012)
    same = got["c"]
    assert (same["diff"], same["ci_low"], same["ci_high"], same["n_users"]) == (0, 0, 0, 400)


def test_uneven_seeds_are_refused(spark):
    runs = spark.createDataFrame([("d", "m", 0, 1, 0.5), ("d", "m", 0, 2, 0.5), ("d", "m", 1, 1, 0.5)], "dataset string, series string, seed long, user long, value double")
    with pytest.raises(ValueError, match="different users"):
        bs.seed_average(runs)


@pytest.mark.parametrize("block", [20_000, 16])
def test_blocked_topk_matches_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(vs, "MIN_BLOCK", 8)
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    owners = [f"o{i % 7}" for i in range(50)]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query long, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist(), owners[i]) for i, x in enumerate(v)], "item long, vec array<double>, owner string")
    hidden = {(int(a), int(b)) for a, b in rng.integers(0, 30, (80, 2))}
    exclude = spark.createDataFrame(sorted(hidden), "query long, item long")
    s = q @ v.T
    for cap in (None, 2):
        out = defaultdict(list)
        for r in vs.blocked_topk(queries, items, 10, exclude, cap, block).orderBy("query", "rank").collect():
            out[r["query"]].append(r["item"])
        for i in range(30):
            want, used = [], Counter()
            for j in sorted(range(50), key=lambda j: (-s[i, j], j)):
                if (i, j) in hidden or (cap and used[owners[j]] >= cap):
                    continue
                used[owners[j]] += 1
                want.append(j)
            assert out[i] == want[:10]


def test_blocked_topk_moves_each_vector_once(spark, monkeypatch):
    """Blocks meet where they are read: a side is written once, however many blocks the other one has."""
    monkeypatch.setattr(vs, "MIN_BLOCK", 8)
    rng = np.random.default_rng(7)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(64, 4)))], "query long, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(96, 4)))], "item long, vec array<double>")
    held = {}

    def keep(df, label):
        held[label] = df.cache()
        return held[label]

    monkeypatch.setattr(vs, "cut", keep, raising=False)
    assert vs.blocked_topk(queries, items, 3, block=8).count() == 64 * 3
    for label, column, n in (("query-blocks", "query", 64), ("item-blocks", "item", 96)):
        sizes = [r[0] for r in held[label].select(F.size(column)).collect()]
        assert sum(sizes) == n and len(sizes) > 1


def test_moments_give_z_scores(spark):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(5, 4)), rng.normal(size=(40, 4)) + 1
    items = spark.createDataFrame([(x.tolist(),) for x in v], "vec array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "user long, vec array<double>")
    got = {r["user"]: (r["zvec"], r["offset"]) for r in vs.standardised(queries, vs.moments(items, 4)).collect()}
    s = q @ v.T
    z = (s - s.mean(1, keepdims=True)) / (s.std(1, keepdims=True) + 1e-9)
    for i in range(5):
        assert np.allclose(v @ np.array(got[i][0]) + got[i][1], z[i])


def test_propagation(spark):
    train = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "user long, item long")
    edges = gr.normalized_adjacency(train)
    w = {(r["src_side"], r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert w[("u", 1, 1)] == pytest.approx(1 / np.sqrt(2)) and w[("i", 1, 0)] == pytest.approx(0.5)
    start = spark.createDataFrame([("u", 0, [1.0]), ("u", 1, [2.0]), ("i", 0, [3.0]), ("i", 1, [4.0])], "side string, node long, vec array<double>")
    none = {(r["side"], r["node"]): r["vec"][0] for r in gr.graph_propagate(edges, start, 0, 1).collect()}
    assert none == {("u", 0): 1, ("u", 1): 2, ("i", 0): 3, ("i", 1): 4}
    one = {(r["side"], r["node"]): r["vec"][0] for r in gr.graph_propagate(edges, start, 1, 1).collect()}
    assert one[("u", 1)] == pytest.approx((2 + 4 / np.sqrt(2)) / 2)

@pytest.mark.parametrize("sizes", [{}, {"cells": 30}, {"most": 7, "cells": 30}])
def test_propagation_moves_no_vectors(spark, monkeypatch, sizes):
    """Small blocks, pieces of a hub's edges, nodes without vectors or edges, a node that comes twice."""
    rng = np.random.default_rng(1)
    edges = [e for u in range(30) for i in {0, *rng.choice(20, 4).tolist()} for e in (("u", u, "i", i, 0.5 + i), ("i", i, "u", u, 1.0 + u))]
    edges += [("u", 1, "x", 5, 1.0), ("x", 7, "u", 3, 2.0), ("u", 2, "u", 4, 0.5)]
    start = [(s, n, rng.random(3).tolist()) for s, m in (("u", 25), ("i", 15)) for n in range(m)] + [("u", 3, [1.0, 2.0, 3.0]), ("z", 9, [1.0] * 3), ("i", 19, None)]
    now: dict = {}
    for s, n, v in start:
        if v is not None:
            now[s, n] = now.get((s, n), 0) + np.array(v)
    want = dict(now)
    for _ in range(2):
        then: dict = {}
        for a, b, c, d, w in edges:
            if (a, b) in now:
                then[c, d] = then.get((c, d), 0) + w * now[a, b]
        now = then
        want = {k: want.get(k, 0) + now.get(k, 0) for k in {*want, *now}}
    written = []
    monkeypatch.setattr(gr, "cut", lambda df, label="cut", *more: (written.append((label, df._jdf.queryExecution().toString())), scale.cut(df, label, *more))[1])
    e = spark.createDataFrame(edges, "src_side string, src long, dst_side string, dst long, w double")
    got = gr.graph_propagate(e, spark.createDataFrame(start, "side string, node long, vec array<double>"), 2, 3, **sizes)
    got = {(r["side"], r["node"]): r["vec"] for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k] / 3) for k in want)
    layers = [plan for label, plan in written if label.startswith("layer")]
    assert layers and not any("Exchange" in plan for plan in layers)


def test_factor_model_beats_popularity_on_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(u, (u % 2) * 10 + int(i)) for u in range(40) for i in rng.choice(10, 6, replace=False)]
    train = spark.createDataFrame(rows, "user long, item long")
    users, items = tr.implicit_mf(train, rank=4, iterations=5)
    top = vs.blocked_topk(users.withColumnRenamed("user", "query"), items, 4, train.withColumnRenamed("user", "query"))
    share = top.agg(F.avg((F.floor(F.col("item") / 10) == F.col("query") % 2).cast("int"))).first()[0]
    assert share > 0.9


def test_factor_model_drops_files_of_earlier_iterations(spark, monkeypatch):
    """Spark deletes the shuffle files of an iteration only at a checkpoint."""
    from pyspark.ml import recommendation

    made, fit = [], recommendation.ALS.fit
    monkeypatch.setattr(recommendation.ALS, "fit", lambda self, *more: (made.append(self), fit(self, *more))[1])
    train = spark.createDataFrame([(u, (u + i) % 6) for u in range(8) for i in range(3)], "user long, item long")
    tr.implicit_mf(train, rank=2, iterations=3)
    assert made[0].getCheckpointInterval() <= 2 and made[0].getMaxIter() == 3


def test_negatives(spark, random_pairs):
    index = spark.range(80).select(F.col("id").alias("item"), F.col("id").alias("rank"))
    neg = tr.sample_negatives(random_pairs, index, 80, 3)
    assert neg.count() == 3 * random_pairs.select("user", "item").distinct().count()
    bad = neg.join(random_pairs.select("user", F.col("item").alias("negative")), ["user", "negative"], "left_semi")
    assert bad.count() == 0
    full = spark.createDataFrame([(0, i) for i in range(5)], "user long, item long")
    with pytest.raises(ValueError):
        tr.sample_negatives(full, index.filter("item < 5"), 5)


def greedy(rows):
    picked, owners, stars = [], Counter(), 0
    for s, r, o, st in sorted(rows, key=lambda x: (-x[0], x[1])):
        if owners[o] >= rc.MAX_PER_OWNER or (st and stars >= rc.MAX_STARRED):
            continue
        stars += st
        owners[o] += 1
        picked.append(r)
        if len(picked) == rc.N_REPOS:
            break
    return picked


def test_diverse_pick_matches_greedy(spark):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for u in range(60):
        rows = [
            (float(rng.integers(0, 40)), r, f"o{int(rng.integers(0, 2 + u % 12))}", bool(rng.random() < 0.2 + 0.6 * (u % 2)))
            for r in range(80)
        ]
        want[u] = greedy(rows)
        data += [(u, r, o, st, s) for s, r, o, st in rows]
    d = spark.createDataFrame(data, "user long, repo_id long, owner string, starred boolean, score double")
    got = defaultdict(list)
    for r in rc.select_diverse(d).orderBy("user", "rank").collect():
        got[r["user"]].append(r["repo_id"])
    assert dict(got) == want


def test_history_ranking_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    n, dim = 40, 5
    model, text = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    lang = [["Py", "Go", "C"][i % 3] for i in range(n)]
    repos = spark.createDataFrame(
        [(i, f"o{i % 9}", lang[i], model[i].tolist(), text[i].tolist()) for i in range(n)],
        "repo_id long, owner string, language string, model_vec array<double>, text_vec array<double>",
    )
    with_issues = repos.filter("repo_id % 5 <> 4").select("repo_id")
    cand = [i for i in range(n) if i % 5 != 4]
    histories = {0: [3], 1: [1, 2, 8, 11, 20], 2: [99], 3: [5, 6]}
    rows = [(u, r, t, lang[r] if r < n else "Go", ["t1"] if u else ["none"]) for u, h in histories.items() for t, r in enumerate(h)]
    stars = spark.createDataFrame(rows, "user long, repo_id long, ts long, language string, topics array<string>")
    tv = rng.normal(size=dim)
    topics = spark.createDataFrame([("a", 0, ["t1"], tv.tolist())], "topic string, position int, kw array<string>, vec array<double>")
    own = spark.createDataFrame([(1, "o3")], "user long, owner string")
    ranked, users, _ = rc.history_scores(stars, repos, with_issues, topics, own, dim)
    got = defaultdict(list)
    for r in rc.select_diverse(ranked).orderBy("user", "rank").collect():
        got[r["user"]].append(r["repo_id"])
    modes = {r["user"]: r["mode"] for r in users.collect()}
    assert modes == {0: "blend", 1: "model", 2: "text_profile", 3: "model"}

    def z(x):
        return (x - x.mean()) / (x.std() + 1e-9)

    for u, h in histories.items():
        hist = [r for r in h if r < n]
        w = min(1.0, len(hist) / 2)
        parts = ([text[hist[-50:]].mean(0)] if hist else []) + ([tv / np.linalg.norm(tv)] if u else [])
        score = np.zeros(len(cand))
        if hist:
            score += w * z(model[cand] @ model[hist].mean(0))
        if parts:
            t = np.mean(parts, axis=0)
            score += (1 - w) * z(text[cand] @ (t / np.linalg.norm(t)))
        spoken = {lang[r] if r < n else "Go" for r in h}
        score += 0.15 * np.array([lang[i] in spoken for i in cand])
        rows = [(round(float(s), 9), i, f"o{i % 9}", i in h) for s, i in zip(score, cand, strict=True) if not (u == 1 and i % 9 == 3)]
        assert got[u] == greedy(rows)


def test_rankings(spark):
    d = spark.createDataFrame([("[3] > [1] > [3] > [9] > [x]",)], "t string")
    order, missing = an.parse_ranking(F.col("t"), F.lit(4))
    assert tuple(d.select(order, missing).first()) == ([2, 0, 1, 3], 2)
    r = spark.createDataFrame([(0, 0, [0, 1, 2]), (0, 1, [1, 0, 2]), (0, 2, [1, 2, 0])], "list long, ranking long, order array<int>")
    assert [x["candidate"] for x in an.borda(r).orderBy("place").collect()] == [1, 0, 2]


def test_answers_parse(spark):
    d = spark.createDataFrame([(1, 'so {"skills": [" a ", 5], "summary": " s "} ok'), (2, "none"), (3, "{broken")], "repo_id long, response string")
    got = {r["repo_id"]: r for r in an.repo_features(d).collect()}
    assert (got[1]["skills"], got[1]["summary"], got[1]["parsed"]) == (["a", "5"], "s", True)
    assert not got[2]["parsed"] and not got[3]["parsed"]
    facts = F.array(F.lit("Repository: x (main language: Python)."))
    bad = spark.range(1).select(an.unsupported_claims(F.lit('Python and Rust, "a long quote", 42, me/you'), facts)).first()[0]
    assert bad == ["42", "a long quote", "me/you", "rust"]


def test_grid_points():
    points = gs.grid_points({"k": 1, "s": 0}, {"k": [1, 2]}, {"k": [3, 2]}, None, [{"k": 2}, {"s": 9}])
    assert points == [{"k": 1, "s": 0}, {"k": 2, "s": 0}, {"k": 3, "s": 0}, {"k": 1, "s": 9}]


def test_candidate_sets_hold_one_target_and_no_seen_item(spark, random_pairs):
    index = spark.range(80).select(F.col("id").alias("item"), F.col("id").alias("rank"))
    targets = random_pairs.filter("item < 10").select("user", "item")
    sets = scale.cut(an.random_candidate_sets(targets, random_pairs.select("user", "item"), index, 80, 20))
    per = sets.groupBy("user").agg(F.count("*").alias("n"), F.count_if("is_target").alias("t"), F.count_distinct("item").alias("d"))
    assert per.filter("n <> 20 OR t <> 1 OR d <> 20").count() == 0
    assert sets.filter("NOT is_target").join(random_pairs, ["user", "item"], "left_semi").count() == 0


def test_profile_list_makes_no_table_of_pairs(spark):
    """Shared skills count in the search, three at most, also those that rows of a repository repeat; no join on a skill word."""
    from tidemark.operators import recommend as rc
    from tidemark.operators import vectorscore as vs

    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(1200)]  # more than a task compares at once
    asked = [[str(w) for w in rng.choice(names, 900, replace=False)] for _ in range(7)]
    offered = [[str(w) for w in rng.choice(names, n)] for n in rng.integers(0, 6, 40)]
    left, right = rng.normal(size=(7, 3)), rng.normal(size=(40, 3))
    queries = spark.createDataFrame([(i, left[i].tolist(), asked[i]) for i in range(7)], "query long, vec array<double>, words array<string>")
    items = spark.createDataFrame([(i, right[i].tolist(), offered[i]) for i in range(40)], "item long, vec array<double>, words array<string>")
    got = vs.blocked_topk(queries, items, 5, bonus=(0.4, 3)).collect()
    score = left @ right.T + [[0.4 * min(3, sum(w in set(a) for w in o)) for o in offered] for a in asked]
    assert len(got) == 35
    for r in got:
        assert np.argsort(-score[r["query"]])[r["rank"] - 1] == r["item"] and abs(score[r["query"], r["item"]] - r["score"]) < 1e-9

    users = spark.createDataFrame([(1, ["Go"], ["t"]), (2, [], ["t"]), (3, ["go"], None)], "user long, languages array<string>, interests array<string>")
    repos = spark.createDataFrame(
        [(i, f"o{i % 4}", "Go" if i % 3 else None, ["go", "x", "y", "z"][: i % 5], i, right[i].tolist()) for i in range(1, 30)],
        "repo_id long, owner string, language string, skills array<string>, n_contrib long, text_vec array<double>",
    )
    topics = spark.createDataFrame([("t", ["x", "y", "z"], [1.0, 0.0, 0.0])], "topic string, kw array<string>, vec array<double>")
    d = rc.recommend_from_profile(users, repos, repos.select("repo_id"), topics, 3)
    assert "n_skills" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert d.groupBy("user").count().filter("count = 8").count() == 3


def test_bpr_loss_moves_no_item_vector_to_the_negative(spark):
    from tidemark.operators import training as tr

    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(4, 3)), rng.normal(size=(6, 3))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user long, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, vec array<double>")
    rows = [(a, b, (a + b + c) % 6) for a in range(4) for b in range(3) for c in (1, 2, 2)]
    d = tr.bpr_loss(spark.createDataFrame(rows, "user long, item long, negative long"), users, items, 0.5)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    # what meets the negatives' vectors holds no item vector
    assert not any("_i#" in line and "negative#" in line and "Project" in line for line in plan.splitlines())
    x = np.array([u[a] @ v[b] - u[a] @ v[c] for a, b, c in rows])
    l2 = np.mean([u[a] @ u[a] + v[b] @ v[b] + v[c] @ v[c] for a, b, c in rows]) / 2
    got = d.first()
    assert np.allclose([got["bpr"], got["l2"], got["loss"]], [np.log1p(np.exp(-x)).mean(), l2, np.log1p(np.exp(-x)).mean() + 0.5 * l2])


def test_claims_are_checked_by_all_cores(spark, tmp_path):
    """A part table of one small file was one task's."""
    from checks.registry import QUERIES
    import checks.q_answers  # noqa: F401

    part = spark.range(40).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'red bolt' as p_name", "'MEDIUM' as p_type", "cast(id as int) as p_size")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    d = QUERIES["faithfulness_check"](spark, str(tmp_path))
    assert d.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and d.count() > 0


def test_excluded_pairs_are_scored_where_vectors_meet(spark, monkeypatch):
    """Scores that 4-byte numbers cannot tell apart are ordered by their 8-byte products; excluded pairs come with theirs."""
    monkeypatch.setattr(vs, "MIN_BLOCK", 8)
    monkeypatch.setattr(vs, "FIRST", 5)
    rng = np.random.default_rng(2)
    base, q = rng.normal(size=6), rng.normal(size=(20, 6))
    v = base + 1e-10 * rng.normal(size=(60, 6))
    tags = [["a"], ["b"], [], None]
    queries = spark.createDataFrame([(u, q[u].tolist(), tags[u % 4], 1e-10) for u in range(20)], "query long, vec array<double>, tags array<string>, boost double")
    items = spark.createDataFrame([(i, v[i].tolist(), f"o{i % 9}", "abc"[i % 3]) for i in range(60)], "item long, vec array<double>, owner string, tag string")
    gone = [(u, (u * 7 + j) % 60) for u in range(20) for j in range(3)]
    out = vs.blocked_topk(queries, items, 4, spark.createDataFrame([*gone, (99, 1), (1, 99)], "query long, item long"), owner_cap=2, block=25, scored=True).collect()
    score = {(u, i): q[u] @ v[i] + (1e-10 if "abc"[i % 3] in (tags[u % 4] or []) else 0) for u in range(20) for i in range(60)}
    assert {(r["query"], r["item"]) for r in out if r["rank"] is None} == set(gone)
    assert all(r["score"] == pytest.approx(score[r["query"], r["item"]], abs=1e-14) for r in out)
    for u in range(20):
        want, held = [], Counter()
        for i in sorted((i for i in range(60) if (u, i) not in gone), key=lambda i: (-round(score[u, i], 12), i)):
            held[i % 9] += 1
            want += [i] if held[i % 9] <= 2 else []
        assert [r["item"] for r in sorted((r for r in out if r["query"] == u and r["rank"]), key=lambda r: r["rank"])] == want[:4]


def test_ages_are_not_moved_with_candidates(spark):
    from tidemark.operators import issues as iss

    rows = [(c, 1_000_000, n, 1_000_000 - 86_400 * n, n == c, 1.0, 0.5, float(n)) for c, ns in ((1, (1, 2)), (3, (4, 5)), (6, (6,))) for n in ns]
    d = spark.createDataFrame(rows, "case long, t long, number long, created long, is_linked boolean, diff double, skill double, age double")
    out = iss.usable_cases(d)
    assert out.columns == d.columns and sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] == 1)
    exchanged = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Project" in x]
    assert not any("age#" in x and "AS age" not in x for x in exchanged)
