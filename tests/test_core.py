"""Splits, cores, ids, popularity, neighbours and metrics on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.operators import evaluation as ev
from tidemark.operators import interactions as ia
from tidemark.operators import neighbours as nb
from tidemark.operators import popularity as pp
from tidemark.operators import split as sp


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_threshold(spark):
    r = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 3, 2), (2, 1, 4, 3), (2, 2, 1, 4)], "user long, item long, rating long, ts long")
    assert rows(ia.to_implicit(r, 4), "user", "item") == [(1, 1), (2, 1)]


def test_core_drops_until_stable(spark):
    pairs = [(u, i) for u in range(6) for i in range(5)] + [(u, 9) for u in range(4)]
    pairs += [(6, 0), (6, 1), (6, 2), (6, 9)]
    df = spark.createDataFrame([(u, i, 0) for u, i in pairs], "user long, item long, ts long")
    out = rows(ia.k_core(df, 5), "user", "item")
    assert out == [(u, i) for u in range(6) for i in range(5)]


def test_remap_round_trip(spark):
    df = spark.createDataFrame([(30, 7), (10, 5), (20, 7), (10, 9)], "user long, item long")
    out, users, items = ia.remap_ids(df)
    assert rows(users, "raw_id", "user") == [(10, 0), (20, 1), (30, 2)]
    assert rows(items, "raw_id", "item") == [(5, 0), (7, 1), (9, 2)]
    assert rows(out, "user", "item") == [(0, 0), (0, 2), (1, 1), (2, 1)]


def test_heavy_users_go_everywhere(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(5)] + [("a", 9, 99), ("b", 1, 10)], "user string, item long, ts long")
    assert rows(ia.drop_heavy_users(df, 3, 50), "user", "item") == [("b", 1)]


def test_split_sizes(spark):
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 10, 15, 25)], "n long")
    tr, va, te = sp.split_sizes(F.col("n"))
    got = [tuple(r) for r in n.select("n", tr.alias("a"), va.alias("b"), te.alias("c")).orderBy("n").collect()]
    assert [g[1] for g in got] == [1, 1, 1, 3, 8, 11, 19]
    assert [g[2] for g in got] == [0, 0, 1, 1, 1, 2, 3]
    assert [g[3] for g in got] == [0, 1, 1, 1, 1, 2, 3]


def test_split_is_chronological_and_independent_of_input_order(spark, random_pairs):
    a = sp.chronological_split(random_pairs)
    b = sp.chronological_split(random_pairs.orderBy(F.rand(1)))
    cols = ("user", "item", "seq", "part")
    assert rows(a, *cols) == rows(b, *cols)
    other = sp.chronological_split(random_pairs, seed=7)
    assert rows(a, *cols) != rows(other, *cols)
    ends = a.groupBy("user").pivot("part", ["train", "val", "test"]).agg(F.max("ts").alias("hi"), F.min("ts").alias("lo"))
    assert ends.filter("train_hi > val_lo OR val_hi > test_lo").count() == 0
    assert a.count() == random_pairs.count()


def test_hot_groups_get_the_same_positions(spark, random_pairs):
    cols = ("user", "item", "seq", "part")
    plain = sp.chronological_split(random_pairs)
    split = sp.chronological_split(random_pairs, hot_rows=5)
    assert rows(plain, *cols) == rows(split, *cols)
    # one user holds almost all rows, all at one time
    hot = spark.createDataFrame([(0, i, 5) for i in range(3000)] + [(1, 1, 1)], "user long, item long, ts long")
    assert rows(sp.chronological_order(hot), "item", "seq") == rows(sp.chronological_order(hot, hot_rows=100), "item", "seq")


def test_global_index_large_path(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    small, n = scale.global_index(df, [F.col("x")], "i")
    big, m = scale.global_index(df, [F.col("x")], "i", small_rows=10)
    assert n == m == 5000
    assert rows(small, "x", "i") == rows(big, "x", "i")


def test_short_users_and_sample(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1)], "user long, item long, ts long")
    assert sp.short_users(df).first()[0] == 2
    assert sp.chronological_split(df).filter("part = 'test'").select("item").collect()[0][0] == 2
    assert rows(sp.sample_users(df, 1), "user") == rows(sp.sample_users(df.orderBy(F.desc("item")), 1), "user")


def test_global_cutoff_keeps_listed_cold_items(spark):
    block = [(u, i, 1) for u in range(6) for i in range(5)]
    later = [(0, 9, 20), (0, 1, 20), (7, 0, 20), (0, 8, 20)]
    df = spark.createDataFrame(block + later, "user long, item long, ts long")
    cold = spark.createDataFrame([(9,)], "item long")
    out = sp.global_temporal_split(df, 10, 15, 5, cold)
    assert rows(out.filter("part = 'test'"), "user", "item") == [(0, 9)]
    assert out.filter("part = 'val'").count() == 0


def test_histories_continue_in_pieces(spark, random_pairs):
    s = sp.chronological_order(random_pairs)
    whole = {r["user"]: r["items"] for r in sp.ordered_histories(s).collect()}
    pieces = defaultdict(list)
    for r in sp.ordered_histories(s, piece=4).orderBy("user", "piece").collect():
        assert len(r["items"]) <= 4
        pieces[r["user"]] += r["items"]
    assert whole == dict(pieces)


def test_head_items(spark):
    pop = spark.createDataFrame(list(enumerate([5, 1, 5, 3, 0, 9, 2, 2, 1, 0])), "item long, pop long")
    assert rows(pp.head_items(pop).filter("is_head"), "item") == [(0,), (5,)]


@pytest.fixture(scope="module")
def parts(random_pairs):
    return scale.cut(sp.chronological_split(random_pairs))


def histories(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["user"]].add(r["item"])
    return out


@pytest.mark.parametrize("slice_size", [512, 3])
def test_cooccurrence_matches_brute_force(parts, slice_size):
    train = parts.filter("part = 'train'")
    want = Counter()
    for items in histories(train).values():
        for i in items:
            for j in items:
                if i < j:
                    want[(i, j)] += 1
    got = {(r["i"], r["j"]): r["co"] for r in nb.cooccurrence(train, slice_size).collect()}
    assert got == dict(want)


def knn_brute(train, k, shrink):
    users = defaultdict(set)
    for u, items in histories(train).items():
        for i in items:
            users[i].add(u)
    out = {}
    for j in users:
        sims = []
        for i in users:
            co = len(users[i] & users[j])
            if i != j and co:
                sims.append((-co / (math.sqrt(len(users[i])) * math.sqrt(len(users[j])) + shrink + 1e-12), i))
        out[j] = {i: -s for s, i in sorted(sims)[:k]}
    return out


@pytest.mark.parametrize("sim_rows", [0, 4_000_000, 60])
def test_neighbour_ranking_matches_brute_force(parts, monkeypatch, sim_rows):
    train = parts.filter("part = 'train'")
    sims = knn_brute(train, 5, 10.0)
    fitted = nb.itemknn_fit(train, 5, 10.0)
    got = defaultdict(dict)
    for r in fitted.collect():
        got[r["item"]][r["neighbour"]] = r["sim"]
    assert {j: set(v) for j, v in got.items()} == {j: set(v) for j, v in sims.items() if v}
    targets, seen = ev.targets_of(parts, "test"), ev.seen_of(parts, "test")
    index = ia.id_map(parts, "item").select(F.col("raw_id").alias("item"), F.col("item").alias("rank"))
    monkeypatch.setattr(nb, "SIM_ROWS", sim_rows)
    monkeypatch.setattr(nb, "SCORE_CELLS", 500)
    scores = nb.itemknn_topk(train, fitted, targets, seen, block=7) if sim_rows else nb.unseen_scores(train, fitted, targets, seen)
    top = nb.fill_topk(scores.drop("rank"), targets, seen, index, 20)
    lists = defaultdict(list)
    for r in top.orderBy("user", "rank").collect():
        lists[r["user"]].append(r["item"])
    held, hidden = histories(train), histories(seen)
    items = sorted({r["item"] for r in parts.select("item").distinct().collect()})
    for u in histories(targets):
        scored = []
        for j in items:
            if j not in hidden[u]:
                score = sum(s for i, s in sims.get(j, {}).items() if i in held[u])
                scored.append((-round(score, 9), j))
        assert lists[u] == [j for _, j in sorted(scored)[:20]]


def test_popularity_lists_match_brute_force(parts):
    train = parts.filter("part = 'train'")
    pop = {r["item"]: r["pop"] for r in pp.item_popularity(train, parts).collect()}
    ranked, n = pp.ranked_items(pp.item_popularity(train, parts))
    assert n == len(pop)
    targets, seen = ev.targets_of(parts, "test"), ev.seen_of(parts, "test")
    hidden = histories(seen)
    order = sorted(pop, key=lambda i: (-pop[i], i))
    lists = defaultdict(list)
    for r in pp.popularity_topk(targets, seen, ranked).orderBy("user", "rank").collect():
        lists[r["user"]].append(r["item"])
    for u in histories(targets):
        assert lists[u] == [i for i in order if i not in hidden[u]][:20]


def test_ranking_metrics(spark):
    top = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 7, 3)], "user long, item long, rank int")
    tgt = spark.createDataFrame([(0, 1), (0, 7), (0, 9)], "user long, item long")
    r = ev.ranking_metrics(top, tgt, 3).first()
    a, b, c = 1.0, 1 / math.log2(3), 1 / math.log2(4)
    assert r["recall"] == pytest.approx(2 / 3)
    assert r["ndcg"] == pytest.approx((b + c) / (a + b + c))
    top = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "user long, item long, rank int")
    tgt = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)], "user long, item long")
    r = ev.ranking_metrics(top, tgt, 2).first()
    assert (r["recall"], r["ndcg"]) == (0.5, pytest.approx(1.0))


def test_list_quality(spark):
    top = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 2, 2), (2, 0, 1)], "user long, item long, rank int")
    heads = spark.createDataFrame([(0, 10, True), (1, 4, True), (2, 1, False), (3, 0, False)], "item long, pop long, is_head boolean")
    r = ev.list_quality(top, heads.select("item", "pop"), heads, 4, 2).first()
    assert (r["coverage"], r["avg_pop"], r["long_tail_share"]) == (0.75, pytest.approx(29 / 5), pytest.approx(0.2))


def test_slices(spark):
    top = spark.createDataFrame([(0, 0, 1), (1, 3, 1)], "user long, item long, rank int")
    tgt = spark.createDataFrame([(0, 0), (1, 1), (1, 3)], "user long, item long")
    heads = spark.createDataFrame([(0, 5, True), (1, 2, False), (3, 0, False)], "item long, pop long, is_head boolean")
    got = rows(ev.slice_metrics(top, tgt, heads, 1), "slice", "user")
    assert got == [("cold", 1), ("head", 0), ("tail", 1)]


def test_all_equal_scores_fill_the_list(spark):
    pop = spark.createDataFrame([(i, 1) for i in range(25)], "item long, pop long")
    ranked, _ = pp.ranked_items(pop)
    seen = spark.createDataFrame([(0, i) for i in range(10)], "user long, item long")
    users = spark.createDataFrame([(0,), (1,)], "user long")
    sizes = {r["user"]: r["count"] for r in pp.popularity_topk(users, seen, ranked).groupBy("user").count().collect()}
    assert sizes == {0: 15, 1: 20}


@pytest.mark.parametrize("list_rows, block_rows", [(3, 10), (10_000, 4_000_000)])
def test_packed_neighbour_lists(spark, monkeypatch, list_rows, block_rows):
    """Lists cut into pieces and dealt to item blocks give the sums of all products, whatever columns share them."""
    monkeypatch.setattr(nb, "LIST_ROWS", list_rows)
    monkeypatch.setattr(nb, "SIM_ROWS", block_rows)
    rng = random.Random(5)
    held = sorted({(u, rng.randrange(25)) for u in range(30) for _ in range(5)})
    sims = [(i, j, rng.randrange(1, 9) / 8, None if j % 3 else 0.5) for i in range(25) for j in range(25) if i != j]
    train = spark.createDataFrame(held, "user long, item long")
    table = spark.createDataFrame(sims, "item long, neighbour long, sim double, other double")
    want = {}
    for u, h in held:
        for i, j, s, o in sims:
            if j == h:
                one = want.setdefault((u, i), [0.0, 0.0])
                one[0] += s
                one[1] += o or 0.0
    got = {(r["user"], r["item"]): r["score"] for r in nb.itemknn_score(train, table).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    top = nb.itemknn_topk_by(train, table, train, train, ["sim", "other"], 4).collect()
    found = {}
    for r in top:
        found.setdefault((r["column"], r["user"]), set()).add((r["item"], r["score"]))
    for u in {u for u, _ in held}:
        for c in (0, 1):
            free = [(-v[c], i) for (x, i), v in want.items() if x == u and (u, i) not in held and v[c] > 0]
            assert found.get((c, u), set()) == {(i, -s) for s, i in sorted(free)[:4]}
    half = {(r["i"], r["j"]): (r["co"], r["n_i"], r["n_j"]) for r in nb.cooccurrence(train, 3, degrees=True).collect()}
    joined = nb.with_degrees(nb.cooccurrence(train, 3), train).collect()
    assert half == {(r["i"], r["j"]): (r["co"], r["n_i"], r["n_j"]) for r in joined}


@pytest.mark.parametrize("few", [200_000, 3])
def test_core_writes_rows_again_only_when_many_are_gone(spark, monkeypatch, few):
    from tidemark.operators import interactions as ia

    # a dense core with a long chain that is peeled off one end per pass; missing and repeated keys
    rows = [(u, i, 0) for u in range(20) for i in range(20)]
    for j in range(6):
        rows += [(100 + j, 100 + j, 1), (100 + j, 101 + j, 1)]
    rows += [(None, 3, 2), (None, 500, 2), (4, None, 2), (5, 5, 3)]
    written = []
    real = ia.cut
    monkeypatch.setattr(ia, "cut", lambda d, label: written.append(label) or real(d, label))
    monkeypatch.setattr(ia, "FEW_KEYS", few)
    got = ia.k_core(spark.createDataFrame(rows, "user long, item long, ts long"), 2).collect()
    want = rows
    while True:
        n_u, n_i = Counter(r[0] for r in want), Counter(r[1] for r in want)
        kept = [r for r in want if (r[0] is None or n_u[r[0]] >= 2) and (r[1] is None or n_i[r[1]] >= 2)]
        if len(kept) == len(want):
            break
        want = kept
    assert Counter(map(tuple, got)) == Counter(want)
    passes = sum(label == "dropped" for label in written)
    assert passes > 4 and (few == 3 or written.count("core") == 2)


def test_seen_pairs_are_left_out_where_scores_are(parts, monkeypatch):
    """Masked scores come out of the blocks: nothing is moved after the product, and rows are those of the masked table."""
    monkeypatch.setattr(nb, "SIM_ROWS", 40)
    train = parts.filter("part = 'train'")
    fitted = nb.itemknn_fit(train, 5, 10.0)
    want = ev.mask_seen(nb.itemknn_score(train, fitted), parts, "test")
    got = ev.mask_seen(partial(nb.itemknn_score, train, fitted), parts, "test")
    assert "Exchange" not in got._jdf.queryExecution().toString()
    some = lambda d: {(r["user"], r["item"]): pytest.approx(r["score"]) for r in d.collect()}
    assert some(got) == some(want) and got.count() == want.count() > 0


def test_nearest_by_several_similarities_at_once(spark):
    """The rows of an item are moved once for all similarities, and ranks are those of each of them alone."""
    rng = random.Random(3)
    sims = [(i, j, rng.randrange(-1, 4), rng.randrange(0, 3)) for i in range(8) for j in range(8) if i != j]
    table = spark.createDataFrame(sims, "item long, neighbour long, a int, b int")
    got = nb.nearest_by(table, 3, {"a": F.col("a"), "b": F.col("b") * 2})
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = got.collect()
    for c, x in (("a", F.col("a")), ("b", F.col("b") * 2)):
        want = nb.nearest(table.withColumn("sim", x).filter("sim > 0"), 3).collect()
        assert {(r["item"], r["neighbour"], r["rank_" + c]) for r in found if r["rank_" + c]} == {(r["item"], r["neighbour"], r["rank"]) for r in want}


def test_a_list_moves_as_one_row(spark):
    top = spark.createDataFrame([(0, None, 1), (0, 1, 2), (1, 7, 1)], "user long, item long, rank int")
    tgt = spark.createDataFrame([(0, 1), (0, 9), (2, 7)], "user long, item long")
    got = {(r["user"], r["item"]): r["rank"] for r in ev.placed(tgt, top, 2, ["user"]).collect()}
    assert got == {(0, 1): 2, (0, 9): None, (2, 7): None}


def test_seen_null_items_hide_nothing(spark):
    held = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, None)], "user long, item long")
    sims = spark.createDataFrame([(i, j, 0.5) for i in range(1, 5) for j in range(1, 5) if i != j], "item long, neighbour long, sim double")
    hidden = spark.createDataFrame([(0, None), (1, 3), (None, 4)], "user long, item long")
    whole = {(r["user"], r["item"]) for r in nb.itemknn_score(held, sims).collect()}
    got = {(r["user"], r["item"]) for r in nb.itemknn_score(held, sims, users=held, hidden=hidden).collect()}
    assert (0, 4) in whole and got == whole - {(1, 3)}
