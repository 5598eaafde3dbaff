"""Whitening, exact deduplication and collocations against brute force, and hashes that must not collide."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from plain_forms import SMALL, repetition

from tidemark.llm import arrays, collocations, exact_dedup, jaccard_join, sanitise, secrets_link, suffix_dedup, whitening
from tidemark.llm import repetition as rules

TEXTS = "doc_id long, text string"


# hashes --------------------------------------------------------------------------------------------


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return t[:n]


@pytest.mark.parametrize("n", [1024, 4096])
def test_strings_made_to_collide_stay_apart(spark, n):
    t = thue_morse(n)
    x, y = "".join("ab"[i] for i in t), "".join("ba"[i] for i in t)
    as_words = [" ".join(("left", "right")[i ^ k] for i in t) for k in (0, 1)]
    filler = " ".join(f"w{i}" for i in range(60))
    rows = [(1, x), (2, y), (3, f"{x}\n{y}\n{filler}"), (4, f"{as_words[0]} stop {as_words[1]}")]
    docs = spark.createDataFrame(rows, TEXTS)
    got = {r["doc_id"]: r for r in rules.rules(docs).collect()}
    for doc_id, text in rows:
        want = repetition(text, 8)
        assert (got[doc_id]["n_dup_lines"], got[doc_id]["n_repeat_words"]) == (want["n_dup_lines"], want["n_repeat_words"])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == {i: i for i in range(1, 5)}


def test_span_hashes_equal_for_equal_spans_and_products_are_exact():
    rng = np.random.default_rng(0)
    p = int(arrays.MOD)
    a, b = rng.integers(0, p, (2, 500), dtype=np.uint64)
    a[:2], b[:2] = p - 1, p - 1
    assert arrays.mod_product(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    raw = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    raw[2_000_000:2_001_000] = raw[5_000:6_000]
    start = np.array([0, 5_000, 6_000, 2_000_000])
    h = arrays.hash_spans(raw, start, start + np.array([10, 1_000, 1_900_000, 1_000]))
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    values = rng.integers(0, 2**64, 300, dtype=np.uint64)
    values[200:250] = values[20:70]
    prefix = arrays.mod_prefix(values)
    assert arrays.mod_spans(prefix, np.array([20]), np.array([70])) == arrays.mod_spans(prefix, np.array([200]), np.array([250]))


# exact deduplication -------------------------------------------------------------------------------


def odd_rows():
    rnd = random.Random(5)
    rows = [(i % 37, f"text {rnd.randrange(12)}") for i in range(400)]  # ties of doc_id, copies
    rows += [(1000 + i, "hot") for i in range(300)]
    rows += [(None, None), (None, ""), (7, ""), (None, "alone"), (None, "alone"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "X" * 300_000)]
    return rows


@pytest.mark.parametrize("fan_bits", [1, 4])
def test_exact_groups_equal_brute_force(spark, fan_bits):
    rows = odd_rows()
    held = defaultdict(list)
    for doc_id, text in rows:
        held[text or ""].append(doc_id)
    docs = spark.createDataFrame(rows, TEXTS).repartition(40)
    got = [tuple(r) for r in exact_dedup.groups(docs, fan_bits=fan_bits).collect()]
    want = []
    for doc_id, text in rows:
        ids = [i for i in held[text or ""] if i is not None]
        want.append((doc_id, max(ids, default=None), len(held[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(((d, k, n, h) for d, k, n, _, h in got), key=str) == sorted(want, key=str)
    kept = [(d, k, h) for d, k, _, kept, h in got if kept]
    assert len(kept) == len(held) == len({h for _, _, h in kept}) and all(d == k for d, k, _ in kept)


def test_dedup_keeps_all_columns_and_the_smallest_row(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, TEXTS).withColumns({"a.b": F.lit(1), "digest": F.lit("d"), "part": F.lit(None).cast("string")})
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    least = {}
    for doc_id, text in rows:
        old = least.get(text or "", (True, None))
        least[text or ""] = min(old, (doc_id is None, doc_id), key=lambda v: (v[0], v[1] or 0))
    assert {(r["text"] or "", r["doc_id"]) for r in got.collect()} == {(t, v[1]) for t, v in least.items()}
    assert got.count() == len(least)
    small = exact_dedup.groups(docs.select("doc_id", "text"), normalise=F.lower)
    # the long texts differ only in case; three texts are empty
    assert small.filter(F.col("group_size") == 3).count() == 6


def test_texts_whose_digests_collide_stay_apart(spark):
    rows = spark.createDataFrame([(0, 5, bytes([k % 2]) * 32, k, k) for k in range(6)], "part long, digest long, sha binary, keep_id long, keep_row long")
    got = sorted((bytes(r["sha"])[0], r["keep_id"], r["size"]) for r in exact_dedup.merged(rows, True).collect())
    assert got == [(0, 4, 3), (1, 5, 3)]


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


# whitening -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(rows, components=16):
    d = max(len(v) for _, v in rows if v is not None)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    grid = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good], dtype=object)
    fit = sorted({tuple(g) for g in grid})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(c * n - s) / n for c, s in zip(g, sums, strict=True)] for g in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-13 * values.sum()).sum())
    out = {}
    for (i, _), g in zip(good, grid, strict=True):
        z = np.array([float(c * n - s) / n for c, s in zip(g, sums, strict=True)]) @ vectors[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(g, sums, strict=True)), z))
    return n, out, values[:k] / values.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    rows = [(i, (rng.normal(size=20) @ mix).tolist()) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [(7, rows[9][1]), (None, rows[1][1]), (901, None), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, []), (906, [1.0])]
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("whitened", F.lit("clash"))
    got = whitening.whiten(vectors.repartition(7)).collect()
    n, want, explained = plain_whitening(rows)
    assert {r["n"] for r in got} == {n} and len(got) == 16 * sum(map(len, want.values()))
    found = defaultdict(lambda: defaultdict(list))
    for r in got:
        found[r["vec_id"]][r["component"]].append(r)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
    turn = {c: np.sign(found[0][c][0]["whitened"] * want[0][0][1][c - 1]) for c in range(1, 17)}  # one sign per component
    for i, rows_ in want.items():
        assert sorted(r["deviation"] for r in found[i][1]) == sorted(d for d, _ in rows_)
        for c in range(1, 17):
            a = sorted(turn[c] * r["whitened"] for r in found[i][c])
            assert a == pytest.approx(sorted(z[c - 1] for _, z in rows_), abs=1e-8)


def test_few_directions_and_odd_tables(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).count() == 0
    huge = spark.createDataFrame([(i, [1e30 * (i % 2), 1.0 * i]) for i in range(4)], VECTORS)
    assert {r["deviation"] for r in whitening.whiten(huge).collect()} == {None}


def test_transform_keeps_other_columns(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)], i) for i in range(30)] + [(99, None, 0)], VECTORS + ", `a.b` long")
    table = whitening.fit_list(rows, 2)
    model = whitening.fit(table.cache(), 2)
    got = whitening.transform(rows, model)
    assert got.columns == ["vec_id", "embedding", "a.b", "whitened"]
    z = {r["vec_id"]: r["whitened"] for r in got.collect()}
    assert z[99] is None and len(z[0]) == 2 and z[0] == pytest.approx(z[15])
    assert whitening.identity_error(table, model) < 1e-12


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 30, 30),
        np.concatenate((np.full(6, 3.0), 3 + 1e-9 * np.arange(6), np.linspace(5, 6, 10), 10 + 1e-13 * np.arange(4), np.zeros(4))),
        10.0 ** np.arange(-12, 4),
    ],
)
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refined_eigenvectors(a)
    assert np.abs(a @ x - x * e).max() < 4e-16 * np.abs(values).max() * 4
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert (np.diff(e) <= 0).all()


# collocations --------------------------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\t]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    cand = {(g, w): a for (g, w), a in counts.items() if len(w) > 1 and a >= least}
    longer = Counter()
    for (g, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[g, w[i : i + m]] = max(longer[g, w[i : i + m]], a)
    out = defaultdict(list)
    for (g, w), a in cand.items():
        if 100 * longer[g, w] >= share * a:
            continue
        cuts = [(1000 * a * totals[g] // (counts[g, w[:k]] * counts[g, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[g].append((-score, -a, " ".join(w).encode(), counts[g, w[:k]], counts[g, w[k:]], totals[g]))
    rows = []
    for g, found in out.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:top], 1):
            rows.append((g, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ä", "x-y", "日本", "Big"]
    passage = "  The quick\tbrown fox  jumps over the lazy dog, then; sleeps\nlong and well. "
    rows = []
    for i in range(300):
        words = rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randrange(0, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n"]) for w in words)
        rows.append((text + (passage if i % 3 == 0 else "") + text[:20], rnd.choice(["en", "de", None, "und"])))
    rows += [("again and again " * 4000, "en"), (None, "en"), ("", None), ("one", "xx"), (".,;:!?\n", "de")]
    rows += [rows[0]] * 20
    return rows


@pytest.mark.parametrize(("filter_bits", "every"), [(20, 32), (10, 3)])
def test_collocations_equal_brute_force(spark, prose, filter_bits, every):
    docs = spark.createDataFrame([(None, t, g, "clash") for t, g in prose], "doc_id long, text string, lang string, chunk string")
    for least, share, top in ((5, 100, 2000), (8, 80, 25)):
        got = collocations.collocations(docs.repartition(5), least, share, top, filter_bits, every)
        assert sorted(map(tuple, got.collect())) == plain_collocations(prose, least, share, top)


def test_very_long_texts_are_cut_at_piece_ends(spark, prose, monkeypatch):
    text = " ".join(t for t, _ in prose if t)[:200_000]
    docs = spark.createDataFrame([(text, "en"), (text, "en")], "text string, lang string")
    raw = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(collocations, "PART_BYTES", 5_000)
    offsets, row = collocations._parts(raw, np.array([0, len(raw)]))
    assert len(row) > 10 and offsets[-1] == len(raw) and all(collocations._BREAK[raw[o - 1]] for o in offsets[1:-1])
    got = collocations.collocations(docs, 6, 100, 2000, 16)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(text, "en")] * 2, 6, 100, 2000)


def test_parse_covers_every_word_once(spark, prose):
    docs = spark.createDataFrame(prose, "text string, lang string")
    total = collocations.parse(docs, 8).agg(F.sum(F.col("own") * F.col("times"))).first()[0]
    assert total == sum(len(re.findall(r"[^\x20\t.,;:!?\x0A-\x0D]+", t or "")) for t, _ in prose)
    # copies add no chunk
    assert collocations.parse(docs.union(docs), 8).count() == collocations.parse(docs, 8).count()


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**9, 9 * 10**15, 7 * 10**12, 5 * 10**12 + 1
    frequent = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert collocations.scored(frequent, totals).first()["score"] == 1000 * a * n // (left * right)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


# stages --------------------------------------------------------------------------------------------


def test_stages_carry_columns_whose_names_hold_dots(spark):
    text = "password=abcdefghijklmnop " + " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 5), (2, "jane@corp.com " + text[:300], 6)], "doc_id long, text string, `a.b` long")
    for stage in (rules.keep, jaccard_join.keep_one, suffix_dedup.remove_repeats, secrets_link.redact, sanitise.sanitise):
        got = stage(docs)
        assert got.columns == docs.columns
        assert {(r["doc_id"], r["a.b"]) for r in got.collect()} <= {(1, 5), (2, 6)}


def test_long_keys_and_words_are_found(spark):
    key = "aB" * 35 + "3"
    name = "n" * 68
    rows = [(1, f"user=bob {key}"), (2, f"{name} jane@corp.com")]
    docs = spark.createDataFrame(rows, TEXTS)
    spans = {r["doc_id"]: {s["value"] for s in r["spans"]} for r in secrets_link.find(docs).collect()}
    assert key in spans[1]
    terms = {r["doc_id"]: {s["value"] for s in r["spans"] if s["kind"] == "term"} for r in sanitise.find(docs).collect()}
    assert name in terms[2]
