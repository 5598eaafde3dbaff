from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from plain_forms import jaccard_components, repeated_bytes

from tidemark.llm import jaccard_join, suffix_dedup

TEXTS = "doc_id long, text string"
by = lambda rows: sorted(map(tuple, rows), key=str)


def clashing(docs):
    """Extra columns with names that the operators use themselves."""
    for c in ("id", "th", "row", "spans", "n", "u", "label", "component", "name", "elements", "one", "turn"):
        docs = docs.withColumn(c, F.lit(c))
    return docs


@pytest.fixture(scope="module")
def near():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    edited = lambda w, p: [rnd.choice(vocabulary) if rnd.random() < p else x for x in w]
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "A b"), (5, "a B"), (6, "a b c d e"), (None, "a b c d e"), (6, "a b c d e")]
    shared = [fresh(70) for _ in range(3)]
    for _ in range(25):
        base = fresh(rnd.choice([3, 5, 8, 20, 40, 90, 200, 500]))
        for _ in range(rnd.randrange(1, 6)):
            w = edited(base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03]))
            if rnd.random() < 0.3:
                k = rnd.randrange(0, len(w) + 1)
                w = w[:k] + rnd.choice(shared) + w[k:]
            rows.append((len(rows) + 10, " ".join(w)))
    hub = fresh(150)
    rows += [(1000 + k, " ".join(edited(hub, 0.012))) for k in range(40)]
    rows += [(2000 + k, " ".join(fresh(20) + shared[0] + fresh(10))) for k in range(30)]
    return rows


def test_components_equal_brute_force(spark, near):
    docs = clashing(spark.createDataFrame(near, TEXTS)).repartition(4)
    assert by(jaccard_join.join(docs).collect()) == by(jaccard_components(near))


def test_broadcast_limit_changes_the_plan_only(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_SETS", 0)
    some = near[:60]
    assert by(jaccard_join.join(spark.createDataFrame(some, TEXTS)).collect()) == by(jaccard_components(some))


def test_join_sql_agrees(spark, near):
    some = [r for r in near if r[0] is not None]
    documents = spark.createDataFrame(some, TEXTS).toPandas()  # noqa: F841  read by name
    assert by(duckdb.sql(jaccard_join.oracle_sql()).fetchall()) == by(jaccard_components(some))


def test_keep_one_of_each_group(spark, near):
    docs = clashing(spark.createDataFrame(near, TEXTS))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {(d, t) for (d, t), (_, n, c) in zip(near, jaccard_components(near), strict=True) if n == 0 or d == c}
    assert len(got) == len(want) and set(got) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXTS)
    assert jaccard_join.join(none).count() == 0
    assert jaccard_join.keep_one(none).count() == 0
    assert suffix_dedup.digests(none).count() == 0


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 6)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(90) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "a" * 1000), (None, "b" * 300), (5, "ab" * 400), (6, "ab" * 101)]
    for i in range(7, 90):
        parts = [fresh(rnd.randrange(0, 30)) if rnd.random() < 0.5 else rnd.choice(shared)[rnd.randrange(0, 60) :] for _ in range(rnd.randrange(1, 5))]
        rows.append((i, "".join(parts)))
    return rows + [(200, rows[20][1]), (200, rows[20][1]), (200, rows[30][1])]


@pytest.mark.parametrize(("length", "gram", "limit"), [(200, 64, 256), (40, 8, 3)])
def test_repeated_bytes_equal_brute_force(spark, passages, length, gram, limit):
    docs = clashing(spark.createDataFrame(passages, TEXTS)).repartition(3)
    got = suffix_dedup.digests(docs, length=length, gram=gram, limit=limit).collect()
    assert by(got) == by(repeated_bytes(passages, length))


def test_suffix_order_is_that_of_the_bytes():
    import numpy as np

    raw = np.frombuffer(b"banana banana bandana ananas", np.uint8)
    suffixes = suffix_dedup.Suffixes(np.concatenate((raw, np.zeros(4, np.uint8))), 4)
    start, segment = np.arange(len(raw)), np.zeros(len(raw), np.int64)
    order = suffixes.merge_sort(start, segment)
    padded = raw.tobytes() + bytes(4)
    assert [padded[i : i + 4] for i in order] == sorted(padded[i : i + 4] for i in range(len(raw)))


def test_removed_characters_leave_valid_text(spark):
    rows = [(1, "é" * 150 + "x"), (2, "é" * 150 + "y"), (3, None)]
    docs = clashing(spark.createDataFrame(rows, TEXTS))
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "x", 2: "y", 3: None}
