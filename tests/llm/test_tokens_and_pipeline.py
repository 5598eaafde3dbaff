from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from plain_forms import jaccard_components, repeated_bytes, repetition, secrets
from tokenizers import Tokenizer

from tidemark.llm import bytebpe, order_minhash, packing, queries
from tidemark.llm import repetition as rules

TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "\r", "a", "b", "é", "ñ", "1", "'", "'s", "'ll", ".", ",", ", ", "<|endoftext|>", "\u3000", "\x85", "\u200b", "\x1c", "日", "😀", "\u0301", "\xa0", "X"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 16)))) for i in range(3000)]
    return rows + [(None, None), (5000, ""), (5001, "word " * 20000), (5001, "word " * 20000)]


def test_byte_bpe_equals_the_rank_library_and_round_trips(spark, odd):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(odd, TEXTS).withColumn("ids", F.lit(1))
    want = []
    for doc_id, text in odd:
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bytebpe.digests(docs, queries.BYTE_BPE).collect()), key=str) == sorted(want, key=str)


def test_offsets_cover_characters(spark, odd):
    docs = spark.createDataFrame(odd[:300], TEXTS)
    encoded = bytebpe.encode(docs, queries.BYTE_BPE)
    texts = dict(odd[:300])
    table, _ = bytebpe.token_bytes(queries.BYTE_BPE)
    for r in encoded.collect():
        text, ids = texts[r["doc_id"]], np.frombuffer(r["ids"], "<u4")
        at = np.frombuffer(r["offsets"], "<i4").reshape(-1, 2)
        assert len(at) == len(ids) == r["n_tokens"]
        for i, (a, b) in zip(ids.tolist(), at.tolist(), strict=True):
            assert table[i] in text[a:b].encode()
    decoded = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bytebpe.decode(encoded, queries.BYTE_BPE).collect()}
    assert decoded == texts


def check_packing(rows, docs_rows, length=2048):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    want = {}
    for doc_id, text in docs_rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want.setdefault((doc_id, k), []).append((at, len(part), zlib.crc32(part.tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)


def test_packing_is_whole_and_tight(spark, odd):
    rnd = random.Random(3)
    rows = odd[:200] + odd[-4:] + [(9000 + i, "word " * rnd.randrange(0, 3000)) for i in range(200)]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("length", F.lit(1)).withColumn("shard", F.lit(1))
    out = packing.pack_documents(docs, queries.WORD_BPE).collect()
    assert check_packing(out, rows) <= -(-sum(r["length"] for r in out) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), queries.WORD_BPE).count() == 0


def test_swaps_never_need_more_bins_than_best_fit():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = [rnd.randrange(300, 1400) for _ in range(rnd.randrange(1, 120))]
        first = packing.best_fit(sizes, 2048)
        better = packing.improve([list(b) for b in first], sizes, 2048)
        assert sorted(i for b in better for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in better) and len(better) <= len(first)


def test_swaps_empty_a_bin():
    # best fit leaves 6+3 | 5+5 | 4; exchanging 3 for 4 and moving the 3 into no room keeps three bins,
    # 7+2 | 6+3 | 5+4 | 1+1+2 fits into three of ten after moves
    sizes = [7, 2, 6, 3, 5, 4, 1, 1, 1]
    assert len(packing.improve([[0, 1], [2, 3], [4, 5], [6], [7], [8]], sizes, 10)) == 3


def test_edited_texts_and_fingerprints(spark, odd):
    rows = [(i, t * 9) for i, t in odd[:120] if t] + [(None, None), (7000, ""), (7001, "same text here"), (7002, "same text here")]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("part", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in order_minhash.compare_with_edited(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (next_id, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = text or "", following or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, near = (order_minhash.fingerprint(order_minhash.code_points(t)) for t in (text, edited, following))
        assert r["near_edited"] == order_minhash.likeness(own, changed)
        assert r["near_next"] == order_minhash.likeness(own, near)
        assert r["fingerprint"] == own.astype("<u2").tobytes().hex()
        assert len(prints[doc_id]) == len(r["fingerprint"])
    assert got[7001]["fingerprint"] == got[7002]["fingerprint"]
    assert order_minhash.compare_with_edited(docs.limit(0)).count() == 0
    assert order_minhash.compare_with_edited(docs.filter("doc_id = 7001")).first()["near_next"] == 1.0


def test_fingerprints_fall_with_edits_and_moves():
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    of = lambda t: order_minhash.fingerprint(order_minhash.code_points(t))
    light, heavy = text[:200] + "XX" + text[205:], text[:1200] + "".join(rnd.choice("abc ") for _ in range(1200))
    # three parts in another order: nearly the same k-mers, but their order is gone
    moved = text[1600:] + text[800:1600] + text[:800]
    near = [order_minhash.likeness(of(text), of(t)) for t in (text, light, heavy)]
    assert near[0] == 1.0 and near[1] > 0.8 and near[1] > near[2]
    assert order_minhash.likeness(of(text), of(moved)) < 0.7


def plain_order_minhash(text):
    """The fingerprint by its definition, one k-mer and one order at a time."""
    full = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    if not text:
        return [0] * 64
    level = [ord(c) + 1 for c in text]
    level += [0] * (8 - len(level))
    steps = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    for width, step in zip((1, 2, 4), steps, strict=True):
        level = [(a * step + b) & full for a, b in zip(level, level[width:])]
        level = [h ^ h >> 29 for h in level]
    seen, keys = {}, []
    for h in level:
        k = seen[h] = seen.get(h, -1) + 1
        keys.append(mixed(h + k * 0xD6E8FEB86659FD93 & full) >> 32)
    out = []
    for flip, factor in zip(order_minhash._FLIP.tolist(), order_minhash._FACTOR.tolist(), strict=True):
        ranked = sorted(range(len(keys)), key=lambda i: ((keys[i] ^ flip) * factor & 0xFFFFFFFF, i))
        value = 0
        for i in sorted(ranked[:2]):
            value = mixed(value * steps[0] + level[i] & full)
        out.append(value & 0xFFFF)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abababababababab" * 9, "the quick brown fox jumps over the lazy dog, twice: the quick brown fox", "日本語のテキスト😀" * 5])
def test_order_minhash_equals_its_definition(text):
    assert order_minhash.fingerprint(order_minhash.code_points(text)).tolist() == plain_order_minhash(text)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    fresh = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    shared = fresh(60)
    rows = [(1, None), (2, "short"), (3, "same words again " * 60)]
    for i in range(10, 40):
        text = fresh(rnd.randrange(60, 200))
        if i % 3 == 0:
            text += "\n" + shared
        if i % 4 == 0:
            text += ' token = "0641917ea4e9feb9cda83477b57ac2654884f485" ' + fresh(3)
        rows.append((i, text))
        if i % 5 == 0:
            rows.append((100 + i, text + " end"))
    # passages found twice: 9 percent of the words each (stays), 15 (the longest is over 10), four of 8 (over 24 together)
    once, twice = [fresh(90) for _ in range(4)], lambda n: fresh(n)
    nine, fifteen, eights = twice(10), twice(18), [twice(9) for _ in range(4)]
    rows += [(50, f"{nine} {once[0]} {nine}"), (51, f"{fifteen} {once[1]} {fifteen}"), (52, f"{' '.join(eights)} {once[2]} {' '.join(reversed(eights))}")]
    docs = [(i, t, "en", "s", len(t) if t is not None else None, i) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row long").write.parquet(f"{tmp_path}/documents.parquet")

    def good(t):
        m = repetition(t, rules.MIN_WORDS)
        n = m["n_words"]
        long_ = m["longest_repeat"] >= 8 and 100 * m["longest_repeat"] > 10 * n
        return n >= 50 and 100 * m["n_repeat_words"] <= 50 * n and 100 * m["n_covered_words"] <= 24 * n and not long_

    left = [(i, t) for i, t in rows if good(t)]
    assert {50, 51, 52} & {i for i, _ in left} == {50}
    left = [r for r, (i, _, c) in zip(left, jaccard_components(left), strict=True) if i == c]
    gone = {i: (removed, kept) for i, _, removed, _, kept in repeated_bytes(left, 200)}
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(len(names)), strict=True):
        out = stage(spark, seen, str(tmp_path))
        if k < 4:
            assert out.columns == seen.columns
            out.write.parquet(f"{tmp_path}/{k}.parquet")
            out = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen = out
        if k == 1:
            assert {r["doc_id"] for r in seen.collect()} == {i for i, _ in left}
        if k == 2:
            assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in seen.collect()} == {i: kept for i, (_, kept) in gone.items()}
        if k == 3:
            clean = {r["doc_id"]: r for r in seen.collect()}
            assert not any(secrets(r["text"]) for r in clean.values()) and any("[secret]" in r["text"] for r in clean.values())
            assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    texts = [(i, r["text"]) for i, r in clean.items()]
    n = check_packing(seen.collect(), texts)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(again) == seen.count() and check_packing(again, texts) == n
