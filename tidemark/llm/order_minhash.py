"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so that repeats count. For each of `M`
random orders of these numbered k-mers the `L` smallest are selected, put back into text order and
hashed as a tuple; the low 16 bits of the `M` tuple hashes are the fingerprint. Two texts agree on a
tuple when they share the selected k-mers in the same order, so the share of equal tuples falls with
both missing and moved text.

Nulls are empty texts; all empty texts have one fingerprint. A text shorter than `K` is one k-mer.
Equal texts have equal fingerprints. Repeated rows and ties of doc_id are ordered by text; a null
doc_id comes last. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.arrays import mix, slices
from tidemark.scale import cut

K, L, M = 8, 2, 64
BLOCK = 1 << 18  # cells of the orders x k-mers matrix worked on at once

_seeds = np.random.default_rng(20).integers(0, 1 << 63, size=(2, M), dtype=np.int64).astype(np.uint64)
_FLIP, _FACTOR = (_seeds[0] >> np.uint64(31)).astype(np.uint32), (_seeds[1] >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hash of every K code points; of all of them for a shorter text."""
    h = points.astype(np.uint64) + np.uint64(1)
    if len(h) < K:
        short = np.zeros(K, np.uint64)
        short[: len(h)] = h
        h = short
    width = 1
    for step in _STEPS:  # 1, 2, 4, 8 code points
        h = h[:-width] * step + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def numbered(h: np.ndarray) -> np.ndarray:
    """Hash of (k-mer, how many equal ones came before it)."""
    order = np.argsort(h)
    values = h[order]
    same = values[1:] == values[:-1]
    if not same.any():
        return mix(h)
    tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    value, place = values[tied], order[tied]
    place = place[np.lexsort((place, value))]
    first = np.concatenate(([True], value[1:] != value[:-1]))
    at = np.arange(len(value))
    out = h.copy()
    out[place] += (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


_cells = np.empty(BLOCK, np.uint32)


def fingerprint(points: np.ndarray) -> np.ndarray:
    """M 16-bit tuple hashes of a text's code points."""
    if not len(points):
        return np.zeros(M, np.uint16)
    kmers = kmer_hashes(points)
    keys = (numbered(kmers) >> np.uint64(32)).astype(np.uint32)
    n = len(keys)
    picks = np.empty((M, min(L, n)), np.int64)
    step = max(1, BLOCK // n)
    for first in range(0, M, step):
        rows = slice(first, min(M, first + step))
        count = rows.stop - first
        order = _cells[: count * n].reshape(count, n) if n <= BLOCK else np.empty((count, n), np.uint32)
        np.bitwise_xor(keys[None, :], _FLIP[rows, None], out=order)
        np.multiply(order, _FACTOR[rows, None], out=order)
        row = np.arange(count)
        for j in range(picks.shape[1]):
            at = order.argmin(axis=1)
            picks[rows, j] = at
            order[row, at] = np.uint32(0xFFFFFFFF)
    picks.sort(axis=1)
    out = np.zeros(M, np.uint64)
    for j in range(picks.shape[1]):
        out = mix(out * _STEPS[0] + kmers[picks[:, j]])
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples."""
    return float(np.count_nonzero(a == b)) / M


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint (hexadecimal) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            points = [code_points(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in points], pa.int64()), pa.array([fingerprint(p).astype(">u2").tobytes().hex() for p in points], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, n_chars long, fingerprint string")


EDITED = "part int, role int, doc_id long, n_chars long, edited binary, own binary, changed binary, near_edited double, near_next double, text string"
_NAMES = [c.split()[0] for c in EDITED.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
DONE, OPEN, FIRST = 0, 1, 2


def _compared(text: str, own: np.ndarray, following: str, following_print: np.ndarray) -> tuple:
    """n_chars .. near_next of a text and the text that follows it."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = fingerprint(code_points(edited))
    return (
        len(text),
        hashlib.sha256(edited.encode()).digest(),
        own.tobytes(),
        changed.tobytes(),
        likeness(own, changed),
        likeness(own, following_print),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and the text whose second half is replaced by the start of the next one in
    descending order of doc_id (after the last: the first).

    Texts are moved once, to ranges of doc_id. A task walks through its range; only the first and the
    last text of each range are passed on, to meet their neighbours from other ranges.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                own = fingerprint(code_points(text))
                if before is None:
                    rows.append((part, FIRST, doc_id, None, None, own.tobytes(), None, None, None, text))
                else:
                    rows.append((part, DONE, before[0], *_compared(before[1], before[2], text, own), None))
                before = (doc_id, text, own)
            if rows:
                yield _batch(rows)
        if before is not None:
            yield _batch([(part, OPEN, before[0], None, None, before[2].tobytes(), None, None, None, before[1])])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (0, DONE, r["doc_id"], *_compared(r["text"], np.frombuffer(r["own"], np.uint16), r["next_text"], np.frombuffer(r["next_own"], np.uint16)), None)
                for r in batch.to_pylist()
            ]
            if rows:
                yield _batch(rows)

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    walked = cut(ranged.mapInArrow(walk, EDITED), "fingerprints")
    # two rows for each range of doc_id: numbers of ranges meet in one task, texts do not
    parts = walked.filter(F.col("role") == FIRST).select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    first = walked.filter(F.col("role") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    ends = walked.filter(F.col("role") == OPEN).join(following, "part").join(first, "next_part").select("doc_id", "text", "own", "next_text", "next_own")
    return (
        walked.filter(F.col("role") == DONE)
        .unionByName(ends.mapInArrow(close, EDITED))
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("edited")).alias("edited_sha256"),
            F.lower(F.hex("own")).alias("fingerprint"),
            F.lower(F.hex("changed")).alias("edited_fingerprint"),
            "near_edited",
            "near_next",
        )
    )
