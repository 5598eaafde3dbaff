"""Best-fit packing of token sequences, improved by swaps.

A document's tokens are cut only where they exceed the length of a sequence. The pieces are dealt to
shards of about `SHARD` pieces by hash; each shard is packed on its own, so no task sees more than that
and the loss is at most about one sequence in a shard. Within a shard, best-fit decreasing comes first;
then pieces move, or are exchanged one for one or two for one, between sequences that are not full,
always towards the fuller one. Each exchange raises the sum of squared fills, so the search ends, and
the emptiest sequences run empty.

Null texts are empty (one closing token). Repeated rows are packed like any others. An empty table
gives an empty result. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordcodes
from tidemark.llm.arrays import SLICE_BYTES, slices
from tidemark.scale import cut

LENGTH = 2048
SHARD = 8_192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, closing: int = 0, kept: int = wordcodes.KEPT, portion: int = SLICE_BYTES) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids. `kept` bounds the words that a task
    remembers, `portion` the bytes of text that it encodes at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = wordcodes.load(path, False)
        tail = np.array([closing], "<u4").tobytes()
        for batch in slices(batches, most=portion):
            doc_ids = batch.column(0).to_pylist()
            codes = wordcodes.loose([t or "" for t in batch.column(1).to_pylist()], tokenizer, kept)
            rows = []
            for doc_id, ids in zip(doc_ids, codes, strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, PIECES)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of positions in `sizes`: largest first, each to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by the room they have
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _largest(items: list[tuple[int, int]], low: int, high: int) -> tuple[int, int] | None:
    """Largest (size, item) with low < size <= high."""
    k = bisect_right(items, (high, 1 << 62)) - 1
    return items[k] if k >= 0 and items[k][0] > low else None


def improve(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Local search over the bins that are not full; see the module's description."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fill, strict=True) if f == length]
    open_ = [list(b) for b, f in zip(bins, fill, strict=True) if f < length]
    while len(open_) > 1:
        open_.sort(key=lambda b: (sum(sizes[i] for i in b), b), reverse=True)
        target, donors = open_[0], open_[1:]
        room = length - sum(sizes[i] for i in target)
        if sum(sizes[i] for b in open_ for i in b) <= length:  # all that is left fits into one
            full.append([i for b in open_ for i in b])
            open_ = []
            break
        home = {i: b for b in donors for i in b}
        items = sorted((sizes[i], i) for i in home)
        best, step = 0, None
        if found := _largest(items, 0, room):  # move
            best, step = found[0], ((), (found[1],))
        for x in target:
            if best == room:
                break
            if found := _largest(items, sizes[x] + best, sizes[x] + room):  # one for one
                best, step = found[0] - sizes[x], ((x,), (found[1],))
        for b in donors if best < room else ():  # two for one, both ways
            pairs = [(sizes[p] + sizes[q], p, q) for k, p in enumerate(b) for q in b[k + 1 :]]
            for total, p, q in pairs:
                for x in target:
                    if best < total - sizes[x] <= room:
                        best, step = total - sizes[x], ((x,), (p, q))
            if best == room:
                break
        for k, p in enumerate(target if best < room else ()):
            for q in target[k + 1 :]:
                out = sizes[p] + sizes[q]
                if found := _largest(items, out + best, out + room):
                    best, step = found[0] - out, ((p, q), (found[1],))
        if step is None:
            full.append(target)
            open_ = donors
            continue
        gone, come = step
        source = home[come[0]]
        for i in come:
            source.remove(i)
        for i in gone:
            target.remove(i)
        target.extend(come)
        source.extend(gone)
        if best == room:
            full.append(target)
            open_.remove(target)
        open_ = [b for b in open_ if b]
    return full + open_


def pack_sizes(sizes: list[int], length: int) -> list[list[int]]:
    whole = [[i] for i, s in enumerate(sizes) if s == length]
    rest = [i for i, s in enumerate(sizes) if s < length]
    local = [sizes[i] for i in rest]
    found = improve(best_fit(local, length), local, length)
    return whole + [[rest[i] for i in b] for b in found]


def pack(parts: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """`parts` (see `pieces`) + sequence_id and offset, the place in the sequence."""
    parts = cut(parts, "pieces")
    n_shards = max(1, -(-parts.count() // shard))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        sizes = group["length"].tolist()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for k, b in enumerate(pack_sizes(sizes, length)):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = k, at
                at += sizes[i]
        group["sequence_id"] = sequence + int(group.pop("shard").iloc[0]) * (1 << 32)
        group["offset"] = offset
        return group

    # an even hash over unique keys: shards differ by chance only; repeated rows get different shards' room
    return (
        parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_shards)))
        .groupBy("shard")
        .applyInPandas(one, PIECES + ", sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, **limits: int) -> DataFrame:
    """Cut `docs` into pieces and pack them."""
    return pack(pieces(docs, path, length, **limits), length)
