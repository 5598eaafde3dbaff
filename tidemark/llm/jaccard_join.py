"""Exact Jaccard self-join of word n-gram sets, by a partitioned universe and the pigeonhole principle.

A text's set holds the hashes of its different `WORDS`-word shingles. Two texts link when
100 |A n B| >= PERCENT |A u B|, which leaves at most H = (1 - t) / (1 + t) (|A| + |B|) elements that only
one of them has. Sets are banded by size (powers of two). Each band deals the universe of elements to
segments by hash; a set's elements in a segment are one *value* of the set. Of any H + 1 segments of two
linked sets at least one has the same value, so:

* A set counts in its own band, and in the next one where a linked larger set could lie there.
* A segment may be allotted 1 (same value wanted) or 2 (at most one element apart, found through the
  one-deletion neighbourhood of the values of every fourth segment). Allotments that sum to H + 1 find
  all links. Values that no other set has cost nothing, so a set with H + 1 of these has no partner: these
  sets, most of a corpus, are dropped after one count, and again while that leaves new such sets.
* Of the sets that are left, each larger one (the prober) allots by cost, the number of sets that a
  value is shared with; the candidates are verified on their whole sets.

Only what connects texts is wanted, so candidates come in rounds: each prober first meets one set, the
hub, for each of its values; sets that are already connected need no further candidates. Values that more
than `DENSE` sets still hold unconnected (large groups of texts that are alike, but not alike enough) tie
their holders to families, whose sets are compared in blocks by matrix products; a block pair returns the
links that connect it, not its pairs. The last round takes every pair of the other values that is not
connected yet.

Bands of small sets have one segment for each element. Empty sets (no words, null text) link with
nothing. Texts with equal sets are one set throughout. Repeated rows are texts with equal sets. A null
doc_id is never the smallest of a component that has others. Columns other than `doc_id` and `text` are
not read; `keep_one` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, hash_spans, lower_ascii, mix, slices, words
from tidemark.scale import cut

WORDS, PERCENT = 5, 75
FINEST = 64  # bands up to this size have a segment for each element
SEGMENTS = 0.72  # segments per smallest size of a band above
NEIGHBOURHOOD = 4  # every how many segments have one-deletion neighbourhoods
HUB_ROUNDS = 2
DENSE = 64  # holders of a value up to which they are paired one by one
BLOCK_SETS, BLOCK_ELEMENTS = 1_024, 1 << 20  # of a block of a family
COLUMNS = 4_096  # elements per matrix product
BROADCAST_SETS = 1_000_000  # more sets than this are joined by shuffle
PORTION = 1 << 20  # bytes of text or elements worked on at once

_EACH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, end to end, and where each text's begin."""
    raw, at = flat(column)
    rows = len(at) - 1
    raw = lower_ascii(raw)
    start, end, row = words(raw, at)
    word = hash_spans(raw, start, end)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    # each place takes the words up to the end of its shingle; a short text is one shingle
    length = np.minimum(count, size)[row]
    place = np.arange(len(word))
    begins = place + length <= first[1:][row]
    begins &= (count[row] >= size) | (place == first[:-1][row])
    begin = np.flatnonzero(begins)
    hashes = length[begin].astype(np.uint64)
    for k in range(size):
        more = k < length[begin]
        hashes[more] = mix(hashes[more] * _EACH[0] + word[begin[more] + k])
    row = row[begin]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def set_hashes(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    size = np.diff(at).astype(np.uint64)
    return tuple(mix(_sums(mix(elements ^ salt), at) + size * _EACH[0]) for salt in _EACH[1:])


def apart(size: np.ndarray, percent: int) -> np.ndarray:
    """Most elements that only one of two linked sets has, for a prober and its smaller partner."""
    return (2 * size * (100 - percent)) // (100 + percent)


def apart_any(size: np.ndarray, percent: int) -> np.ndarray:
    """The same for a set and any partner, up to 100 / percent as large."""
    return ((size + size * 100 // percent) * (100 - percent)) // (100 + percent)


class Entries:
    """Values of sets in their own band (side 0) and the next one (side 1).

    set: place of the set; side; segment: unique in the set and side; key; elements: number in the value;
    place: of the first element in `order`, so that deletions can be formed.
    """

    def __init__(self, elements: np.ndarray, at: np.ndarray, percent: int):
        size = np.diff(at)
        own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        next_ = np.flatnonzero((size > 0) & (100 * size >= percent * (1 << (own + 1))))
        use = np.concatenate((np.flatnonzero(size > 0), next_))
        side = np.concatenate((np.zeros(len(use) - len(next_), np.int64), np.ones(len(next_), np.int64)))
        band = own[use] + side
        number = np.where(1 << band <= FINEST, 0, np.ceil(SEGMENTS * (1 << band)).astype(np.int64))
        number = np.where(number > 0, np.maximum(number, apart((2 << band) - 1, percent) + 1), 0)
        n = size[use]
        member = np.repeat(np.arange(len(use)), n)
        local = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        element = elements[np.repeat(at[:-1][use], n) + local]
        spread = mix(element)
        parts = number[member]
        segment = np.where(parts > 0, (spread >> np.uint64(33)).astype(np.int64) % np.maximum(parts, 1), local)
        order = np.lexsort((segment, member))
        member, segment, spread = member[order], segment[order], spread[order]
        edge = np.concatenate(([True], (member[1:] != member[:-1]) | (segment[1:] != segment[:-1]))) if len(member) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        bounds = np.append(first, len(member))
        self.spread, self.first = spread, first
        self.total = _sums(spread, bounds)
        self.elements = np.diff(bounds)
        which = member[first]
        self.set, self.side, self.segment = use[which], side[which], segment[first]
        # a segment of a band is named by the band and its number; the finest are named by their element
        self.name = mix(band[which].astype(np.uint64) * _EACH[1] + np.where(number[which] > 0, segment[first], -1).astype(np.uint64))
        self.key = mix(self.name + self.total * _EACH[0])
        self.deep = (number[which] > 0) & (segment[first] % NEIGHBOURHOOD == 0) & (self.elements > 1)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(entry, key) of each value of a deep segment with one element less."""
        deep = np.flatnonzero(self.deep)
        n = self.elements[deep]
        entry = np.repeat(deep, n)
        place = np.repeat(self.first[deep], n) + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        return entry, mix(self.name[entry] + (self.total[entry] - self.spread[place]) * _EACH[0])


# First count: which sets may have a partner at all ---------------------------------------------------

_BLOBS = "bucket int, keys binary, refs binary, reports binary"
_REPORT = np.dtype([("ref", "<i8"), ("shared", "<i4"), ("need", "<i4")])


def _blobs(elements: np.ndarray, at: np.ndarray, sets: np.ndarray, percent: int, buckets: int) -> Iterator[tuple]:
    """Values of a portion of sets by bucket of their keys; `sets` are 64-bit names of the sets.

    A value that several sets of the portion have is sent once, without its sets: that it is shared is
    known, and their reports count it. So a value sends one row per portion, however many sets have it.
    """
    e = Entries(elements, at, percent)
    ref = (sets[e.set] & ~np.uint64(1)) | e.side.astype(np.uint64)
    order = np.lexsort((ref, e.key))
    key, ref, of, side = e.key[order], ref[order], e.set[order], e.side[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]))) if len(key) else np.zeros(0, bool)
    key, ref, of, side = key[new], ref[new], of[new], side[new]
    equal = key[1:] == key[:-1]
    local = np.concatenate(([False], equal)) | np.concatenate((equal, [False])) if len(key) else np.zeros(0, bool)
    head = np.concatenate(([True], ~equal)) if len(key) else np.zeros(0, bool)
    size = np.diff(at)
    slot = 2 * of + side
    values = np.bincount(slot, minlength=2 * len(size))
    shared = np.bincount(slot[local], minlength=2 * len(size))
    have = np.flatnonzero(values)
    report = np.zeros(len(have), _REPORT)
    report["ref"] = ((sets[have // 2] & ~np.uint64(1)) | (have % 2).astype(np.uint64)).view(np.int64)
    report["shared"] = shared[have]
    report["need"] = values[have] - apart_any(size[have // 2], percent)
    key, ref, local = key[head], np.where(local, 0, ref)[head].astype(np.uint64), local[head]
    bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    key, ref = key[by], ref[by]
    ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
    reports = np.array_split(report, buckets) if len(report) > buckets else [report[k : k + 1] for k in range(len(report))]
    turn = int(key[0] % np.uint64(buckets)) if len(key) else 0  # portions start their reports at different buckets
    told = {(turn + k) % buckets: r.tobytes() for k, r in enumerate(reports)}
    for b in range(buckets):
        piece = slice(ends[b], ends[b + 1])
        if ends[b] < ends[b + 1] or told.get(b):
            yield b, key[piece].tobytes(), ref[piece].tobytes(), told.get(b, b"")


def _count_shared(batch_table: pa.Table) -> pa.Table:
    """Reports of one bucket, with what its values add: a set's values that other sets have too."""
    key = np.frombuffer(b"".join(batch_table["keys"].to_pylist()), "<u8")
    ref = np.frombuffer(b"".join(batch_table["refs"].to_pylist()), "<u8")
    told = np.frombuffer(b"".join(batch_table["reports"].to_pylist()), _REPORT)
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]))) if len(key) else np.zeros(0, bool)
    sure = ref == 0  # shared within a portion
    edge = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    group = np.cumsum(edge) - 1
    many = (np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > 1) | (np.bincount(group[sure], minlength=group[-1] + 1 if len(group) else 0) > 0)
    found, count = np.unique(ref[new & ~sure & many[group]] if len(group) else ref, return_counts=True)
    return pa.table(
        {
            "ref": pa.array(np.concatenate((told["ref"], found.view(np.int64)))),
            "shared": pa.array(np.concatenate((told["shared"], count)).astype(np.int64)),
            "need": pa.array(np.concatenate((told["need"], np.full(len(found), -(1 << 30)))).astype(np.int64)),
        }
    )


def _alive(blobs: DataFrame) -> DataFrame:
    """Names of the sets (last bit 0) that may have a partner in one of their bands."""
    counted = blobs.groupBy("bucket").applyInArrow(_count_shared, "ref long, shared long, need long")
    kept = counted.groupBy("ref").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter("shared >= need")
    return kept.select(F.col("ref").bitwiseAND(F.lit(-2)).alias("name")).distinct()


_KIND = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("reports", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _text_blobs(docs: DataFrame, size: int, percent: int) -> DataFrame:
    buckets = _buckets(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 * PORTION):
            elements, at = shingle_sets(batch.column(0), size)
            yield _rows(list(_blobs(elements, at, set_hashes(elements, at)[0], percent, buckets)), _KIND)

    return docs.select("text").mapInArrow(work, _BLOBS)


def _set_blobs(sets: DataFrame, percent: int) -> DataFrame:
    buckets = _buckets(sets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 2 * PORTION):
            elements, at = _elements(batch.column(1))
            yield _rows(list(_blobs(elements, at, batch.column(0).to_numpy().astype(np.int64).view(np.uint64), percent, buckets)), _KIND)

    return sets.select("name", "elements").mapInArrow(work, _BLOBS)


def _elements(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(np.uint64), at - at[0]


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same sets in batches of about `most` bytes of elements (the second column)."""
    for batch in batches:
        at, first = batch.column(1).offsets.to_numpy().astype(np.int64), 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most // 8, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


_DESCRIBED = "doc_id long, th long, name long, h1 long, h2 long, n long, elements array<long>"


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, a hash of the text, and the hashes, size and elements of its set. `name` is h1 with
    the last bit 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PORTION):
            elements, at = shingle_sets(batch.column(2), size)
            h1, h2 = set_hashes(elements, at)
            raw = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((h1 & ~np.uint64(1)).view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(at)), raw],
                [c.split()[0] for c in _DESCRIBED.split(", ")],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) th", "text").mapInArrow(work, _DESCRIBED)


def _only(df: DataFrame, names: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the named sets; the names are broadcast after a count only."""
    few = names.count() <= BROADCAST_SETS
    return df.join(F.broadcast(names) if few else names, "name", how)


# Candidates ------------------------------------------------------------------------------------------

HEAD, OWN, NEXT, LESS, LESS_NEXT = 9, 0, 1, 2, 3  # kinds of rows: a set, a value of a band, a deletion
_VALUES = "u long, kind int, segment long, key long, n long, extra long"


def _values(sets: DataFrame, percent: int) -> DataFrame:
    """Values and deletions of the sets as rows, and a head for each set (n: size, segment: number of its
    own values, extra: how many of these have deletions)."""
    names = [c.split()[0] for c in _VALUES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, PORTION):
            elements, at = _elements(batch.column(1))
            u, size = batch.column(0).to_numpy(), np.diff(at)
            e = Entries(elements, at, percent)
            entry, less = e.deletions()
            own = e.side == 0
            values = np.bincount(e.set[own], minlength=len(u))
            deep = np.bincount(e.set[own & e.deep], minlength=len(u))
            columns = [
                np.concatenate((u, u[e.set], u[e.set[entry]])),
                np.concatenate((np.full(len(u), HEAD), e.side, LESS + e.side[entry])),
                np.concatenate((values, e.segment, e.segment[entry])),
                np.concatenate((np.zeros(len(u), np.int64), e.key.view(np.int64), less.view(np.int64))),
                np.concatenate((size, np.zeros(len(e.key) + len(less), np.int64))),
                np.concatenate((deep, e.deep.astype(np.int64), np.zeros(len(less), np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if k == 1 else np.int64)) for k, c in enumerate(columns)], names)

    return sets.select("u", "elements").mapInArrow(work, _VALUES)


def _allot(percent: int):
    """Choose probes for each set from its head and its shared values, the cheapest first."""

    def one(rows: list[tuple]) -> list[tuple]:
        head = [r for r in rows if r[1] == HEAD]
        if not head:
            return []
        _, _, own_values, _, n, deep = head[0][:6]
        need = int(apart(np.int64(n), percent)) + 1
        value, less = {}, {}
        for _, kind, segment, key, _, extra, same, fewer in rows:
            if kind == OWN:
                value[segment] = key, same - 1, fewer, extra
            elif kind == LESS:
                less.setdefault(segment, []).append((key, same))
        shared = {s for s, v in value.items() if v[1] > 0}
        touched = {s for s, v in value.items() if v[3] and (v[1] > 0 or v[2] > 0)} | set(less)
        # free: values of this set alone, and those of them whose neighbourhood is this set's alone too
        left = need - (own_values - len(shared)) - (deep - len(touched))
        if left <= 0:
            return []
        options = [(value[s][1], s, 0) for s in shared]
        for s in touched:
            key, same, fewer, _ = value.get(s, (None, 0, 0, 1))
            options.append((max(same, fewer + sum(c for _, c in less.get(s, ()))), s, 1))
        options.sort(key=lambda o: (o[0], o[2], o[1]))
        if len(options) < left:
            raise ValueError(f"a set of {n} elements has too few values in its band")
        out = set()
        for _, s, more in options[:left]:
            if s in value:
                out.add((value[s][0], 0))
            if more:
                if s in value:
                    out.add((value[s][0], 1))
                out.update((key, 0) for key, _ in less.get(s, ()))
        return [(rows[0][0], key, wants) for key, wants in out]

    schema = pa.schema([("u", pa.int64()), ("key", pa.int64()), ("wants", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += one(group)
                    group = []
                group.append(row)
            if out:
                yield _rows(out, schema)
        if group and (out := one(group)):
            yield _rows(out, schema)

    return work


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, x and whether they link, by their whole sets."""
    elements = sets.select("u", "elements")
    joined = pairs.join(elements.withColumnRenamed("elements", "a"), "u").join(elements.select(F.col("u").alias("x"), F.col("elements").alias("b")), "x")
    common = F.size(F.array_intersect("a", "b"))
    counted = joined.select("u", "x", common.alias("common"), (F.size("a") + F.size("b")).alias("both"))
    return counted.select("u", "x", (100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).alias("linked"))


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """`labels` (u, label) after joining what `links` (u, x) connects; a label is a u of its component.

    Every round each label takes the least label that a link leads to and then that label's own label,
    so that chains get shorter by half; it stops when nothing changes. The tables hold sets that have
    candidates, not documents.
    """
    while True:
        a, b = labels.select("u", F.col("label").alias("a")), labels.select(F.col("u").alias("x"), F.col("label").alias("b"))
        edges = links.join(a, "u").join(b, "x").filter("a != b").select(F.greatest("a", "b").alias("label"), F.least("a", "b").alias("less"))
        moves = cut(edges.groupBy("label").agg(F.min("less").alias("less")), "moves")
        if moves.isEmpty():
            return labels
        # a move's goal may move too: follow it once more
        onward = moves.select(F.col("label").alias("less"), F.col("less").alias("further"))
        moves = moves.join(onward, "less", "left").select("label", F.coalesce("further", "less").alias("less"))
        labels = cut(labels.join(moves, "label", "left").select("u", F.coalesce("less", "label").alias("label")), "labels")


def _connect(sets: DataFrame, percent: int) -> DataFrame:
    """u and label of the sets that have candidates; equal labels are connected by links."""
    values = _values(sets, percent)
    entries = values.filter(F.col("kind") != HEAD)
    is_value = F.col("kind") <= NEXT
    counts = (
        entries.groupBy("key")
        .agg(F.sum(is_value.cast("long")).alias("same"), F.sum((~is_value).cast("long")).alias("fewer"))
        .filter("same > 0 and same + fewer > 1")
    )
    own = entries.filter(F.col("kind").isin(OWN, LESS))
    priced = own.join(counts.hint("shuffle_merge"), "key").filter((F.col("kind") == OWN) | (F.col("same") > 0))
    zero = F.lit(0).cast("long")
    columns = ["u", "kind", "segment", "key", "n", "extra", "same", "fewer"]
    asked = priced.select(*columns).unionByName(values.filter(F.col("kind") == HEAD).withColumns({"same": zero, "fewer": zero}).select(*columns))
    probes = cut(asked.repartition("u").sortWithinPartitions("u").mapInArrow(_allot(percent), "u long, key long, wants int"), "probes")
    # all holders of the probed values
    held = entries.select("key", F.when(is_value, 0).otherwise(1).alias("wants"), F.col("u").alias("x"))
    holders = cut(held.join(probes.select("key", "wants").distinct().hint("shuffle_merge"), ["key", "wants"], "left_semi"), "holders")
    labels = cut(probes.select("u").union(holders.select("x")).distinct().withColumn("label", F.col("u")), "labels")
    tried = None
    for turn in range(HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS
        if last:
            families, links = _families(probes, holders, labels, sets, percent)
            labels = components(cut(links, "links"), labels)
        mine = labels.select("u", F.col("label").alias("a"))
        theirs = labels.select(F.col("u").alias("x"), F.col("label").alias("b"))
        probing = probes.join(mine, "u")
        open_values = _unconnected(probes, holders, labels)
        if last:  # the dense values were compared in blocks
            open_values = open_values.filter("not dense")
        holding = holders.join(theirs, "x").join(open_values, ["key", "wants"], "left_semi")
        if not last:
            # a hub for each value; every round another one
            order = F.col("x") if turn == 0 else F.xxhash64("b", F.lit(turn))
            holding = holding.groupBy("key", "wants").agg(F.min_by(F.struct("x", "b"), order).alias("hub")).select("key", "wants", "hub.x", "hub.b")
        met = probing.join(holding.hint("shuffle_merge"), ["key", "wants"]).filter("a != b").select(F.least("u", "x").alias("u"), F.greatest("u", "x").alias("x")).distinct()
        if tried is not None:
            met = met.join(tried, ["u", "x"], "left_anti")
        if last:
            of = families.select("u", F.col("label").alias("f")), families.select(F.col("u").alias("x"), F.col("label").alias("g"))
            met = met.join(of[0], "u", "left").join(of[1], "x", "left").filter("f is null or g is null or f != g").select("u", "x")
        verified = cut(_verify(cut(met, "pairs"), sets, percent), "verified")
        if not verified.isEmpty():
            labels = components(verified.filter("linked").select("u", "x"), labels)
            tried = verified.select("u", "x") if tried is None else tried.unionByName(verified.select("u", "x"))
    return labels


def _unconnected(probes: DataFrame, holders: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, wants, dense): values whose holders and probers have several labels; dense: more than `DENSE` of them."""
    all_ = holders.withColumnRenamed("x", "u").unionByName(probes).join(labels, "u")
    counted = all_.groupBy("key", "wants").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    return counted.filter("lo != hi").select("key", "wants", (F.col("n") > DENSE).alias("dense"))


def _families(probes: DataFrame, holders: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(u, label) of the sets that dense values tie together, and links that connect what is linked in a family."""
    dense = _unconnected(probes, holders, labels).filter("dense").select("key", "wants")
    tied = cut(holders.withColumnRenamed("x", "u").unionByName(probes).join(dense, ["key", "wants"], "left_semi"), "dense")
    hubs = tied.groupBy("key", "wants").agg(F.min("u").alias("x"))
    ties = tied.join(hubs.hint("shuffle_merge"), ["key", "wants"]).select("u", "x").distinct()
    families = components(cut(ties, "ties"), cut(tied.select("u").distinct().withColumn("label", F.col("u")), "families"))
    member = families.join(sets.select("u", F.size("elements").alias("n")), "u")
    wide = member.groupBy("label").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    placed = families.join(wide, "label").withColumn("block", block)
    # a set goes to the pairs of blocks that its own is one of: one row for each block of its family
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("u", "label", "block", other).select(
        "u", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    pairs = spread.join(sets.select("u", "elements"), "u").select("label", "i", "j", "block", "u", "elements")
    return families, pairs.groupBy("label", "i", "j").applyInArrow(_compare_blocks(percent), "u long, x long")


def _compare_blocks(percent: int):
    """Links that connect the sets of two blocks, at most one for each set, from all their pairs."""

    def part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = table["elements"].combine_chunks()
        elements, at = _elements(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        return table["u"].to_numpy(), elements, np.diff(at)

    def dense(elements: np.ndarray, row: np.ndarray, rows: int, known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
        here = known[at] == elements
        out = np.zeros((rows, len(known)), np.float32)
        out[row[here], at[here]] = 1
        return out

    def work(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        left, right = part(table.filter(pa.array(block == i))), part(table.filter(pa.array(block == j)))
        (a, ea, na), (b, eb, nb) = left, right
        both = np.intersect1d(ea, eb)
        row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        common = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, len(both), COLUMNS):
            known = both[k : k + COLUMNS]
            common += dense(ea, row_a, len(a), known) @ dense(eb, row_b, len(b), known).T
        linked = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
        name = np.concatenate((a, b))
        root = np.unique(name, return_inverse=True)[1]  # in a block with itself a set is there twice
        edges: list[tuple[int, int]] = []
        for r in range(len(a)):
            near = np.flatnonzero(linked[r])
            found, first = np.unique(root[len(a) + near], return_index=True)
            new = found != root[r]
            if new.any():
                edges += [(int(a[r]), int(b[near[f]])) for f in first[new]]
                root[np.isin(root, found)] = root[r]
        u, x = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "x": pa.array(x, pa.int64())})

    return work


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, th, n and component of each row."""
    names = cut(_alive(_text_blobs(docs, size, percent)).withColumn("alive", F.lit(True)), "names")
    described = _only(_describe(docs, size), names, "left")
    described = cut(described.withColumn("elements", F.when(F.col("alive"), F.col("elements"))).drop("alive"), "described")
    members = described.select("doc_id", "th", "h1", "h2", "n")
    first = described.filter("elements is not null").groupBy("h1", "h2").agg(F.first("name").alias("name"), F.first("elements").alias("elements"))
    sets = cut(first.withColumn("u", F.monotonically_increasing_id()), "sets")
    # sets whose partners were dropped have values of their own now
    before = sets.count()
    while before:
        sets = cut(_only(sets, cut(_alive(_set_blobs(sets, percent)), "names")), "sets")
        after = sets.count()
        if after > 0.9 * before:
            break
        before = after
    labels = _connect(sets, percent)
    return _with_components(members, labels.join(sets.select("u", "h1", "h2"), "u").select("h1", "h2", "label"))


def _with_components(members: DataFrame, labelled: DataFrame) -> DataFrame:
    least = members.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    classes = least.join(labelled, ["h1", "h2"], "left")
    together = classes.filter("label is not null").groupBy("label").agg(F.min("least").alias("together"))
    classes = classes.join(together, "label", "left").select("h1", "h2", F.coalesce("together", "least").alias("component"))
    out = members.join(classes, ["h1", "h2"], "left")
    return out.select("doc_id", "th", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component"))


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    return _joined(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest doc_id (then the least hash of the text); rows
    without words stay. Components whose ids are all null are one for each set."""
    found = cut(_joined(docs, size, percent), "components")
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = found.filter("n > 0 and component is not null").groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("id"), F.col("best.th").alias("th"))
    nameless = found.filter("n > 0 and component is null").select(id_.alias("id"), "th").distinct()
    chosen = best.unionByName(nameless).withColumn("one", F.lit(True))
    empty = found.filter("n = 0").select(id_.alias("id"), "th").distinct().withColumn("one", F.lit(False))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    kept = keyed.join(chosen.unionByName(empty), ["id", "th"])
    # equal rows of one document are told apart for those without words only
    turn = F.when(F.col("one"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    once = kept.withColumn("turn", turn).groupBy("id", "th", "turn").agg(F.first("row").alias("row"))
    return once.select("row.*")


def oracle_sql(size: int = WORDS, percent: int = PERCENT) -> str:
    """The result of `join` over `documents` as SQL, by counting the shingles that texts share."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingle AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {size}
        THEN list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM doc),
    size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
    common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.r <> b.r GROUP BY ALL),
    link AS (SELECT a, b FROM common JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    reach AS (SELECT r AS a, r AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
    SELECT doc.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other.doc_id) AS component_id
    FROM doc LEFT JOIN size USING (r) JOIN reach ON reach.a = doc.r JOIN doc other ON other.r = reach.b GROUP BY doc.r, doc.doc_id"""
