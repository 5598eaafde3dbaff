"""Removal of byte strings that occur more than once in a corpus, by hash-compared suffix sorting.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else, in the same text or
another; matches end with their text. All strings are judged on the input.

1. Every window of LENGTH bytes belongs to an anchor: the first of its GRAM-byte grams with the least
   hash. Equal windows have equal anchors at the same place, so windows only need comparing where their
   anchors' grams are equal. Windows of one anchor are neighbours; together they are its context.
2. Anchors whose gram occurs once are dropped by a count and a join. Contexts that occur twice or more
   are repeated as a whole. What is left are grams with several different contexts.
3. The windows of such a gram's contexts are sorted as suffixes: a merge sort in which two suffixes are
   compared by the length of their common extension, found by binary search on prefix polynomial hashes.
   Neighbours with LENGTH common bytes are repeated, after their bytes have been compared as well.
4. A gram with more than `LIMIT` different contexts (the edge of a passage that very many texts share) is
   split by the text around it instead. Each context is cut into pieces of `CLASS` windows, at fixed
   distances from the anchor. Windows can only be equal within pieces whose common bytes are equal; pieces
   that are equal altogether are repeated as a whole; only what is left, a piece or two at the edge of a
   passage, is counted window by window. All of this is distributed counting by hash.

Texts are moved between tasks once, by document, and that exchange serves the fetching of contexts and
the final cut. Text columns other than `text` are carried along untouched.

Nulls are empty texts. Texts under LENGTH bytes lose nothing. Repeated rows are separate texts and so
remove each other; rows that share a doc_id but not the text are told apart by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, mix, prefix_hashes, runs, slices, span_hashes
from tidemark.scale import cut

LENGTH = 200
GRAM = 64
CLASS = 16  # windows in a piece of a context of a very common gram
LIMIT = 256  # different contexts of a gram that are sorted in one task
CHUNK = 1 << 18  # windows sorted at once
PORTION = 1 << 20  # bytes of text worked on at once; a longer text is worked on alone

NO_ID = -(1 << 63)  # stands for a null doc_id inside the joins


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbouring values."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: (row, gram hash, context hash, first window, last window, place)."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hashes(raw)
    places = np.arange(len(raw) - gram + 1)
    grams = mix(span_hashes(prefix, places, places + gram))
    high = grams & np.uint64(0xFFFFFFFF00000000)
    least = _window_least(high | places.astype(np.uint64), length - gram + 1)  # ties: the first place
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie inside one text, as runs of the same anchor in the same text
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    inside = np.arange(len(place)) + length <= at[1:][row]
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place, row = place[window], row[window]
    edge = np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(window)) - 1
    place, row = place[first], row[first]
    low, top = window[first], window[last]
    shape = (place - low).astype(np.uint64) << np.uint64(32) | (top - low).astype(np.uint64)
    context = mix(span_hashes(prefix, low, top + length) + mix(shape))
    return row, grams[place], context, low - at[row], top - at[row], place - at[row]


def _find(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PORTION):
            raw, at = flat(batch.column(2))
            row, grams, context, low, top, place = anchors(raw, at, length, gram)
            spot = low << 16 | (top - low) << 8 | (place - low)
            picked = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(picked), batch.column(1).take(picked), pa.array(spot)],
                ["g", "c", "id", "th", "spot"],
            )

    return work


class Suffixes:
    """Suffixes of texts laid end to end, compared over their first `length` bytes by prefix hashes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length, self.prefix = raw, length, prefix_hashes(raw)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, at most `length`."""
        low = np.zeros(len(x), np.int64)
        high = np.full(len(x), self.length)
        open_ = np.arange(len(x))
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            a, b = x[open_], y[open_]
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; for equal ones `or_equal`."""
        n = self.common(x, y)
        more = n < self.length
        out = or_equal.copy()
        out[more] = self.raw[x[more] + n[more]] < self.raw[y[more] + n[more]]
        return out

    def merge_sort(self, suffixes: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Sort the suffixes within each segment (equal neighbours in `segment`)."""
        bounds = runs(segment)
        sizes = np.diff(bounds)
        first = np.repeat(bounds[:-1], sizes)
        size = np.repeat(sizes, sizes)
        place = np.arange(len(suffixes)) - first
        out, width = suffixes.copy(), 1
        while width < (sizes.max() if len(sizes) else 0):
            run = place // width
            left = run % 2 == 0
            # the run that each suffix's run is merged with
            low = np.where(left, (run + 1) * width, (run - 1) * width)
            high = np.minimum(low + width, size)
            low = np.minimum(low, high)
            start = low.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):  # how many of the other run come first
                mid = (low[open_] + high[open_]) >> 1
                other = out[first[open_] + mid]
                # of equal suffixes the left run's come first
                sooner = self.before(other, out[open_], ~left[open_])
                low[open_] = np.where(sooner, mid + 1, low[open_])
                high[open_] = np.where(sooner, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            ahead = low - start
            base = first + np.where(left, run, run - 1) * width
            merged = np.empty_like(out)
            merged[base + (place - run * width) + ahead] = out
            out, width = merged, 2 * width
        return out

    def equal_neighbours(self, order: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Whether each suffix shares `length` bytes with a neighbour of its segment; bytes are compared."""
        near = np.flatnonzero(segment[1:] == segment[:-1])
        near = near[self.common(order[near], order[near + 1]) >= self.length]
        span = np.arange(self.length)
        sure = np.zeros(len(near), bool)
        for k in range(0, len(near), 4096):
            pair = near[k : k + 4096]
            sure[k : k + 4096] = (self.raw[order[pair][:, None] + span] == self.raw[order[pair + 1][:, None] + span]).all(axis=1)
        out = np.zeros(len(order), bool)
        out[near[sure]] = True
        out[near[sure] + 1] = True
        return out


def repeated_windows(grams: np.ndarray, raw: np.ndarray, at: np.ndarray, windows: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the repeated windows; contexts of one gram are neighbours."""
    context = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    back = place[context] - window  # bytes from the window's start to its anchor
    group = np.cumsum(np.concatenate(([0], grams[1:] != grams[:-1])))[context] if len(grams) else context
    by = np.lexsort((back, group))
    segment = group[by] << 8 | back[by]
    suffixes = Suffixes(raw, length)
    start = at[context] + window
    order = suffixes.merge_sort(start[by], segment)
    found = order[suffixes.equal_neighbours(order, segment)]
    hit = np.zeros(len(raw) + 1, bool)
    hit[found] = True  # a byte position is the start of one window at most
    context_at, window_at = context[hit[start]], window[hit[start]]
    return context_at, window_at


CONTEXT = "g long, c long, id long, th int, low long, windows int, place int, n long, bytes binary, classes array<struct<key:bigint,piece:bigint,first:int,hashes:array<bigint>>>"
SPAN = "id long, th int, start long, stop long"


def _classes(prefix: np.ndarray, low: int, windows: int, place: int, length: int, gram: int) -> list[dict]:
    """Pieces of a context: the windows whose starts lie CLASS * c to CLASS * (c + 1) - 1 bytes before the anchor.

    key: hash of the bytes that all windows of a whole piece have; piece: hash of the piece and where it
    lies; first: its first window in the context; hashes of its windows.
    """
    anchor = low + place
    s = np.arange(low, low + windows)
    hashes = mix(span_hashes(prefix, s, s + length)).view(np.int64)
    of = (anchor - s) // CLASS
    bounds = runs(of)
    c, first, last = of[bounds[:-1]], bounds[:-1], bounds[1:] - 1
    name = mix(c.astype(np.uint64) + np.uint64(gram & (1 << 64) - 1))
    key = mix(name + span_hashes(prefix, anchor - CLASS * c, anchor - CLASS * c - (CLASS - 1) + length))
    where = mix((anchor - s[first]).astype(np.uint64) << np.uint64(16) | (last - first).astype(np.uint64))
    piece = mix(where + span_hashes(prefix, s[first], s[last] + length))
    return [
        {"key": k, "piece": p, "first": a, "hashes": hashes[a : b + 1].tolist()}
        for k, p, a, b in zip(key.view(np.int64).tolist(), piece.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)
    ]


def _fetch(length: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts of the wanted anchors: bytes where they are sorted, window hashes where they are counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PORTION):
            rows = []
            for id_, th, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = (text or "").encode()
                raw = np.frombuffer(data, np.uint8)
                prefix = prefix_hashes(raw) if any(w["contexts"] > limit for w in wanted) else None
                for w in wanted:
                    low, more, place = w["spot"] >> 16, w["spot"] >> 8 & 255, w["spot"] & 255
                    classes = piece = None
                    if w["contexts"] > limit:
                        classes = _classes(prefix, low, more + 1, place, length, w["g"])
                    else:
                        piece = data[low : low + more + length]
                    rows.append((w["g"], w["c"], id_, th, low, more + 1, place, w["n"], piece, classes))
                if len(rows) >= 4096:
                    yield _contexts(rows)
                    rows = []
            if rows:
                yield _contexts(rows)

    return work


_PIECES = pa.list_(pa.struct([("key", pa.int64()), ("piece", pa.int64()), ("first", pa.int32()), ("hashes", pa.list_(pa.int64()))]))
_CONTEXT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), _PIECES]
_CONTEXT_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXT_KINDS, strict=True)], _CONTEXT_NAMES)


def _sort(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of the repeated windows of contexts that come in the order of their grams."""

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        grams, id_, th, low, windows, place, n = (table[c].to_numpy() for c in ("g", "id", "th", "low", "windows", "place", "n"))
        raw, at = flat(table["bytes"])
        context, window = repeated_windows(grams, raw, at[:-1], windows, place, length)
        alone = n[context] == 1  # the others are repeated as a whole, in all their places
        context, window = context[alone], window[alone]
        # runs of neighbouring windows are one span
        edge = np.concatenate(([True], (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1))) if len(context) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(context)) - 1 if len(first) else first
        start = low[context[first]] + window[first]
        stop = low[context[first]] + window[last] + length
        return pa.RecordBatch.from_arrays([pa.array(id_[context[first]]), pa.array(th[context[first]]), pa.array(start), pa.array(stop)], ["id", "th", "start", "stop"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            waiting += int(pa.compute.sum(batch.column("windows")).as_py())
            if waiting < CHUNK:
                continue
            table = pa.Table.from_batches(kept)
            grams = table["g"].to_numpy()
            full = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on
            if full:
                yield done(table.slice(0, full))
            kept = table.slice(full).combine_chunks().to_batches()
            waiting = sum(int(pa.compute.sum(b.column("windows")).as_py()) for b in kept)
        if kept:
            yield done(pa.Table.from_batches(kept))

    return work


def _texts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """id, th, text and the carried columns as one struct, dealt by document."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.hash("text").alias("th"),
        F.col("text"),
        F.struct(*[f"`{c}`" for c in carried]).alias("row"),
    )
    return keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "th")


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """Per text (id, th): `spans`, an array of (start, stop) in bytes that cover all repeated windows."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.hash("text").alias("th"), "text")
    found = keys.mapInArrow(_find(length, gram), "g long, c long, id long, th int, spot long")
    several = found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    shared = cut(found.join(several.hint("shuffle_merge"), "g"), "anchors")
    contexts = cut(shared.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "spot")).alias("at")), "contexts")
    mixed = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    wanted = (
        contexts.join(mixed.hint("shuffle_merge"), "g")
        .groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th"))
        .agg(F.collect_list(F.struct("g", "c", "n", F.col("at.spot").alias("spot"), "contexts")).alias("wanted"))
    )
    fetched = texts.select("id", "th", "text", "row").join(wanted, ["id", "th"], "left").filter("wanted is not null").select("id", "th", "text", "wanted")
    pieces = cut(fetched.mapInArrow(_fetch(length, limit), CONTEXT), "contexts")
    few = (
        pieces.filter("bytes is not null")
        .select("g", "id", "th", "low", "windows", "place", "n", "bytes")
        .repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(_sort(length), SPAN)
    )
    classes = pieces.filter("classes is not null").select("id", "th", "low", "n", F.inline("classes"))
    at = F.struct("id", "th", (F.col("low") + F.col("first")).alias("start"))
    different = classes.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.min(at).alias("at"), F.first("hashes").alias("hashes"))
    # equal pieces, in all their places
    equal = (
        classes.filter("n = 1")
        .join(different.filter("n > 1").select("key", "piece").hint("shuffle_merge"), ["key", "piece"])
        .select("id", "th", (F.col("low") + F.col("first")).alias("start"), (F.col("low") + F.col("first") + F.size("hashes") - 1 + length).alias("stop"))
    )
    # different pieces with the same common bytes, window by window
    open_keys = different.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select("key")
    window = different.join(open_keys.hint("shuffle_merge"), "key").select("at", "n", F.posexplode("hashes").alias("k", "h"))
    again = window.groupBy("h").agg(F.sum("n").alias("all")).filter("all > 1").select("h")
    single = (
        window.filter("n = 1")
        .join(again.hint("shuffle_merge"), "h")
        .select("at.id", "at.th", (F.col("at.start") + F.col("k")).alias("start"), (F.col("at.start") + F.col("k") + length).alias("stop"))
    )
    many = equal.unionByName(single)
    low, more = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(255)
    whole = shared.join(contexts.filter("n > 1").select("g", "c").hint("shuffle_merge"), ["g", "c"]).select(
        "id", "th", low.alias("start"), (low + more + length).alias("stop")
    )
    return (
        whole.unionByName(few)
        .unionByName(many)
        .groupBy("id", "th")
        .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    )


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs of sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["stop"])
        else:
            out.append((s["start"], s["stop"]))
    return out


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    ends = [0, *(stop for _, stop in gone)]
    starts = [*(start for start, _ in gone), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


def _apply(docs: DataFrame, carried: list[str], added: str, values: Callable[[str | None, bytes, list[tuple[int, int]]], tuple], **options) -> DataFrame:
    """Carried columns of `docs` and what `values` makes of each text, its bytes and its removed runs."""
    texts = _texts(docs, carried)
    spans = repeated_spans(docs, texts, **options)
    names = [c.split()[0] for c in added.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in added.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PORTION):
            rows = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(values(text, (text or "").encode(), merged(found)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), *columns], ["row", *(f"_{n}" for n in names)])

    schema = texts.select("row").schema
    for name, kind in zip(names, types, strict=True):
        schema = schema.add(f"_{name}", "long" if kind == pa.int64() else "string")
    joined = texts.select("id", "th", "text", "row").join(spans, ["id", "th"], "left").select("text", "spans", "row")
    return joined.mapInArrow(work, schema)


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def values(text: str | None, data: bytes, gone: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest()

    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = _apply(docs.select("doc_id", "text"), ["doc_id"], added, values, **options)
    return out.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"_{c.split()[0]}").alias(c.split()[0]) for c in added.split(", ")))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the repeated bytes taken out of `text`. A character that loses some of its bytes goes
    whole. A null text stays null."""

    def values(text: str | None, data: bytes, gone: list[tuple[int, int]]) -> tuple:
        return (text if not gone else _kept(data, gone).decode(errors="ignore"),)

    rest = [c for c in docs.columns if c != "text"]
    out = _apply(docs, rest, "text string", values, **options)
    return out.select(*(F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
