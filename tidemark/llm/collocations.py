"""Phrase collocations, counted over a prefix-free parse.

A text is a sequence of words, broken into pieces by punctuation and line ends. It is parsed into
overlapping chunks: a chunk starts at every place where the hash of the next `WINDOW` words is 0 modulo
`EVERY` (and `LONGEST` words after the last start, so that a monotone text has no endless chunk), and reaches
`WINDOW` words into the next chunk as far as its last piece goes. Where a chunk ends depends on the words
around it alone, so passages that documents share give the same chunks. The dictionary holds each distinct
chunk once with its frequency in the parse. Phrases of up to `WINDOW` + 1 words are counted inside distinct
chunks, weighted; a phrase belongs to the chunk whose own words it starts in, so the overlap counts once.

Longer phrases are counted level by level: a phrase of k words can have `least` occurrences only if both
phrases of k - 1 words inside it do. Tasks know these from a filter of fixed size (`FILTER_BITS`), which
lets some rare phrases through and never stops a frequent one; a full filter costs time, not results.
Phrases are told apart by their text, never by a hash.

Nulls in `text` are empty texts, a null `lang` is `und`. Repeated rows and ties of doc_id count each time.
An empty table, or one without a frequent phrase, gives no rows. Very long texts are cut at piece ends and
worked on in parts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.arrays import flat, hash_spans, lower_ascii, mix, slices
from tidemark.scale import cut

LONGEST_PHRASE = 5
WINDOW = LONGEST_PHRASE - 1  # words that decide a chunk's start, and that chunks share
EVERY = 32  # one place in EVERY starts a chunk
LONGEST = 256  # words of a chunk of its own at most
LEAST = 100  # occurrences of a candidate
SHARE = 100  # percent of a candidate's occurrences inside one longer candidate that drop it
TOP = 2000  # phrases reported per language
FILTER_BITS = 26  # the filter of frequent phrases has 2 ** FILTER_BITS bits
SEGMENT_BITS = 16
PART_BYTES = 4 << 20  # bytes of text worked on at once

_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of a batch of rows: places in `raw`, row, end of the piece (as a word number), and hashes."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    piece_end: np.ndarray
    code: np.ndarray  # equal for equal words of the batch
    n_codes: int
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Spans of `raw` as an Arrow column."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat((start - (ends - length)).astype(np.int32), length) + np.arange(total, dtype=np.int32)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(offsets), pa.py_buffer(raw[places])])


def find_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Words of rows of bytes that lie end to end, row i at at[i] .. at[i + 1]."""
    breaks = _BREAK[raw]
    solid = ~(breaks | _GAP[raw])
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1] | first[1:-1]
    closes[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(at, start, side="right") - 1
    n = len(start)
    last = np.ones(n, bool)  # last of its piece
    if n:
        seen = np.cumsum(breaks, dtype=np.int32)
        last[:-1] = (seen[start[1:]] > seen[end[:-1] - 1]) | (row[1:] != row[:-1])
    ends = np.flatnonzero(last) + 1
    piece_end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    coded = gathered(raw, start, end - start, pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    letters, where = flat(coded.dictionary)
    hashes = hash_spans(letters, where[:-1], where[1:])
    return Words(raw, start, end, row, piece_end, code, len(hashes), hashes[code])


def phrase_hashes(words: Words, begin: np.ndarray, length: int, salt: np.ndarray) -> np.ndarray:
    """Hash of the `length` words from each place of `begin`; `salt` is added to the first."""
    h = mix(words.hash[begin] ^ salt)
    for k in range(1, length):
        h = mix(h * _STEP + words.hash[begin + k])
    return h


def name_hashes(column: pa.Array) -> np.ndarray:
    """Hash of each value of a string column."""
    letters, where = flat(column)
    return hash_spans(letters, where[:-1], where[1:])


# the parse -----------------------------------------------------------------------------------------


def _parts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows cut after piece ends into parts of about PART_BYTES: (offsets of the parts, row of each)."""
    if len(raw) <= PART_BYTES:
        return at, np.arange(len(at) - 1)
    cuts, rows = [0], []
    for row in range(len(at) - 1):
        a, b = int(at[row]), int(at[row + 1])
        while b - a > PART_BYTES:
            found = np.flatnonzero(_BREAK[raw[a + PART_BYTES : b]])
            if not len(found):
                break
            a += PART_BYTES + int(found[0]) + 1
            cuts.append(a)
            rows.append(row)
        cuts.append(b)
        rows.append(row)
    return np.array(cuts), np.array(rows)


def chunks_of(words: Words, every: int = EVERY, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end of the own words, end with the overlap) of each chunk, as word numbers."""
    n = len(words)
    place = np.arange(n)
    begin = np.ones(n, bool)
    begin[1:] = words.row[1:] != words.row[:-1]
    if n > WINDOW:
        window = np.arange(n - WINDOW + 1)
        same = words.row[window] == words.row[window + WINDOW - 1]
        hit = phrase_hashes(words, window, WINDOW, np.uint64(0)) % np.uint64(every) == 0
        begin[window] |= same & hit
    since = place - np.maximum.accumulate(np.where(begin, place, 0))
    first = np.flatnonzero(begin | (since % longest == 0))
    own = np.append(first[1:], n)
    return first, own, np.minimum(own + WINDOW, words.piece_end[own - 1])


def parse(docs: DataFrame, every: int = EVERY, longest: int = LONGEST) -> DataFrame:
    """lang, own (number of own words), chunk, times: the dictionary of the parse.

    A chunk's text has a space between words of a piece and a line feed between pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            letters, at = flat(batch.column(1))
            letters = lower_ascii(letters)
            offsets, row_of = _parts(letters, at)
            for first in _groups(offsets):
                a, b = first
                sub = offsets[a : b + 1]
                words = find_words(letters[sub[0] : sub[-1]], sub - sub[0])
                if not len(words):
                    continue
                begin, own, end = chunks_of(words, every, longest)
                # every word and one mark after it, end to end
                length = words.end - words.start
                to = np.cumsum(length + 1)
                text = np.empty(int(to[-1]), np.uint8)
                text[to - 1] = np.where(words.piece_end == np.arange(1, len(words) + 1), 0x0A, 0x20)
                inside = np.ones(len(text), bool)
                inside[to - 1] = False
                solid = ~(_BREAK[words.raw] | _GAP[words.raw])
                text[inside] = words.raw[solid]
                start = (to - length - 1)[begin]
                column = gathered(text, start, to[end - 1] - 1 - start, pa.string())
                lang = batch.column(0).take(pa.array(row_of[a:b][words.row[begin]]))
                found = pa.table({"lang": lang, "own": pa.array((own - begin).astype(np.int32)), "chunk": column})
                counted = found.group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["lang", "own", "chunk", "times"]).to_batches()

    source = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    chunks = source.mapInArrow(work, "lang string, own int, chunk string, times long")
    return chunks.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring parts of at most about PART_BYTES together."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + PART_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


# counting ------------------------------------------------------------------------------------------


def phrase_counts(dictionary: DataFrame, length: int, known: bytes | None = None) -> DataFrame:
    """lang, phrase, f: occurrences of the phrases of `length` words.

    With `known`, a filter of the frequent phrases of `length` - 1 words, only phrases that consist of
    two of these are counted.
    """
    box = dictionary.sparkSession.sparkContext.broadcast(known)  # at most 2 ** FILTER_BITS bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if box.value is None else np.frombuffer(box.value, np.uint8)
        for batch in slices(batches, "chunk", PART_BYTES):
            words = find_words(*flat(batch.column(2)))
            n = len(words)
            if not n:
                continue
            langs = batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()[words.row].astype(np.int64)
            own = batch.column(1).to_numpy()
            first_of_row = np.searchsorted(words.row, words.row, side="left")
            place = np.arange(n)
            left = words.piece_end - place  # words from here to the end of the piece
            begin = np.flatnonzero((place - first_of_row < own[words.row]) & (left >= length))
            if bits is not None:
                salt = name_hashes(langs.dictionary)[lang]
                shorter = np.flatnonzero(left >= length - 1)
                frequent = np.zeros(n + 1, bool)
                frequent[shorter] = _holds(bits, phrase_hashes(words, shorter, length - 1, salt[shorter]))
                begin = begin[frequent[begin] & frequent[begin + 1]]
            if not len(begin):
                continue
            code = lang[begin] * words.n_codes + words.code[begin]
            for k in range(1, length):
                code = np.unique(code, return_inverse=True)[1] * words.n_codes + words.code[begin + k]
            _, one, group = np.unique(code, return_index=True, return_inverse=True)
            weight = np.zeros(len(one), np.int64)
            np.add.at(weight, group, batch.column(3).to_numpy()[words.row[begin]])
            a, b = words.start[begin[one]], words.end[begin[one] + length - 1]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[begin[one]])), gathered(words.raw, a, b - a, pa.string()), pa.array(weight)],
                ["lang", "phrase", "f"],
            )

    found = dictionary.select("lang", "own", "chunk", "times").mapInArrow(work, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _slots(hashes, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def phrase_filter(phrases: DataFrame, length: int, filter_bits: int = FILTER_BITS) -> bytes:
    """Bits of all `phrases` (lang, phrase), 2 ** filter_bits of them whatever the number of phrases.

    Bits are put together by segment on the executors; the driver gets the segments.
    """
    size = 1 << filter_bits
    width = min(filter_bits, SEGMENT_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase", PART_BYTES):
            words = find_words(*flat(batch.column(1)))
            begin = np.arange(batch.num_rows) * length
            slot = np.unique(_slots(phrase_hashes(words, begin, length, name_hashes(batch.column(0))), size))
            cuts = np.flatnonzero(np.diff(slot >> width)) + 1
            parts = np.split(slot, cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(p[0] >> width) for p in parts], pa.int32()), pa.array([(p & ((1 << width) - 1)).astype("<u2").tobytes() for p in parts], pa.binary())],
                ["segment", "places"],
            )

    def together(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << width, np.uint8)
        for p in group.column("places"):
            bits[np.frombuffer(p.as_buffer(), "<u2")] = 1
        return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    segments = phrases.select("lang", "phrase").mapInArrow(places, "segment int, places binary")
    out = bytearray(size >> 3)
    step = (1 << width) >> 3
    for r in segments.groupBy("segment").applyInArrow(together, "segment int, bits binary").collect():
        out[r["segment"] * step : (r["segment"] + 1) * step] = r["bits"]
    return bytes(out)


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST_PHRASE, filter_bits: int = FILTER_BITS, every: int = EVERY
) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f of all phrases with `least` occurrences; lang, n of all words)."""
    if longest > WINDOW + 1:
        raise ValueError(f"chunks overlap by {WINDOW} words; phrases have at most {WINDOW + 1}")
    dictionary = cut(parse(docs, every), "chunk-dictionary")
    singles = cut(phrase_counts(dictionary, 1), "words")
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    level = singles.filter(F.col("f") >= least)
    levels = [level.withColumn("words", F.lit(1))]
    for k in range(2, longest + 1):
        known = phrase_filter(level, k - 1, filter_bits)
        level = cut(phrase_counts(dictionary, k, known).filter(F.col("f") >= least), f"phrases{k}")
        levels.append(level.withColumn("words", F.lit(k)))
    return reduce(DataFrame.unionByName, levels).select("lang", "words", "phrase", "f"), totals


# scores --------------------------------------------------------------------------------------------


def scored(frequent: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer candidate stands for."""
    candidates = frequent.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = "array_join(slice(w, {}, {}), ' ')"
    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr(part.format("1", "k")).alias("left"), F.expr(part.format("k + 1", "words - k")).alias("right")
    )
    known = frequent.filter(F.col("words") < LONGEST_PHRASE)
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    both = both.withColumn("up", whole[0] * whole[1] * 1000).withColumn("down", whole[2] * whole[3])
    lowest = both.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    inside = (
        candidates.filter("words > 2")
        .select("lang", "a", "words", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("m"))
        .select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("k"))
        .select("lang", F.expr(part.format("k", "m")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, filter_bits: int = FILTER_BITS, every: int = EVERY) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = frequent_phrases(docs, least, filter_bits=filter_bits, every=every)
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored(frequent, totals, share).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS words, array_to_string(w[i:i + {k - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)"
        for k in range(1, LONGEST_PHRASE + 1)
    )
    return rf"""WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
counts AS MATERIALIZED (SELECT lang, words, phrase, CAST(count(*) AS BIGINT) AS f FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang),
freq AS MATERIALIZED (SELECT * FROM counts WHERE f >= {least}),
cand AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE words > 1),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)),
marked AS (
  SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM cuts c JOIN freq p ON p.lang = c.lang AND p.phrase = x JOIN freq q ON q.lang = c.lang AND q.phrase = y
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[k:k + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, words - m + 2)) AS k FROM (SELECT *, unnest(range(2, words)) AS m FROM cand))
  GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < {share} * best.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= {top}"""
