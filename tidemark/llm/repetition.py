"""Quality rules on repetition inside a text, by a suffix array over its words.

The words of a batch of texts are sorted as suffixes by prefix doubling (only suffixes that are still
tied take part in a round, and a suffix ends with its text). Neighbours' longest common prefixes give
the maximal repeated passages: a suffix belongs to one as far as the longer of its two neighbours'
prefixes reaches. The union of the passages of at least `MIN_WORDS` words gives the covered share; the
longest prefix gives the longest repeat. Words, lines and word sequences are compared by
hashes modulo a 61-bit prime.

A text is kept unless the fixed rule fails it (fewer than 50 words, or more than half of the words in
repeated three-word windows), more than `COVERED` percent of the words are covered, or the longest
repeat has at least `MIN_WORDS` words and over `LONGEST` percent of the words.

The limits come from the Gopher rules for repeated 8- to 10-word windows: 12 percent of a text in further
copies, which is 24 percent with the first ones, and 10 percent for a single passage. A passage found twice
covers twice its length, so a `LONGEST` under half of `COVERED` is needed for it to decide anything, and
both have to be well under the 50 percent at which the fixed rule fails a text by itself.

Nulls and empty texts have no words and fail the fixed rule. Very long texts are worked on alone.
Repeated rows give repeated results. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import flat, hash_spans, mix, mod_prefix, mod_spans, slices, words

MIN_WORDS = 8  # shortest repeated passage that counts
COVERED = 24  # percent of the words in repeated passages
LONGEST = 10  # percent of the words in the longest one
PORTION = 1 << 20  # bytes of text worked on at once; a longer text is worked on alone

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_covered_words long, longest_repeat long, kept boolean"
)


def suffix_order(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix array of many sequences laid end to end: `end[i]` is where the sequence of i ends.

    Suffixes of one sequence come together, in the order of their symbols; a prefix comes first.
    """
    n = len(symbols)
    order = np.lexsort((symbols, end))
    head = np.concatenate(([True], (symbols[order][1:] != symbols[order][:-1]) | (end[order][1:] != end[order][:-1]))) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    step = 1
    tied = np.flatnonzero(~head | ~np.concatenate((head[1:], [True]))) if n else np.zeros(0, np.int64)
    while len(tied):
        here = order[tied]
        ahead = here + step
        inside = ahead < end[here]
        following = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[here]
        by = np.lexsort((following, group))
        here, group, following = here[by], group[by], following[by]
        order[tied] = here
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])))
        rank[here] = tied[np.maximum.accumulate(np.where(head, np.arange(len(here)), 0))]
        tied = tied[~head | ~np.concatenate((head[1:], [True]))]
        step *= 2
    return order


def neighbour_prefixes(order: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in `order`, by binary search on hashes."""
    if not len(order):
        return np.zeros(0, np.int64)
    a, b = order[:-1], order[1:]
    low = np.zeros(len(a), np.int64)
    high = np.where(end[a] == end[b], np.minimum(end[a] - a, end[b] - b), 0)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        x, y = a[open_], b[open_]
        mid = (low[open_] + high[open_] + 1) >> 1
        same = mod_spans(prefix, x, x + mid) == mod_spans(prefix, y, y + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return np.concatenate(([0], low))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def repeats(symbols: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(words covered by repeated passages, longest repeated passage) of each sequence at[i]:at[i + 1]."""
    sizes = np.diff(at)
    end = np.repeat(at[1:], sizes)
    order = suffix_order(symbols, end)
    lcp = neighbour_prefixes(order, end, mod_prefix(symbols))
    reach = np.empty(len(order), np.int64)
    reach[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0]))) if len(lcp) else lcp
    row = np.repeat(np.arange(len(sizes)), sizes)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, row, reach)
    long_ = np.flatnonzero(reach >= min_words)
    return _per_row(covered(long_, reach[long_], len(symbols)), at), longest


def measure(column: pa.Array, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """All counts for a batch of texts."""
    raw, at = flat(column)
    n = len(at) - 1
    start, end, row = words(raw, at)
    n_words = np.bincount(row, minlength=n)
    word_at = np.concatenate(([0], np.cumsum(n_words)))
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    symbols = hash_spans(raw, start, end)

    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(raw == 10)
    line_start = np.sort(np.concatenate((at[:-1], breaks + 1)))
    line_row = np.searchsorted(at, line_start, side="right") - 1
    # an empty row, or a line break that ends a row, starts an empty line; it has no word and drops out
    stop = np.sort(np.concatenate((breaks, at[1:])))
    with_word = np.searchsorted(start, stop) > np.searchsorted(start, line_start)
    line_start, stop, line_row = line_start[with_word], stop[with_word], line_row[with_word]
    key = hash_spans(raw, line_start, stop)
    by = np.lexsort((key, line_row))
    again = (key[by][1:] == key[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])
    n_dup = np.bincount(line_row[by][1:][again], minlength=n)

    # three-word windows found twice or more
    repeat_words = np.zeros(n, np.int64)
    if len(symbols) > 2:
        window = symbols[:-2] * np.uint64(3) + mix(symbols[1:-1] * np.uint64(5) + mix(symbols[2:]))
        first = np.flatnonzero(row[:-2] == row[2:])
        by = first[np.lexsort((window[first], row[first]))]
        same = (window[by][1:] == window[by][:-1]) & (row[by][1:] == row[by][:-1])
        twice = by[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(by) else by
        repeat_words = _per_row(covered(twice, np.full(len(twice), 3), len(symbols)), word_at)

    n_covered, longest = repeats(symbols, word_at, min_words)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(row, weights=leads[end] - leads[start], minlength=n).astype(np.int64),
        "n_symbols": _per_row(_SYMBOL[raw], at),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words,
        "n_covered_words": n_covered,
        "longest_repeat": longest,
    }


def _verdicts(m: dict[str, np.ndarray], min_words: int, most_covered: int, most_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts of `measure`."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    long_ = (m["longest_repeat"] >= min_words) & (100 * m["longest_repeat"] > most_longest * m["n_words"])
    return failed, ~(failed | long_ | (100 * m["n_covered_words"] > most_covered * m["n_words"]))


def rules(docs: DataFrame, min_words: int = MIN_WORDS, most_covered: int = COVERED, most_longest: int = LONGEST) -> DataFrame:
    """Per row: counts, `base_failed` (the fixed rule) and `kept` (see the module's description)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PORTION):
            m = measure(batch.column(1), min_words)
            failed, kept = _verdicts(m, min_words, most_covered, most_longest)
            base = [m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns = [batch.column(0), *map(pa.array, (*base, failed, m["n_covered_words"], m["longest_repeat"], kept))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, SCHEMA)


def keep(docs: DataFrame, min_words: int = MIN_WORDS, most_covered: int = COVERED, most_longest: int = LONGEST) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, in one pass."""
    text_at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{text_at}", PORTION):
            _, kept = _verdicts(measure(batch.column(text_at), min_words), min_words, most_covered, most_longest)
            yield batch.filter(pa.array(kept))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
