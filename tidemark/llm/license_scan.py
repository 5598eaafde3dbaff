"""Licences in texts: normalised passages compared with templates by the Dice coefficient of word bigrams.

Passages are a text's lines, its paragraphs (between blank lines) and the whole text. Normalising makes
ASCII letters small, writes ``license`` for ``licence`` and keeps runs of letters and digits as words. With
A and B the sets of neighbouring word pairs, Dice = 2 |A n B| / (|A| + |B|). A Dice of at least t needs
|A| between t / (2 - t) and (2 - t) / t times |B|; passages outside
a template's bounds are not compared with it.

Pairs are compared by 64-bit hashes over a batch of texts at once; passages that share too few pairs with
all templates together are dropped first. Nothing is shuffled: templates go with the task.

Nulls, empty texts and passages of fewer than two words match nothing. Repeated rows give repeated
results; a passage that is repeated in a text counts once. Ties of Dice go to the first licence name.
Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.arrays import flat, hash_spans, mix, runs, slices, words

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True

# Notices and licence texts by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "proprietary": "All rights reserved.",
    "public domain": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """Different word pairs of a template, normalised as passages are."""
    found = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)).replace("licence", "license"))
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Least and largest |A| for which Dice with |B| = size can reach the threshold."""
    slack = 1e-9  # Dice itself decides at the bounds
    return threshold * size / (2 - threshold) - slack, (2 - threshold) * size / threshold + slack


def _hash_pairs(words: list[str]) -> np.ndarray:
    """Hashes of the word pairs, as `_pairs` forms them from bytes."""
    raw = np.frombuffer("\n".join(words).encode(), np.uint8)
    start, end, _ = _words(raw, np.array([0, len(raw)]))
    return _pairs(raw, start, end)


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of letters and digits."""
    return words(np.where(_WORD[raw], raw, 32).astype(np.uint8), at)


def _pairs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word with the one after it."""
    word = hash_spans(raw, start, end)
    return mix(word[:-1] * np.uint64(3) + mix(word[1:]))


def _matches(texts: pa.Array, hashes: dict[str, np.ndarray], threshold: float) -> Iterator[tuple[int, tuple, str, float]]:
    """(row, passage, licence, Dice) of every match in a batch of texts."""
    normal = pc.replace_substring(pc.ascii_lower(texts.fill_null("")), "licence", "license")
    raw, at = flat(normal)
    start, end, row = _words(raw, at)
    if len(start) < 2 or not hashes:
        return
    pairs = _pairs(raw, start, end)
    known = np.unique(np.concatenate(list(hashes.values())))
    hit = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
    # lines, and paragraphs as runs of lines between lines of blanks
    line_at = np.sort(np.concatenate((at[:-1], np.flatnonzero(raw == 10) + 1)))
    filled = np.concatenate(([0], np.cumsum(~_BLANK[raw])))
    blank = filled[np.append(line_at[1:], len(raw))] == filled[line_at]
    line = np.searchsorted(line_at, start, side="right") - 1
    paragraph = (np.cumsum(blank) + np.searchsorted(at, line_at, side="right"))[line]
    least = min(-(-bounds(len(b), threshold)[0] // 1) for b in hashes.values())
    seen: set[tuple] = set()
    for unit in (line, paragraph, row):
        first = runs(unit)
        number = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(number[:-1] == number[1:])
        shared = np.bincount(number[inside], weights=hit[inside], minlength=len(first) - 1)
        inside = inside[shared[number[inside]] >= least]
        if not len(inside):
            continue
        # different pairs of the passages that are left
        by = inside[np.lexsort((pairs[inside], number[inside]))]
        new = np.concatenate(([True], (pairs[by][1:] != pairs[by][:-1]) | (number[by][1:] != number[by][:-1])))
        pair, of = pairs[by][new], number[by][new]
        size = np.bincount(of, minlength=len(first) - 1)
        for name, template in hashes.items():
            low, high = bounds(len(template), threshold)
            both = np.bincount(of[np.isin(pair, template)], minlength=len(first) - 1)
            dice = 2.0 * both / (size + len(template))
            for u in np.flatnonzero((both > 0) & (size >= low) & (size <= high) & (dice >= threshold)).tolist():
                span = slice(first[u], first[u + 1])
                passage = tuple(raw[a:b].tobytes() for a, b in zip(start[span].tolist(), end[span].tolist()))
                key = int(row[first[u]]), passage, name
                if key not in seen:
                    seen.add(key)
                    yield *key, float(dice[u])


SCHEMA = "doc_id long, license string, dice double, n_passages long, licenses string"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, license and dice of the best match (null: none), n_passages that match, licenses
    (names of all matches, comma-joined)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {}
        for name, text in templates.items():
            if pairs := bigrams(text):
                hashes[name] = np.unique(np.concatenate([_hash_pairs(p.split(" ")) for p in pairs]))
        for batch in slices(batches):
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for row, passage, name, dice in _matches(batch.column(1), hashes, threshold):
                found[row].append((-dice, name, passage))
            best = [min(f)[:2] if f else (None, None) for f in found]
            columns = [
                batch.column(0),
                pa.array([b[1] for b in best], pa.string()),
                pa.array([None if b[0] is None else -b[0] for b in best], pa.float64()),
                pa.array([len({p for _, _, p in f}) for f in found], pa.int64()),
                pa.array([",".join(sorted({n for _, n, _ in f})) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, SCHEMA)


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result as SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(templates.items()))
    normal = f"replace(translate({{}}, '{UPPER}', '{LOWER}'), 'licence', 'license')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH template AS (SELECT license, {pairs} AS b FROM (
        SELECT license, regexp_extract_all({normal.format('t')}, '[a-z0-9]+') AS w FROM (VALUES {values}) v(license, t))),
    doc AS (SELECT row_number() OVER () AS r, doc_id, {normal.format("coalesce(text, '')")} AS t FROM documents),
    passage AS (SELECT r, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n[\\x20\\t\\r]*\\n'), [t]))) AS p FROM doc),
    word AS (SELECT r, p, regexp_extract_all(p, '[a-z0-9]+') AS w FROM passage),
    bigram AS (SELECT DISTINCT r, w, {pairs} AS a FROM word WHERE len(w) > 1),
    matched AS (SELECT r, w, license, CAST(2 * len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b)) AS dice
        FROM bigram, template
        WHERE len(a) BETWEEN {threshold} * len(b) / (2 - {threshold}) - 1 AND (2 - {threshold}) * len(b) / {threshold} + 1),
    kept AS (SELECT * FROM matched WHERE dice >= {threshold})
    SELECT any_value(doc_id) AS doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
        count(DISTINCT w) AS n_passages, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
    FROM doc LEFT JOIN kept USING (r) GROUP BY r"""
