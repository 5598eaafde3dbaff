"""Inner-product scoring over a whole catalog in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.vectors import mean_vector, sum_vector
from tidemark.operators.evaluation import comparable
from tidemark.scale import array_bytes, bytes_array, cut

BLOCK = 20_000  # vectors per block side
MIN_BLOCK = 256
TILE_CELLS = 8_000_000  # scores held at once inside a task
SLICE = 2_000  # queries of a block whose best rows are sorted at once
FIRST = 2_000  # items of the first block that go ahead of the others
MANY = 64  # tags of a block above which a boost is added instead of multiplied
PAIRS = 100_000  # scores formed anew at once
WORDS = 512  # words that a task compares at once
DIGITS = 12  # scores equal to this many decimals are ties


def _by_score() -> list[Column]:
    return [comparable("score", DIGITS).desc(), F.col("item")]


def best_of_rows(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `keep` largest finite scores per row, earlier columns win ties."""
    m = scores.shape[1]
    if m > keep:
        edge = np.partition(scores, m - keep, axis=1)[:, m - keep]
        rows, cols = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, rows, side="left")
    ok = np.arange(len(rows)) - start < keep
    return rows[ok], cols[ok]


def _owner_best(
    scores: np.ndarray, owners: np.ndarray, ids: np.ndarray, cap: int, keep: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `keep` largest finite scores per row with at most `cap` per owner.

    Columns are ordered by owner, then id; ties go to the lower id. Uses `scores` up. Only owners with
    more than `cap` columns are looked at one by one.
    """
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    ends = np.r_[starts[1:], len(owners)]
    for a, b in zip(starts[ends - starts > cap], ends[ends - starts > cap], strict=True):
        part = scores[:, a:b]
        over = np.argsort(-part, axis=1, kind="stable")[:, cap:]
        np.put_along_axis(part, over, -np.inf, axis=1)
    m = scores.shape[1]
    fits = np.isfinite(scores)
    if m > keep:
        fits &= scores >= np.partition(scores, m - keep, axis=1)[:, m - keep, None]
    rows, cols = np.nonzero(fits)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    ok = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < keep
    return rows[ok], cols[ok]


def tag_score(boost: Column, tags: Column, tag: Column) -> Column:
    """What a query's boost adds to an item: the boost if the item's tag is one of the query's."""
    return F.when(F.array_contains(tags, tag), boost).otherwise(0.0)


def tag_scores(vectors: pd.DataFrame, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(queries x tags of the block) boosts and the column of each item."""
    codes, names = pd.factorize(tags)
    place = {t: k for k, t in enumerate(names)}
    boosts = np.zeros((len(vectors), len(names) + 1))  # the last column is for items without a tag
    for row, (mine, boost) in enumerate(zip(vectors["tags"], vectors["boost"], strict=True)):
        for t in mine if mine is not None else ():
            if t in place:
                boosts[row, place[t]] = boost
    return boosts, np.where(codes < 0, len(names), codes)


class _Words:
    """The words of some rows as positions in a vocabulary; words outside it are left out."""

    def __init__(self, lists: list, vocabulary: pd.Index) -> None:
        lists = [x or () for x in lists]
        at = vocabulary.get_indexer(pd.Index([w for x in lists for w in x], dtype=object))
        self.n, self.row, self.at = len(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])[at >= 0], at[at >= 0]

    def counts(self, first: int, last: int, a: int, b: int) -> np.ndarray:
        """(rows first to last x words a to b) how often a row has a word."""
        fits = (self.row >= first) & (self.row < last) & (self.at >= a) & (self.at < b)
        cell = (self.row[fits] - first) * (b - a) + self.at[fits] - a
        return np.bincount(cell, minlength=(last - first) * (b - a)).reshape(last - first, b - a).astype(np.float32)


def blocks_of(queries: DataFrame, items: DataFrame, block: int = BLOCK) -> tuple[int, int]:
    """Numbers of query and item blocks of about `block` rows. Small inputs get smaller blocks, so that
    every core has a few pairs of blocks. Counts both inputs."""
    rows_q, rows_i = max(1, queries.count()), max(1, items.count())
    cores = queries.sparkSession.sparkContext.defaultParallelism
    block = max(MIN_BLOCK, min(block, int((rows_q * rows_i / (4 * cores)) ** 0.5)))
    return -(-rows_q // block), -(-rows_i // block)


def in_blocks(df: DataFrame, key: str, own: int, own_name: str, other: int, other_name: str) -> DataFrame:
    """Rows hashed to one of `own` blocks, once for each of the `other` side's blocks."""
    every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    placed = df.withColumn(own_name, F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn(other_name, every)
    return placed.repartition(min(own * other, 100_000), "qb", "ib")


def _short(cells: np.ndarray) -> np.ndarray | None:
    """4-byte numbers, or None if products of some could leave their range."""
    return cells.astype("<f4") if not cells.size or np.abs(cells).max() < 1e15 else None


def _products(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows."""
    parts = [np.einsum("ij,ij->i", left[i[x : x + PAIRS]], right[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _taken(v: Row | dict, some: np.ndarray) -> dict:
    """Some items of a block."""
    cells = np.frombuffer(v["cells"], "<f8").reshape(len(v["item"]), -1)[some].tobytes()
    lists = {c: None if v[c] is None else [v[c][i] for i in some] for c in ("owner", "tag", "words")}
    return {"item": np.asarray(v["item"])[some], "cells": cells, **lists}


def _one_list(column: pa.ChunkedArray) -> pa.Array:
    """A column as one list."""
    values = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cells(table: pa.Table) -> pa.Array:
    """The vectors of a table as the bytes of one matrix."""
    vec = table.column("vec").combine_chunks()
    sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
    if not (sizes == sizes[0]).all():
        raise ValueError("all vectors must have the same number of elements")
    return pa.array([vec.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())


class _Best:
    """The best rows of a block of queries over the item blocks that were added."""

    def __init__(self, q: Row | dict, k: int, owner_cap: int | None, tagged: bool, bonus: tuple[float, int] | None = None, scored: bool = False) -> None:
        self.scored, self.hidden = scored, []
        self.k, self.cap, self.tagged, self.bonus = k, owner_cap, tagged, bonus
        self.names = np.asarray(q["query"])
        self.left = np.frombuffer(q["cells"], "<f8").reshape(len(self.names), -1)
        self.norms, self.left4 = np.sqrt(np.einsum("ij,ij->i", self.left, self.left)), _short(self.left)
        if tagged:
            self.boosts = pd.DataFrame({"tags": q["tags"], "boost": q["boost"]})
        self.vocabulary = pd.Index(sorted({w for x in q["words"] for w in x or () if w is not None} if bonus else ()), dtype=object)
        if bonus:
            self.words = _Words([set(x or ()) for x in q["words"]], self.vocabulary)
        row = pd.Index(self.names).get_indexer(q["gone_query"])
        order = np.argsort(row, kind="stable")
        order = order[row[order] >= 0]
        self.gone_q, self.gone_i = row[order], pd.Index(q["gone_item"])[order]
        self.kept: dict[int, pd.DataFrame] = {}  # by first query of a slice: row, score, grid, item, owner
        self.least = np.full(len(self.names), -np.inf)  # a lower score is not among the best k

    def add(self, v: Row) -> None:
        """Takes in a block of items.

        Products are formed in 4-byte numbers; what may be among the best k for all that these can be wrong is scored
        again in 8 bytes, so that the answers are those of 8-byte products. With owners, some items of the first block go
        ahead: they tell which scores of the others can be passed over.
        """
        n = len(v["item"])
        if self.cap and n > FIRST and not np.isfinite(self.least).all():
            ahead = np.arange(n) % (n // FIRST + 1) == 0
            for some in (np.flatnonzero(ahead), np.flatnonzero(~ahead)):
                self._add(_taken(v, some))
        else:
            self._add(v)

    def _add(self, v: Row | dict) -> None:
        ids = np.asarray(v["item"])
        right = np.frombuffer(v["cells"], "<f8").reshape(len(ids), -1)
        owners = np.array(v["owner"], object) if self.cap else None
        boosts, tag_of = tag_scores(self.boosts, np.array(v["tag"], object)) if self.tagged else (None, None)
        offered = _Words(v["words"], self.vocabulary) if self.bonus else None
        parts = [(c, min(c + WORDS, len(self.vocabulary))) for c in range(0, len(self.vocabulary), WORDS)] if self.bonus else []
        sides = [offered.counts(0, len(ids), *c).T for c in parts[:1]]  # held for all tiles if it is the only one
        gone_i = pd.Index(ids).get_indexer(self.gone_i)
        known = gone_i >= 0
        gone_q, gone_i = self.gone_q[known], gone_i[known]
        if self.scored:
            score = _products(self.left, gone_q, right, gone_i)
            if self.tagged:
                score += boosts[gone_q, tag_of[gone_i]]
            self.hidden.append(pd.DataFrame({"row": gone_q, "item": ids[gone_i], "score": score}))
        right4 = _short(right) if self.left4 is not None else None
        boosts4 = _short(boosts) if self.tagged else None
        short = right4 is not None and (boosts4 is not None or not self.tagged) and len(ids) > 0
        if short:
            # how far a 4-byte score can be from the right one
            far = np.sqrt(np.einsum("ij,ij->i", right, right).max())
            more = np.abs(boosts).max(axis=1) if self.tagged else 0.0
            more = more + (abs(self.bonus[0]) * self.bonus[1] if self.bonus else 0.0)
            wrong = 2.0**-24 * 1.01 * ((right.shape[1] + MANY + 8) * (self.norms * far + more)) + 1e-36 * right.shape[1] * (1 + self.norms + far)
            left4, marked = self.left4, self.tagged and boosts4.shape[1] <= MANY
            if marked:  # a boost is a product with one-hot vectors
                left4 = np.hstack([left4, boosts4])
                right4 = np.hstack([right4, np.eye(boosts4.shape[1], dtype=np.float32)[tag_of]])
        step = min(SLICE, max(1, TILE_CELLS // max(1, len(ids))))
        bounds = [(s, a, min(a + step, s + SLICE)) for s in range(0, len(self.names), SLICE) for a in range(s, min(s + SLICE, len(self.names)), step)]
        new: list[pd.DataFrame] = []
        for at_tile, (s, a, b) in enumerate(bounds):
            least = self.least[a:b]
            quick = short and (not self.cap or np.isfinite(least).all())
            raw = left4[a:b] @ right4.T if quick else self.left[a:b] @ right.T
            if self.tagged and not (quick and marked):
                raw += (boosts4 if quick else boosts)[a:b][:, tag_of]
            shared = None
            if parts:
                shared = np.zeros(raw.shape, np.float32)
                for at, c in enumerate(parts):
                    side = sides[at] if at < len(sides) else offered.counts(0, len(ids), *c).T
                    shared += self.words.counts(a, a + len(raw), *c) @ side
                np.minimum(shared, self.bonus[1], out=shared)
                raw += raw.dtype.type(self.bonus[0]) * shared.astype(raw.dtype, copy=False)
            lo, hi = np.searchsorted(gone_q, [a, b])
            raw[gone_q[lo:hi] - a, gone_i[lo:hi]] = -np.inf
            if quick:
                rows, cols = self._candidates(raw, least, wrong[a:b])
                score = _products(self.left, a + rows, right, cols)
                if self.tagged:
                    score += boosts[a + rows, tag_of[cols]]
                if parts:
                    score += self.bonus[0] * shared[rows, cols].astype(float)
                fits = score >= least[rows]
                rows, cols, score = rows[fits], cols[fits], score[fits]
            else:
                if np.isfinite(least).all():
                    rows, cols = np.nonzero((raw >= least[:, None]) & (raw < np.inf))
                elif self.cap:
                    rows, cols = _owner_best(np.round(raw, DIGITS), owners, ids, self.cap, self.k)
                else:
                    rows, cols = best_of_rows(np.round(raw, DIGITS), self.k)
                score = raw[rows, cols]
            found = {"row": a + rows, "score": score, "grid": np.round(score, DIGITS), "item": ids[cols]}
            new.append(pd.DataFrame({**found, "owner": owners[cols]} if self.cap else found))
            if at_tile + 1 == len(bounds) or bounds[at_tile + 1][0] != s:
                self._keep(s, pd.concat([*([self.kept[s]] if s in self.kept else []), *new], ignore_index=True))
                new = []

    def _candidates(self, raw: np.ndarray, least: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the 4-byte scores that may stand for one of the row's best k."""
        floor, m = least - wrong, raw.shape[1]
        if m > self.k and not np.isfinite(least).all():
            edge = np.partition(raw, m - self.k, axis=1)[:, m - self.k].astype(float)
            floor = np.maximum(floor, edge - 2 * wrong - 2 * 10.0**-DIGITS - 8e-15 * np.abs(edge))
        floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        floor = np.maximum(floor, np.finfo(np.float32).min)  # a pair that is excluded has no score
        return np.divmod(np.flatnonzero(raw >= floor[:, None]), m)

    def _keep(self, first: int, found: pd.DataFrame) -> None:
        row, grid = found["row"].to_numpy(), found["grid"].to_numpy()
        item = pd.factorize(found["item"], sort=True)[0]
        chosen = np.arange(len(found))
        if self.cap:
            owner = pd.factorize(found["owner"])[0]
            order = np.lexsort((item, -grid, owner, row))
            key = row[order].astype(np.int64) * (len(found) + 1) + owner[order]
            chosen = order[np.arange(len(order)) - np.searchsorted(key, key) < self.cap]
        order = chosen[np.lexsort((item[chosen], -grid[chosen], row[chosen]))]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        self.kept[first] = found.iloc[order[place < self.k]].reset_index(drop=True)
        last = order[place == self.k - 1]
        self.least[row[last]] = grid[last] - 10.0**-DIGITS - 4e-15 * np.abs(grid[last])

    def lists(self, size: int = 50_000) -> Iterator[tuple]:
        for kept in self.kept.values():
            for a in range(0, len(kept), size):
                some = kept.iloc[a : a + size]
                owners = some["owner"].tolist() if self.cap else None
                yield self.names[some["row"]].tolist(), some["item"].tolist(), some["score"].tolist(), owners, False
        for found in self.hidden:
            for a in range(0, len(found), size):
                some = found.iloc[a : a + size]
                yield self.names[some["row"]].tolist(), some["item"].tolist(), some["score"].tolist(), [None] * len(some) if self.cap else None, True


def blocked_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    owner_cap: int | None = None,
    block: int = BLOCK,
    bonus: tuple[float, int] | None = None,
    scored: bool = False,
) -> DataFrame:
    """(query, item, score, rank): exact top-k by inner product over all items, ties by item.

    `queries`: query, vec. `items`: item, vec (and owner with `owner_cap`). `exclude`: query, item
    pairs that must not be returned. Both sides are hashed into blocks of about `block` vectors and
    written once, one row per block. A task holds a block of queries and reads the item blocks one after
    the other: it multiplies two small matrices and keeps the best k rows per query so far (with
    `owner_cap`, at most that many per owner). So what is moved and written grows with the two sides
    and the answers, only the products with both. Counts both inputs to choose the number of blocks.

    With `tags` (array) and `boost` in `queries` and `tag` in `items`, a query's boost is added to the
    items whose tag it has: a product with one-hot vectors, however many tags there are. With `bonus` (weight,
    most) each of an item's `words` (array) that is among the query's `words` adds the weight, `most` times at most.
    With `scored` (not with `bonus`) the excluded pairs come too, with their scores and without a rank: they are scored
    where their vectors meet.
    """
    if scored and bonus:
        raise ValueError("excluded pairs are not scored with a bonus")
    tagged = "tags" in queries.columns and "tag" in items.columns
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows_q, rows_i = max(1, queries.count()), max(1, items.count())
    n_q = max(-(-rows_q // block), min(4 * cores, -(-rows_q // MIN_BLOCK)))
    n_i = -(-rows_i // block)
    n_r = min(n_i, -(-2 * cores // n_q))  # few query blocks: the items are dealt to several tasks

    q_kind, i_kind = queries.schema["query"].dataType.simpleString(), items.schema["item"].dataType.simpleString()

    def part(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("block")

    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    asking = queries.select(
        part("query", n_q),
        "query",
        vec,
        (F.col("tags") if tagged else F.lit(None)).cast("array<string>").alias("tags"),
        (F.col("boost") if tagged else F.lit(None)).cast("double").alias("boost"),
        (F.col("words") if bonus else F.lit(None)).cast("array<string>").alias("words"),
    ).filter("vec is not null")
    hidden = spark.createDataFrame([], f"query {q_kind}, item {i_kind}") if exclude is None else exclude
    # under names of its own: both sides of the cogroup may come from one table
    hidden = hidden.select(part("query", n_q), F.col("query").alias("gone_query"), F.col("item").alias("gone_item"))
    offered = items.select(
        part("item", n_i),
        "item",
        vec,
        (F.col("owner") if owner_cap else F.lit(None)).cast("string").alias("owner"),
        (F.col("tag") if tagged else F.lit(None)).cast("string").alias("tag"),
        (F.col("words") if bonus else F.lit(None)).cast("array<string>").alias("words"),
    )

    def pack_queries(vectors: pa.Table, gone: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return pa.table({})
        ids = {c: [array_bytes(gone.column(c).combine_chunks())] for c in ("gone_query", "gone_item")}
        lists = {c: some(vectors.column(c), used) for c, used in (("tags", tagged), ("boost", tagged), ("words", bonus))}
        return pa.table({"cells": _cells(vectors), "query": _one_list(vectors.column("query")), **lists, **{c: pa.array(x, pa.binary()) for c, x in ids.items()}})

    def pack_items(found: pa.Table) -> pa.Table:
        found = found.sort_by([(c, "ascending") for c in (["owner", "item"] if owner_cap else ["item"])])
        lists = {c: some(found.column(c), used) for c, used in (("owner", owner_cap), ("tag", tagged), ("words", bonus))}
        return pa.table({"cells": _cells(found), "item": _one_list(found.column("item")), **lists})

    def some(column: pa.ChunkedArray, used: object) -> pa.Array:
        return _one_list(column) if used else pa.nulls(1, pa.list_(column.type))

    left_kind = f"cells binary, query array<{q_kind}>, tags array<array<string>>, boost array<double>, words array<array<string>>, gone_query binary, gone_item binary"
    left = asking.groupBy("block").cogroup(hidden.groupBy("block")).applyInArrow(pack_queries, left_kind)
    left = cut(left, "query-blocks")
    right = offered.groupBy("block").applyInArrow(pack_items, f"cells binary, item array<{i_kind}>, owner array<string>, tag array<string>, words array<array<string>>")
    right = cut(right, "item-blocks")
    # the blocks of both sides meet where they are read: no block is copied for its partners
    left = left.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n_q, "at")

    def search(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        asked: dict[int, _Best] = {}

        for q, v in pairs:
            if q["at"] not in asked:
                gone = {c: bytes_array(q[c]).to_numpy(zero_copy_only=False) for c in ("gone_query", "gone_item")}
                asked[q["at"]] = _Best({**q.asDict(), **gone}, k, owner_cap, tagged, bonus, scored)
            asked[q["at"]].add(v)
        for best in asked.values():
            yield from best.lists()

    lists = left.rdd.cartesian(right.coalesce(n_r).rdd).mapPartitions(search)
    found = spark.createDataFrame(lists, f"query array<{q_kind}>, item array<{i_kind}>, score array<double>, owner array<string>, hidden boolean", verifySchema=False)
    found = found.select("hidden", F.inline(F.arrays_zip("query", "item", "score", *(["owner"] if owner_cap else []))))
    if scored:
        found = cut(found, "found")  # read twice below
        excluded = found.filter("hidden").select("query", "item", "score", F.lit(None).cast("int").alias("rank"))
        found = found.filter("not hidden")
    found = found.drop("hidden")
    if owner_cap:
        w = Window.partitionBy("query", "owner").orderBy(*_by_score())
        found = found.withColumn("_o", F.row_number().over(w)).filter(F.col("_o") <= owner_cap).drop("_o")
    w = Window.partitionBy("query").orderBy(*_by_score())
    best = found.drop("owner").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.unionByName(excluded) if scored else best


def moments(items: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean vector, mean of outer products) of the item vectors.

    Partitions add up their own dim * dim sums; what reaches the driver is dim * dim numbers
    whatever the number of items. With these, mean and deviation of any query's scores over the
    catalog are known without scoring it.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["vec"].to_numpy()).astype(float)
                m = np.hstack([m, np.ones((len(m), 1))])
                total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = items.select("vec").mapInPandas(partial, "cell int, value double")
    rows = cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    full = np.zeros((dim + 1) ** 2)
    for r in rows:
        full[r["cell"]] = r["value"]
    full = full.reshape(dim + 1, dim + 1)
    n = max(full[dim, dim], 1.0)
    return full[dim, :dim] / n, full[:dim, :dim] / n


def standardised(
    queries: DataFrame, stats: tuple[np.ndarray, np.ndarray], out: str = "zvec", vec: str = "vec"
) -> DataFrame:
    """Add `out` and `offset`: inner product with `out` plus `offset` is the z-score of the score.

    z = (score - mean) / (population deviation + 1e-9) over the catalog the moments describe.
    """
    mean, second = stats
    cov = second - np.outer(mean, mean)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q = np.stack(pdf[vec].to_numpy()).astype(float)
                sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", q, cov, q), 0.0)) + 1e-9
                pdf = pdf.assign(**{out: list(q / sd[:, None]), "offset": -(q @ mean) / sd})
            else:
                pdf = pdf.assign(**{out: [], "offset": []})
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(convert, f"{schema}, {out} array<double>, offset double")


def history_mean(
    pairs: DataFrame, items: DataFrame, dim: int, by: str = "user"
) -> DataFrame:
    """(user, n, vec): mean vector of the user's items."""
    joined = pairs.select(by, "item").join(items.select("item", "vec"), "item")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), mean_vector("vec", dim).alias("vec"))


def history_mean_without(pairs: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """(user, item, vec): mean vector of the user's other items, for every pair."""
    joined = pairs.select("user", "item").join(items.select("item", "vec"), "item")
    sums = joined.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), sum_vector("vec", dim).alias("total")
    )
    rest = F.zip_with("total", "vec", lambda t, v: (t - v.cast("double")) / F.greatest(F.col("n") - 1, F.lit(1)))
    return joined.join(sums, "user").select("user", "item", rest.alias("vec"))


def fold_in_user_mean(
    users: DataFrame, profiles: DataFrame, items: DataFrame, pop: DataFrame, dim: int
) -> tuple[DataFrame, DataFrame]:
    """Query and item vectors whose inner product scores users that were not in training.

    A user is the mean of the profile items' vectors (zero without any); one more dimension holds
    1e-6 * popularity / largest popularity, which decides ties.
    """
    top = pop.agg(F.max("pop")).scalar()
    tie = F.lit(1e-6) * F.coalesce("pop", F.lit(0)) / top
    catalog = (
        items.select("item", "vec")
        .join(pop.select("item", "pop"), "item", "left")
        .select(
            "item",
            F.concat(F.transform("vec", lambda x: x.cast("double")), F.array(tie)).alias("vec"),
        )
    )
    means = history_mean(profiles, items, dim)
    zero = F.array_repeat(F.lit(0.0), dim)
    queries = (
        users.select("user")
        .distinct()
        .join(means, "user", "left")
        .select(
            F.col("user").alias("query"),
            F.concat(F.coalesce("vec", zero), F.array(F.lit(1.0))).alias("vec"),
        )
    )
    return queries, catalog


def vector_recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact answers that an approximate answer also returned."""
    found = exact.select("query", "item").join(
        approx.select("query", "item", F.lit(1).alias("hit")), ["query", "item"], "left"
    )
    return found.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
