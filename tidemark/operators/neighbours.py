"""Item co-occurrence and the item-neighbour recommender."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.evaluation import topk
from tidemark.scale import array_bytes, bytes_array, count_up, cut, unbounded

SLICE = 512  # items of one user handled together
USER_BLOCK = 131_072  # users scored together
HELD_ROWS = 4_000_000  # held and marked items of the users scored together
SIM_ROWS = 4_000_000  # similarities in a block
SCORE_CELLS = 1_000_000  # products that a task adds up at once
KEEP_ROWS = 2_000_000  # rows that wait before the best of them are kept
LIST_ROWS = 50_000  # rows passed on at once


def _half_pairs(lists: DataFrame) -> DataFrame:
    """(i, j) with i < j out of one sorted item list per row."""
    first = lists.select("items", F.posexplode("items").alias("pos", "i"))
    rest = F.slice(F.col("items"), F.col("pos") + 2, F.greatest(F.size("items"), F.lit(1)))
    return first.select("i", F.explode(rest).alias("j"))


def cooccurrence(train: DataFrame, slice_size: int = SLICE, degrees: bool = False) -> DataFrame:
    """(i, j, co) for i < j: users that hold both items; with `degrees` also n_i and n_j, the users of each.

    Degrees travel with the items of a list, so that the counted pairs need not be joined with them afterwards.

    The count is symmetric, so each unordered pair is produced once. Pairs stream into map-side
    partial counts and are never stored. A user above `slice_size` items is cut into slices;
    every two slices of a user are one small row of work with its own key, so a very large user
    spreads over the cluster instead of filling one task.
    """
    pairs = train.select("user", "item").distinct()
    if degrees:
        deg = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.join(unbounded(deg), "item").select("user", F.struct("item", "n").alias("item"))
    sizes = pairs.groupBy("user").agg(
        F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("parts")
    )
    sliced = pairs.join(unbounded(sizes), "user").withColumn(
        "part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")
    )
    lists = sliced.groupBy("user", "parts", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    single = lists.filter(F.col("parts") == 1)
    many = lists.filter(F.col("parts") > 1)
    low = many.select(
        "user",
        F.col("part").alias("lo"),
        F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("hi"),
        F.col("items").alias("a"),
    )
    high = many.select(
        "user",
        F.explode(F.sequence(F.lit(0), F.col("part"))).alias("lo"),
        F.col("part").alias("hi"),
        F.col("items").alias("b"),
    )
    blocks = low.join(high, ["user", "lo", "hi"])
    inside = blocks.filter(F.col("lo") == F.col("hi")).select(F.col("a").alias("items"))
    across = (
        blocks.filter(F.col("lo") < F.col("hi"))
        .select("b", F.explode("a").alias("x"))
        .select("x", F.explode("b").alias("y"))
        .select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    )
    half = _half_pairs(single.select("items").unionByName(inside)).unionByName(across)
    keys = ["i", "j"]
    if degrees:
        half = half.select("i.item", "j.item", "i.n", "j.n").toDF("i", "j", "n_i", "n_j")
        keys = ["i", "j", "n_i", "n_j"]
    return half.groupBy(*keys).agg(F.count(F.lit(1)).alias("co"))


def both_ways(half: DataFrame, *keep: str) -> DataFrame:
    """(item, neighbour, ...) from rows with i < j."""
    ends = F.array(
        F.struct(F.col("i").alias("item"), F.col("j").alias("neighbour")),
        F.struct(F.col("j").alias("item"), F.col("i").alias("neighbour")),
    )
    return half.select(F.explode(ends).alias("e"), *keep).select("e.item", "e.neighbour", *keep)


def with_degrees(half: DataFrame, train: DataFrame) -> DataFrame:
    """Add n_i and n_j: users per item of the pair."""
    deg = train.select("user", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return half.join(deg.select(F.col("item").alias("i"), F.col("n").alias("n_i")), "i").join(
        deg.select(F.col("item").alias("j"), F.col("n").alias("n_j")), "j"
    )


def cosine(shrink: float | Column, epsilon: float = 1e-12) -> Column:
    """Shrunk cosine of two binary item vectors from co, n_i, n_j."""
    lo, hi = F.least("n_i", "n_j").cast("double"), F.greatest("n_i", "n_j").cast("double")
    base = F.sqrt(lo) * F.sqrt(hi)
    return F.col("co") / (base + shrink + F.lit(epsilon))


def nearest(sims: DataFrame, k: int, by: tuple[str, ...] = ("item",)) -> DataFrame:
    """The `k` most similar neighbours per item, ties by neighbour id."""
    w = Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.col("neighbour"))
    return sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_by(sims: DataFrame, k: int, columns: Mapping[str, Column]) -> DataFrame:
    """(item, neighbour, ...): each of the similarities `columns` and rank_..., the place of the neighbour by it (null if it is
    not positive), for neighbours among the `k` most similar by one of them. The rows of an item are moved once for all."""
    sims = sims.repartition("item").select("item", "neighbour", *[x.alias(c) for c, x in columns.items()])
    for c in columns:
        w = Window.partitionBy("item").orderBy((F.col(c) > 0).desc(), F.col(c).desc(), F.col("neighbour"))
        sims = sims.withColumn(f"rank_{c}", F.row_number().over(w))
    ranks = [F.when((F.col(c) > 0) & (F.col(f"rank_{c}") <= k), F.col(f"rank_{c}")).alias(f"rank_{c}") for c in columns]
    kept = sims.select("item", "neighbour", *columns, *ranks)
    return kept.filter(F.coalesce(*[F.col(f"rank_{c}") for c in columns]).isNotNull())


def itemknn_fit(train: DataFrame, k: int = 100, shrink: float = 10.0) -> DataFrame:
    """(item, neighbour, sim, rank): positive neighbours only, self never included."""
    half = cooccurrence(train, degrees=True).withColumn("sim", cosine(F.lit(shrink)))
    return nearest(both_ways(half, "sim").filter(F.col("sim") > 0), k)


def itemknn_score(
    context: DataFrame, sims: DataFrame, by: tuple[str, ...] = (), users: DataFrame | None = None, hidden: DataFrame | None = None
) -> DataFrame:
    """(user, item, score): sum of similarities between an item and the user's items.

    `by` names extra grouping columns of `sims` (a configuration id in a grid search). Without it, the sums are
    formed in blocks of users, so that neither neighbour lists nor products are moved. With `users` only theirs are
    formed; pairs in `hidden` (user, item) are left out where the sums are, so that no table of scores is moved to be masked.
    """
    if not by:
        users = context.select("user").distinct() if users is None else users.select("user").distinct()
        if hidden is not None:
            hidden = hidden.select("user", "item").join(unbounded(users), "user", "left_semi")
        return _score_blocks(context, sims, hidden, users, 0, USER_BLOCK).drop("column")
    if users is not None:
        context = context.join(unbounded(users.select("user").distinct()), "user", "left_semi")
    held = context.select("user", F.col("item").alias("neighbour")).distinct()
    scores = (
        held.join(sims.select(*by, "item", "neighbour", "sim"), "neighbour")
        .groupBy(*by, "user", "item")
        .agg(F.sum("sim").alias("score"))
    )
    return scores if hidden is None else scores.join(unbounded(hidden), ["user", "item"], "left_anti")


def unseen_scores(
    context: DataFrame, sims: DataFrame, users: DataFrame, seen: DataFrame
) -> DataFrame:
    """`itemknn_score` for `users` without their seen items.

    Seen pairs join the stream as markers, so that summing and masking are one aggregate on
    (user, item) instead of an aggregate followed by an anti join.
    """
    users = users.select("user").distinct()
    held = context.select("user", F.col("item").alias("neighbour")).distinct()
    parts = (
        held.join(users, "user", "left_semi")
        .join(sims.select("item", "neighbour", "sim"), "neighbour")
        .select("user", "item", "sim")
    )
    markers = seen.join(users, "user", "left_semi").select("user", "item", F.lit(None).cast("double").alias("sim"))
    sums = parts.unionByName(markers).groupBy("user", "item").agg(
        F.sum("sim").alias("score"), F.count_if(F.col("sim").isNull()).alias("seen")
    )
    return sums.filter(F.col("seen") == 0).drop("seen")


def _distinct(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values, each once; the place of every row among them)."""
    codes, found = pd.factorize(values.to_pandas(), sort=True)
    return np.asarray(found), codes


def _read(data: bytes, size: int) -> np.ndarray:
    return bytes_array(pa.decompress(data, size, codec="zstd")).to_numpy(zero_copy_only=False)


class _Scores:
    """Scores of a block of users by the blocks of similarities that were added.

    `values`: the place of a similarity column, and that of a rank column (or None) with the last rank that counts. `k`: only the best k unmarked cells of a user, earlier items win ties; 0: all unmarked cells with a similarity;
    None: marked cells with a score.
    """

    def __init__(self, q: Row, k: int | None, values: list[tuple[int, int | None, int]]) -> None:
        self.k, self.values, self.n_values = k, values, len(values)
        self.names, self.things = [_read(q[c], q["sizes"][i]) for i, c in enumerate(("users", "things"))]
        self.who, self.what, self.marked_who, self.marked_what = [np.frombuffer(q[c], "<i4") for c in ("who", "what", "marked_who", "marked_what")]
        self.kept: list[list[pd.DataFrame]] = [[] for _ in self.values]
        self.waiting = [0] * self.n_values
        self.least = [np.full(len(self.names), -np.inf) for _ in self.values]  # below it a score is not among the best k

    def _places(self, among: np.ndarray) -> np.ndarray:
        """Where the block's items are in a sorted array, -1 if they are not."""
        at = np.searchsorted(among, self.things)
        at[at == len(among)] = 0
        return np.where(among[at] == self.things, at, -1) if len(among) else np.full(len(self.things), -1)

    def add(self, v: Row) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Takes in a block of similarities; passes on (column, users, items, scores) unless the best are kept."""
        items, neighbours, begin, item, *sims = [_read(x, n) for x, n in zip(v["cells"], v["sizes"], strict=True)]
        at = self._places(neighbours)[self.what]
        mine, at = self.who[at >= 0], at[at >= 0]
        size = begin[at + 1] - begin[at]
        code = self._places(items)[self.marked_what]
        hidden = np.unique(self.marked_who[code >= 0].astype(np.int64) * len(items) + code[code >= 0])
        # tiles of whole users with about SCORE_CELLS products
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
        tile = (np.cumsum(size) - size)[first] // SCORE_CELLS
        edges = np.r_[first[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])], len(mine)] if len(mine) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = size[a:b]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[a:b]], n)
            cell = np.repeat(mine[a:b].astype(np.int64) * len(items), n) + item[entry]
            sort = np.argsort(cell)
            cell, entry = cell[sort], entry[sort]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            cell = cell[start]
            marked = np.isin(cell, hidden, assume_unique=True)
            wanted = marked if self.k is None else ~marked
            who = cell // len(items)
            read = [sim[entry] for sim in sims]
            for c, (sim, rank, last) in enumerate(self.values):
                weight = read[sim]
                empty = np.isnan(weight) if rank is None else np.isnan(weight) | ~(read[rank] <= last)
                score = np.add.reduceat(np.where(empty, 0.0, weight), start)
                fits = wanted & (np.add.reduceat(~empty, start, dtype=np.int64) > 0)
                if self.k != 0:
                    fits &= score > 0
                if self.k:
                    fits &= np.rint(score * 1e9) >= self.least[c][who]
                some = np.flatnonzero(fits)
                if self.k:
                    self._wait(c, pd.DataFrame({"who": who[some], "item": items[cell[some] % len(items)], "score": score[some]}))
                else:
                    yield c, self.names[who[some]], items[cell[some] % len(items)], score[some]
        for c in range(self.n_values if self.k else 0):
            self._keep(c, KEEP_ROWS)

    def _wait(self, c: int, found: pd.DataFrame) -> None:
        self.kept[c].append(found)
        self.waiting[c] += len(found)

    def _keep(self, c: int, more_than: int = 0) -> None:
        """Forgets all but the best if more rows wait than `more_than` and than there are users."""
        if self.waiting[c] <= min(more_than, len(self.names)):
            return
        found = pd.concat(self.kept[c], ignore_index=True)
        who, grid, item = found["who"].to_numpy(), np.rint(found["score"].to_numpy() * 1e9), pd.factorize(found["item"], sort=True)[0]
        order = np.lexsort((item, -grid, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        self.kept[c], self.waiting[c] = [found.iloc[order[place < self.k]]], 0
        last = order[place == self.k - 1]
        self.least[c][who[last]] = grid[last]

    def best(self) -> Iterator[tuple]:
        """(column, users, items, scores, ranks, rows of the user) of what is kept."""
        for c in range(self.n_values if self.k else 0):
            if self.kept[c]:
                self._keep(c, -1)
                found = self.kept[c][0]
                who = found["who"].to_numpy()
                first = np.searchsorted(who, who)
                rank, n = np.arange(len(found)) - first + 1, np.searchsorted(who, who, side="right") - first
                for a in range(0, len(found), SCORE_CELLS):
                    some = found.iloc[a : a + SCORE_CELLS]
                    yield c, self.names[some["who"]], some["item"].to_numpy(), some["score"].to_numpy(), rank[a : a + SCORE_CELLS], n[a : a + SCORE_CELLS]


def _score_blocks(
    context: DataFrame,
    sims: DataFrame,
    marks: DataFrame | None,
    users: DataFrame,
    k: int | None,
    block: int,
    values: Sequence[str | tuple[str, str, int]] = ("sim",),
) -> DataFrame:
    """(column, user, item, score) for each of the similarity columns `values` (null: no row); see `_Scores` for `k`.

    With k > 0 also rank and n, the rows of the user. A value may be (similarity column, rank column, last rank that counts).

    A sparse product by blocks. Users are hashed to blocks of about `block` users and `HELD_ROWS` held items, similarities
    by their item to blocks of about `SIM_ROWS`; both are written once, one row per block. A task holds a block of users and
    reads the similarities where they were written, one block after the other: a user's score of an item
    comes out of one block, no list of neighbours is copied to the users that hold it, and no table of scored pairs is moved. Cells
    are added up for a few users at a time by sorting. `marks`: user, item pairs of `users`.
    """
    spark = users.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((users, "user"), (sims, "item"), (context, "item"))]
    values = [(v, None, 0) if isinstance(v, str) else v for v in values]
    names = sorted({c for v in values for c in v[:2] if c})
    places = [(names.index(v), None if r is None else names.index(r), n) for v, r, n in values]
    sims = cut(sims.select("item", "neighbour", *names).filter("neighbour is not null"), "sims")
    held = context.select("user", F.col("item").alias("thing")).distinct().join(unbounded(users), "user", "left_semi")
    asked = held.select("user", "thing", F.lit(False).alias("marked"))
    if marks is not None:
        asked = asked.unionByName(marks.select("user", F.col("item").alias("thing"), F.lit(True).alias("marked")))
    asked = cut(asked.filter("user is not null and thing is not null"), "asked")
    n_users = max(1, users.count())
    n_u = max(-(-n_users // block), -(-asked.count() // HELD_ROWS), min(2 * cores, n_users))
    n_i = max(1, -(-sims.count() * len(names) // max(1, SIM_ROWS)))
    n_r = min(n_i, -(-2 * cores // n_u))  # few blocks of users: the similarities are dealt to several tasks

    def pack_users(t: pa.Table) -> pa.Table:
        users, who = _distinct(t.column("user"))
        things, what = _distinct(t.column("thing"))
        marked = t.column("marked").to_numpy().astype(bool)
        order = np.argsort(who, kind="stable")
        order, hidden = order[~marked[order]], order[marked[order]]
        sides = {"who": who[order], "what": what[order], "marked_who": who[hidden], "marked_what": what[hidden]}
        packed = {"users": array_bytes(pa.array(users, t.schema.field("user").type)), "things": array_bytes(pa.array(things, t.schema.field("thing").type))}
        row = {n: [pa.compress(x, codec="zstd", asbytes=True)] for n, x in packed.items()} | {n: [x.astype("<i4").tobytes()] for n, x in sides.items()}
        return pa.table({**row, "sizes": pa.array([[len(x) for x in packed.values()]], pa.list_(pa.int64()))})

    def pack_sims(t: pa.Table) -> pa.Table:
        items, item = _distinct(t.column("item"))
        neighbours, to = _distinct(t.column("neighbour"))
        order = np.lexsort((item, to))
        begin = np.searchsorted(to[order], np.arange(len(neighbours) + 1))
        cells = [pa.array(items, t.schema.field("item").type), pa.array(neighbours, t.schema.field("neighbour").type), pa.array(begin), pa.array(item[order].astype(np.int32))]
        cells += [pa.array(t.column(c).to_numpy().astype(float)[order]) for c in names]
        raw = [array_bytes(x) for x in cells]
        row = {"cells": pa.array([[pa.compress(x, codec="zstd", asbytes=True) for x in raw]], pa.list_(pa.binary()))}
        return pa.table({**row, "sizes": pa.array([[len(x) for x in raw]], pa.list_(pa.int64()))})

    def by(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("block")

    left = asked.groupBy(by("user", n_u)).applyInArrow(pack_users, "users binary, things binary, who binary, what binary, marked_who binary, marked_what binary, sizes array<long>")
    left = cut(left, "user-blocks")
    right = cut(sims.groupBy(by("item", n_i)).applyInArrow(pack_sims, "cells array<binary>, sizes array<long>"), "sim-blocks")
    left = left.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n_u, "at")

    def work(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple]:
        found: dict[int, _Scores] = {}
        for q, v in pairs:
            if q["at"] not in found:
                found[q["at"]] = _Scores(q, k, places)
            for c, *parts in found[q["at"]].add(v):
                yield c, *[array_bytes(pa.array(x)) for x in parts]
        for scores in found.values():
            for c, *parts in scores.best():
                yield c, *[array_bytes(pa.array(x)) for x in parts]

    parts = [("user", kinds[0]), ("item", kinds[1]), ("score", "double"), *([("rank", "long"), ("n", "long")] if k else [])]
    cells = left.rdd.cartesian(right.coalesce(n_r).rdd).mapPartitions(work)
    cells = spark.createDataFrame(cells, ", ".join(["column int", *[f"{c} binary" for c, _ in parts]]), verifySchema=False)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, *packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                columns = [bytes_array(x) for x in packed]
                for a in range(0, len(columns[0]), LIST_ROWS):
                    some = [x.slice(a, LIST_ROWS) for x in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), c, np.int32)), *some], ["column", *[n for n, _ in parts]])

    out = cells.mapInArrow(unpack, ", ".join(["column int", *[f"{c} {kind}" for c, kind in parts]]))
    if not k:
        return out
    if n_r == 1:  # a user's rows are all there if one task read all similarities
        return out.withColumn("rank", F.col("rank").cast("int"))
    every = Window.partitionBy("column", "user")
    return topk(out.drop("rank"), k, ("column", "user")).withColumn("n", F.count(F.lit(1)).over(every))


def itemknn_topk(
    context: DataFrame, sims: DataFrame, users: DataFrame, seen: DataFrame, k: int = 20, block: int = USER_BLOCK
) -> DataFrame:
    """(user, item, score, rank, n): the best `k` unseen items with a score for each of `users`; n is the rows of the user."""
    users = users.select("user").distinct()
    hidden = seen.select("user", "item").join(unbounded(users), "user", "left_semi")
    return _score_blocks(context, sims, hidden, users, k, block).drop("column")


def itemknn_topk_by(
    context: DataFrame,
    sims: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    values: Sequence[str | tuple[str, str, int]],
    k: int = 20,
    block: int = USER_BLOCK,
) -> DataFrame:
    """(column, user, item, score, rank, n): the best `k` unseen items of each user by each of the similarity columns
    `values`, numbered from 0; null similarities are left out. A value may be (similarity column, rank column, last rank
    that counts). The columns share the product's work."""
    users = users.select("user").distinct()
    hidden = seen.select("user", "item").join(unbounded(users), "user", "left_semi")
    return _score_blocks(context, sims, hidden, users, k, block, values)


def itemknn_pairs(context: DataFrame, sims: DataFrame, pairs: DataFrame, block: int = USER_BLOCK) -> DataFrame:
    """(user, item, score) of the given `pairs` (user, item) only; a pair without a row scores 0."""
    pairs = pairs.select("user", "item").distinct()
    return _score_blocks(context, sims, pairs, pairs.select("user").distinct(), None, block).drop("column")


def costar_neighbours(
    pairs: DataFrame, k: int = 10, shrink: float = 30.0, min_shared: int = 2
) -> DataFrame:
    """(item, neighbour, co, rank): top `k` first, then only those sharing enough users."""
    half = cooccurrence(pairs, degrees=True).withColumn("sim", cosine(F.lit(shrink), 0.0))
    return nearest(both_ways(half, "sim", "co"), k).filter(F.col("co") >= min_shared)


def fill_topk(
    scores: DataFrame,
    users: DataFrame,
    seen: DataFrame,
    index: DataFrame,
    k: int = 20,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Top-k over the whole catalog when every item without a row in `scores` counts 0.

    `scores` holds positive, unseen items. A user with fewer than `k` of them gets the lowest
    unseen item ids; these lie inside the first k + seen + scored ids, so only that prefix of
    `index` (item, rank by id) is matched. `users` holds by... and user. Scores that have `rank` and n, the rows of their
    user, are not ranked again.
    """
    keys = [*by, "user"]
    if not {"rank", "n"} <= set(scores.columns):
        scores = topk(scores.drop("rank", "n"), k, tuple(keys)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    top = scores.filter(F.col("rank") <= k)
    top = cut(top.select(*keys, "item", "score", "rank", F.least("n", F.lit(k)).alias("c")), "top")  # read four times below
    counts = top.filter("rank = 1").select(*keys, "c")
    seen_n = seen.groupBy("user").agg(F.count(F.lit(1)).alias("s"))
    short = (
        users.select(*keys)
        .distinct()
        .join(unbounded(counts), keys, "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .filter(F.col("c") < k)
        .join(unbounded(seen_n), "user", "left")
        .select(*keys, "c", (F.coalesce("s", F.lit(0)) + k).alias("need"))
    )
    # a short user has fewer than k scored items, all of them in `top`
    extra = (
        count_up(short, "need", "rank")
        .select(*keys, "c", "rank")
        .join(unbounded(index.select("item", "rank")), "rank")
        .drop("rank")
        .join(unbounded(seen.select("user", "item")), ["user", "item"], "left_anti")
        .join(unbounded(top.filter(F.col("c") < k).select(*keys, "item")), [*keys, "item"], "left_anti")
    )
    w = Window.partitionBy(*keys).orderBy("item")
    extra = (
        extra.withColumn("slot", F.row_number().over(w))
        .filter(F.col("slot") <= k)
        .withColumn("rank", (F.col("slot") + F.col("c")).cast("int"))
        .filter(F.col("rank") <= k)
        .select(*keys, "item", F.lit(0.0).alias("score"), "rank")
    )
    return top.select(*keys, "item", "score", "rank").unionByName(extra)
