"""Exact top-k between two vector tables that skips the blocks whose bound is below what a row has found."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import as_doubles
from tastemill.operators.blocks import ordinal_rank, top_per_group
from tastemill.operators.vectors import BLOCK, block_count, block_topk, tile_scores
from tastemill.schema import ITEM, RANK, USER
from tastemill.session import stored

#: Directions (or places, for distances) around which rows are gathered: at most so many rows reach the driver.
PIVOTS = 256
#: Balls that a block of users is compared with at once, and blocks that are scored first for a user's floor.
CHUNK, SEEDS = 2048, 2
#: Users of a block at most (nearly: they are dealt out by a hash), and bounds that are worked out at once.
USERS, AT_ONCE = 1024, 1 << 20
#: Blocks of items at least: the first blocks of a few large ones are a large share of all pairs.
LEAST = 50
#: With fewer item blocks than this everything is scored.
WORTH = 4
#: In `topk`: if the bounds leave more than this share of all pairs, all is scored, in wide blocks.
SPARED = 0.5


@dataclass(frozen=True)
class Search:
    """What a search found, and one row on its work: users, items, cells (all pairs) and scored (pairs that were)."""

    found: DataFrame
    work: DataFrame


def _pivots(right: DataFrame, blocks: int, metric: str) -> np.ndarray:
    chosen = right.orderBy(F.xxhash64(ITEM), ITEM).limit(min(PIVOTS, blocks)).select("vec").collect()
    if not chosen:
        return np.zeros((0, 0))
    pivots = np.array([r["vec"] for r in chosen], np.float64)
    if metric == "l2":
        return pivots
    norms = np.linalg.norm(pivots, axis=1, keepdims=True)
    return np.divide(pivots, norms, out=np.zeros_like(pivots), where=norms > 0)


def _with_cell(df: DataFrame, key: str, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add `_cell` (the pivot of the same direction, or the nearest one) and `_norm`."""
    more = [c for c in df.columns if c not in (key, "vec")]
    half = 0.5 * (pivots * pivots).sum(axis=1) if metric == "l2" else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_numpy())
                batch["_cell"] = np.argmax(x @ pivots.T - half, axis=1).astype(np.int32)
                batch["_norm"] = np.linalg.norm(x, axis=1)
                yield batch

    extra = "".join(f", {c} double" for c in more)
    return df.select(key, "vec", *more).mapInPandas(run, f"{key} bigint, vec array<double>{extra}, _cell int, _norm double")


def _packed(df: DataFrame, key: str, by: str, more: tuple[str, ...]) -> DataFrame:
    """One row a block: its ids in order, their flat vectors and the columns `more`, each as a list."""
    rows = F.array_sort(F.collect_list(F.struct(key, "vec", *more)))
    packed = df.groupBy(by).agg(rows.alias("_rows"))
    return packed.select(by, F.col(f"_rows.{key}").alias("_ids"), F.flatten("_rows.vec").alias("_x"), *(F.col(f"_rows.{m}").alias(m) for m in more))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; a list is a view of the batch's numbers, or None."""
    columns = []
    for column in batch.columns:
        if pa.types.is_list(column.type):
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            columns.append([values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)])
        else:
            columns.append(column.to_pylist())
    yield from zip(*columns)


def _balls(packed: DataFrame) -> DataFrame:
    """(_r, center, radius, norm, top, n): a ball that holds the block, its largest norm and bias, its size."""

    names = ["_r", "center", "radius", "norm", "top", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, ids, flat, bias in _rows(batch):
                x = flat.reshape(len(ids), -1)
                center = x.mean(axis=0)
                radius = np.sqrt(((x - center) ** 2).sum(axis=1).max())
                out.append((block, center.tolist(), float(radius), float(np.linalg.norm(x, axis=1).max()), float(bias.max()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    schema = "_r bigint, center array<double>, radius double, norm double, top double, n bigint"
    return packed.select("_r", "_ids", "_x", "bias").mapInArrow(run, schema)


def bounds(x: np.ndarray, center: np.ndarray, radius: np.ndarray, norm: np.ndarray, top: np.ndarray, metric: str) -> np.ndarray:
    """For each row of x and each ball: no vector in the ball scores higher. Rounding errors are allowed for."""
    if metric == "l2":
        far = (x * x).sum(1)[:, None] + (center * center).sum(1)[None, :] - 2.0 * (x @ center.T)
        scale = np.sqrt((x * x).sum(1))[:, None] + norm[None, :]
        return -np.maximum(np.sqrt(np.maximum(far, 0.0)) - radius[None, :] - 1e-6 * (1 + scale), 0.0) + 2e-6
    size = np.linalg.norm(x, axis=1)[:, None]
    best = np.minimum(x @ center.T + size * radius[None, :], size * norm[None, :])
    return best + top[None, :] + 1e-9 * (2 + size * norm[None, :])


def _bounds_in_turn(ids, x, centers, radius, norm, top, metric: str) -> Iterator[tuple[slice, np.ndarray]]:
    """`bounds` of a block of users and a chunk of balls, about AT_ONCE numbers at a time: (which balls, their columns)."""
    x, centers = x.reshape(len(ids), -1), centers.reshape(len(radius), -1)
    step = max(1, AT_ONCE // len(ids))
    for start in range(0, len(radius), step):
        at = slice(start, start + step)
        yield at, bounds(x, centers[at], radius[at], norm[at], top[at], metric)


def _dealt_users(left: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """(user, vec, _l): the users of a cell dealt into blocks of about USERS, however many the cell has."""
    celled = stored(_with_cell(left, USER, pivots, metric).select(USER, "vec", "_cell"))
    # One row a pivot.
    counts = {r["_cell"]: r["n"] for r in celled.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    parts = np.array([-(-counts.get(c, 0) // USERS) for c in range(len(pivots))], np.int64)
    first = np.cumsum(parts) - parts
    at = F.col("_cell") + 1
    part = F.pmod(F.xxhash64(USER), F.element_at(F.lit(np.maximum(parts, 1)), at))
    return stored(celled.select(USER, "vec", (F.element_at(F.lit(first), at) + part).alias("_l")))


def _chunked(balls: DataFrame, n: int) -> tuple[DataFrame, int]:
    chunks = max(1, -(-n // CHUNK))
    dealt = balls.withColumn("_chunk", F.pmod(F.xxhash64("_r"), F.lit(chunks)).cast("int"))
    lists = [F.col(f"_b.{c}").alias(f"_b_{c}") for c in ("_r", "radius", "norm", "top", "n")]
    packed = dealt.groupBy("_chunk").agg(F.collect_list(F.struct("_r", "center", "radius", "norm", "top", "n")).alias("_b"))
    return packed.select("_chunk", F.flatten("_b.center").alias("_b_center"), *lists), chunks


def _each_chunk(users: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    return users.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(chunks, "_chunk").drop("_chunk")


def _seed_pairs(users: DataFrame, chunks: DataFrame, n: int, metric: str, seeds: int = SEEDS) -> DataFrame:
    """(_l, _r): for each block of users the blocks of each chunk with the highest mean bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, ids, x, centers, blocks, radius, norm, top in _rows(batch):
                turns = _bounds_in_turn(ids, x, centers, radius, norm, top, metric)
                best = np.lexsort((blocks, -np.concatenate([high.mean(axis=0) for _, high in turns])))[:seeds]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), left)), pa.array(blocks[best])], names=["_l", "_r"])

    met = _each_chunk(users.select("_l", "_ids", "_x"), chunks, n)
    cols = ["_l", "_ids", "_x", "_b_center", "_b__r", "_b_radius", "_b_norm", "_b_top"]
    return met.select(*cols).mapInArrow(run, "_l bigint, _r bigint")


def _left(users: DataFrame, chunks: DataFrame, n: int, metric: str) -> int:
    """How many pairs the floors leave to be scored: users of a block times items of a block that one of them may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = 0
            for ids, x, floor, centers, radius, norm, top, sizes in _rows(batch):
                for at, high in _bounds_in_turn(ids, x, centers, radius, norm, top, metric):
                    cells += int((high >= floor[:, None]).sum(axis=0) @ sizes[at])
            yield pa.RecordBatch.from_arrays([pa.array([cells])], names=["cells"])

    met = _each_chunk(users.select("_l", "_ids", "_x", "_floor"), chunks, n)
    cols = ["_ids", "_x", "_floor", "_b_center", "_b_radius", "_b_norm", "_b_top", "_b_n"]
    return met.select(*cols).mapInArrow(run, "cells bigint").agg(F.sum("cells")).first()[0] or 0


def _needed(users: DataFrame, chunks: DataFrame, n: int, metric: str) -> DataFrame:
    """(_l, _r, _at): places of the users in a block whose floor a block of items may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, ids, x, floor, centers, blocks, radius, norm, top in _rows(batch):
                for part, high in _bounds_in_turn(ids, x, centers, radius, norm, top, metric):
                    ball, at = np.nonzero((high >= floor[:, None]).T)
                    some, first = np.unique(ball, return_index=True)
                    if len(some):
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ball)), pa.int32()), pa.array(at, pa.int32()))
                        made = [pa.array(np.full(len(some), left)), pa.array(blocks[part][some]), lists]
                        yield pa.RecordBatch.from_arrays(made, names=["_l", "_r", "_at"])

    met = _each_chunk(users.select("_l", "_ids", "_x", "_floor"), chunks, n)
    cols = ["_l", "_ids", "_x", "_floor", "_b_center", "_b__r", "_b_radius", "_b_norm", "_b_top"]
    return met.select(*cols).mapInArrow(run, "_l bigint, _r bigint, _at array<int>")


def _score(pairs: DataFrame, users: DataFrame, items: DataFrame, known: DataFrame | None, k: int, metric: str) -> DataFrame:
    """The k best of each user in each pair of blocks; with `_at` only for the users named there."""
    left = users.select("_l", F.col("_ids").alias("_users"), "_x")
    right = items.select("_r", F.col("_ids").alias("_items"), F.col("_x").alias("_y"), F.col("bias").alias("_bias"))
    work = pairs.join(left, "_l").join(right, "_r")
    none = F.lit(None).cast("array<bigint>")
    work = work.join(known, ["_l", "_r"], "left") if known is not None else work.withColumns({"_seen_users": none, "_seen_items": none})
    at = F.col("_at") if "_at" in pairs.columns else F.lit(None).cast("array<int>")
    work = work.select("_users", "_x", "_items", "_y", "_bias", "_seen_users", "_seen_items", at.alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for users, x, items, y, bias, seen_users, seen_items, at in _rows(batch):
                x = x.reshape(len(users), -1)
                if at is not None:
                    users, x = users[at], x[at]
                found = tile_scores(users, x, items, y.reshape(len(items), -1), bias, seen_users, seen_items, k, metric)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return work.mapInArrow(run, f"{USER} bigint, {ITEM} bigint, score double")


def bounded_search(
    left: DataFrame,
    right: DataFrame,
    k: int,
    seen: DataFrame | None = None,
    metric: str = "dot",
    block: int = BLOCK,
    spared: float | None = None,
) -> Search | None:
    """As `block_topk`: the k best right vectors of every left vector, `seen` pairs left out, with what it took.

    Rows are gathered around pivots, and a pivot's items are cut into blocks in falling norm. A block is bounded by a
    ball and by its largest norm: u.v is at most u.c + |u| r and |u| |v| (a distance is at least |u - c| - r). Each
    block of users first meets the blocks with the highest bounds (SEEDS, or more if they are small), which gives each user a floor: the score of the
    k-th best so far. A block of items is scored again only with those users whose bound is not below their floor, so
    nothing is lost. Vectors of one length without direction in common have no bound that helps, and all is scored.

    With `spared` the search gives up (None) where the bounds leave more than that share of all pairs to be scored: wide
    blocks do that with less to shuffle.

    The balls (one row a block) meet blocks of users in chunks; neither side is collected, but PIVOTS rows.
    """
    left = stored(left.select(USER, as_doubles("vec").alias("vec")))
    right = stored(right.select(ITEM, as_doubles("vec").alias("vec"), F.col("bias").cast("double").alias("bias")))
    block = min(block, block_count(right, LEAST))
    # Small blocks: enough of them for twice the k best, or hardly a user gets a floor.
    first_blocks = max(SEEDS, -(-2 * k // block))
    pivots = _pivots(right, block_count(right, block), metric)
    if not len(pivots):
        empty = left.sparkSession.createDataFrame([], f"{USER} bigint, {ITEM} bigint, score double, {RANK} bigint")
        return Search(empty, left.agg(F.count("*").alias("users"), *(F.lit(0).cast("bigint").alias(c) for c in ("items", "cells", "scored"))))

    celled = ordinal_rank(_with_cell(right, ITEM, pivots, metric), [F.desc("_norm"), F.asc(ITEM)], "_place", within=("_cell",))
    number = F.floor((F.col("_place") - 1) / block)
    celled = celled.withColumn("_r", F.col("_cell").cast("bigint") + number * len(pivots))
    item_block = stored(celled.select(ITEM, "vec", "bias", "_r"))
    items = stored(_packed(item_block, ITEM, "_r", ("bias",)))
    balls = stored(_balls(items))
    chunks, n = _chunked(balls, balls.count())
    chunks = stored(chunks)

    own = _dealt_users(left, pivots, metric)
    users = stored(_packed(own, USER, "_l", ()))
    known = None
    if seen is not None:
        pairs = seen.select(USER, ITEM).join(own.select(USER, "_l"), USER).join(item_block.select(ITEM, "_r"), ITEM)
        lists = [F.collect_list(c).alias(a) for c, a in ((USER, "_seen_users"), (ITEM, "_seen_items"))]
        known = stored(pairs.groupBy("_l", "_r").agg(*lists))

    seeds = stored(_seed_pairs(users, chunks, n, metric, first_blocks))
    first = stored(_score(seeds, users, items, known, k, metric))
    best = top_per_group(first, [USER], [F.desc("score"), F.asc(ITEM)], k)
    floors = best.filter(F.col(RANK) == k).select(USER, F.col("score").alias("_floor"))
    floored = own.join(floors, USER, "left").withColumn("_floor", F.coalesce("_floor", F.lit(float("-inf"))))
    floored = _packed(floored, USER, "_l", ("_floor",))
    if spared is not None:
        floored = stored(floored)
        if _left(floored, chunks, n, metric) > spared * left.count() * right.count():
            return None
    needed = _needed(floored, chunks, n, metric)
    needed = stored(needed.join(seeds, ["_l", "_r"], "left_anti"))
    more = _score(needed, users, items, known, k, metric)
    found = top_per_group(first.union(more), [USER], [F.desc("score"), F.asc(ITEM)], k)
    found = found.withColumn("score", -F.col("score")) if metric == "l2" else found

    sizes = users.select("_l", F.size("_ids").alias("_n"))
    pairs = seeds.join(sizes, "_l").select("_r", "_n").union(needed.select("_r", F.size("_at").alias("_n")))
    scored = pairs.join(balls.select("_r", "n"), "_r").agg(F.coalesce(F.sum(F.col("_n") * F.col("n")), F.lit(0)).alias("scored"))
    work = left.agg(F.count("*").alias("users")).withColumns({
        "items": balls.agg(F.sum("n")).scalar(),
        "cells": F.col("users") * balls.agg(F.sum("n")).scalar(),
        "scored": scored.scalar(),
    })
    return Search(found, work)


def topk(left: DataFrame, right: DataFrame, k: int, seen: DataFrame | None = None, metric: str = "dot", block: int = BLOCK) -> DataFrame:
    """(user_id, item_id, score, rank): the k best right vectors of every left vector, `seen` pairs left out."""
    left, right = stored(left), stored(right)
    if block_count(right, block) < WORTH:
        return block_topk(left, right, k, seen, metric, None)
    found = bounded_search(left, right, k, seen, metric, block, SPARED)
    return block_topk(left, right, k, seen, metric, None) if found is None else found.found


def nearest(queries: DataFrame, vectors: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """The n vectors nearest to each query by Euclidean distance.

    `queries` is (user_id, vec), `vectors` (item_id, vec).
    """
    found = topk(queries, vectors.withColumn("bias", F.lit(0.0)), n, metric="l2", block=block)
    return found.select(USER, ITEM, F.col("score").alias("distance"), RANK)
