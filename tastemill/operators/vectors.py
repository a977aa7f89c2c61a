"""Exact top-k between two vector tables, in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import as_doubles, euclidean, steady
from tastemill.operators.blocks import top_per_group
from tastemill.schema import ITEM, RANK, USER
from tastemill.session import stored

#: Rows of a packed block, numbers of a wide one, and pairs that a task scores at once.
BLOCK, WIDE, CELLS = 1024, 1 << 22, 1 << 22


def _blocked(df: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def block_count(df: DataFrame, block: int = BLOCK) -> int:
    return max(1, -(-df.count() // block))


def tile_scores(users, x, items, y, bias, seen_users, seen_items, k: int, metric: str) -> pd.DataFrame:
    """(user_id, item_id, score): the k best of a tile for each user but the seen pairs; scores lie on a grid.

    About CELLS pairs are scored at a time. The k-th highest of the maxima of short strips of items is no higher than a
    user's k-th score, so only the pairs that reach it are sorted.
    """
    # Ascending ids break ties by id, and let pairs be looked up.
    rows, columns = np.argsort(users), np.argsort(items)
    users, items, x, y, bias = users[rows], items[columns], x[rows], y[columns], bias[columns]
    n, m = len(users), len(items)
    hit_rows = hit_columns = np.zeros(0, np.int64)
    if seen_users is not None and n and m:
        r, c = np.searchsorted(users, seen_users), np.searchsorted(items, seen_items)
        r, c = np.minimum(r, n - 1), np.minimum(c, m - 1)
        hit = (users[r] == seen_users) & (items[c] == seen_items)
        order = np.argsort(r[hit], kind="stable")
        hit_rows, hit_columns = r[hit][order], c[hit][order]
    grid = 1e6 if metric == "l2" else 1e9
    squares = (y * y).sum(1)[None, :] if metric == "l2" else None
    strips = np.arange(0, m, max(1, m // (4 * k)))
    step = max(1, CELLS // max(m, 1))
    found = []
    for start in range(0, n if m else 0, step):
        part = x[start : start + step]
        scores = part @ y.T
        if metric == "l2":
            scores = -np.sqrt(np.maximum((part * part).sum(1)[:, None] + squares - 2.0 * scores, 0.0))
        else:
            scores += bias[None, :]
        low, high = np.searchsorted(hit_rows, (start, start + step))
        scores[hit_rows[low:high] - start, hit_columns[low:high]] = -np.inf
        if m > k:
            best = np.maximum.reduceat(scores, strips, axis=1)
            if np.isnan(best).any():
                scores[np.isnan(scores)] = -np.inf
                best = np.maximum.reduceat(scores, strips, axis=1)
            floor = np.partition(best, best.shape[1] - k, axis=1)[:, -k]
            # What lies on the same step of the grid may win by its id.
            floor -= np.where(np.isfinite(floor), 1.1 / grid + 1e-15 * np.abs(floor), 0.0)
            r, c = np.nonzero(scores >= floor[:, None])
        else:
            r, c = (at.ravel() for at in np.indices(scores.shape))
        s = scores[r, c]
        s = -np.floor(-s * grid + 0.5) / grid if metric == "l2" else np.floor(s * grid + 0.5) / grid
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.searchsorted(r, np.arange(len(part)))
        kept = (np.arange(len(r)) - first[r] < k) & np.isfinite(s)
        found.append((users[start + r[kept]], items[c[kept]], s[kept]))
    u, i, s = (np.concatenate(z) for z in zip(*found)) if found else (users[:0], items[:0], np.zeros(0))
    return pd.DataFrame({USER: u, ITEM: i, "score": s})


def wide_block(left_rows: int, right_rows: int, width: int, tiles: int) -> int:
    """Rows of a block such that there are about `tiles` pairs of blocks, but a block has at most WIDE numbers."""
    even = math.isqrt(max(1, left_rows * right_rows // max(1, tiles)))
    return max(1, min(max(even, BLOCK), WIDE // max(1, width)))


def block_topk(
    left: DataFrame,
    right: DataFrame,
    k: int,
    seen: DataFrame | None = None,
    metric: str = "dot",
    block: int | None = BLOCK,
) -> DataFrame:
    """(user_id, item_id, score, rank): the k best right vectors of every left vector.

    `left` is (user_id, vec), `right` (item_id, vec, bias). A task scores one pair of blocks, of about `block` rows each,
    with matrix products and returns k rows per left vector, so neither side is collected, and `seen` pairs leave before
    the k best are taken. Vectors, packed by about BLOCK, and seen pairs are shuffled once to their pairs of blocks: rows
    of one side times blocks of the other, so large blocks (`block` None: see `wide_block`) move less.
    """
    left, right = stored(left), stored(right)
    if block is None:
        sides = left.count(), right.count()
        width = max((r[0] or 0 for r in left.select(F.size("vec")).limit(1).collect()), default=1)
        block = wide_block(*sides, width, 4 * left.sparkSession.sparkContext.defaultParallelism)
        nl, nr = (max(1, -(-n // block)) for n in sides)
    else:
        nl, nr = block_count(left, block), block_count(right, block)
    # Factors of single precision travel as such and are widened in the task.
    single = all("array<float>" == f.schema["vec"].dataType.simpleString() for f in (left, right))
    number = "float" if single else "double"
    pieces = max(1, -(-block // BLOCK))

    def packed(df: DataFrame, key: str, blocks: int, name: str, other: str, others: int, side: int) -> DataFrame:
        bias = F.col("bias").cast("double") if "bias" in df.columns else F.lit(0.0)
        piece = F.pmod(F.xxhash64(F.lit(1), key), F.lit(pieces)).alias("_piece")
        rows = _blocked(df, key, blocks, name).groupBy(name, piece).agg(
            F.collect_list(key).alias("_ids"),
            F.flatten(F.collect_list(F.col("vec").cast(f"array<{number}>"))).alias("_x"),
            F.collect_list(bias).alias("_bias"),
        )
        spread = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return spread.select("_l", "_r", F.lit(side).alias("_side"), "_ids", "_x", "_bias", F.lit(None).cast("array<bigint>").alias("_seen"))

    work = packed(left, USER, nl, "_l", "_r", nr, 0).union(packed(right, ITEM, nr, "_r", "_l", nl, 1))
    if seen is not None:
        pairs = seen.select(USER, ITEM).filter(f"{USER} is not null and {ITEM} is not null")
        pairs = _blocked(_blocked(pairs, USER, nl, "_l"), ITEM, nr, "_r")
        known = pairs.groupBy("_l", "_r").agg(F.collect_list(USER).alias("_ids"), F.collect_list(ITEM).alias("_seen"))
        none = (F.lit(None).cast(t).alias(c) for c, t in (("_x", f"array<{number}>"), ("_bias", "array<double>")))
        work = work.union(known.select("_l", "_r", F.lit(2), "_ids", *none, "_seen"))

    def score_tile(tile: pa.Table) -> pa.Table:
        side = tile["_side"].to_numpy()

        def flat(name: str, which: int) -> np.ndarray:
            rows = tile[name].filter(pa.array(side == which)).combine_chunks()
            return rows.flatten().to_numpy(zero_copy_only=False)

        users, items = flat("_ids", 0), flat("_ids", 1)
        empty = not len(users) or not len(items)
        x, y = (np.zeros((0, 1)) if empty else flat("_x", s).astype(np.float64).reshape(len(i), -1) for s, i in ((0, users), (1, items)))
        found = tile_scores(
            users[:0] if empty else users, x, items[:0] if empty else items, y, flat("_bias", 1)[: 0 if empty else None],
            flat("_ids", 2), flat("_seen", 2), k, metric,
        )
        columns = [found[USER].to_numpy(np.int64), found[ITEM].to_numpy(np.int64), found["score"].to_numpy(np.float64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=[USER, ITEM, "score"])

    scored = work.groupBy("_l", "_r").applyInArrow(score_tile, f"{USER} bigint, {ITEM} bigint, score double")
    best = top_per_group(scored, [USER], [F.desc("score"), F.asc(ITEM)], k)
    return best.withColumn("score", -F.col("score")) if metric == "l2" else best


def distances(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distance of every query to every vector. The queries are packed into blocks of at most
    about BLOCK rows and each vector meets a block once; the output has queries x vectors rows."""
    blocks = block_count(queries)
    packed = (
        _blocked(queries.select(USER, as_doubles("vec").alias("vec")), USER, blocks, "_q")
        .groupBy("_q")
        .agg(F.collect_list(F.struct(F.col(USER), F.col("vec").alias("_query"))).alias("_queries"))
    )
    spread = vectors.select(ITEM, as_doubles("vec").alias("vec")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    met = spread.join(packed, "_q").select(ITEM, "vec", F.explode("_queries").alias("_one"))
    return met.select(
        f"_one.{USER}", ITEM, steady(euclidean("vec", "_one._query"), 6).alias("distance")
    )


def distance_profile(dist: DataFrame) -> DataFrame:
    """Smallest, quartile and largest distance per query."""
    return dist.groupBy(USER).agg(
        F.count("*").alias("n"),
        F.min("distance").alias("min"),
        F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.max("distance").alias("max"),
    ).select(
        USER,
        "n",
        "min",
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q75"),
        "max",
    )


def describe_items(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Attributes of the retrieved items."""
    return recs.join(items, ITEM)


def triplet_loss(triplets: DataFrame, users: DataFrame, items: DataFrame, margin: float = 0.5) -> DataFrame:
    """Mean of max(d(user, positive) - d(user, negative) + margin, 0) over the triplets.

    `users` is (user_id, vec), `items` (item_id, vec).
    """
    u = users.select(USER, as_doubles("vec").alias("_u"))
    p = items.select(F.col(ITEM).alias("pos_item"), as_doubles("vec").alias("_p"))
    n = items.select(F.col(ITEM).alias("neg_item"), as_doubles("vec").alias("_n"))
    near = triplets.join(u, USER).join(p, "pos_item").withColumn("_dp", euclidean("_u", "_p")).drop("_p")
    both = near.join(n, "neg_item")
    loss = F.greatest(F.col("_dp") - euclidean("_u", "_n") + F.lit(margin), F.lit(0.0))
    return both.agg(F.avg(loss).alias("loss"), F.count("*").alias("triplets"))


def embed(df: DataFrame, weights: dict[str, np.ndarray], batch_col: str = ITEM) -> DataFrame:
    """Apply a small feed-forward entity model to (id, vec, features) rows.

    weights: w_feat, b_feat (features to hidden), w_hid, b_hid (concatenated to hidden), w_out
    (hidden to output, no bias). Normalisation layers are folded into the weights. The id vectors
    are a column, so only the layer weights travel with the task.
    """
    need = {"w_feat", "b_feat", "w_hid", "b_hid", "w_out"}
    if set(weights) != need:
        raise ValueError(f"weights must be {sorted(need)}")
    layer = {name: np.asarray(value, dtype=np.float64) for name, value in weights.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vec = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            feats = np.stack(batch["features"].to_numpy()).astype(np.float64)
            hidden = feats @ layer["w_feat"] + layer["b_feat"]
            hidden = np.concatenate([vec, hidden], axis=1) @ layer["w_hid"] + layer["b_hid"]
            # GELU in its exact form.
            erf = np.frompyfunc(math.erf, 1, 1)(hidden / np.sqrt(2.0)).astype(np.float64)
            out = (0.5 * hidden * (1.0 + erf)) @ layer["w_out"]
            yield pd.DataFrame({batch_col: batch[batch_col], "vec": list(out.astype(np.float32))})

    return df.select(batch_col, "vec", "features").mapInPandas(run, f"{batch_col} bigint, vec array<float>")
