"""Implicit matrix factorisation: fit and top-k of unseen items."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import quantize
from tastemill.operators.features import dense_ids
from tastemill.operators.labels import select_pos
from tastemill.operators.search import topk
from tastemill.schema import ITEM, RANK, USER
from tastemill.session import ensure_checkpoint_dir, stored


#: User and item blocks at least, and factors of 64 numbers that a block receives in a half iteration at most (expected).
BLOCKS, RECEIVED = 10, 1_250_000


def block_number(ratings: int, users: int, items: int, rank: int) -> int:
    """The smallest number of blocks, BLOCKS at least, for which a block's ratings name about RECEIVED ids of the other side at most.

    A task holds the factors of all ids that its block names. Up to 60 times sf0.1 this is BLOCKS.
    """
    most = RECEIVED * 64 / max(1, rank)

    def named(blocks: int, ids: int) -> float:
        return -ids * math.expm1(-ratings / (blocks * ids)) if ids else 0.0

    blocks = BLOCKS
    while max(named(blocks, users), named(blocks, items)) > most:
        blocks += max(1, blocks // 16)
    return blocks


@dataclass(frozen=True)
class AlsFit:
    model: ALSModel
    users: DataFrame  # user_id, u
    items: DataFrame  # item_id, i


def als_fit(
    df: DataFrame,
    rank: int = 64,
    reg: float = 3.01,
    iterations: int = 9,
    alpha: float = 1.0,
    weight: str | None = None,
    quant: int = 5,
    seed: int = 0,
    blocks: int | None = None,
) -> AlsFit:
    """Implicit ALS. Weight 1 per interaction, or a column floored to steps of `quant`.

    Ids become dense 32-bit numbers first. Spark multiplies `reg` by the number of ratings. `blocks` is the number
    of user and of item blocks, on which the result of a seed depends; None: see `block_number`.
    Every half iteration shuffles factors to up to `blocks` blocks. Item factors are checkpointed in each iteration, which
    lets Spark drop the shuffles behind them; else those of many iterations lie on disk at a time.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = select_pos(df)
    value = F.lit(1.0) if weight is None else quantize(weight, quant).cast("float")
    users = stored(dense_ids(rows, USER, "u"))
    items = stored(dense_ids(rows, ITEM, "i"))
    ratings = (
        rows.select(USER, ITEM, value.alias("rating"))
        .join(users, USER)
        .join(items, ITEM)
        .select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float"))
    )
    ratings = stored(ratings)
    if blocks is None:
        blocks = block_number(ratings.count(), users.count(), items.count(), rank)
    als = ALS(
        rank=rank,
        regParam=reg,
        maxIter=iterations,
        alpha=alpha,
        implicitPrefs=True,
        userCol="u",
        itemCol="i",
        ratingCol="rating",
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=1,
        coldStartStrategy="drop",
    )
    return AlsFit(als.fit(ratings), users, items)


def factors(fit: AlsFit, side: str, keys: DataFrame | None = None) -> DataFrame:
    """(id, vec) of the users or items of a fit."""
    key, code, table, ids = (
        (USER, "u", fit.model.userFactors, fit.users) if side == "user" else (ITEM, "i", fit.model.itemFactors, fit.items)
    )
    if keys is not None:
        ids = ids.join(keys.select(key).distinct(), key, "left_semi")
    return table.join(ids, table["id"] == ids[code]).select(key, F.col("features").alias("vec"))


def als_recommend(fit: AlsFit, users: DataFrame, seen: DataFrame | None, k: int = 10) -> DataFrame:
    """Top k items per user without the seen ones, which leave before the k best are taken."""
    items = factors(fit, "item").withColumn("bias", F.lit(0.0))
    return topk(factors(fit, "user", users), items, k, seen)


def als_similar_items(fit: AlsFit, items: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, similar_item_id, score, rank): the n items of largest cosine between factor vectors."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = factors(fit, "item").withColumn("_norm", norm).filter(F.col("_norm") > 0)
    unit = stored(unit.select(ITEM, F.transform("vec", lambda x: x.cast("double") / F.col("_norm")).alias("vec")))
    given = unit.join(items.select(ITEM).distinct(), ITEM, "left_semi").withColumnRenamed(ITEM, USER)
    itself = given.select(USER, F.col(USER).alias(ITEM))
    found = topk(given, unit.withColumn("bias", F.lit(0.0)), n, itself)
    return found.select(F.col(USER).alias(ITEM), F.col(ITEM).alias("similar_item_id"), "score", RANK)
