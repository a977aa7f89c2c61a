"""Item-to-item neighbour recommenders with cosine, TF-IDF and BM25 weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import steady
from tastemill.operators.blocks import (
    attach_by_key,
    attach_totals,
    top_per_group,
)
from tastemill.operators.labels import select_pos
from tastemill.operators.tiles import PIECE, grid, pair_sums
from tastemill.schema import ITEM, RANK, USER
from tastemill.session import stored

#: Rows of an item in the histories above which its list of neighbours is salted.
HOT = 100_000
BM25_K1 = 1.2
BM25_B = 0.75
WEIGHTINGS = ("cosine", "tfidf", "bm25")


def _weight_parts(df: DataFrame, weighting: str, weight: str | None, by: list[str]) -> DataFrame:
    """(user, item, w, f): the weight of an interaction is w * f, and f is the same in all rows of a user."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting!r}")
    x = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = select_pos(df).select(*by, USER, ITEM, x.alias("_x"))
    value: Column = F.col("_x")
    if weighting != "cosine":
        users = rows.groupBy(*by, USER).agg(F.count("*").alias("_items_of_user"))
        items = rows.groupBy(*by, ITEM).agg(F.sum("_x").alias("_len"))
        totals = items.groupBy(*by).agg(
            F.count("*").cast("double").alias("_items"), F.avg("_len").alias("_avg_len")
        )
        rows = attach_by_key(rows, users, [*by, USER])
        rows = attach_totals(rows, totals, by)
        idf = F.ln(F.col("_items") / (1 + F.col("_items_of_user")))
        if weighting == "tfidf":
            value = F.sqrt("_x") * idf
        else:
            rows = attach_by_key(rows, items, [*by, ITEM])
            scale = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / F.col("_avg_len"))
            value = F.col("_x") * (BM25_K1 + 1) / (F.col("_x") + scale)
            return rows.select(*by, USER, ITEM, value.alias("w"), idf.alias("f"))
    rows = rows.select(*by, USER, ITEM, value.alias("w"))
    norms = rows.groupBy(*by, ITEM).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")
    )
    value = F.coalesce(F.try_divide("w", "_norm"), F.lit(0.0))
    return attach_by_key(rows, norms, [*by, ITEM]).select(*by, USER, ITEM, value.alias("w"), F.lit(1.0).alias("f"))


def knn_weights(
    df: DataFrame, weighting: str, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(user, item, w): the weight of each interaction, unit length per item except for BM25.

    Items are the documents and users the terms; lengths and frequencies are grouped sums.
    """
    by = list(by)
    return _weight_parts(df, weighting, weight, by).select(*by, USER, ITEM, (F.col("w") * F.col("f")).alias("w"))


def item_knn(
    df: DataFrame,
    weighting: str = "cosine",
    k: int = 10,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The k most similar other items of each item: (item_id, similar_item_id, score, rank).

    The rows are written once for the sums that weigh them, and the weights once for the pairs; the part of a weight
    that is the user's own is shuffled once a history. Tiles hand on only the k best of an item.
    """
    by = list(by)
    rows = stored(select_pos(df).select(*by, USER, ITEM, *([weight] if weight else [])))
    weights = stored(_weight_parts(rows, weighting, weight, by))
    best = (k, lambda sums: grid(sums["dot"]))
    pairs = pair_sums(weights, USER, ITEM, "w", ["dot"], by, best, factor="f")
    both = pairs.select(*by, F.col("item_i").alias(ITEM), F.col("item_j").alias("similar_item_id"), steady("dot").alias("score"))
    # Written, so the tiles' shuffle is gone before the lists are read.
    return stored(top_per_group(both, [*by, ITEM], [F.desc("score"), F.asc("similar_item_id")], k))


def knn_recommend(
    users: DataFrame,
    history: DataFrame,
    neighbors: DataFrame,
    k: int = 10,
    weight: str | None = None,
    by: Sequence[str] = (),
    keep_seen: bool = False,
) -> DataFrame:
    """Score = sum over the user's history of weight x similarity; top k unseen items.

    Lists are those of `item_knn`, some rows an item. A row of the history travels with its item's list, and the item itself
    is what the user has seen, so one shuffle by the user serves the sums, the seen items and the top list of a part.
    Candidates of a history above PIECE items are dealt into several parts. Lists meet the history by the item; only those
    of items with more than HOT rows are salted.
    """
    by = list(by)
    x = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    own = history.select(*by, USER, ITEM, x.alias("_x"))
    wanted = own.join(users.select(*by, USER).distinct(), [*by, USER], "left_semi").filter(F.col(ITEM).isNotNull())
    lists = neighbors.groupBy(*by, ITEM).agg(F.collect_list(F.struct("similar_item_id", "score")).alias("_l"))
    lists = lists.select(*by, ITEM, F.col("_l.similar_item_id").alias("_items"), F.col("_l.score").alias("_scores"))
    long = own.groupBy(*by, USER).agg(F.count("*").alias("_n")).filter(F.col("_n") > PIECE)
    parts = F.lit(1)
    if not long.isEmpty():
        wanted = attach_by_key(wanted, long, [*by, USER], "left")
        parts = F.coalesce(F.ceil(F.col("_n") / PIECE), F.lit(1))
    wanted = wanted.select(*by, USER, ITEM, "_x", parts.cast("int").alias("_parts"))
    # Fewer items than rows / HOT.
    hot = own.groupBy(*by, ITEM).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).drop("_n")
    if hot.isEmpty():
        met = wanted.join(lists, [*by, ITEM], "left")
    else:
        hot = F.broadcast(stored(hot))
        few, many = (wanted.join(hot, [*by, ITEM], how) for how in ("left_anti", "left_semi"))
        salted = attach_by_key(many, lists.join(hot, [*by, ITEM], "left_semi"), [*by, ITEM], "left")
        met = few.join(lists, [*by, ITEM], "left").unionByName(salted)
    # Lists are shuffled once, by the user; only a long history is dealt out by its candidates.
    key = [*by, USER, "_part"]
    met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(*key)
    items, scores = F.coalesce("_items", F.array().cast("array<bigint>")), F.coalesce("_scores", F.array().cast("array<double>"))
    if not keep_seen:
        items, scores = F.concat(items, F.array(ITEM)), F.concat(scores, F.array(F.lit(None).cast("double")))
    links = met.withColumns({"_items": items, "_scores": scores})
    links = links.select(*key, "_parts", "_x", F.size("_items").alias("_n"), F.posexplode(F.arrays_zip("_items", "_scores")).alias("_at", "_l"))
    links = links.select(
        *key, "_parts", F.col("_l._items").alias(ITEM), (F.col("_x") * F.col("_l._scores")).alias("_s"),
        F.lit(False).alias("_seen") if keep_seen else (F.col("_at") == F.col("_n") - 1).alias("_seen"),
    )
    scores = (
        links.filter(F.pmod(F.xxhash64(ITEM), F.col("_parts")) == F.col("_part"))
        .groupBy(*key, ITEM)
        .agg(steady(F.sum("_s")).alias("score"), F.max("_seen").alias("_seen"))
        .filter(~F.col("_seen"))
        .drop("_seen")
    )
    # The best of a part first: few rows of a user are left to meet.
    best = top_per_group(scores, key, [F.desc("score"), F.asc(ITEM)], k).select(*by, USER, ITEM, "score")
    return top_per_group(best, [*by, USER], [F.desc("score"), F.asc(ITEM)], k)


def similar_items(items: DataFrame, neighbors: DataFrame, n: int = 10) -> DataFrame:
    """The n nearest items of each given item, with score."""
    return (
        neighbors.join(items.select(ITEM).distinct(), ITEM, "left_semi")
        .filter(F.col(RANK) <= n)
        .select(ITEM, "similar_item_id", "score", RANK)
    )
