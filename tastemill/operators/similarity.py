"""Item similarity over co-raters, neighbour lists and mean-centred predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.expressions import steady
from tastemill.operators.blocks import attach_by_key, mirrored, top_per_group
from tastemill.operators.tiles import grid, pair_sums
from tastemill.schema import ITEM, RANK, USER
from tastemill.session import stored

ZERO = 1e-8  # norms at or below this count as zero


#: The sums over co-raters that each measure needs.
MEASURES = {
    "adjusted_cosine": ["support", "dot", "ii", "jj"],
    "euclidean": ["support", "dot", "ii", "jj"],
    "manhattan": ["support", "gap"],
    "cosine": ["support", "dot"],
    "jaccard": ["support"],
}


def _tile_score(sums: dict[str, np.ndarray], measure: str, min_support: int, keep_weak: bool) -> np.ndarray:
    """The similarity as `item_similarity` has it, from the sums of a tile."""
    if measure == "adjusted_cosine":
        flat = (sums["ii"] <= ZERO) | (sums["jj"] <= ZERO)
        norms = np.where(flat, 1.0, np.sqrt(sums["ii"]) * np.sqrt(sums["jj"]))
        sim = grid(np.where(flat, 0.0, sums["dot"] / norms))
    elif measure == "euclidean":
        sim = grid(np.sqrt(np.maximum(sums["ii"] + sums["jj"] - 2 * sums["dot"], 0.0)), 6)
    else:
        sim = grid(sums["gap"])
    return np.where(sums["support"] < min_support, 0.0 if keep_weak else -np.inf, sim)


def item_similarity(
    df: DataFrame,
    value: str = "norm_rating",
    min_support: int = 0,
    measure: str = "adjusted_cosine",
    diagonal: bool = True,
    keep_weak: bool = False,
    best: int | None = None,
) -> DataFrame:
    """(item_i, item_j, sim, support) in both directions, over users who rated both items.

    Pairs below `min_support` have similarity 0 and are left out unless `keep_weak`. `euclidean`
    and `manhattan` give distances. `cosine` divides by the norms over all raters, and `jaccard`
    compares the sets of raters; the sums of both need the per-item totals as well. With `best` only pairs that
    can be among the `best` highest of item_i are sure to be there, for a top list that follows.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    rows = stored(df.select(USER, ITEM, F.col(value).cast("double").alias("v")))
    paired = rows
    if not keep_weak and min_support > 1:
        # An item with fewer raters than that has no pair with enough of them.
        rated = rows.groupBy(ITEM).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_support)
        paired = stored(rows.join(rated.select(ITEM), ITEM, "left_semi"))
    score = None
    if best is not None and measure not in ("cosine", "jaccard"):
        score = (best, lambda sums: _tile_score(sums, measure, min_support, keep_weak))
    sums = MEASURES[measure]
    # Pairs with too few co-raters stay in their tile.
    pairs = pair_sums(paired, USER, ITEM, "v", sums, best=score, least=0 if keep_weak else min_support, once=score is None)
    if score is None:
        pairs = mirrored(pairs, {"item_i": "item_j", **({"ii": "jj"} if "ii" in sums else {})})
    new = {"dot": "_dot", "ii": "_ii", "jj": "_jj", "gap": "_abs"}
    pairs = pairs.withColumn("support", F.col("support").cast("bigint")).withColumnsRenamed(new)
    if not keep_weak and min_support > 0:
        pairs = pairs.filter(F.col("support") >= min_support)

    if measure in ("cosine", "jaccard"):
        totals = rows.groupBy(ITEM).agg(
            F.count("*").alias("_n"), F.sum(F.col("v") * F.col("v")).alias("_sq")
        )
        for s in ("i", "j"):
            pairs = pairs.join(
                totals.select(
                    F.col(ITEM).alias(f"item_{s}"), F.col("_n").alias(f"_n{s}"), F.col("_sq").alias(f"_sq{s}")
                ),
                f"item_{s}",
            )
    if measure == "adjusted_cosine":
        norms = F.sqrt("_ii") * F.sqrt("_jj")
        flat = (F.col("_ii") <= ZERO) | (F.col("_jj") <= ZERO)
        sim = F.when(flat, F.lit(0.0)).otherwise(F.try_divide("_dot", norms))
    elif measure == "cosine":
        flat = (F.col("_sqi") <= ZERO) | (F.col("_sqj") <= ZERO)
        sim = F.when(flat, F.lit(0.0)).otherwise(
            F.try_divide(F.col("_dot"), F.sqrt("_sqi") * F.sqrt("_sqj"))
        )
    elif measure == "jaccard":
        sim = F.col("support") / (F.col("_ni") + F.col("_nj") - F.col("support"))
    elif measure == "euclidean":
        sim = F.sqrt(F.greatest(F.col("_ii") + F.col("_jj") - 2 * F.col("_dot"), F.lit(0.0)))
    else:
        sim = F.col("_abs")
    if keep_weak:
        sim = F.when(F.col("support") < min_support, F.lit(0.0)).otherwise(sim)
    digits = 6 if measure == "euclidean" else 9
    out = pairs.select("item_i", "item_j", steady(sim, digits).alias("sim"), "support")
    if not diagonal:
        return out
    same = F.lit(0.0 if measure in ("euclidean", "manhattan") else 1.0)
    own = rows.groupBy(ITEM).agg(F.count("*").alias("support")).select(
        F.col(ITEM).alias("item_i"), F.col(ITEM).alias("item_j"), same.alias("sim"), "support"
    )
    return out.unionByName(own)


def top_neighbors(sim: DataFrame, k: int | None = None) -> DataFrame:
    """Other items of each item by falling similarity. Without k the whole list, the item last."""
    window_order = [F.desc("sim"), F.asc("item_j")]
    if k is not None:
        others = sim.filter(F.col("item_i") != F.col("item_j"))
        return top_per_group(others, ["item_i"], window_order, k)
    own_last = (F.col("item_i") == F.col("item_j")).asc()
    window = Window.partitionBy("item_i").orderBy(own_last, *window_order)
    return sim.withColumn(RANK, F.row_number().over(window).cast("bigint"))


def explain_neighbors(neighbors: DataFrame, items: DataFrame) -> DataFrame:
    """Neighbour table with the titles of both items."""
    titles = items.select(ITEM, "title")
    left = titles.select(F.col(ITEM).alias("item_i"), F.col("title").alias("title_i"))
    right = titles.select(F.col(ITEM).alias("item_j"), F.col("title").alias("title_j"))
    return neighbors.join(left, "item_i").join(right, "item_j")


def candidates(history: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Neighbours of the user's items that the user has not interacted with."""
    links = neighbors.select(F.col("item_i").alias(ITEM), F.col("item_j").alias("_cand"))
    return (
        attach_by_key(history.select(USER, ITEM), links, [ITEM])
        .select(USER, F.col("_cand").alias(ITEM))
        .distinct()
        .join(history.select(USER, ITEM), [USER, ITEM], "left_anti")
    )


def predict_ratings(
    cands: DataFrame, history: DataFrame, sim: DataFrame, score: str = "centered"
) -> DataFrame:
    """Score of each candidate against the user's whole history.

    `centered`: mean + sum(c * w) / sum(|w|), the user's mean if no similarity is known.
    `sum`: the plain sum of similarities. `history` carries norm_rating and mean_user_rating.
    """
    links = sim.filter(F.col("item_i") != F.col("item_j")).select(
        F.col("item_j").alias(ITEM), F.col("item_i").alias("_cand"), F.col("sim").alias("_w")
    )
    # Only the candidates are summed.
    wanted = cands.select(USER, F.col(ITEM).alias("_cand")).distinct()
    sums = (
        attach_by_key(history, links, [ITEM])
        .join(wanted, [USER, "_cand"], "left_semi")
        .groupBy(USER, F.col("_cand").alias(ITEM))
        .agg(
            F.sum(F.col("norm_rating") * F.col("_w")).alias("_num"),
            F.sum(F.abs("_w")).alias("_den"),
            F.sum("_w").alias("_sum"),
        )
    )
    joined = cands.join(sums, [USER, ITEM], "left")
    if score == "sum":
        return joined.select(USER, ITEM, steady(F.coalesce("_sum", F.lit(0.0))).alias("score"))
    if score != "centered":
        raise ValueError(f"unknown score {score!r}")
    means = history.groupBy(USER).agg(F.max("mean_user_rating").alias("_mean"))
    shift = F.when(F.col("_den") > ZERO, F.try_divide("_num", "_den"))
    return joined.join(means, USER).select(
        USER, ITEM, steady(F.col("_mean") + F.coalesce(shift, F.lit(0.0)), 8).alias("score")
    )


def topn_items(scores: DataFrame, items: DataFrame, n: int = 30) -> DataFrame:
    """Each user's n best candidates with title."""
    best = top_per_group(scores, [USER], [F.desc("score"), F.asc(ITEM)], n)
    return best.join(items.select(ITEM, "title"), ITEM)


def sparsity(df: DataFrame) -> DataFrame:
    """One row: users, items, cells and the share of empty cells, from one pass."""
    sides = F.explode(F.array(F.struct(F.lit("u").alias("side"), F.col(USER).alias("id")), F.struct(F.lit("i").alias("side"), F.col(ITEM).alias("id"))))
    ids = df.select(sides.alias("s")).groupBy("s.side", "s.id").agg(F.count("*").alias("n"))
    counts = ids.agg(
        F.sum(F.when(F.col("side") == "u", F.col("n"))).alias("cells"),
        F.count_if((F.col("side") == "u") & F.col("id").isNotNull()).alias("users"),
        F.count_if((F.col("side") == "i") & F.col("id").isNotNull()).alias("items"),
    ).withColumn("cells", F.coalesce("cells", F.lit(0)))
    return counts.withColumn("sparsity", 1 - F.col("cells") / (F.col("users").cast("double") * F.col("items")))
