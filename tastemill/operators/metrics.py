"""Ranking quality, diversity, novelty and serendipity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import genre_list
from tastemill.operators.blocks import attach_by_key, attach_totals, ordinal_rank
from tastemill.schema import ITEM, RANK, USER


def join_truth(truth: DataFrame, recs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Truth rows with the rank of the recommendation (NULL if none) and the user's truth size."""
    keys = [*by, USER, ITEM]
    sizes = truth.groupBy(*by, USER).agg(F.count("*").alias("item_count_per_user"))
    joined = truth.select(*keys).join(recs.select(*keys, RANK), keys, "left")
    return attach_by_key(joined, sizes, [*by, USER])


def hits(joined: DataFrame, k: int) -> DataFrame:
    """Add hit@k; a missing rank is no hit."""
    return joined.withColumn(f"hit@{k}", F.coalesce(F.col(RANK) <= k, F.lit(False)))


def user_hits(
    truth: DataFrame, recs: DataFrame, max_k: int, by: Sequence[str] = ()
) -> DataFrame:
    """One row per truth user: the sorted ranks of the hits (at most max_k) and the truth size.

    Every rank metric is a function of this row, so truth and recommendations meet once.
    """
    keys = [*by, USER, ITEM]
    listed = recs.filter(F.col(RANK) <= max_k).select(*keys, F.col(RANK).cast("int").alias(RANK))
    return (
        truth.select(*keys)
        .join(listed, keys, "left")
        .groupBy(*by, USER)
        .agg(
            F.array_sort(F.collect_list(RANK)).alias("ranks"),
            F.count("*").alias("items"),
        )
    )


def _hit_count(k: int) -> Column:
    return F.size(F.filter("ranks", lambda r: r <= k))


def precision_expr(k: int) -> Column:
    return F.sum(_hit_count(k) / F.lit(float(k))) / F.count("*")


def recall_expr(k: int) -> Column:
    return F.sum(_hit_count(k) / F.col("items")) / F.count("*")


def mrr_expr() -> Column:
    first = F.when(F.size("ranks") > 0, F.lit(1.0) / F.element_at("ranks", 1))
    return F.sum(F.coalesce(first, F.lit(0.0))) / F.count("*")


def map_expr() -> Column:
    terms = F.transform("ranks", lambda r, i: (i + 1) / r)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sum(total / F.col("items")) / F.count("*")


def precision_at(per_user: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return per_user.groupBy(*by).agg(precision_expr(k).alias("value"))


def recall_at(per_user: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return per_user.groupBy(*by).agg(recall_expr(k).alias("value"))


def mrr(per_user: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_user.groupBy(*by).agg(mrr_expr().alias("value"))


def map_score(per_user: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_user.groupBy(*by).agg(map_expr().alias("value"))


def compute_metrics(
    truth: DataFrame,
    recs: DataFrame,
    max_k: int,
    separate_k: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """prec and recall for k = 1..max_k, MRR and MAP, in long form: name[, k], value."""
    per_user = user_hits(truth, recs, max_k, by)
    named: list[tuple[str, int, Column]] = []
    for k in range(1, max_k + 1):
        named += [("prec", k, precision_expr(k)), ("recall", k, recall_expr(k))]
    named += [("MRR", max_k, mrr_expr()), ("MAP", max_k, map_expr())]
    wide = per_user.groupBy(*by).agg(*(expr.alias(f"_{i}") for i, (_, _, expr) in enumerate(named)))
    if not by:
        wide = wide.filter(F.col("_0").isNotNull())
    entries = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(k).alias("k"), F.col(f"_{i}").alias("value"))
            for i, (name, k, _) in enumerate(named)
        )
    )
    long = wide.select(*by, F.explode(entries).alias("_m")).select(*by, "_m.name", "_m.k", "_m.value")
    if separate_k:
        return long
    return long.select(*by, F.concat_ws("@", "name", F.col("k").cast("string")).alias("name"), "value")


def intra_list_diversity(recs: DataFrame, items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean pairwise Hamming distance of the listed items' genre flags per user.

    With m listed items that have features, a genre carried by c of them differs in c * (m - c)
    pairs, so the sum over pairs is a sum over genres and no pair is built. NULL for one item.
    """
    flags = items.filter(F.col("genres").isNotNull()).select(
        ITEM, F.array_distinct(genre_list("genres")).alias("_genres")
    )
    vocabulary = flags.select(F.explode("_genres").alias("g")).distinct().agg(F.count("*")).scalar()
    keys = [*by, USER]
    listed = recs.join(flags, ITEM, "left")
    sizes = listed.groupBy(*keys).agg(
        F.max(RANK).alias("_n"), F.count("_genres").alias("_m")
    )
    carried = (
        listed.select(*keys, F.explode("_genres").alias("_g"))
        .groupBy(*keys, "_g")
        .agg(F.count("*").alias("_c"))
        .join(sizes, keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("_c") * (F.col("_m") - F.col("_c"))).alias("_apart"))
    )
    n = F.col("_n")
    # 2 / (n (n - 1)) fails for n = 1 only.
    value = F.try_divide(
        2.0 * F.coalesce("_apart", F.lit(0)), n * (n - 1) * F.col("_vocabulary").cast("double")
    )
    return (
        sizes.join(carried, keys, "left")
        .withColumn("_vocabulary", vocabulary)
        .select(*keys, value.alias("intra_list_div"))
    )


def miuf(recs: DataFrame, train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of -log2(share of users who know the item) per user; unknown items count one user."""
    by = list(by)
    pairs = train.groupBy(*by, USER, ITEM).agg(F.lit(1).alias("_one"))
    per_item = pairs.groupBy(*by, ITEM).agg(F.count("*").alias("_users"))
    totals = (
        pairs.select(*by, USER).distinct().groupBy(*by).agg(F.count("*").alias("_all"))
    )
    known = attach_totals(recs.join(per_item, [*by, ITEM], "left"), totals, by)
    share = F.coalesce("_users", F.lit(1)) / F.col("_all")
    return known.groupBy(*by, USER).agg((-F.avg(F.log2(share))).alias("miuf"))


def popularity_rank(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ordinal rank of every item by falling interaction count (ties: smaller id)."""
    counts = train.groupBy(*by, ITEM).agg(F.count("*").alias("n"))
    return ordinal_rank(counts, [F.desc("n"), F.asc(ITEM)], "item_pop_rank", within=by)


def serendipity(
    recs: DataFrame, train: DataFrame, test: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over the user's list of relevant x how far the item is above its popularity rank."""
    by = list(by)
    keys = [*by, USER, ITEM]
    relevant = test.select(*keys).withColumn("_rel", F.lit(1))
    gap = F.greatest(F.col("item_pop_rank") - F.col(RANK), F.lit(0)) * F.coalesce("_rel", F.lit(0))
    return (
        recs.join(relevant, keys, "left")
        .join(popularity_rank(train, by).drop("n"), [*by, ITEM])
        .groupBy(*by, USER)
        .agg(F.avg(gap).alias("seren"))
    )


def mean_metric(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias(f"mean_{col}"))


def mean_map(metrics: DataFrame, k: int) -> DataFrame:
    """Mean MAP@k over folds: the objective of a parameter search."""
    return metrics.filter(F.col("name") == f"MAP@{k}").agg(F.avg("value").alias("mean_map"))


def compare(metrics: DataFrame, models: Sequence[str], pattern: str) -> DataFrame:
    """Metric names that match `pattern` as rows, models as columns (largest value)."""
    return (
        metrics.filter(F.col("name").rlike(pattern))
        .groupBy("name")
        .pivot("model", list(models))
        .agg(F.max("value"))
    )


def auc(scored: DataFrame, score: str = "score", target: str = "target") -> float:
    """Area under the ROC curve of a scored, labelled frame."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    flat = scored.select(F.col(score).cast("double").alias("s"), F.col(target).cast("double").alias("t"))
    judge = BinaryClassificationEvaluator(
        rawPredictionCol="s", labelCol="t", metricName="areaUnderROC", numBins=0
    )
    return judge.evaluate(flat)
