"""Positive and negative labels, negative sampling and training triplets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.blocks import attach_by_key, ordinal_rank
from tastemill.schema import DATE, FOLD, ITEM, PROGRESS, RATING, TARGET, USER
from tastemill.session import stored

MASKED = 62  # folds that the bits of a row can name
LOW_PROGRESS = 10  # fixed rule: an unrated item read below this share is a negative


def user_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items, mean progress and mean known rating (0 if none) per user."""
    return df.groupBy(*by, USER).agg(
        F.count(ITEM).alias("num_interacted_items"),
        F.avg(PROGRESS).alias("mean_user_progress"),
        F.coalesce(F.avg(RATING), F.lit(0.0)).alias("avg_user_rating"),
    )


def _with_verdict(df: DataFrame, stats: DataFrame, rule: str, by: Sequence[str]) -> DataFrame:
    """Add `_neg`: rated below the user's mean, or unrated with too little progress."""
    if rule == "fixed":
        low = F.col(PROGRESS) < LOW_PROGRESS
    elif rule == "user_mean":
        low = F.col(PROGRESS) < F.col("mean_user_progress")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    below = F.when(F.col(RATING).isNotNull(), F.col(RATING) < F.col("avg_user_rating")).otherwise(low)
    known = F.col("num_interacted_items").isNotNull()
    return attach_by_key(df, stats, [*by, USER], "left").withColumn(
        "_neg", known & F.coalesce(below, F.lit(False))
    ).drop("num_interacted_items", "mean_user_progress", "avg_user_rating")


def negatives(df: DataFrame, stats: DataFrame, rule: str = "fixed", by: Sequence[str] = ()) -> DataFrame:
    """Rows that the rule calls negative, judged with the given (train) statistics."""
    return (
        _with_verdict(df, stats, rule, by)
        .filter("_neg")
        .select(*df.columns, F.lit(0).cast("tinyint").alias(TARGET))
    )


def label(
    df: DataFrame,
    stats: DataFrame,
    rule: str = "fixed",
    by: Sequence[str] = (),
    dedupe: bool = False,
) -> DataFrame:
    """All rows with `target`; expects one row per (user, item).

    A user without any positive keeps the negatives and gets them as positives too; `dedupe=True`
    keeps only the positive copy.
    """
    keys = [*by, USER]
    judged = _with_verdict(df, stats, rule, by)
    lonely = (
        judged.groupBy(*keys)
        .agg(F.bool_and("_neg").alias("_lonely"))
        .filter("_lonely")
    )
    both = F.array(F.lit(1)) if dedupe else F.array(F.lit(1), F.lit(0))
    target = (
        F.when(~F.col("_neg"), F.array(F.lit(1)))
        .when(F.col("_lonely"), both)
        .otherwise(F.array(F.lit(0)))
        .cast("array<tinyint>")
    )
    return (
        attach_by_key(judged, lonely, keys, "left")
        .withColumn(TARGET, F.explode(target))
        .drop("_neg", "_lonely")
    )


def label_prefixes(
    df: DataFrame, starts: Sequence[tuple[int, dt.date]], rule: str = "fixed", date: str = DATE
) -> tuple[DataFrame, DataFrame]:
    """(rows, stats) as `label` and `user_stats` have them for train sets that hold all rows before a fold's start.

    `starts` is (fold, start), at most MASKED of them. A row is judged in all its folds at once and stored once, with the
    folds it is in and those it is a positive in as bits; it is repeated per fold only where `rows` is read. Statistics
    are running sums over the stretches between starts: one small row per user and stretch.
    """
    starts = sorted(starts, key=lambda s: s[1])
    day = F.col(date)
    known = df.filter(day < F.lit(starts[-1][1])) if starts else df.limit(0)
    # The first fold that a row is in; it is in all later ones too.
    stretch = F.lit(0)
    for _, start in starts[:-1]:
        stretch = stretch + (day >= F.lit(start)).cast("int")
    known = known.withColumn("_first", stretch)
    sums = known.groupBy(USER, "_first").agg(
        F.count(ITEM).alias("items"),
        F.sum(F.col(PROGRESS).cast("double")).alias("p"),
        F.count(PROGRESS).alias("np"),
        F.sum(F.col(RATING).cast("double")).alias("r"),
        F.count(RATING).alias("nr"),
    )
    per_user = stored(sums.groupBy(USER).agg(F.collect_list(F.struct("_first", "items", "p", "np", "r", "nr")).alias("_s")))

    def total(n: int, field: str):
        zero = F.lit(0.0) if field in ("p", "r") else F.lit(0).cast("bigint")
        own = F.filter("_s", lambda s: s["_first"] <= n)
        return F.aggregate(own, zero, lambda t, s: t + F.coalesce(s[field], zero))

    def means(n: int):
        return F.struct(
            F.lit(starts[n][0]).alias(FOLD),
            total(n, "items").alias("num_interacted_items"),
            F.try_divide(total(n, "p"), total(n, "np")).alias("mean_user_progress"),
            F.coalesce(F.try_divide(total(n, "r"), total(n, "nr")), F.lit(0.0)).alias("avg_user_rating"),
            F.exists("_s", lambda s: s["_first"] <= n).alias("_there"),
        )

    all_means = per_user.select(USER, F.array(*(means(n) for n in range(len(starts)))).alias("_m"))
    stats = all_means.select(USER, F.explode("_m").alias("_m")).select(USER, "_m.*").filter("_there").drop("_there")
    few = all_means.select(USER, F.transform("_m", lambda m: F.struct(m["mean_user_progress"].alias("p"), m["avg_user_rating"].alias("r"))).alias("_m"))
    if rule not in ("fixed", "user_mean"):
        raise ValueError(f"unknown rule {rule!r}")
    inside, positive = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for n in range(len(starts)):
        own = F.col("_m")[n]
        low = F.col(PROGRESS) < (F.lit(LOW_PROGRESS) if rule == "fixed" else own["p"])
        below = F.when(F.col(RATING).isNotNull(), F.col(RATING) < own["r"]).otherwise(low)
        here, bit = F.col("_first") <= n, F.lit(1 << n).cast("bigint")
        inside = inside + F.when(here, bit).otherwise(0)
        positive = positive + F.when(here & ~F.coalesce(F.col("_m").isNotNull() & below, F.lit(False)), bit).otherwise(0)
    judged = attach_by_key(known, few, [USER], "left").select(*df.columns, inside.alias("_in"), positive.alias("_pos"))
    judged = stored(judged)
    some = judged.groupBy(USER).agg(F.bit_or("_pos").alias("_some"), F.bit_or("_in").alias("_all"))
    # Few users have a fold without a positive.
    lonely = some.filter("_some <> _all").select(USER, F.col("_all").bitwiseAND(F.bitwise_not("_some")).alias("_lonely"))
    judged = stored(attach_by_key(judged, lonely, [USER], "left"))
    # A constant list of folds and targets, so a row is repeated by compiled code; the bits say which of the copies stay.
    good = F.col("_in").bitwiseAND(F.col("_pos").bitwiseOR(F.coalesce("_lonely", F.lit(0).cast("bigint"))))
    bad = F.col("_in").bitwiseAND(F.bitwise_not("_pos"))
    marks = [
        F.struct(F.lit(fold).alias(FOLD), F.lit(target).cast("tinyint").alias(TARGET), F.lit(1 << n).cast("bigint").alias("bit"))
        for n, (fold, _) in enumerate(starts)
        for target in (1, 0)
    ]
    empty = F.expr("cast(array() as array<struct<fold:int,target:tinyint,bit:bigint>>)")
    rows = judged.select(*df.columns, good.alias("_good"), bad.alias("_bad"), F.explode(F.array(*marks) if marks else empty).alias("_k"))
    rows = rows.filter(F.when(F.col(f"_k.{TARGET}") > 0, F.col("_good")).otherwise(F.col("_bad")).bitwiseAND(F.col("_k.bit")) != 0)
    return rows.select(f"_k.{FOLD}", *df.columns, f"_k.{TARGET}"), stats


def select_pos(df: DataFrame) -> DataFrame:
    """Positives only if the frame is labelled, else the frame itself."""
    return df.filter(F.col(TARGET) > 0) if TARGET in df.columns else df


def build_samples(
    labelled: DataFrame, recommend: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(user, item, target) where every user of `labelled` has a negative if one can be found.

    `recommend(users)` gives recommendations for the users that have none; those the user has not
    interacted with become negatives.
    """
    seen = labelled.select(USER, ITEM)
    positives = select_pos(labelled).select(USER, ITEM)
    plain = labelled.join(positives, [USER, ITEM], "left_anti").select(USER, ITEM, TARGET)
    lacking = positives.select(USER).distinct().join(plain.select(USER), USER, "left_anti")
    extra = (
        recommend(lacking)
        .join(seen, [USER, ITEM], "left_anti")
        .select(USER, ITEM, F.lit(0).cast("tinyint").alias(TARGET))
    )
    marked = positives.withColumn(TARGET, F.lit(1).cast("tinyint"))
    return marked.unionByName(plain).unionByName(extra)


def sample_negatives(
    candidates: DataFrame, positives: DataFrame, ratio: int = 2, seed: int = 0
) -> DataFrame:
    """Exactly `ratio` x positives (or all) of the candidates that are no hit.

    Rows are ordered by a seeded MD5 hash of the pair. A histogram of the hash's first 16 bits finds the bucket in
    which the wanted number is reached: the buckets before it are taken by a filter, and only its own rows are ranked.
    """
    pool = candidates.join(positives.select(USER, ITEM), [USER, ITEM], "left_anti").withColumn(
        "_h", F.md5(F.concat_ws("-", F.col(USER).cast("string"), F.col(ITEM).cast("string"), F.lit(str(seed))))
    )
    pool = pool.withColumn("_bucket", F.substring("_h", 1, 4))
    wanted = positives.agg(F.count("*") * ratio).scalar()
    sizes = pool.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most 65,536 rows
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .withColumn("_wanted", wanted)
        .filter(F.col("_before") < F.col("_wanted"))
        .select("_bucket", "_n", (F.col("_wanted") - F.col("_before")).alias("_room"))
    )
    met = pool.join(F.broadcast(edges), "_bucket")
    whole = met.filter(F.col("_n") <= F.col("_room"))
    within = Window.partitionBy("_bucket").orderBy("_h", USER, ITEM)
    edge = met.filter(F.col("_n") > F.col("_room")).withColumn("_at", F.row_number().over(within))
    edge = edge.filter(F.col("_at") <= F.col("_room")).drop("_at")
    return (
        whole.unionByName(edge)
        .drop("_h", "_bucket", "_n", "_room")
        .withColumn(TARGET, F.lit(0).cast("tinyint"))
    )


def make_triplets(samples: DataFrame) -> DataFrame:
    """(user, pos_item, neg_item): a user's negatives go round-robin to the positives.

    Positions come from a global rank, so one user with a large share of all rows is split too. The samples are written
    once, since the ranks, the samples of their bounds and the totals all read them.
    """
    samples = stored(samples.select(USER, ITEM, TARGET))
    pos = samples.filter(F.col(TARGET) == 1).select(USER, F.col(ITEM).alias("pos_item"))
    neg = samples.filter(F.col(TARGET) == 0).select(USER, F.col(ITEM).alias("neg_item"))
    totals = neg.groupBy(USER).agg(F.count("*").alias("_total"))
    p = ordinal_rank(pos, [F.asc("pos_item")], "_p", within=[USER])
    n = ordinal_rank(neg, [F.asc("neg_item")], "_n", within=[USER])
    turns = attach_by_key(p, totals, [USER]).withColumn("_turn", F.pmod(F.col("_p") - 1, F.col("_total")))
    return turns.join(n.withColumn("_turn", F.col("_n") - 1), [USER, "_turn"]).select(
        USER, "pos_item", "neg_item"
    )


def label_share(df: DataFrame) -> DataFrame:
    """Share of each target value."""
    counts = df.groupBy(TARGET).agg(F.count("*").alias("n"))
    return counts.select(TARGET, (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def sample_report(samples: DataFrame) -> DataFrame:
    """Users, users with negatives, their ratio, and mean distinct negatives per such user."""
    per_user = (
        samples.groupBy(USER, ITEM)
        .agg(F.max((F.col(TARGET) == 0).cast("int")).alias("_neg"))
        .groupBy(USER)
        .agg(F.sum("_neg").alias("_negs"))
    )
    return per_user.agg(
        F.count("*").alias("users"),
        F.count_if(F.col("_negs") > 0).alias("users_with_neg"),
        F.avg((F.col("_negs") > 0).cast("double")).alias("ratio"),
        F.avg(F.when(F.col("_negs") > 0, F.col("_negs"))).alias("mean_negatives"),
    )
