"""Popularity recommenders: global, per segment, and topping up short lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.blocks import attach_by_key, attach_totals, ordinal_rank, top_per_group
from tastemill.operators.labels import select_pos
from tastemill.schema import DATE, ITEM, RANK, USER
from tastemill.session import stored


def _recent(df: DataFrame, days: int, by: Sequence[str], date: str) -> DataFrame:
    """Rows of the last `days` days before the newest date (of each fold)."""
    newest = df.groupBy(*by).agg(F.max(date).alias("_newest"))
    return (
        attach_totals(df, newest, by)
        .filter(F.col(date) > F.date_sub("_newest", days))
        .drop("_newest")
    )


def popular(
    df: DataFrame, days: int = 30, max_k: int | None = 100, by: Sequence[str] = (), date: str = DATE
) -> DataFrame:
    """Most interacted items of the last `days` days with rank; positives only if labelled.

    Without `max_k` all items are ranked, which needs no single large partition (not with `by`).
    """
    counts = (
        _recent(select_pos(df), days, by, date).groupBy(*by, ITEM).agg(F.count("*").alias("n"))
    )
    order = [F.desc("n"), F.asc(ITEM)]
    if max_k is None:
        if by:
            raise ValueError("a ranking of all items is for one group only")
        return ordinal_rank(counts, order, RANK)
    if by:
        return top_per_group(counts, by, order, max_k)
    top = counts.orderBy(*order).limit(max_k)
    return top.withColumn(RANK, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def popular_recommend(users: DataFrame, pop: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The first k popular items for every distinct user."""
    top = pop.filter(F.col(RANK) <= k)
    if by:
        # k rows per fold: a broadcast of known size.
        lists = F.broadcast(top.select(*by, ITEM, RANK))
        return users.select(*by, USER).distinct().join(lists, list(by)).select(*by, USER, ITEM, RANK)
    listed = top.agg(F.collect_list(F.struct(ITEM, RANK))).scalar()
    return (
        users.select(USER)
        .distinct()
        .withColumn("_top", listed)
        .select(USER, F.explode("_top").alias("_t"))
        .select(USER, f"_t.{ITEM}", f"_t.{RANK}")
    )


def popular_by(
    df: DataFrame,
    users: DataFrame,
    segment: str = "age",
    days: int = 30,
    max_k: int = 100,
    by: Sequence[str] = (),
    date: str = DATE,
) -> DataFrame:
    """Most interacted items of the last `days` days inside each user segment."""
    segments = users.filter(F.col(segment).isNotNull()).select(USER, segment)
    counts = (
        _recent(select_pos(df), days, by, date)
        .join(segments, USER)
        .groupBy(*by, segment, ITEM)
        .agg(F.count("*").alias("n"))
    )
    return top_per_group(counts, [*by, segment], [F.desc("n"), F.asc(ITEM)], max_k)


def popular_by_recommend(
    users: DataFrame,
    user_features: DataFrame,
    by_segment: DataFrame,
    pop: DataFrame,
    k: int = 10,
    segment: str = "age",
    by: Sequence[str] = (),
) -> DataFrame:
    """Segment list, topped up from the global list; the global list for all other users.

    The lists are finished per segment (a few rows each) before any user is joined.
    """
    by = list(by)
    own = by_segment.filter(F.col(RANK) <= k).select(*by, segment, ITEM, RANK)
    top = pop.filter(F.col(RANK) <= k).select(*by, ITEM, RANK)
    packed = top.groupBy(*by).agg(F.collect_list(F.struct(ITEM, RANK)).alias("_top"))
    segments = own.select(*by, segment).distinct()
    spare = (
        attach_totals(segments, packed, by)
        .select(*by, segment, F.explode("_top").alias("_t"))
        .select(*by, segment, f"_t.{ITEM}", f"_t.{RANK}")
        .join(own, [*by, segment, ITEM], "left_anti")
    )
    lists = top_per_group(
        own.withColumn("_source", F.lit(0)).unionByName(spare.withColumn("_source", F.lit(1))).withColumnRenamed(RANK, "_place"),
        [*by, segment],
        [F.asc("_source"), F.asc("_place")],
        k,
    ).select(*by, segment, ITEM, RANK)
    wanted = (
        users.select(*by, USER)
        .distinct()
        .join(user_features.select(USER, segment), USER, "left")
        .join(segments.withColumn("_known", F.lit(True)), [*by, segment], "left")
    )
    known = wanted.filter(F.col("_known")).join(lists, [*by, segment])
    other = popular_recommend(wanted.filter(F.col("_known").isNull()), pop, k, by)
    cols = [*by, USER, ITEM, RANK]
    return known.select(*cols).unionByName(other.select(*cols))


def drop_seen(recs: DataFrame, seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recommendations the user has not interacted with."""
    keys = [*by, USER, ITEM]
    return recs.join(seen.select(*keys), keys, "left_anti")


def fill_short(
    recs: DataFrame, users: DataFrame, pop: DataFrame, seen: DataFrame, k: int
) -> DataFrame:
    """Top lists shorter than k up with popular items that are neither seen nor listed yet.

    `pop` should rank all items (`popular` without max_k): a user with a long history needs k + history places of it,
    and gets just these. `filled` marks the added rows; its sum is the number of missing recommendations.
    """
    recs = stored(recs.select(USER, ITEM, RANK))
    have = recs.groupBy(USER).agg(F.count("*").alias("_have"))
    past = seen.select(USER, ITEM).distinct().groupBy(USER).agg(F.count("*").alias("_past"))
    short = users.select(USER).distinct().join(have, USER, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = short.filter(F.col("_have") < k).join(past, USER, "left")
    depth = F.lit(k) + F.coalesce("_past", F.lit(0))
    spare = (
        attach_by_key(
            short.select(USER, "_have", F.explode(F.sequence(F.lit(1).cast("bigint"), depth)).alias("_place")),
            pop.select(ITEM, F.col(RANK).cast("bigint").alias("_place")),
            ["_place"],
        )
        .join(seen.select(USER, ITEM), [USER, ITEM], "left_anti")
        .join(recs.select(USER, ITEM), [USER, ITEM], "left_anti")
    )
    added = (
        top_per_group(spare, [USER], [F.asc("_place")], k, "_extra")
        .withColumn(RANK, F.col("_have") + F.col("_extra"))
        .filter(F.col(RANK) <= k)
        .select(USER, ITEM, RANK, F.lit(True).alias("filled"))
    )
    return recs.withColumn("filled", F.lit(False)).unionByName(added)
