"""Time based folds, cold-start filters and other splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.schema import DATE, FOLD, ITEM, USER
from tastemill.session import stored

_FOLD_SCHEMA = "fold int, start date, end date"


def fold_points(
    first: dt.date,
    last: dt.date,
    interval_days: int,
    folds: int,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> list[dt.date]:
    """Boundary dates inside the data range [first, last]."""
    step = dt.timedelta(days=interval_days)
    if start is None:
        start = last - step * (folds + 1)
    if end is None:
        end = start + step * (folds + 1)
    points = []
    point = start
    while point < end:
        points.append(point)
        point += step
    if len(points) < 2:
        raise ValueError("the parameters leave no fold between start and end")
    return [p for p in points if first <= p <= last]


def make_folds(
    df: DataFrame,
    interval_days: int,
    folds: int,
    start: dt.date | None = None,
    end: dt.date | None = None,
    date: str = DATE,
) -> DataFrame:
    """Fold table (fold, start, end) from the date range of `df`.

    Without `start` the folds end one interval before the last date. Reads one row (the smallest
    and largest date); the result is a constant table, so its dates reach the scan as filters.
    Fails if rows are there but no fold fits their dates.
    """
    first, last = df.agg(F.min(date), F.max(date)).first()
    points = fold_points(first, last, interval_days, folds, start, end) if first is not None else []
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(points, points[1:]), 1)]
    if first is not None and not rows:
        raise ValueError(f"no fold fits the dates {first} to {last}")
    return df.sparkSession.createDataFrame(rows, _FOLD_SCHEMA)


def n_folds(
    df: DataFrame, interval_days: int, folds: int, start=None, end=None, date: str = DATE
) -> int:
    """Number of folds that fit the date range of `df`."""
    first, last = df.agg(F.min(date), F.max(date)).first()
    if first is None:
        return 0
    return max(0, len(fold_points(first, last, interval_days, folds, start, end)) - 1)


def _rows(folds: DataFrame) -> list[tuple[int, dt.date, dt.date]]:
    """The fold table is a handful of dates, never data."""
    return sorted((r["fold"], r["start"], r["end"]) for r in folds.collect())


def _array(rows) -> Column:
    if not rows:
        return F.expr("cast(array() as array<struct<fold:int,start:date,end:date>>)")
    return F.array(
        *(
            F.struct(F.lit(n).alias("fold"), F.lit(a).alias("start"), F.lit(b).alias("end"))
            for n, a, b in rows
        )
    )


def assign_train(
    df: DataFrame, folds: DataFrame, train_min_date: dt.date | None = None, date: str = DATE
) -> DataFrame:
    """A row goes to every fold that starts after its date."""
    rows = _rows(folds)
    day = F.col(date)
    if train_min_date is not None:
        df = df.filter(day >= F.lit(train_min_date))
    if rows:
        df = df.filter(day < F.lit(max(a for _, a, _ in rows)))
    later = F.filter(_array(rows), lambda f: day < f["start"])
    return df.withColumn(FOLD, F.explode(F.transform(later, lambda f: f["fold"])))


def assign_test(df: DataFrame, folds: DataFrame, date: str = DATE) -> DataFrame:
    """A row goes to the fold whose window [start, end) holds its date."""
    rows = _rows(folds)
    day = F.col(date)
    if rows:
        df = df.filter(
            (day >= F.lit(min(a for _, a, _ in rows))) & (day < F.lit(max(b for _, _, b in rows)))
        )
    inside = F.filter(_array(rows), lambda f: (day >= f["start"]) & (day < f["end"]))
    return df.withColumn(FOLD, F.explode(F.transform(inside, lambda f: f["fold"])))


def filter_cold(test: DataFrame, train: DataFrame, entity: str) -> DataFrame:
    """Test rows whose user (or item) occurs in the train set of the same fold."""
    known = train.select(FOLD, entity).distinct()
    return test.join(known, [FOLD, entity], "left_semi")


def filter_seen(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test pairs that the train set of the same fold does not hold."""
    return test.join(train.select(FOLD, USER, ITEM), [FOLD, USER, ITEM], "left_anti")


def set_diff(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct key values of `left` that `right` lacks."""
    keys = list(cols)
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def first_dates(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    train_min_date: dt.date | None = None,
    date: str = DATE,
) -> DataFrame:
    """Earliest date per key: the key is in a fold's train set iff that date precedes the fold.

    One row per user, item or pair replaces a train set that repeats for every fold.
    """
    rows = df if train_min_date is None else df.filter(F.col(date) >= F.lit(train_min_date))
    return rows.groupBy(*keys).agg(F.min(date).alias(name))


def flag_test(
    df: DataFrame, folds: DataFrame, train_min_date: dt.date | None = None, date: str = DATE
) -> DataFrame:
    """Test rows with the flags cold_user, cold_item and seen, all against the fold's train set."""
    starts = _rows(folds)
    begin = F.element_at(
        F.filter(_array(starts), lambda f: f["fold"] == F.col(FOLD)), 1
    )["start"]
    test = assign_test(df, folds, date).withColumn("_begin", begin)
    for keys, flag in (([USER], "cold_user"), ([ITEM], "cold_item"), ([USER, ITEM], "_new")):
        firsts = first_dates(df, keys, "_first", train_min_date, date)
        test = (
            test.join(firsts, keys, "left")
            .withColumn(flag, F.coalesce(F.col("_first") >= F.col("_begin"), F.lit(True)))
            .drop("_first")
        )
    return test.withColumn("seen", ~F.col("_new")).drop("_new", "_begin")


def split(
    df: DataFrame,
    folds: DataFrame,
    train_min_date: dt.date | None = None,
    cold_users: bool = True,
    cold_items: bool = True,
    already_seen: bool = True,
    date: str = DATE,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of all folds; the switches turn the three test filters on."""
    train = assign_train(df, folds, train_min_date, date)
    if not (cold_users or cold_items or already_seen):
        return train, assign_test(df, folds, date)
    test = flag_test(df, folds, train_min_date, date)
    for on, flag in ((cold_users, "cold_user"), (cold_items, "cold_item"), (already_seen, "seen")):
        if on:
            test = test.filter(~F.col(flag))
    return train, test.drop("cold_user", "cold_item", "seen")


def fold_stats(
    df: DataFrame,
    folds: DataFrame,
    train_min_date: dt.date | None = None,
    date: str = DATE,
    labels: bool = True,
    rule: str = "fixed",
) -> DataFrame:
    """Sizes of each fold, its cold users and items, known pairs and, optionally, label counts."""
    from tastemill.operators.labels import label, user_stats

    daily = df.groupBy(date).agg(F.count("*").alias("_n"))
    train_sizes = (
        assign_train(daily, folds, train_min_date, date)
        .groupBy(FOLD)
        .agg(F.sum("_n").alias("train"))
    )
    flags = stored(flag_test(df, folds, train_min_date, date))
    new_user = F.col("cold_user")
    new_item = ~F.col("cold_user") & F.col("cold_item")
    warm = ~F.col("cold_user") & ~F.col("cold_item")
    counts = flags.groupBy(FOLD).agg(
        F.count_distinct(F.when(new_user, F.col(USER))).alias("new_users"),
        F.count_if(new_user).alias("new_users_interactions"),
        F.count_distinct(F.when(new_item, F.col(ITEM))).alias("new_items"),
        F.count_if(new_item).alias("new_items_interactions"),
        F.count_if(warm & F.col("seen")).alias("known_interactions"),
        F.count_if(warm & ~F.col("seen")).alias("test"),
    )
    out = folds.join(train_sizes, FOLD, "left").join(counts, FOLD, "left")
    names = [
        "train",
        "new_users",
        "new_users_interactions",
        "new_items",
        "new_items_interactions",
        "known_interactions",
        "test",
    ]
    if labels:
        train = assign_train(df, folds, train_min_date, date)
        test = flags.filter(warm & ~F.col("seen")).drop("cold_user", "cold_item", "seen")
        stats = stored(user_stats(train, by=[FOLD]))
        for part, rows in (("train", train), ("test", test)):
            marked = label(rows, stats, rule=rule, by=[FOLD])
            sizes = marked.groupBy(FOLD).agg(
                F.count_if(F.col("target") == 1).alias(f"{part}_pos"),
                F.count_if(F.col("target") == 0).alias(f"{part}_neg"),
            )
            out = out.join(sizes, FOLD, "left")
            names += [f"{part}_pos", f"{part}_neg"]
    return out.select(
        FOLD, "start", "end", *(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names)
    )


def holdout(df: DataFrame, first: dt.date, last: dt.date, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before `first`, and rows of [first, last)."""
    day = F.col(date)
    return df.filter(day < F.lit(first)), df.filter((day >= F.lit(first)) & (day < F.lit(last)))


def quantile_date(df: DataFrame, q: float, date: str = DATE) -> DataFrame:
    """One row: the date at position round(q * (rows - 1)) of the sorted dates.

    Dates are counted first, so the running sum sees one row per distinct date.
    """
    daily = df.filter(F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    total = daily.agg(F.sum("_n")).scalar()
    spot = F.floor((total - 1) * F.lit(float(q)) + F.lit(0.5))
    return (
        daily.withColumn("_upto", F.sum("_n").over(upto))
        .filter(F.col("_upto") > spot)
        .agg(F.min(date).alias("boundary"))
    )


def quantile_split(df: DataFrame, q: float = 0.6, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Train: dates up to the q-quantile. Test: later rows of users the train set knows."""
    boundary = quantile_date(df, q, date).scalar()
    train = df.filter(F.col(date) <= boundary)
    test = df.filter(F.col(date) > boundary)
    return train, test.join(train.select(USER).distinct(), USER, "left_semi")


def split_by_user(
    df: DataFrame, weights: Sequence[tuple[str, float]], seed: int = 0, name: str = "part"
) -> DataFrame:
    """Put every user into one named part by an MD5 hash; the same user and seed always agree."""
    total = sum(w for _, w in weights)
    digest = F.md5(F.concat_ws("-", F.col(USER).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000 / F.lit(10_000.0)
    edge, choice = 0.0, None
    for part, weight in weights[:-1]:
        edge += weight / total
        hit = bucket < F.lit(edge)
        choice = F.when(hit, part) if choice is None else choice.when(hit, part)
    last = weights[-1][0]
    return df.withColumn(name, F.lit(last) if choice is None else choice.otherwise(last))


def take_fold(df: DataFrame, index: DataFrame) -> DataFrame:
    """Interaction rows of the keys in a fold index (inner join on user and item)."""
    return df.join(index, [USER, ITEM])


def restrict_features(features: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Feature rows of the entities that occur in `keys`."""
    return features.join(keys.select(on).distinct(), on, "left_semi")
