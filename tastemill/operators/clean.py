"""Cleaning and normalisation of interactions, users and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.expressions import genre_list, missing_as_null, tidy_list, tidy_text
from tastemill.operators.blocks import attach_by_key, ordinal_rank
from tastemill.schema import DATE, ITEM, PROGRESS, RATING, USER
from tastemill.session import stored


def dedupe_interactions(df: DataFrame) -> DataFrame:
    """One row per (user, item): best progress, best known rating, earliest date."""
    rating = missing_as_null(RATING) if dict(df.dtypes)[RATING] in ("double", "float") else F.col(RATING)
    return df.groupBy(USER, ITEM).agg(
        F.max(PROGRESS).alias(PROGRESS),
        F.max(rating).alias(RATING),
        F.min(DATE).alias(DATE),
    )


def filter_noise(df: DataFrame, min_items: int = 5) -> DataFrame:
    """Drop unread rows, then users left with fewer than `min_items` distinct items.

    Distinct items are counted by first grouping on (user, item), so a user with very many rows
    is counted by many tasks.
    """
    read = df.filter(F.col(PROGRESS) > 0)
    kept = (
        read.groupBy(USER, ITEM)
        .agg(F.lit(1).alias("_one"))
        .groupBy(USER)
        .agg(F.count("*").alias("_items"))
        .filter(F.col("_items") >= min_items)
    )
    return read.join(kept.select(USER), USER, "left_semi")


def restrict_to_known(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions whose user and item exist in the dimension tables."""
    return df.join(users.select(USER), USER, "left_semi").join(items.select(ITEM), ITEM, "left_semi")


def normalize_items(df: DataFrame) -> DataFrame:
    return df.withColumns({"title": tidy_text("title"), "genres": tidy_list("genres")})


def genre_counts(items: DataFrame) -> DataFrame:
    """Genre vocabulary with counts; genres are few, so this frame is small."""
    return (
        items.select(F.explode(genre_list("genres")).alias("genre"))
        .groupBy("genre")
        .agg(F.count("*").alias("n"))
    )


def genre_coverage(items: DataFrame) -> DataFrame:
    """Vocabulary by falling count with its running share of all genre mentions."""
    counts = genre_counts(items)
    upto = Window.orderBy(F.desc("n"), F.asc("genre")).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("cum_fraction", F.sum("n").over(upto) / total)


def _cut_count(counts: DataFrame, total: int, cov: float, ways: int = 64) -> tuple[int, int]:
    """(count, kept): genres with a greater count stay within `cov`, and of those with this count the first `kept`.

    Each pass sums the counts of an interval in `ways` parts and goes on with the part in which the share is passed, so
    the driver sees `ways` rows a pass and no row of the vocabulary.
    """
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0
    while True:
        step = -(-(high - low) // ways)
        inside = counts.filter((F.col("n") >= low) & (F.col("n") < high))
        sums = inside.groupBy(F.floor((F.col("n") - low) / step).alias("p")).agg(F.sum("n").alias("sum")).collect()
        for part, mass in sorted(((r.p, r["sum"]) for r in sums), reverse=True):
            if (above + mass) / total > cov:
                break
            above += mass
        else:
            return low - 1, 0
        low, high = low + part * step, min(high, low + (part + 1) * step)
        if high - low == 1:
            kept = int((cov * total - above) // low)
            while (above + (kept + 1) * low) / total <= cov:
                kept += 1
            while kept and (above + kept * low) / total > cov:
                kept -= 1
            return low, kept


def kept_genres(items: DataFrame, cov: float) -> DataFrame:
    """(genre): the most frequent genres whose running share stays within `cov`; ties by name."""
    counts = stored(genre_counts(items))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return counts.select("genre")
    count, first = _cut_count(counts, total, cov)
    kept = counts.filter(F.col("n") > count).select("genre")
    if not first:
        return kept
    ties = ordinal_rank(counts.filter(F.col("n") == count).select("genre"), [F.asc("genre")], "place")
    return kept.union(ties.filter(F.col("place") <= first).select("genre"))


def select_genres(items: DataFrame, cov: float, null_value: str | None = None) -> DataFrame:
    """Keep the most frequent genres whose running share stays within `cov`.

    Each distinct list of genres meets the kept ones in a plain join, and the rows their list, salted.
    """
    if not 0.0 <= cov <= 1.0:
        raise ValueError("cov must lie in [0, 1]")
    lists = items.select("genres").distinct().select("genres", F.explode(F.array_distinct(genre_list("genres"))).alias("genre"))
    found = lists.join(kept_genres(items, cov), "genre").groupBy("genres").agg(F.collect_list("genre").alias("_kept"))
    found = found.select("genres", F.array_join(F.array_sort("_kept"), ",").alias("_chosen"))
    chosen = F.when(F.col("_chosen") != "", F.col("_chosen"))
    if null_value is not None:
        chosen = F.coalesce(chosen, F.lit(null_value))
    return (
        attach_by_key(items, found, ["genres"], "left")
        .withColumns({"title": tidy_text("title"), "genres": chosen})
        .select(*items.columns)
    )


def keep_top_items(df: DataFrame, n: int) -> DataFrame:
    """Interactions with the n items that have most interactions (ties: smaller id first)."""
    top = df.groupBy(ITEM).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.asc(ITEM)).limit(n)
    return df.join(top.select(ITEM), ITEM, "left_semi")


def _filled(name: str, value: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(value)).alias(name)


def fill_user_features(df: DataFrame, age: str = "unknown", sex: str = "unknown") -> DataFrame:
    return df.withColumns({"age": _filled("age", age), "sex": _filled("sex", sex)})


def fill_item_features(df: DataFrame, genres: str = "genre_unknown", year: str = "unknown") -> DataFrame:
    return df.select(ITEM, _filled("genres", genres), _filled("year", year))


def center_ratings(df: DataFrame) -> DataFrame:
    """Add each user's mean rating and the rating less that mean."""
    means = df.groupBy(USER).agg(F.avg(RATING).alias("mean_user_rating"))
    return attach_by_key(df, means, [USER]).withColumn(
        "norm_rating", F.col(RATING) - F.col("mean_user_rating")
    )
