"""Feature frames, dense ids and ranking data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.expressions import genre_list
from tastemill.operators.blocks import ordinal_rank
from tastemill.schema import DATE, ITEM, TARGET, USER


def _categories(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct values of a categorical column: the caller asks for a column for each of them."""
    found = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("v")).distinct()
    return sorted(r["v"] for r in found.collect())


def genre_vocabulary(items: DataFrame, null_value: str = "unknown") -> list[str]:
    genres = F.coalesce(genre_list("genres"), F.array(F.lit(null_value)))
    return _categories(items.select(F.explode(genres).alias("genre")), "genre")


def genre_matrix(
    items: DataFrame, vocabulary: Sequence[str] | None = None, null_value: str = "unknown"
) -> DataFrame:
    """One 0/1 column per genre, in sorted order. Each row is computed alone: no pivot shuffle."""
    vocabulary = list(vocabulary) if vocabulary is not None else genre_vocabulary(items, null_value)
    rows = items.select(
        ITEM, F.coalesce(genre_list("genres"), F.array(F.lit(null_value))).alias("_genres")
    )
    flags = [F.array_contains("_genres", g).cast("tinyint").alias(g) for g in vocabulary]
    return rows.select(ITEM, *flags)


def dense_ids(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dictionary (col, name): the sorted distinct values numbered from 0."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return ordinal_rank(values, [F.asc(col)], name).withColumn(name, F.col(name) - 1)


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each categorical column by 0/1 columns named column_value."""
    rest = [c for c in df.columns if c not in cols]
    flags = [
        F.coalesce(F.col(c) == value, F.lit(False)).cast("tinyint").alias(f"{c}_{value}")
        for c in cols
        for value in _categories(df, c)
    ]
    return df.select(*rest, *flags)


def feature_lists(users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature lists per entity: (age, sex) of users and the genres of items, nulls filled."""
    age = F.coalesce(F.col("age").cast("string"), F.lit("age_unknown"))
    sex = F.coalesce(F.col("sex").cast("string"), F.lit("sex_unknown"))
    genres = F.split(F.coalesce(F.col("genres"), F.lit("genre_unknown")), ",")
    return (
        users.select(USER, F.array(age, sex).alias("features")),
        items.select(ITEM, genres.alias("features")),
    )


def feature_vocabulary(user_lists: DataFrame, item_lists: DataFrame) -> DataFrame:
    """Distinct features of both sides: (side, feature)."""
    u = user_lists.select(F.lit("user").alias("side"), F.explode("features").alias("feature"))
    i = item_lists.select(F.lit("item").alias("side"), F.explode("features").alias("feature"))
    return u.distinct().unionByName(i.distinct())


def add_features(df: DataFrame, features: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(features, on)


def add_group_ids(df: DataFrame, by: Sequence[str], name: str = "group_id") -> DataFrame:
    """Dense id of each grouping key in key order."""
    by = list(by)
    keys = df.select(*by).distinct()
    ids = ordinal_rank(keys, [F.asc(c) for c in by], name).withColumn(name, F.col(name) - 1)
    return df.join(ids, by)


def typed_features(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], DataFrame]:
    """Names of the categorical (string) columns, and the frame with numbers cast to float."""
    kept = [f for f in df.schema.fields if f.name not in exclude]
    categorical = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in kept if isinstance(f.dataType, T.NumericType)]
    others = [c for c in df.columns if c in exclude]
    return categorical, df.select(
        *others, *categorical, *(F.col(c).cast("float").alias(c) for c in numeric)
    )


def pairwise_set(df: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """(pair_id, group_id, pos_item, neg_item, pos_date, neg_date): one row per pair.

    Each column of `features` comes as pos_<name> and neg_<name>. A grouped maximum picks both sides, which needs
    one shuffle and no join of the frame with itself. The job fails on a pair id without exactly one positive and
    one negative row.
    """
    side = F.struct(F.col(ITEM).alias("item"), F.col(DATE).alias("date"), *features)
    sides = {"pos": F.col(TARGET) == 1, "neg": F.col(TARGET) == 0}
    picked = df.groupBy("pair_id", "group_id").agg(
        *(F.max(F.when(cond, side)).alias(f"_{s}") for s, cond in sides.items()),
        *(F.count_if(cond).alias(f"_{s}_rows") for s, cond in sides.items()),
    )
    whole = (F.col("_pos_rows") == 1) & (F.col("_neg_rows") == 1)
    wrong = F.raise_error(F.concat(F.lit("not one row per side in pair "), F.col("pair_id").cast("string")))
    checked = picked.withColumn("pair_id", F.when(whole, F.col("pair_id")).otherwise(wrong.cast(picked.schema["pair_id"].dataType)))
    return checked.select(
        "pair_id",
        "group_id",
        *(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for c in ("item", "date", *features) for s in sides),
    )


def listwise_set(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Target, group, date and features, with the rows of a group together and in order.

    Range partitioning on (group, item) keeps groups in order and splits one that is very large.
    """
    out = df.select("group_id", ITEM, TARGET, DATE, *features)
    return out.repartitionByRange("group_id", ITEM).sortWithinPartitions("group_id", ITEM)
