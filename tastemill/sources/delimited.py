"""Readers for delimited files with declared types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill import schema as S
from tastemill.functions.expressions import flag_names, missing_as_null, tidy_list, tidy_text


def read_ratings(spark: SparkSession, path: str, sort: bool = False) -> DataFrame:
    """Tab separated user, item, rating, epoch seconds; the epoch becomes a date."""
    raw = spark.read.schema(S.FILM_RATINGS).option("sep", "\t").csv(path)
    ratings = raw.select(
        S.USER,
        S.ITEM,
        S.RATING,
        # Days since 1970 in UTC, whatever the session time zone.
        F.date_from_unix_date(F.floor(F.col("timestamp") / 86_400).cast("int")).alias(S.DATE),
    )
    return ratings.orderBy(S.USER, S.ITEM) if sort else ratings


def read_flag_items(
    spark: SparkSession, path: str, columns: Sequence[str] | None = (S.ITEM, "title")
) -> DataFrame:
    """Pipe separated Latin-1 film items; the genre flags fold into one sorted string.

    `columns=None` reads the whole file. Flag columns named in `columns` (or all of them) decide
    which genres can appear; without any the genres string is empty.
    """
    raw = spark.read.schema(S.FILM_ITEMS).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    wanted = list(columns) if columns is not None else raw.columns
    flags = [name for name in S.FILM_GENRES if name in wanted]
    plain = [name for name in wanted if name not in flags and name != "video_release_date"]
    out = raw.select(*(F.col(f"`{name}`") for name in plain), flag_names(flags).alias("genres"))
    if "release_date" in plain:
        out = out.withColumn("release_date", F.to_date("release_date", "dd-MMM-yyyy"))
    return out


def read_flag_users(spark: SparkSession, path: str) -> DataFrame:
    """Pipe separated film users."""
    return spark.read.schema(S.FILM_USERS).option("sep", "|").csv(path)


def _by_name(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header, columns taken by name and cast to the declared types.

    The header decides the order of the columns in the file, so it is read as strings first; the
    CSV parser still reads only the selected columns.
    """
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(name).cast(dtype).alias(name) for name, dtype in columns.items()))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """CSV interactions; a missing or NaN rating is NULL. Dedupe with `dedupe_interactions`."""
    raw = _by_name(
        spark,
        path,
        {
            S.USER: "bigint",
            S.ITEM: "bigint",
            S.PROGRESS: "smallint",
            S.RATING: "double",
            S.DATE: "date",
        },
    )
    return raw.withColumn(S.RATING, missing_as_null(S.RATING))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """CSV items; `id` becomes `item_id`, title and genres are normalised."""
    raw = _by_name(
        spark,
        path,
        {"id": "bigint", "title": "string", "genres": "string", "authors": "string", "year": "string"},
    )
    return raw.withColumnRenamed("id", S.ITEM).withColumns(
        {"title": tidy_text("title"), "genres": tidy_list("genres")}
    )


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """CSV users; sex arrives as a float flag and leaves as a category string."""
    raw = _by_name(spark, path, {S.USER: "bigint", "age": "string", "sex": "double"})
    return raw.withColumn("sex", F.col("sex").cast("tinyint").cast("string"))
