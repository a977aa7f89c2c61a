"""Column names and declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

USER = "user_id"
ITEM = "item_id"
DATE = "start_date"
TARGET = "target"
PROGRESS = "progress"
RATING = "rating"
RANK = "rank"
FOLD = "fold"

# The genre flags of the film item file, in file order.
FILM_GENRES = (
    "unknown",
    "Action",
    "Adventure",
    "Animation",
    "Children's",
    "Comedy",
    "Crime",
    "Documentary",
    "Drama",
    "Fantasy",
    "Film-Noir",
    "Horror",
    "Musical",
    "Mystery",
    "Romance",
    "Sci-Fi",
    "Thriller",
    "War",
    "Western",
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


FILM_RATINGS = _struct(
    (USER, T.LongType()),
    (ITEM, T.LongType()),
    (RATING, T.FloatType()),
    ("timestamp", T.IntegerType()),
)

FILM_ITEMS = _struct(
    (ITEM, T.LongType()),
    ("title", T.StringType()),
    ("release_date", T.StringType()),
    ("video_release_date", T.StringType()),
    ("IMDb_URL", T.StringType()),
    *((genre, T.ByteType()) for genre in FILM_GENRES),
)

FILM_USERS = _struct(
    (USER, T.LongType()),
    ("age", T.ShortType()),
    ("gender", T.StringType()),
    ("occupation", T.StringType()),
    ("zip_code", T.StringType()),
)
