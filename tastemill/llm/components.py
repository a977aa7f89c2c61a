"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import stored


#: Parts over which the rows of one node are spread when they meet the node's smallest neighbour.
SALTS = 16


def _meet(pairs: DataFrame, node: str, other: str, low: DataFrame) -> DataFrame:
    """Join on `node`, salted by `other`, as a hub may have very many neighbours."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    low = low.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(SALTS)))))
    return pairs.join(low, [node, "salt"])


def _sign(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of `links`, the smallest node that its links reach.

    Each round hangs every node's neighbours below its smallest neighbour (first the larger ones, then all), so
    paths shorten by half and more. Only pairs of nodes move, and each round is written to the shared folder.
    Links to itself and links with a null end count for nothing.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = stored(links.filter("a <> b").distinct())
    sign = _sign(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _meet(both, "u", "v", low).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, "a", "b", low).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = stored(small.union(low.select("a", "m")).distinct())
        found = _sign(new)
        if found == sign:
            break
        now, sign = new, found
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
