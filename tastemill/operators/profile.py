"""Data profiles: column summaries, categories, histograms and box-plot numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import quantize
from tastemill.operators.blocks import top_per_group
from tastemill.schema import ITEM, PROGRESS, USER


def profile(df: DataFrame, cols: Sequence[str], quantiles: bool = False) -> DataFrame:
    """One row per numeric column: rows, nulls, mean, std, min, max and optional quartiles."""
    cells = df.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols))
        ).alias("_c")
    ).select("_c.*")
    aggs = [
        F.count("*").alias("rows"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    ]
    if quantiles:
        quarters = F.percentile_approx("x", [0.25, 0.5, 0.75])
        aggs += [quarters[n].alias(name) for n, name in enumerate(("q25", "median", "q75"))]
    return cells.groupBy("column").agg(*aggs)


def profile_categorical(df: DataFrame, cols: Sequence[str], top: int = 10) -> DataFrame:
    """Per column: rows, distinct values, missing share, and the `top` values with counts."""
    cells = df.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols))
        ).alias("_c")
    ).select("_c.*")
    counts = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count("v").alias("cardinality"),
        (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing"),
    )
    best = top_per_group(
        counts.filter(F.col("v").isNotNull()), ["column"], [F.desc("n"), F.asc("v")], top
    )
    return best.join(summary, "column").select(
        "column", "rows", "cardinality", "missing", F.col("rank"), F.col("v").alias("value"), "n"
    )


def histogram(df: DataFrame, col: str = PROGRESS, width: int = 5) -> DataFrame:
    """Percent of rows per bin of `width`."""
    bins = df.groupBy(quantize(col, width).alias("bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("percent", 100.0 * F.col("n") / bins.agg(F.sum("n")).scalar())


def bin_counts(df: DataFrame, col: str = PROGRESS, width: int = 20) -> DataFrame:
    """Interactions per user and bin."""
    return df.groupBy(USER, quantize(col, width).alias("bin")).agg(
        F.count(ITEM).alias("num_interactions")
    )


def box_stats(counts: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the counts per bin.

    Counts are grouped by value first, and the exact percentile takes the frequencies.
    """
    sizes = counts.groupBy("bin", "num_interactions").agg(F.count("*").alias("_f"))
    quarter = lambda q: F.expr(f"percentile(num_interactions, {q}, _f)")
    return sizes.groupBy("bin").agg(
        F.sum("_f").alias("users"),
        F.min("num_interactions").alias("min"),
        quarter(0.25).alias("q25"),
        quarter(0.5).alias("median"),
        quarter(0.75).alias("q75"),
        F.max("num_interactions").alias("max"),
    )


def vocab_size(items: DataFrame) -> DataFrame:
    """Number of distinct genres, a missing genre list counting as one."""
    genres = F.coalesce(F.split("genres", ","), F.array(F.lit(None).cast("string")))
    return (
        items.select(F.explode(genres).alias("genre"))
        .distinct()
        .agg(F.count("*").alias("num_genres"))
    )


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: distinct values of each column. Values are grouped first, then counted."""
    cells = df.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols))
        ).alias("_c")
    ).select("_c.*")
    return (
        cells.filter(F.col("v").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count("*").alias("distinct_values"))
    )
