"""Parquet tables and CSV reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_table(df: DataFrame, path: str, partition_by: str | None = None, files: int | None = None) -> None:
    """Parquet output. Spark spreads a large partition value over several writers: rows are
    shuffled by range on (partition column, remaining columns), not hashed on the value alone."""
    writer = df
    if partition_by is not None:
        others = [name for name in df.columns if name != partition_by][:2]
        keys = [partition_by, *others]
        writer = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
        writer.write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return
    if files:
        writer = df.repartition(files)
    writer.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; meant for fold statistics and metric tables."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_reports(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Read one or many reports (folders or globs) of the same schema as one table."""
    found = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("header", True).csv(found)
