"""Building blocks: global ranks, per-group top-k, group pairs, keyed attachments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import cut_lineage

SALTS = 8  # parts per key in joins of rows with per-key statistics
ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def ordinal_rank(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "rank",
    within: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Rank rows 1..n by `order` (which must make every row distinct) without one big partition.

    Rows are range partitioned and sorted, so a partition holds a run of consecutive ranks; its
    first rank is the number of rows in the partitions before it. The sorted rows are written to
    the checkpoint folder between the two passes: the range bounds come from a sample, and the
    counts and the ranks must see the same bounds. A large `within` group spans many partitions.
    """
    keys = [*(F.col(c).asc() for c in within), *order]
    # Without `parts` AQE may merge neighbouring ranges, which keeps them in order.
    spread = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged = (
        spread.sortWithinPartitions(*keys)
        .withColumn("_rowid", F.monotonically_increasing_id())
    )
    ranged = cut_lineage(ranged)
    part = F.shiftright("_rowid", ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition, so a single window is small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    ranked = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_rowid").bitwiseAND((1 << ROW_BITS) - 1) + 1)
        .drop("_rowid", "_start")
    )
    if not within:
        return ranked.drop("_part")
    # A group's first rank meets its rows by (group, partition), so a large group stays where it is spread out.
    pieces = ranked.groupBy(*within, "_part").agg(F.min(name).alias("_low"))
    firsts = pieces.withColumn("_first", F.min("_low").over(Window.partitionBy(*within))).drop("_low")
    return ranked.join(firsts, [*within, "_part"]).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", "_part")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows of each group; each task keeps k rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).filter(F.col(name) <= k)


def attach_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of a totals table: one row in all, or one row per `by` value.

    `by` names folds or the like, of which there is a handful, so the table is broadcast: a shuffle on so
    few keys would put all rows into a few tasks.
    """
    if by:
        return df.join(F.broadcast(totals), list(by))
    return df.withColumns(
        {name: totals.select(name).scalar() for name in totals.columns}
    )


def attach_by_key(
    rows: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join `stats` (few rows per key) to `rows` on (key, salt): a key's rows go to SALTS parts.

    The result is not partitioned by the key, so a later aggregate shuffles partial sums and
    AQE stays free to cut a part that is still too large (a key may hold a third of all rows).
    Never a broadcast: Spark's estimate sees neither the SALTS copies nor how long lists in `stats` are.
    """
    on = list(on)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    salts = F.array(*(F.lit(n) for n in range(SALTS)))
    right = stats.withColumn("_salt", F.explode(salts))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def group_pairs(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    values: Sequence[str],
    aggs: Mapping[str, Column],
    chunk: int = 512,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Aggregate over the groups that hold both items: one row per (item_i < item_j).

    Columns of `group` named in `keep` (folds, segments) stay apart in the result.

    `df` must be distinct on (group, item). Expressions in `aggs` read the value columns with the
    suffixes `_i` and `_j`. Two items meet inside a group (a user), and a user with n items is cut
    into ceil(n / chunk) chunks; every pair of chunks is its own join key. No join key ever gathers
    more than about `chunk` rows per side, so the pairs of one heavy user are built by many tasks,
    and the sums start in the task that builds them.
    """
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk)
    rows = (
        attach_by_key(df.select(*group, item, *values), sizes, group, "left")
        .withColumn("_chunks", F.coalesce(F.ceil(F.col("_n") / chunk), F.lit(1)).cast("int"))
        .withColumn("_c", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int"))
        .drop("_n")
    )

    def side(suffix: str, low: Column, high: Column, a: str, b: str) -> DataFrame:
        return rows.withColumn(b, F.explode(F.sequence(low, high))).select(
            *group,
            F.col("_c").alias(a),
            b,
            F.col(item).alias(f"item_{suffix}"),
            *(F.col(v).alias(f"{v}_{suffix}") for v in values),
        )

    left = side("i", F.col("_c"), F.col("_chunks") - 1, "_a", "_b")
    right = side("j", F.lit(0), F.col("_c"), "_b", "_a")
    met = left.join(right, [*group, "_a", "_b"]).filter(
        (F.col("_a") < F.col("_b")) | (F.col("item_i") < F.col("item_j"))
    )
    flip = F.col("item_i") > F.col("item_j")
    swapped = {
        f"{v}_{s}": F.when(flip, F.col(f"{v}_{o}")).otherwise(F.col(f"{v}_{s}"))
        for v in ["item", *values]
        for s, o in (("i", "j"), ("j", "i"))
    }
    return (
        met.select(*keep, *(expr.alias(name) for name, expr in swapped.items()))
        .groupBy(*keep, "item_i", "item_j")
        .agg(*(expr.alias(name) for name, expr in aggs.items()))
    )


def mirrored(pairs: DataFrame, swap: Mapping[str, str]) -> DataFrame:
    """Each pair row once as it is and once with the columns of `swap` exchanged."""
    both = {**swap, **{v: k for k, v in swap.items()}}
    plain = F.struct(*(F.col(c) for c in pairs.columns))
    turned = F.struct(*(F.col(both.get(c, c)).alias(c) for c in pairs.columns))
    return pairs.select(F.explode(F.array(plain, turned)).alias("_p")).select("_p.*")
