"""Mixing sources to target weights by thresholds on a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.operators.blocks import ordinal_rank
from tastemill.session import stored

#: Hex digits of the hash that one level of the histogram resolves, and the number of levels.
DIGITS, LEVELS = 2, 5

#: The words that a text's size counts, and the weights that sources take in turn.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def rotating_weights(sources: DataFrame, source: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): the weights in turn over the distinct sources by code point, null last."""
    named = sources.select(source).distinct().select(source, F.hex(source).alias("points"))
    named = stored(named.withColumn("last", F.col("points").isNull()))
    ranked = ordinal_rank(named, [F.col("last"), F.col("points")], "turn")
    turn = F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int")
    return ranked.select(source, F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"))


def capped_targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """Add `target` to (.., size, weight): all sizes together shared by weight, at most `repeats` times a source's size.

    What a source cannot take goes to the others by weight, until none is above its limit. Each round needs two
    sums; the rounds are few, as each one fixes every source above its limit.
    """
    limit = F.col("size") * repeats
    total = sizes.agg(F.sum("size")).first()[0] or 0
    level = -1.0
    while True:
        fixed = limit <= F.col("weight") * level
        row = sizes.agg(F.sum(F.when(fixed, limit)), F.sum(F.when(~fixed, F.col("weight")))).first()
        if not row[1]:
            break
        new = (total - (row[0] or 0)) / row[1]
        if new <= level:
            break
        level = new
    return sizes.withColumn(
        "target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    size: str = "size",
    id: str = "doc_id",
    weights: DataFrame | None = None,
    repeats: int = 3,
) -> DataFrame:
    """Add mix_source_size, mix_target and mix_copies (how often the mix takes the row) to `docs`.

    Names that start with mix_ are reserved; any other column of `docs` is kept.

    `docs` must be stored (it is read several times). `weights` holds (source, weight); without it the sources
    take WEIGHTS in turn. A source whose target is n whole times its size and a rest takes every row n times, and
    once more those rows whose hash lies below a threshold. The thresholds come from histograms: sizes are summed
    by source and leading hash digits, the bucket in which the rest ends is the boundary, and only its rows are
    summed by the next digits. The last bucket is taken if that brings the sum nearer. A larger target keeps all
    that a smaller one took. No rows are sorted, and joins run on (source, bucket), so a large source is spread out.

    A null size counts as 0; a null source is a source of its own; rows with the same id share a hash. A row of size 0 is
    taken as often as its source as a whole, never once more. Nothing to take (all sizes 0, or no rows) gives 0 copies.
    """
    digest = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("\0null")))
    keyed = docs.withColumn("mix_hash", digest)
    keyed = keyed.withColumn("mix_size", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    keyed = keyed.withColumn("mix_key", F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    slim = stored(keyed.select(F.col(source).alias("name"), "mix_key", "mix_hash", "mix_size"))

    # A source's total is a sum over its histogram.
    first = stored(
        slim.groupBy("name", "mix_key", F.substring("mix_hash", 1, DIGITS).alias("bucket")).agg(
            F.sum("mix_size").alias("sum")
        )
    )
    sizes = first.groupBy("name", "mix_key").agg(F.sum("sum").alias("size"))
    turns = (
        rotating_weights(sizes, "name")
        if weights is None
        else weights.select(F.col(source).alias("name"), F.col("weight").cast("double").alias("weight"))
    )
    turns = turns.select(F.coalesce(F.concat(F.lit("="), "name"), F.lit("")).alias("mix_key"), "weight")
    sizes = stored(sizes.drop("name").join(turns, "mix_key"))
    targets = capped_targets(sizes, repeats)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - whole * F.col("size"))
    targets = stored(targets.select("mix_key", "size", "target", "whole", "rest"))

    # Level by level: whole buckets below the boundary are in, those above are out, the boundary goes on.
    level = first.select("mix_key", "bucket", "sum").join(targets.select("mix_key", F.col("rest")), "mix_key")
    ends = []
    order = Window.partitionBy("mix_key").orderBy("bucket")
    for k in range(1, LEVELS + 1):
        summed = level.withColumn("upto", F.sum("sum").over(order))
        edge = summed.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("sum") <= F.col("rest")))
        edge = stored(
            edge.select("mix_key", "bucket", "sum", (F.col("rest") - F.col("upto") + F.col("sum")).alias("rest"))
        )
        ends.append(edge)
        if k == LEVELS:
            break
        held = slim.select("mix_key", "mix_hash", "mix_size", F.substring("mix_hash", 1, DIGITS * k).alias("bucket"))
        held = held.join(edge.select("mix_key", "bucket", "rest"), ["mix_key", "bucket"])
        level = held.groupBy(
            "mix_key", F.substring("mix_hash", 1, DIGITS * (k + 1)).alias("bucket"), "rest"
        ).agg(F.sum("mix_size").alias("sum"))
    last = ends[-1].select(
        "mix_key",
        # The hash must lie below this; the last bucket itself is taken when that brings the sum nearer.
        F.when(F.col("rest") * 2 >= F.col("sum"), F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket")).alias("below"),
    )
    limits = targets.join(last, "mix_key", "left").select(
        "mix_key",
        F.col("size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("whole").alias("mix_whole"),
        # Nothing is left over where the target is a whole number of times the size.
        F.when(F.col("rest") > 0, F.col("below")).alias("mix_below"),
    )
    spread = stored(first.select("mix_key", F.col("bucket").alias("mix_bucket")).join(limits, "mix_key"))
    keyed = keyed.withColumn("mix_bucket", F.substring("mix_hash", 1, DIGITS))
    once = F.coalesce(((F.col("mix_hash") < F.col("mix_below")) & (F.col("mix_size") > 0)).cast("bigint"), F.lit(0))
    found = keyed.join(spread, ["mix_key", "mix_bucket"])
    return found.select(
        *docs.columns, "mix_source_size", "mix_target", (F.col("mix_whole") + once).alias("mix_copies")
    )
