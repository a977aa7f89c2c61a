"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work on at most this many bytes of text at once inside a task (one longer text is a slice of its own).
SLICE_BYTES = 8 << 20

#: A frame of at most this many rows of a few short columns may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (which must be stored) with a broadcast hint if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def text_key(text: str = "text") -> Column:
    """64 bits that stand for a text together with its id; null and empty texts differ."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def in_share(id: str, share: Column) -> Column:
    """Whether the hash of an id falls into the share (0 to 1) of all hashes; a share above 0 is rounded up, never to 0."""
    return F.pmod(F.xxhash64(id), F.lit(1 << 40)) < F.ceil(share * float(1 << 40))


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that each part holds a bounded amount of text; null texts come as b""."""
    for batch in batches:
        raw = batch.column(text).cast(pa.binary()).fill_null(b"")
        ends = pc.cumulative_sum(pc.binary_length(raw).cast(pa.int64())).to_pylist()
        start, before = 0, 0
        for i, end in enumerate(ends):
            if i > start and end - before > SLICE_BYTES:
                yield batch.slice(start, i - start), raw.slice(start, i - start).to_pylist()
                start, before = i, ends[i - 1]
        if batch.num_rows > start:
            yield batch.slice(start), raw.slice(start).to_pylist()


def map_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    schema: str,
    work: Callable[[pa.RecordBatch, list[bytes]], dict[str, object]],
) -> DataFrame:
    """One output row per row: the columns `keep` and those that `work` makes of each slice's texts.

    A column of `keep` gives way to a made one of the same name.
    """
    made = [part.split()[0] for part in schema.split(", ")]
    keep = [k for k in keep if k not in made]
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keep).schema.fields}
    out = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), schema])

    def run(batches):
        for batch, raw in slices(batches, text):
            found = work(batch, raw)
            arrays = [batch.column(k) for k in keep] + [
                v if isinstance(v, pa.Array) else pa.array(v) for v in (found[m] for m in made)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    return source.mapInArrow(run, out)
