"""Substring dedup by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import slices
from tastemill.llm.spans import cut, keyed_texts
from tastemill.session import stored

#: Least and largest chunk in bytes, and the share of places (one in 2^BITS) at which a chunk may end.
LEAST, MOST, BITS = 16, 1024, 5
#: The gear table: a fixed random number for each byte value.
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes whose rolling hashes are worked out at once.
STRETCH = 1 << 20


def gear_ends(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes has its top BITS bits clear.

    h = (h << 1) + gear[byte] in 32 bits forgets a byte after 32 steps, so it is a sum of 32 shifted table values,
    which doubling makes in five steps.
    """
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunk_ends(text: bytes) -> list[int]:
    """Ends of a text's chunks. No chunk is cut inside a UTF-8 character."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    found = []
    for at in range(0, n, STRETCH):
        ahead = min(32, at)
        ends = gear_ends(data[at - ahead : at + STRETCH])
        found.append(ends[ends > ahead] + (at - ahead))
    places = np.concatenate(found)
    places = places[(places < n)]
    places = places[data[places] & 0xC0 != 0x80].tolist()
    out, last = [], 0
    for place in [*places, n]:
        while place - last > MOST:
            last += MOST
            while text[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if place - last >= LEAST and place < n:
            out.append(place)
            last = place
    if last < n:
        out.append(n)
    return out


def chunk_table(texts: DataFrame, *keep: str) -> DataFrame:
    """(d1, d2, *keep, first, past): one row per chunk with its 128-bit digest and the columns `keep` of its text."""
    kinds = [f"{k} {texts.schema[k].dataType.simpleString()}" for k in keep]

    def run(batches):
        for batch in batches:
            for part, raw in slices([batch], "text"):
                ends = [chunk_ends(t) for t in raw]
                starts = [[0, *e[:-1]] if e else [] for e in ends]
                digests = b"".join(
                    xxhash.xxh3_128_digest(t[a:b]) for t, ss, es in zip(raw, starts, ends) for a, b in zip(ss, es)
                )
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                at = pa.array(np.repeat(np.arange(len(raw)), [len(e) for e in ends]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair[:, 0]),
                        pa.array(pair[:, 1]),
                        *(part.column(k).take(at) for k in keep),
                        pa.array([a for ss in starts for a in ss], pa.int32()),
                        pa.array([b for es in ends for b in es], pa.int32()),
                    ],
                    names=["d1", "d2", *keep, "first", "past"],
                )

    schema = ", ".join(["d1 bigint", "d2 bigint", *kinds, "first int", "past int"])
    return texts.select("text", *keep).mapInArrow(run, schema)


def chunk_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_shared[, kept]): one row per row of `df`.

    Every chunk is kept where it comes first (smallest id, nulls last, then smallest hash of the text, then place) and
    removed elsewhere, in the same text too. n_shared counts a text's chunks that also occur elsewhere. Chunk ends
    depend on the bytes around them and, by LEAST, on the end before: after an insertion they fall in step again
    within a few cuts. Rows alike in id and text are one text: each gets the same result, and their chunks count as
    shared. Null and empty texts have no chunks. Other columns of `df` are not looked at.

    The texts are cut twice instead of storing their chunks: once for the digests that occur more than once and where
    each comes first, and once to look up those digests.
    """
    texts = keyed_texts(df, id, text)
    none = "none" if texts.filter("id is null").limit(1).count() else None
    rows = texts.withColumn("none", F.col("id").isNull()) if none else texts
    place = F.struct(*([none] if none else []), "id", "doc", "first")
    chunks = chunk_table(rows, *([none] if none else []), "id", "doc", "copies")
    shared = chunks.groupBy("d1", "d2").agg(F.sum("copies").alias("n"), F.min(place).alias("best")).filter("n > 1")
    shared = stored(shared.select("d1", "d2", F.col("best.doc").alias("own"), F.col("best.first").alias("at")))
    met = chunk_table(texts, "doc").join(shared, ["d1", "d2"])
    keep = (F.col("doc") == F.col("own")) & (F.col("first") == F.col("at"))
    return cut(texts, met.select("doc", "first", "past", keep.alias("keep")), keep_text).withColumnRenamed("n_ranges", "n_shared")
