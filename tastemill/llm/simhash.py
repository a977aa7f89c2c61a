"""SimHash near-dedup: fingerprints, bit-sliced comparison, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.components import connected_components
from tastemill.llm.frames import map_text, text_key
from tastemill.session import stored

#: Fixed value: the seed of the shingle hash.
SEED = 42
#: Rows of one comparison block, and of one part of a bucket that is larger.
BLOCK = 1024
#: Shingle hashes whose bits are spread out at once.
HASHES = 1 << 15


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 values of a text's word shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())),
        np.uint64,
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, text_key, fp long): a signed long that holds the 64 bits."""

    def work(_, raw):
        return {"fp": pa.array([fingerprint(t, width) for t in raw], pa.int64())}

    df = df.select(F.col(id).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    return map_text(df, "text", ["id", "text_key"], "fp bigint", work)


def near(rows: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix: which of the unsigned 64-bit `rows` differ in at most `radius` bits.

    The rows stand as 64 bit planes of one bit a row. Each plane is compared with each query's bit, and the
    differing bits are added to vertical counters, one carry at a time; a counter that passes the radius
    sticks. The planes that are left are skipped once all counters have stuck.
    """
    n = len(rows)
    lanes = -(-n // 64)
    bits = np.unpackbits(rows.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, lanes * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    flip = (bits.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)).T
    levels = int(radius + 1).bit_length()
    out = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        mask = flip[:, at : at + 512]
        count = [np.zeros((mask.shape[1], lanes), np.uint64) for _ in range(levels)]
        over = np.zeros((mask.shape[1], lanes), np.uint64)
        for plane in range(64):
            carry = planes[plane][None, :] ^ mask[plane][:, None]
            for level in count:
                level ^= carry
                carry &= ~level
            over |= carry
            if plane % 8 == 7:
                past = over | _above(count, radius)
                if (past == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                    break
        hit = np.ascontiguousarray(~(over | _above(count, radius))).view(np.uint8)
        out[at : at + 512] = np.unpackbits(hit, axis=1, bitorder="little")[:, :n]
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than `radius`."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], 0xFFFFFFFFFFFFFFFF)
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same &= count[i]
        else:
            more |= same & count[i]
            same &= ~count[i]
    return more


def block_labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row it reaches."""
    n = len(linked)
    labels = np.arange(n)
    while True:
        best = np.where(linked, labels[None, :], n).min(axis=1, initial=n)
        best = np.minimum(labels, best)
        best = np.minimum(best, best[best])
        if (best == labels).all():
            return labels
        labels = best


def _block_links(batches, radius: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets are put together to blocks; each block gives a spanning star of each group in it."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        rows = np.unique(rows)
        low = block_labels(near(rows.view(np.uint64), radius))
        at = np.flatnonzero(low != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(rows[low[at]])], names=["a", "b"])

    held = np.zeros((0, 2), np.int64)
    for batch in batches:
        new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp")], axis=1)
        held = np.concatenate([held, new])
        while len(held) > BLOCK:
            edges = np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1
            fit = edges[edges <= BLOCK]
            cut = fit[-1] if len(fit) else edges[0] if len(edges) else 0
            if not cut:
                break
            yield links(held[:cut, 1])
            held = held[cut:]
    if len(held):
        yield links(held[:, 1])


def link_fingerprints(fps: DataFrame, radius: int = 3, parts: int = 5) -> DataFrame:
    """(a, b): links between distinct values of `fp` that differ in at most `radius` bits, enough to connect them.

    The 64 bits are cut into `parts`; values within the radius agree in at least parts - radius of them, so each
    choice of that many parts is a bucket key. Buckets of one value are dropped. A bucket above BLOCK values is cut
    by hash, and each pair of its parts is a bucket of its own: no task holds a whole large bucket, and no pair is lost.
    """
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [
        sum(((1 << edges[p + 1]) - (1 << edges[p])) for p in chosen)
        for chosen in combinations(range(parts), parts - radius)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(
        F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    ).alias("key")
    keyed = stored(fps.select("fp").distinct().select("fp", key))
    counts = keyed.groupBy("key").count().filter("count > 1")
    counts = stored(counts.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n"))
    met = keyed.join(counts, "key").withColumn("p", part)
    met = met.select("key", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    met = met.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("bucket"), "fp")
    dealt = met.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _block_links(batches, radius), "a bigint, b bigint")


def simhash_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """(id, text_key, fp, component_id, first): one row per row of `df`.

    component_id is the smallest id that links reach; `first` marks the row that stays if one row of each group
    stays (smallest id, nulls last, then the smallest text key; of rows alike in both, all are marked). Copies
    share a fingerprint, so only distinct fingerprints are compared. Null text counts as empty; a null id takes
    part in linking but is no component_id unless its whole group has none. An empty table gives no rows.
    """
    fps = stored(fingerprints(df, id, text, width))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    lows = stored(fps.groupBy("fp").agg(best.alias("best")))
    groups = stored(connected_components(link_fingerprints(lows, radius)))
    named = lows.join(groups, lows.fp == groups.node, "left").select(
        "fp", "best", F.coalesce("component", "fp").alias("component")
    )
    named = stored(named)
    tops = stored(named.groupBy("component").agg(F.min("best").alias("top")))
    tops = stored(named.select("fp", "component").join(tops, "component").select("fp", "top"))
    found = fps.join(tops, "fp")
    return found.select(
        "id",
        "text_key",
        "fp",
        F.col("top.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("text_key") == F.col("top.text_key"))).alias("first"),
    )
