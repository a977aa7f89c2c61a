"""Cutting byte ranges out of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import slices, small, text_key
from tastemill.session import stored


def keyed_texts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, doc, text, copies): one row for the rows alike in id and text; doc is 64 bits for both. Null text is empty.

    Repeated rows are found by their `doc` alone, so texts are not shuffled but for those of repeated rows, of which
    each task hands on one.
    """
    doc = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("\0null")), text_key(text))
    texts = df.select(F.col(id).alias("id"), doc.alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    repeats = stored(texts.groupBy("doc").agg(F.count("*").alias("copies")).filter("copies > 1"))
    if not repeats.limit(1).count():
        return texts.withColumn("copies", F.lit(1).cast("bigint"))
    few = small(repeats)
    once = texts.join(few, "doc", "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
    again = texts.join(few, "doc", "left_semi").groupBy("doc").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    return once.unionByName(again.join(few, "doc"))


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges put together where they touch or overlap."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)]


def cut(texts: DataFrame, ranges: DataFrame, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_ranges[, kept]): ranges taken out of each text of `keyed_texts`.

    `ranges` holds (doc, first, past, keep); those with `keep` are only counted (by where they start). A text's distinct
    ranges are at most as many as its bytes; they meet the text in one join on doc, which is spread evenly, and the
    result is repeated for each copy of the row.
    """
    own = ranges.groupBy("doc").agg(F.collect_set(F.struct("first", "past", "keep")).alias("cuts"))
    both = texts.join(own, "doc", "left").select(
        "id", "text", "copies", *(F.col(f"cuts.{c}").alias(c) for c in ("first", "past", "keep"))
    )
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if keep_text else [])]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_ranges", *(["kept"] if keep_text else [])]

    def run(batches):
        for batch in batches:
            for part, raw in slices([batch], "text"):
                rows = []
                for text, *lists in zip(raw, *(part.column(c) for c in ("first", "past", "keep"))):
                    kept, removed, spans, n = text, 0, 0, 0
                    if lists[0].is_valid:
                        first, past, keep = (x.values.to_numpy(zero_copy_only=False) for x in lists)
                        n, gone = len(np.unique(first)), ~keep.astype(bool)
                        if gone.any():
                            starts, ends = merge(first[gone], past[gone])
                            removed, spans = int((ends - starts).sum()), len(starts)
                            bounds = zip([0, *ends.tolist()], [*starts.tolist(), len(text)])
                            kept = b"".join(text[a:b] for a, b in bounds)
                    rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), n, kept))
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), *made], names=["id", "copies", *names])

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, copies bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_ranges bigint"
    found = both.mapInArrow(run, schema + ", kept binary" * keep_text)
    return found.select("id", *names, F.explode(F.sequence(F.lit(1), "copies")).alias("copies")).drop("copies")
