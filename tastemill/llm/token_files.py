"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.llm.frames import slices, small
from tastemill.session import scratch_folder, stored

#: Words of one generation of a Python worker's cache. When it is full, it becomes the old one, from which words that
#: are still in use move on.
CACHE = 350_000

_tokenizers: dict[str, tuple] = {}


def tokenizer(path: str):
    """(tokenizer, caches of words after a blank, caches of words at the start of a line, added tokens) of this process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        added = re.compile("|".join(re.escape(t.content) for t in made.get_added_tokens_decoder().values()) or r"(?!)").search
        _tokenizers[path] = (made, [{}, {}], [{}, {}], added)
    return _tokenizers[path]


def _learn(made, caches: list[dict[str, bytes | None]], words: set[str], before: str) -> dict[str, bytes | None]:
    """A cache that has the ids of `words`, each after `before`; None for a word that is empty or holds white space."""
    if len(caches[0]) > CACHE:
        caches[:] = [{}, caches[0]]
    cache, old = caches
    plain, marked, tails = set(), [], {}
    for word in words.difference(cache):
        if word in old:
            cache[word] = old[word]
        elif word.split() != [word]:
            cache[word] = None
        elif word[-1] in punctuation and word.rstrip(punctuation)[-1:].isalpha():
            # After a letter, punctuation is a pre-token of its own.
            stem = word.rstrip(punctuation)
            marked.append((word, stem))
            tails[word[len(stem) :]] = b""
            if stem in old:
                cache[stem] = old[stem]
            elif stem not in cache:
                plain.add(stem)
        else:
            plain.add(word)
    plain = list(plain)
    feed = made.encode("\n", add_special_tokens=False).ids
    for at in range(0, len(plain), 1 << 14):
        parts = [plain[k : k + 128] for k in range(at, min(len(plain), at + (1 << 14)), 128)]
        joined = ["\n".join([before + w for w in part]) for part in parts]
        for part, found in zip(parts, made.encode_batch_fast(joined, add_special_tokens=False)):
            # A line feed between two words is always one token of its own.
            ids = np.array(found.ids, "<u4")
            ends = [*np.flatnonzero(ids == feed[0]).tolist(), len(ids)]
            raw = ids.tobytes()
            for word, start, end in zip(part, [0, *(e + 1 for e in ends)], ends):
                cache[word] = raw[4 * start : 4 * end]
    for tail in tails:
        tails[tail] = np.array(made.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
    for word, stem in marked:
        cache[word] = cache[stem] + tails[word[len(stem) :]]
    return cache


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; each word of the texts is encoded once.

    In byte-level BPE a pre-token is white space, or one blank at most and what follows it. So a single blank starts
    a pre-token, a single line feed is one, and the words between can be encoded on their own. A text with any other
    white space, or with some at its ends, or with the string of an added token, is encoded in one piece.
    """
    made, later, starts, added = tokenizer(path)
    lines = [[[""]] if added(t) else [line.split(" ") for line in t.split("\n")] for t in texts]
    inner = _learn(made, later, set().union(*(ws[1:] for ls in lines for ws in ls)), " ")
    first = _learn(made, starts, {ws[0] for ls in lines for ws in ls}, "")
    feed = np.array(made.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
    out = []
    for text, found in zip(texts, lines):
        try:
            out.append(feed.join([b"".join([first[ws[0]], *map(inner.__getitem__, ws[1:])]) for ws in found]))
        except TypeError:  # a word without ids
            out.append(np.array(made.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
    return out


# -- the coding -------------------------------------------------------------------------------------------------

#: For each control byte: the byte lengths of its four values. For each length: the bits that count of four bytes.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)
_BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two bits a value give its length of 1 to 4 bytes; the bytes themselves stand apart."""
    values = values.astype("<u4")
    padded = np.zeros(-(-len(values) // 4) * 4, "<u4")
    padded[: len(values)] = values
    codes = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4)[None, :] <= codes[:, None]
    return control.astype(np.uint8).tobytes(), padded.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Back to `n` values: each control byte looks up the lengths of its four values, so where each one starts."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = data + b"\0\0\0"
    words = np.ndarray((len(data),), "<u4", raw, strides=(1,))  # the four bytes from each place on
    return words[starts] & _BITS[lengths]


#: Columns of the files besides the shard and the coded ids.
KEEP = ("id", "text_key", "before", "n")

# -- Spark jobs -------------------------------------------------------------------------------------------------


def encode_documents(df: DataFrame, path: str, end_id: int | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (id, text_key, n, ids), with `end_id` at the end, and rows (token, times) of each task's counts.

    The ids of a document take two bytes each if they all fit, else four. A null text counts as empty.
    """
    tail = [] if end_id is None else [end_id]
    kind = df.schema[id].dataType.simpleString()
    names = ["id", "text_key", "n", "ids", "token", "times"]

    def run(batches):
        times, key = np.zeros(0, np.int64), pa.null()
        for batch in batches:
            key = batch.column("id").type
            for part, raw in slices([batch], "text"):
                made = []
                for at in range(0, len(raw), 256):
                    for x in encode([t.decode("utf-8", "replace") for t in raw[at : at + 256]], path):
                        ids = np.append(np.frombuffer(x, "<u4"), np.array(tail, "<u4"))
                        made.append(ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids)
                counts = np.bincount(np.concatenate(made))
                times = np.pad(times, (0, max(0, len(counts) - len(times))))
                times[: len(counts)] += counts
                columns = [pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())]
                none = pa.nulls(len(raw), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), *columns, none, none], names=names)
        token = np.flatnonzero(times)
        none = [pa.nulls(len(token), t) for t in (key, pa.int64(), pa.int64(), pa.binary())]
        if len(token):
            yield pa.RecordBatch.from_arrays([*none, pa.array(token), pa.array(times[token])], names=names)

    df = df.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return df.mapInArrow(run, f"id {kind}, text_key bigint, n bigint, ids binary, token bigint, times bigint")


def frequency_ranks(encoded: DataFrame) -> list[int]:
    """Token ids by falling count, ties by id: at most one entry for each id of the vocabulary."""
    counts = encoded.filter("token is not null").groupBy("token").agg(F.sum("times").alias("n"))
    return [r.token for r in counts.orderBy(F.desc("n"), "token").select("token").collect()]


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch of packed rows with each row's values."""
    for part, data in slices([batch], "data"):
        coded = zip(part.column("control"), data, part.column("n"))
        yield part, [unpack(c.as_py(), d, n.as_py()) for c, d, n in coded]


def write_token_files(encoded: DataFrame, folder: str, vocabulary: list[int]) -> None:
    """Write (shard, id, text_key, before, n, control, data) as Parquet files, in ascending id order (null first).

    A shard is one file: a range of ids, sorted; a document is one row. `before` is the number of ids of the
    shard's documents before it. Control and data bytes are columns of their own. The values are ranks in
    `vocabulary`, so frequent tokens take one byte; the vocabulary is written beside the ids.
    """
    table = np.zeros(max(vocabulary, default=0) + 1, np.uint32)
    table[vocabulary] = np.arange(len(vocabulary), dtype=np.uint32)
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def code(batches):
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, raw in slices([batch], "ids"):
                wide = [len(r) == 4 * n for r, n in zip(raw, part.column("n").to_pylist())]
                own = [np.frombuffer(r, "<u4" if w else "<u2") for r, w in zip(raw, wide)]
                coded = [pack(shared.value[ids]) for ids in own]
                sizes = part.column("n").to_numpy()
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                made = [
                    pa.array(np.full(len(own), shard, np.int64)),
                    part.column("id"),
                    part.column("text_key"),
                    pa.array(starts),
                    part.column("n"),
                    pa.array([c for c, _ in coded], pa.binary()),
                    pa.array([d for _, d in coded], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["shard", *KEEP, "control", "data"])

    kind = encoded.schema["id"].dataType.simpleString()
    ids = encoded.filter("token is null").select("id", "text_key", "n", "ids")
    ranged = ids.repartitionByRange("id", "text_key").sortWithinPartitions("id", "text_key")
    coded = ranged.mapInArrow(
        code, f"shard bigint, id {kind}, text_key bigint, before bigint, n bigint, control binary, data binary"
    )
    coded.write.option("compression", "zstd").parquet(f"{folder}/ids")
    ranks = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "rank bigint, token bigint")
    ranks.coalesce(1).write.parquet(f"{folder}/vocabulary")


def read_token_files(spark: SparkSession, folder: str, schema: str, make) -> DataFrame:
    """(shard, id, text_key, before, n) and the column of `schema` that make(ids) gives for a document's id array."""
    ranks = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.array([r.token for r in ranks], "<u4"))
    files = spark.read.parquet(f"{folder}/ids")
    name = schema.split()[0]

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _unpacked(batch):
                made = [make(shared.value[ranks]) for ranks in own]
                kept = [part.column(k) for k in ("shard", *KEEP)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made)], names=["shard", *KEEP, name])

    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in ("shard", *KEEP))
    return files.select("shard", *KEEP, "control", "data").mapInArrow(decode, f"{kinds}, {schema}")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text_key, start, n_tokens, ids_crc32) of each document, from the files alone.

    `start` is the number of ids in the documents before it, over all shards; ids_crc32 is taken over the ids
    as little-endian unsigned 32-bit integers. One small row a shard goes through a single window.
    """
    shards = spark.read.parquet(f"{folder}/ids").groupBy("shard").agg(F.sum("n").alias("sum"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored(shards.select("shard", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")))
    found = read_token_files(spark, folder, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()))
    return found.join(small(shards), "shard").select(
        "id", "text_key", (F.col("base") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32"
    )


def tokenize_to_files(
    df: DataFrame, path: str, end_id: int | None, id: str = "doc_id", text: str = "text", folder: str | None = None
) -> str:
    """Encode, rank by frequency, write; returns the folder of the files.

    Null and empty texts have just the end id; rows with the same id keep their own ids, ordered by a hash of the
    text; an empty table gives files without rows. Other columns of `df` are not looked at.
    """
    spark = df.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    encoded = encode_documents(df, path, end_id, id, text)
    raw = scratch_folder(spark, "ids")
    encoded.write.option("compression", "zstd").parquet(raw)
    encoded = spark.read.schema(encoded.schema).parquet(raw)
    write_token_files(encoded, folder, frequency_ranks(encoded))
    return folder
