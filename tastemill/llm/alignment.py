"""Alignment of two tokenizers: which tokens of one overlap which of the other, and where both end together."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import slices
from tastemill.session import stored

#: A longer text is cut (where both tokenizers always end a token) into parts of about so many characters.
PART = 1 << 18
#: Characters whose tokens are aligned by one merge.
BATCH = 1 << 20
#: Bytes of text in a block: the documents that look their pairs up together.
BLOCK = 8 << 20
#: Fixed value: from this code point on, letter tables of regular expression libraries may differ in age.
OLD_LETTERS = 0x250
#: Signs above OLD_LETTERS (general punctuation to geometric shapes) that were never letters or numbers.
SIGNS = "‐-‧‰-⁞₠-₿←-⇿─-◿"


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text.

    If its ids are the order of its merges, tiktoken finds the same ids five times as fast from the file's
    vocabulary and pattern. Texts with letters of young scripts still go to the tokenizers library.
    """

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        signs = byte_of()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        size = self.slow.get_vocab_size()
        self.bytes = [b""] * size
        for word, i in self.slow.get_vocab(with_added_tokens=True).items():
            own = word in model["vocab"]
            self.bytes[i] = bytes(signs[c] for c in word) if own else word.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        base = size - len(merges) - (size - len(model["vocab"]))
        ordered = all(model["vocab"].get(a + b) == base + i for i, (a, b) in enumerate(merges))
        self.fast = None
        if pattern and ordered:
            import tiktoken

            ranks = {self.bytes[i]: i for i in model["vocab"].values()}
            self.fast = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.young = re.compile(f"[^\\x00-\\u{OLD_LETTERS - 1:04x}{SIGNS}]").search

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text after a blank."""
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out = []
        for text in texts:
            if self.young(text):
                out.append(self.slow.encode(" " + text, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(" " + text))
        return out


class Pieces:
    """A sentencepiece model, which puts a blank before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(named)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Vocabulary:
    """Byte lengths, bytes and decimal digits of the ids of an encoder."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.width = len(str(max(len(entries) - 1, 1)))
        digits = [str(i).encode() for i in range(len(entries))]
        self.lengths = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.rjust(self.width) for d in digits), np.uint8).reshape(-1, self.width)

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - self.starts[ids], sizes)
        return self.flat[at]


def cut_parts(text: str) -> list[str]:
    """Parts of a text, each without the blank before it: cut at a blank between two characters that are no white space.

    A byte-level pre-token and a piece begin there, whatever is around, so the parts have the ids of the whole.
    """
    out, start = [], 0
    while len(text) - start > PART:
        at = start + PART
        while True:
            at = text.find(" ", at, len(text) - 1)
            if at < 0 or not (text[at - 1].isspace() or text[at + 1].isspace()):
                break
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


class Part:
    """What a part of a text adds to its document."""

    __slots__ = ("n_a", "n_b", "n_groups", "n_links", "listed", "codes", "times")


def covering(doc_a, start_a, doc_b, start_b) -> tuple[np.ndarray, np.ndarray]:
    """For each token start of one side, the place of the other side's token that covers it; for both sides.

    Starts count on from document to document, so both frames are in order and no row has to be sorted.
    """
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(start_b))})
    over_a = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    over_b = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    return over_a, over_b


def align(texts: list[str], a_ids: list[list[int]], b_ids: list[list[int]], a: Vocabulary, b: Vocabulary) -> list[Part | None]:
    """Each text's alignment; None where the bytes of a side's tokens are not those of the text after a blank."""
    raws = [(" " + t).encode() for t in texts]
    flat_a = np.fromiter(chain.from_iterable(a_ids), np.int64)
    flat_b = np.fromiter(chain.from_iterable(b_ids), np.int64)
    joined = [v.join(ids).tobytes() for v, ids in ((a, flat_a), (b, flat_b))]
    whole = b"".join(raws)
    n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
    good = np.ones(len(texts), bool)
    if joined[0] != whole or joined[1] != whole:
        bounds = [np.concatenate([[0], np.cumsum(v.sizes[f])]) for v, f in ((a, flat_a), (b, flat_b))]
        upto = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
        for i, raw in enumerate(raws):
            good[i] = all(j[e[u[i]] : e[u[i + 1]]] == raw for j, e, u in zip(joined, bounds, upto))
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
    out: list[Part | None] = [None] * len(texts)
    if not len(flat_a):
        return out
    doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    sizes_a, sizes_b = a.sizes[flat_a], b.sizes[flat_b]
    start_a, start_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    over_a, over_b = covering(doc_a, start_a, doc_b, start_b)

    # Where starts are equal, a group begins, and both directions find the same link.
    begin_a, begin_b = start_b[over_a] == start_a, start_a[over_b] == start_b
    one = ~begin_b
    doc = np.concatenate([doc_a, doc_b[one]])
    code = np.concatenate([flat_a * len(b.sizes) + flat_b[over_a], flat_a[over_b[one]] * len(b.sizes) + flat_b[one]])
    pairs = len(a.sizes) * len(b.sizes)
    keys, times = np.unique(doc * pairs + code, return_counts=True)
    own = np.searchsorted(keys, np.arange(len(texts) + 1) * pairs)
    keys %= pairs

    first_a, first_b = np.flatnonzero(begin_a), np.flatnonzero(begin_b)
    group_a, group_b = np.cumsum(begin_a) - 1, np.cumsum(begin_b) - 1
    next_a, next_b = np.append(first_a[1:], len(flat_a)), np.append(first_b[1:], len(flat_b))
    place_a, place_b = np.arange(len(flat_a)) + first_b[group_a], np.arange(len(flat_b)) + next_a[group_b]
    # Each token's digits and the sign after it: "," inside a side, "|" between sides, ";" between groups.
    width = max(a.width, b.width)
    cells = np.empty((len(flat_a) + len(flat_b), width + 1), np.uint8)
    long = np.empty(len(cells), np.int64)
    cells[:, width] = ord(",")
    for v, ids, place in ((a, flat_a, place_a), (b, flat_b, place_b)):
        cells[place, width - v.width : width] = v.digits[ids]
        long[place] = v.lengths[ids]
    cells[place_a[next_a - 1], width] = ord("|")
    cells[place_b[next_b - 1], width] = ord(";")
    listed = cells[np.arange(width + 1) >= width - long[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(long + 1)])

    n_groups = np.bincount(doc_a[begin_a], minlength=len(texts))
    tokens = np.concatenate([[0], np.cumsum(n_a + n_b)])
    for i in np.flatnonzero(good & (n_a > 0)):
        part = out[i] = Part()
        part.n_a, part.n_b, part.n_groups = int(n_a[i]), int(n_b[i]), int(n_groups[i])
        part.n_links = part.n_a + part.n_b - part.n_groups
        part.listed = listed[ends[tokens[i]] : ends[tokens[i + 1]]]
        part.codes, part.times = keys[own[i] : own[i + 1]], times[own[i] : own[i + 1]]
    return out


def add_up(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their summed times."""
    if len(codes) == 1:
        return codes[0], times[0]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times)).astype(np.int64)


class Aligner:
    """Both encoders of a Python worker."""

    _made: dict[tuple, Aligner] = {}

    def __init__(self, path_a: str, path_b: str, pattern: str | None):
        self.a, self.b = ByteLevel(path_a, pattern), Pieces(path_b)
        self.of_a, self.of_b = Vocabulary(self.a.bytes), Vocabulary(self.b.bytes)
        assert len(self.a.bytes) * len(self.b.bytes) < 1 << 32  # pairs of ids are stored in 32 bits

    @classmethod
    def of(cls, *args) -> Aligner:
        if args not in cls._made:
            cls._made[args] = cls(*args)
        return cls._made[args]

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, codes, times) of each text, in order."""
        held: list[tuple[int, str]] = []
        size, now, sums = 0, 0, None

        def none():
            return [True, 0, 0, 0, 0, hashlib.sha256(), [], [], b""]

        def close(sums):
            if not sums[0] or not sums[1]:
                empty = np.zeros(0, np.int64)
                return 0, 0, 0, 0, "", empty, empty
            sums[5].update(sums[8][:-1])
            return (*sums[1:5], sums[5].hexdigest(), *add_up(sums[6], sums[7]))

        def flush():
            nonlocal now, sums, size
            parts = [t for _, t in held]
            found = align(parts, self.a.encode(parts), self.b.encode(parts), self.of_a, self.of_b)
            for (doc, _), part in zip(held, found):
                while now < doc:
                    yield close(sums)
                    now, sums = now + 1, none()
                if part is None:
                    sums[0] = False
                elif sums[0]:
                    for k, n in enumerate((part.n_a, part.n_b, part.n_groups, part.n_links), 1):
                        sums[k] += n
                    # The last sign is held back: it goes if no part follows.
                    sums[5].update(sums[8] + part.listed[:-1])
                    sums[8] = part.listed[-1:]
                    sums[6].append(part.codes)
                    sums[7].append(part.times)
                    if len(sums[6]) > 64:
                        codes, times = add_up(sums[6], sums[7])
                        sums[6], sums[7] = [codes], [times]
            held.clear()
            size = 0

        sums = none()
        for doc, text in enumerate(texts):
            for part in cut_parts(text) if text else []:
                held.append((doc, part))
                size += len(part)
                if size >= BATCH:
                    yield from flush()
        yield from flush()
        while now < len(texts):
            yield close(sums)
            now, sums = now + 1, none()


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignment_blocks(df: DataFrame, path_a: str, path_b: str, pattern: str | None, id: str, text: str) -> DataFrame:
    """Rows of documents (pair is null) and rows (block, pair, n): how often a block's documents link a pair of ids."""
    kind = df.schema[id].dataType.simpleString()
    names = ["block", "id", *COUNTS, "groups_sha256", "codes", "times", "pair", "n"]
    types = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        made, serial = Aligner.of(path_a, path_b, pattern), 0
        block = TaskContext.get().partitionId() << 24
        held, codes, times, waiting = 0, [], [], 0

        def pairs():
            found, n = add_up(codes, times)
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                rows = len(part)
                own = {"block": np.full(rows, block + serial), "pair": part, "n": n[at : at + (1 << 16)]}
                yield [pa.array(own[m]) if m in own else pa.nulls(rows, t) for m, t in zip(names, types)]

        for batch in batches:
            for part, raw in slices([batch], "text"):
                types[1] = part.column("id").type
                found = list(made.documents([t.decode("utf-8", "replace") for t in raw]))
                cells = [
                    pa.array(np.full(len(raw), block + serial)),
                    part.column("id"),
                    *(pa.array([f[k] for f in found], pa.int64()) for k in range(4)),
                    pa.array([f[4] for f in found]),
                    pa.array([f[5].astype("<u4").tobytes() for f in found], pa.binary()),
                    pa.array([f[6].astype("<u4").tobytes() for f in found], pa.binary()),
                    *(pa.nulls(len(raw), pa.int64()) for _ in range(2)),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=names)
                codes += [f[5] for f in found]
                times += [f[6] for f in found]
                waiting += sum(len(f[5]) for f in found)
                if waiting > 1 << 21:
                    codes, times = map(lambda x: [x], add_up(codes, times))
                    waiting = 0
                held += sum(map(len, raw))
                if held >= BLOCK:
                    for cells in pairs():
                        yield pa.RecordBatch.from_arrays(cells, names=names)
                    held, codes, times, waiting, serial = 0, [], [], 0, serial + 1
        if held:
            for cells in pairs():
                yield pa.RecordBatch.from_arrays(cells, names=names)

    schema = f"block bigint, id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    schema += ", groups_sha256 string, codes binary, times binary, pair bigint, n bigint"
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all documents, and whether no other pair of its B id has more."""
    pairs = stored(blocks.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")))
    most = pairs.groupBy((F.col("pair") % pieces).alias("piece")).agg(F.max("n").alias("most"))
    # One row for each id of the B vocabulary at most.
    met = pairs.join(F.broadcast(most), F.col("pair") % pieces == F.col("piece"))
    return met.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(
    df: DataFrame, path_a: str, path_b: str, pattern: str | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of `df`.

    A (a tokenizers file, byte-level) encodes a blank and the text, B (a sentencepiece model) the text, to which it
    adds a blank. `pattern` is A's pre-token pattern for the fast path of `ByteLevel`. Tokens that overlap in bytes
    are linked; a group ends where both sides end a token. n_best counts links whose pair of ids is, over all
    documents, among the most linked of its B id; count_sum adds the counts of the links' pairs. groups_sha256 is
    over `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and texts that a side does not give back byte by byte, have no tokens: zeros and ''. Rows
    alike in id and text count one by one. Other columns of `df` are not looked at. An empty table gives no rows.

    Tokens are aligned once, task by task, and blocks of documents keep what pairs they hold. Only the pairs of a
    block, not those of a document, meet the counts of all documents in a join; then a block's documents look their
    pairs up in its part. Nothing but the best count of each B id is broadcast.
    """
    of_b = Pieces(path_b).bytes
    blocks = stored(alignment_blocks(df, path_a, path_b, pattern, id, text))
    counts = stored(pair_counts(blocks, len(of_b)))
    pairs = blocks.filter("pair is not null").select("block", "pair")
    looked = pairs.join(counts, "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    docs = blocks.filter("pair is null").select("block", "id", *COUNTS, "groups_sha256", "codes", "times")
    names = ["id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        # A block without tokens has no pairs.
        columns = ("pair", "n", "best") if pairs.num_rows else ()
        known, n, best = [pairs[c].to_numpy() for c in columns] or [np.zeros(0, np.int64)] * 3
        order = np.argsort(known)
        known, n, best = known[order], n[order], best[order].astype(bool)
        n_best, sums = [], []
        for codes, times in zip(docs["codes"], docs["times"]):
            at = np.searchsorted(known, np.frombuffer(codes.as_py(), "<u4"))
            times = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            sums.append(int((times * n[at]).sum()))
        made = [docs[c] for c in ("id", *COUNTS)] + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())]
        return pa.Table.from_arrays([*made, docs["groups_sha256"]], names=names)

    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "n_best", "count_sum"))
    both = docs.groupBy("block").cogroup(looked.groupBy("of"))
    return both.applyInArrow(look_up, schema + ", groups_sha256 string")
