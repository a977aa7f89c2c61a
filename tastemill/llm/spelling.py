"""Spelling variants: words one code point apart, found by a trie over counts of letter groups."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import slices, small
from tastemill.session import stored

#: What a run of letters is, and one in how many occurrences loses a code point.
RUN, ODD = "[A-Za-zÀ-ÿ]+", 199
#: Least code points and occurrences of a word, and how many times as frequent a form must be.
LENGTH, OFTEN, TIMES = 6, 5, 5

#: The letters that have a group of their own, frequent ones first; code points after them fall into SPARE groups.
GROUPS, SPARE = "etaionrshldcum", 4
#: Leading levels of the trie that are the key by which Spark deals the words out.
LEVELS = 4
#: Entries or queries of a task at most, and entries below which a subtree is a leaf.
TILE, LEAF = 20_000, 12
#: Characters worked on at once, and distinct words that a task adds up before it hands them on.
PIECE, HELD = 1 << 20, 500_000

_runs = re.compile(RUN)


# -- words and their counts ---------------------------------------------------------------------------------------


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end where no run goes on."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and _runs.match(text[end]) and _runs.match(text[end - 1]):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def words_of(id: str, text: bytes) -> Counter:
    """Occurrences of a text's words after the odd losses; words of fewer than LENGTH code points are left out."""
    found: Counter = Counter()
    for piece in pieces(text.lower().decode("utf-8", "replace")):
        found.update(_runs.findall(piece))
    out: Counter = Counter()
    for word, n in found.items():
        if len(word) >= LENGTH:
            h = zlib.crc32(f"{id}:{word}".encode())
            if h % ODD == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LENGTH:
                    continue
            out[word] += n
    return out


def word_counts(df: DataFrame, id: str = "doc_id", text: str = "text", often: int = OFTEN) -> DataFrame:
    """(word, n): words with at least `often` occurrences. Tasks add up before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for part, raw in slices([batch], "text"):
                for name, text in zip(part.column("id").to_pylist(), raw):
                    held.update(words_of(name, text))
                    if len(held) > HELD:
                        yield rows()
                        held.clear()
        yield rows()

    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    counted = df.select(name.alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


# -- the trie -----------------------------------------------------------------------------------------------------


def group_counts(words: list[str]) -> np.ndarray:
    """One row a word: how many of its letters are in each group."""
    ends = np.cumsum([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    group = len(GROUPS) + points % SPARE
    for i, letter in enumerate(GROUPS):
        group[points == ord(letter)] = i
    width = len(GROUPS) + SPARE
    row = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    return np.bincount(row * width + group, minlength=len(words) * width).reshape(len(words), width).astype(np.int32)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def search(entries: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, query) places of the pairs that are one code point apart.

    The entries stand in the order of their group counts, so a node of the trie is a range of them, and its children
    are the runs of equal counts in the next column. The search goes down depth first and takes along the queries that
    can still reach the node: each may have one letter too many and one too few. Words of a leaf are compared.
    """
    vectors, wanted = group_counts(entries), group_counts(queries)
    order = np.lexsort(vectors.T[::-1])
    vectors = vectors[order]
    width = vectors.shape[1]
    nodes = [(0, len(entries), 0, np.arange(len(queries)), np.zeros(len(queries), np.int8), np.zeros(len(queries), np.int8))]
    while nodes:
        low, high, depth, at, more, less = nodes.pop()
        if depth == width or high - low <= LEAF:
            for e in range(low, high):
                gap = wanted[at] - vectors[e]
                fits = ((np.maximum(gap, 0).sum(axis=1) <= 1) & (np.minimum(gap, 0).sum(axis=1) >= -1)).nonzero()[0]
                word = entries[order[e]]
                near = [q for q in at[fits].tolist() if one_apart(word, queries[q])]
                if near:
                    yield np.full(len(near), order[e]), np.array(near)
            continue
        column = vectors[low:high, depth]
        steps = np.flatnonzero(np.diff(column)) + 1
        gaps = wanted[at, depth]
        for start, end in zip([0, *steps.tolist()], [*steps.tolist(), high - low]):
            gap = gaps - column[start]
            over, under = more + np.maximum(gap, 0), less - np.minimum(gap, 0)
            go = np.flatnonzero((over <= 1) & (under <= 1))
            if len(go):
                nodes.append((low + start, low + end, depth + 1, at[go], over[go].astype(np.int8), under[go].astype(np.int8)))


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def _level_counts(word: Column) -> Column:
    """Counts of the letters on the key's levels."""
    return F.array(*(F.length(word) - F.length(F.replace(word, F.lit(c), F.lit(""))) for c in GROUPS[:LEVELS]))


#: What one letter more and one letter less can do to the key's levels: no change, a step, or a step up and one down.
_STEPS = [(0,) * LEVELS] + [
    tuple((i == up) - (i == down) for i in range(LEVELS))
    for up in range(LEVELS + 1)
    for down in range(LEVELS + 1)
    if up != down
]


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that are one code point apart, once. `words` (word, n) must be stored and distinct.

    A word is an entry of its own key (counts of the first LEVELS letters) and a query to those keys above it, and its
    own, that one surplus and one deficit letter can reach, so each pair meets in the lower word's query. A key with
    more than TILE entries or queries is cut by hash into tiles, and each tile of entries meets each tile of queries:
    no task holds a large key, and no pair is lost.
    """
    entries = words.select("word", "n", _level_counts(F.col("word")).alias("key"))
    steps = F.array(*(F.array(*map(F.lit, step)) for step in _STEPS))
    to = F.explode(F.transform(steps, lambda s: F.zip_with("key", s, lambda x, y: x + y)))
    queries = entries.select("word", "n", F.col("key").alias("home"), to.alias("key"))
    queries = queries.filter((F.col("key") >= F.col("home")) & ~F.exists("key", lambda x: x < 0))
    queries = stored(queries.select("word", "n", "key", (F.col("key") == F.col("home")).alias("own")))

    counts = entries.groupBy("key").agg(F.count("*").alias("e")).join(queries.groupBy("key").agg(F.count("*").alias("q")), "key")
    tiles = small(stored(counts.select("key", *(F.ceil(F.col(c) / TILE).cast("int").alias(c) for c in "eq"))))

    def dealt(df: DataFrame, mine: str, other: str, salt: int) -> DataFrame:
        part = F.pmod(F.xxhash64("word", F.lit(salt)), F.col(mine)).cast("int").alias(mine)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return df.join(tiles, "key").select(*df.columns, part, every).groupBy("key", "e", "q")

    def meet(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not (entries.num_rows and queries.num_rows):
            kinds = {"a": pa.string(), "a_n": pa.int64(), "b": pa.string(), "b_n": pa.int64()}
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        mine, theirs = entries["word"].to_pylist(), queries["word"].to_pylist()
        own = queries["own"].to_numpy(zero_copy_only=False)
        found = [(i, j) for e, q in search(mine, theirs) for i, j in zip(e, q) if not own[j] or theirs[j] < mine[i]]
        at = np.array(found, np.int64).reshape(-1, 2)
        made = [queries["word"].take(at[:, 1]), queries["n"].take(at[:, 1]), entries["word"].take(at[:, 0]), entries["n"].take(at[:, 0])]
        return pa.Table.from_arrays(made, names=["a", "a_n", "b", "b_n"])

    both = dealt(entries, "e", "q", 1).cogroup(dealt(queries, "q", "e", 2))
    return both.applyInArrow(meet, "a string, a_n bigint, b string, b_n bigint")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of `links` (word, form) that starts at each word of them.

    Each round doubles the steps taken, so a chain of 2^k links takes k rounds; chains are short, as each form is
    several times as frequent as its word.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")
        now = new.drop("moved")


def spelling_variants(df: DataFrame, id: str = "doc_id", text: str = "text", often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word, whatever other columns `df` has.

    Words are runs of letters (A-Z in lower case, one in ODD occurrences short of a code point) of at least LENGTH
    code points with at least `often` occurrences. A word's form is the most frequent word one code point apart
    (ties: the first in code-point order), if it is at least `times` as frequent, else null; its root is the end of
    the chain of forms, itself if it has none.

    Null and empty texts have no words; a null id counts as ''. Repeated rows count one by one. An empty table, and one
    without frequent words, gives no rows.
    """
    words = stored(word_counts(df, id, text, often))
    pairs = stored(near_words(words))
    sides = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    ).alias("side")
    best = pairs.select(sides).select("side.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    )
    met = words.join(best, "word", "left")
    ahead = -F.col("best.rank") >= times * F.col("n")
    met = stored(
        met.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(ahead, F.col("best.near")).alias("form"),
            F.when(ahead, -F.col("best.rank")).alias("form_n"),
        )
    )
    roots = follow(met.filter("form is not null").select("word", "form"))
    found = met.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
