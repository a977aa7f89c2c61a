"""Suffix-array dedup: bytes in a long string that also occurs elsewhere."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import slices
from tastemill.llm.spans import cut, keyed_texts
from tastemill.session import stored

#: Bytes of an anchor's hash; starts of strings that share a core; groups above HOT rows are counted start by start.
GRAM, WIDTH, HOT = 32, 16, 4096
#: Symbols that are sorted at once, and bytes of a text whose anchors are sought at once.
SYMBOLS, STRETCH = 1 << 15, 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by linear grouping; the last symbol must be smaller than all others and occur once.

    Suffixes are grouped by their longest Lyndon prefix. Groups start as equal first symbols and are taken in
    descending order: each member looks up the nearest suffix to its left that lies in a lower group (pointers of
    suffixes done before are followed on the way), and those suffixes move to a new group just above their own, as
    their prefix grows by the prefix of the group taken; of these, the ones with more copies in a row come higher. Then all groups
    are final, and one ascending pass puts each suffix at the next free place of its group once the suffix behind its
    prefix has its place.
    """
    n = len(text)
    symbols = sorted(set(text))
    rank = {s: k for k, s in enumerate(symbols)}
    group = [rank[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(symbols)), -1]
    below = [-1, *range(len(symbols) - 1)]
    done = [False] * len(symbols)
    left = [-1] * n
    current = len(symbols) - 1
    while current >= 0:
        own = members[current]
        if len(own) > 1:
            own = sorted(i for i in own if group[i] == current)
            members[current] = own
        elif own and group[own[0]] != current:
            members[current] = own = []
        done[current] = True
        copies: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = left[j]
            left[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if len(copies) == 1:
            (j,) = copies
            split = {group[j]: {copies[j]: [j]}}
        else:
            split = {}
            for j, k in copies.items():
                split.setdefault(group[j], {}).setdefault(k, []).append(j)
        for lower, by_count in split.items():
            last = lower
            for k in sorted(by_count):
                new = len(members)
                moved = by_count[k]
                members.append(moved)
                done.append(False)
                for j in moved:
                    group[j] = new
                after = above[last]
                above.append(after)
                below.append(last)
                above[last] = new
                if after >= 0:
                    below[after] = new
                last = new
        current = below[current]
    # Start of each group, from the lowest up.
    free, at, current = [0] * len(members), 0, 0
    while current >= 0:
        free[current] = at
        at += len(members[current])
        current = above[current]
    order = [0] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = left[j]
    return order


def repeated_windows(strings: list[tuple[int, bytes, bytes]], width: int = WIDTH) -> list[list[int]]:
    """For each (core, before, after): the starts in `before` of strings of `width` symbols that occur in others too.

    The core counts as one symbol. All strings go into one text, whose suffix array brings equal windows together.
    """
    text, starts = [], []
    cores: dict[int, int] = {}
    for core, before, after in strings:
        starts.append(len(text))
        text += [b + 2 for b in before]
        text.append(258 + cores.setdefault(core, len(cores)))
        text += [b + 2 for b in after]
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text))
    symbols = np.array(text + [0] * width, np.int64)
    same = np.ones(len(order) - 1, bool)
    for k in range(width):
        part = symbols[order + k]
        same &= (part[1:] == part[:-1]) & (part[1:] > 1)
    twice = np.zeros(len(text), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [
        np.flatnonzero(twice[at : at + len(before) + 1]).tolist() for at, (_, before, _) in zip(starts, strings)
    ]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings."""
    h, size, factor = data.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    for shift, times in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(times)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each string of `length` bytes is served by the least hash inside it.

    An anchor serves the strings that start at first..last. Which hash is least, and the leftmost of equal ones,
    depends on the string alone, so equal strings have equal anchors at equal offsets.
    """
    window = length - GRAM + 1
    made = []
    for at in range(0, max(1, len(text) - length + 1), STRETCH):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, STRETCH + length - 1), at)
        if len(data) < length:
            break
        h = gram_hashes(data)
        # The top of the hash with the place below it: the minimum is the leftmost least hash.
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: -(window - size)], least[window - size :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        made.append((h[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    if not made:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*made))


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """(h, context, doc, first, before, more): anchors with a hash of all bytes that their strings cover.

    first is the start of the first string served, before the anchor's distance from it, more the number of further strings.
    """

    def run(batches):
        for batch in batches:
            for part, raw in slices([batch], "text"):
                docs = part.column("doc").to_numpy()
                found = [anchors(t, length) for t in raw]
                h, place, first, last = (np.concatenate(x) for x in zip(*found))
                counts = [len(f[0]) for f in found]
                digest = xxhash.xxh3_64_intdigest
                contexts = np.fromiter(
                    (
                        digest(t[a : b + length], p - a)
                        for t, f in zip(raw, found)
                        for p, a, b in zip(f[1].tolist(), f[2].tolist(), f[3].tolist())
                    ),
                    np.uint64,
                    len(h),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h),
                        pa.array(contexts.view(np.int64)),
                        pa.array(np.repeat(docs, counts)),
                        pa.array(first.astype(np.int32)),
                        pa.array((place - first).astype(np.int16)),
                        pa.array((last - first).astype(np.int16)),
                    ],
                    names=["h", "context", "doc", "first", "before", "more"],
                )

    schema = "h bigint, context bigint, doc bigint, first int, before smallint, more smallint"
    return texts.select("doc", "text").mapInArrow(run, schema)


def flank_table(texts: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """(core, h, doc, place, left, right) for contexts whose anchor also has other contexts.

    The strings that start `WIDTH` q to `WIDTH` q + WIDTH - 1 bytes before the anchor share a core of
    length - WIDTH + 1 bytes. A row has the core's hash and the bytes on both sides that the strings cover;
    place is where the core starts.
    """
    wanted = mixed.groupBy("doc").agg(F.collect_list(F.struct("h", "first", "before", "more")).alias("at"))
    both = texts.select("doc", "text").join(wanted, "doc")
    both = both.select("doc", "text", *(F.col(f"at.{c}").alias(c) for c in ("h", "first", "before", "more")))

    def run(batches):
        for batch in batches:
            for part, raw in slices([batch], "text"):
                rows: list[list] = [[] for _ in range(6)]
                columns = [part.column(c) for c in ("doc", "h", "first", "before", "more")]
                for text, doc, *lists in zip(raw, *columns):
                    doc = doc.as_py()
                    for h, first, before, more in zip(*(x.as_py() for x in lists)):
                        place, low = first + before, before - more
                        for q in range(low // WIDTH, before // WIDTH + 1):
                            # Strings start `o` bytes before the anchor, low <= o <= before.
                            start = place - WIDTH * q
                            far = min(before - WIDTH * q, WIDTH - 1)
                            near = max(low - WIDTH * q, 0)
                            past = start + length - WIDTH + 1
                            core = xxhash.xxh3_64_intdigest(text[start:past], q & 0xFFFF) - (1 << 63)
                            right = text[past : past + WIDTH - 1 - near]
                            for to, value in zip(rows, (core, h, doc, start, text[start - far : start], right)):
                                to.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, k) for r, k in zip(rows, kinds)], names=["core", "h", "doc", "place", "left", "right"]
                )

    return both.mapInArrow(run, "core bigint, h bigint, doc bigint, place int, left binary, right binary")


def _sorted_groups(batches, length: int):
    """Ranges (doc, first, past) of strings that occur in two rows of a core; rows come sorted by core."""
    held: dict[tuple, dict[tuple, list]] = {}
    work, symbols = [], 0
    out: list[tuple[int, int, int]] = []

    def ranges(rows, left, starts):
        # Runs of consecutive starts are one range.
        runs, begin = [], None
        for k, s in enumerate(starts):
            if begin is None:
                begin = s
            if k + 1 == len(starts) or starts[k + 1] != s + 1:
                runs.append((begin, s))
                begin = None
        for doc, place in rows:
            out.extend((doc, place - left + a, place - left + b + length) for a, b in runs)

    def close(groups):
        nonlocal work, symbols
        for key, strings in groups.items():
            for (left, right), rows in strings.items():
                if len(rows) > 1:
                    # The same bytes twice: all their strings repeat.
                    fit = len(left) + len(right) - WIDTH + 2
                    ranges(rows, len(left), list(range(fit)))
            if len(strings) > 1:
                for (left, right), rows in strings.items():
                    work.append((key, left, right, rows if len(rows) == 1 else []))
                    symbols += len(left) + len(right) + 2

    def sort():
        nonlocal work, symbols
        for (key, left, right, rows), starts in zip(work, repeated_windows([w[:3] for w in work])):
            if starts and rows:
                ranges(rows, len(left), starts)
        work, symbols = [], 0

    def batch_of():
        nonlocal out
        made = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        out = []
        return pa.RecordBatch.from_arrays(made, names=["doc", "first", "past"])

    current = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("core", "h", "doc", "place", "left", "right"))
        for core, h, doc, place, left, right in zip(*columns):
            if (core, h) != current:
                close(held)
                held, current = {(core, h): defaultdict(list)}, (core, h)
                if symbols > SYMBOLS:
                    sort()
                    yield batch_of()
            held[current][left, right].append((doc, place))
    close(held)
    if work:
        sort()
    yield batch_of()


def _counted(hot: DataFrame, length: int) -> DataFrame:
    """The same for cores of very many rows: every string is counted by its own bytes."""
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(WIDTH - 1) - F.length("right")), F.length("left"))).alias("o")
    each = hot.select("*", start)
    before = F.expr("substring(left, length(left) - o + 1, o)")
    after = F.expr(f"substring(right, 1, {WIDTH - 1} - o)")
    each = stored(each.select("core", "h", "o", before.alias("before"), after.alias("after"), "doc", "place"))
    key = ["core", "h", "o", "before", "after"]
    twice = stored(each.groupBy(*key).count().filter("count > 1").drop("count"))
    first = F.col("place") - F.col("o")
    return each.join(twice, key).select("doc", first.alias("first"), (first + length).alias("past"))


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """(doc, first, past): ranges that strings of `length` bytes cover which start at two places or more.

    Equal strings have equal anchors, so an anchor hash that occurs once proves its strings unique. Contexts that are
    equal in full are covered in full. What is left, where copies begin to differ, is split by cores; each group of
    rows with the same core is suffix-sorted with the core as one symbol. A core of more than HOT rows is counted
    string by string instead, so no task holds it.
    """
    table = stored(anchor_table(texts, length))
    common = table.groupBy("h").agg(
        F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")
    )
    common = stored(common.filter("n > 1").select("h", "mixed"))
    met = stored(table.join(common, "h"))
    span = F.col("first") + F.col("more") + length
    whole = met.filter("not mixed").select("doc", "first", span.alias("past"))
    mixed = met.filter("mixed").drop("mixed")
    each = mixed.groupBy("h", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "first", "before", "more")).alias("one")
    )
    each = stored(each.select("h", "context", "n", "one.*"))
    copies = mixed.join(each.filter("n > 1").select("h", "context"), ["h", "context"], "left_semi")
    copies = copies.select("doc", "first", span.alias("past"))
    flanks = stored(flank_table(texts, each, length))
    sizes = stored(flanks.groupBy("core", "h").count().filter("count > 1"))
    some = flanks.join(sizes.filter(F.col("count") <= HOT).drop("count"), ["core", "h"], "left_semi")
    many = flanks.join(sizes.filter(F.col("count") > HOT).drop("count"), ["core", "h"], "left_semi")
    dealt = some.repartition("core", "h").sortWithinPartitions("core", "h")
    found = dealt.mapInArrow(lambda batches: _sorted_groups(batches, length), "doc bigint, first int, past int")
    return whole.union(copies).union(found).union(_counted(many, length))


def suffix_dedup(
    df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200, keep_text: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per row of `df`.

    Removes every byte that a string of `length` bytes covers which also starts anywhere else, in the same text or
    another; all copies go. Texts count as UTF-8 bytes, null as empty; strings never cross texts. Rows alike in id and
    text are copies of each other; they are worked on once and each has its row. Other columns of `df` are not looked at. `length` must be at least GRAM + WIDTH.
    """
    texts = keyed_texts(df, id, text)
    # Every string of a repeated row starts in its copies too.
    long = F.octet_length("text").cast("int")
    again = texts.filter((F.col("copies") > 1) & (long >= length)).select("doc", F.lit(0).alias("first"), long.alias("past"))
    ranges = repeated_ranges(texts, length).union(again).withColumn("keep", F.lit(False))
    return cut(texts, ranges, keep_text).drop("n_ranges")
