"""Sums over the users that two items share, worked out in tiles of items and users."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tastemill.operators.blocks import attach_by_key
from tastemill.session import stored

#: Pairs of a tile as planned, pairs built at once, and items of a user's history in one piece.
PAIRS, AT_ONCE, PIECE = 4_000_000, 1 << 21, 1 << 12
#: A block is cut above so many times PAIRS. Items that a task spreads over tiles at once.
HOT, SPREAD = 4, 1 << 22
#: Copies of a row that are shuffled at a time, where only the best partners leave a tile.
COPIES = 8

#: The sums on offer: of a pair's values v (this item) and w (the other one).
SUMS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "support": lambda v, w: np.ones(len(v)),
    "dot": lambda v, w: v * w,
    "ii": lambda v, w: v * v,
    "jj": lambda v, w: w * w,
    "gap": lambda v, w: np.abs(v - w),
}


def _add_up(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    bits = max(1, (len(key) - 1).bit_length())
    if len(key) and int(key.max()).bit_length() + bits < 64:
        # The place behind the key: a plain sort, which is much faster, keeps the order of equal keys.
        both = np.sort((key << bits) | np.arange(len(key)))
        key, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return key[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def tile_sums(left: tuple, right: tuple, sums: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(item_i, item_j, sums) over left (user, item, v) and right (user, item, w) rows of the same user.

    Right rows come in order of the user. At most about AT_ONCE pairs are there at a time; then they are added up.
    """
    users, items, v = left
    others, partners, w = right
    own, place_i = np.unique(items, return_inverse=True)
    low = int(partners.min()) if len(partners) else 0
    span = int(partners.max()) - low + 1 if len(partners) else 0
    dense = span * max(len(own), 1) < 1 << 41
    # Ids that lie close together are their own places.
    theirs, place_j = (None, partners - low) if dense else np.unique(partners, return_inverse=True)
    width = span if dense else len(theirs)
    begin = np.searchsorted(others, users)
    counts = np.searchsorted(others, users, side="right") - begin
    before = np.cumsum(counts) - counts
    keys, held = [], [[] for _ in sums]
    start = 0
    while start < len(users):
        end = max(start + 1, int(np.searchsorted(before, before[start] + AT_ONCE)))
        n = counts[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = np.arange(len(i)) + np.repeat(begin[start:end] - (np.cumsum(n) - n), n)
        other = items[i] != partners[j]
        i, j = i[other], j[other]
        key, found = _add_up(place_i[i] * width + place_j[j], [SUMS[s](v[i], w[j]) for s in sums])
        keys.append(key)
        for h, f in zip(held, found):
            h.append(f)
        start = end
        if len(keys) > 8:
            key, found = _add_up(np.concatenate(keys), [np.concatenate(h) for h in held])
            keys, held = [key], [[f] for f in found]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0) for _ in sums]
    key, found = _add_up(np.concatenate(keys), [np.concatenate(h) for h in held]) if len(keys) > 1 else (keys[0], [h[0] for h in held])
    at = key % max(width, 1)
    return own[key // max(width, 1)], at + low if dense else theirs[at], found


def _best_places(item: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each item, ties to the smaller other item."""
    places, own = None, np.cumsum(np.append(0, item[1:] != item[:-1])) if len(item) else item
    if len(item) > 1000 and own[-1] < 1 << 23 and (item[1:] >= item[:-1]).all() and not np.isnan(score).any():
        # First what is below an item's k-th score in its leading 40 bits goes, by a plain sort.
        bits = (score + 0.0).view(np.int64)
        bits = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        key = (own << 40) | ((1 << 39) - 1 - (bits >> 24))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        last = np.minimum(first + k, np.append(first[1:], len(own))) - 1
        places = np.flatnonzero(key <= np.sort(key)[last][own])
        item, other, score = item[places], other[places], score[places]
    order = np.lexsort((other, -score, item))
    item = item[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, int)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    order = order[place < k]
    return order if places is None else places[order]


def _deal(ids: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """The part, of `parts`, of each id: a hash that every task works out alike."""
    h = (ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x632BE5AB + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _lists(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _squeezed(numbers: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, all first bytes before all second ones, compressed behind their length."""
    plain = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _whole(squeezed: bytes, width: int) -> np.ndarray:
    """The numbers of `_squeezed`."""
    size = int.from_bytes(squeezed[:8], "little")
    plain = np.frombuffer(pa.decompress(squeezed[8:], size, codec="zstd", asbytes=True), np.uint8)
    wide = np.zeros((size // width, 8), np.uint8)
    wide[:, :width] = plain.reshape(width, -1).T
    return wide.view(np.uint64).reshape(-1)


def _bytes_of(numbers: np.ndarray) -> int:
    return max(1, -(-int(numbers.max()).bit_length() // 8))


def _steps(numbers: np.ndarray) -> np.ndarray:
    """From each number to the next, small ones of both signs as small unsigned numbers; overflows wrap around."""
    step = np.diff(numbers, prepend=numbers[:1])
    return ((step << 1) ^ (step >> 63)).view(np.uint64)


def _walked(base: int, steps: np.ndarray) -> np.ndarray:
    return np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)) + np.int64(base)


def _coded(values: np.ndarray, known: np.ndarray) -> tuple[bytes, bytes]:
    """Values, given as places in `known`, as (the bits of those that occur, places among them), or plainly if that is shorter."""
    there = np.zeros(len(known), bool)
    there[values] = True
    own = known[there]
    width = 1 if len(own) <= 1 << 8 else 2
    if len(own) <= 1 << 16 and 8 * len(own) + width * len(values) < 8 * len(values):
        return _squeezed(own.view(np.uint64), 8), _squeezed((np.cumsum(there) - 1)[values], width)
    return b"", _squeezed(known[values].view(np.uint64), 8)


def _decoded(known: bytes, coded: bytes) -> np.ndarray:
    if not known:
        return _whole(coded, 8).view(np.float64)
    values = _whole(known, 8).view(np.float64)
    return values[_whole(coded, 1 if len(values) <= 1 << 8 else 2).view(np.int64)]


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers, bit by bit, the place of each value among them)."""
    known, places = np.unique(values.astype(np.float64, copy=False).view(np.int64), return_inverse=True)
    return known.view(np.float64), places


def pack(
    tiles: np.ndarray, sizes: np.ndarray, items: np.ndarray, values: np.ndarray, known: np.ndarray | None = None
) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Histories of `sizes` items, in the order of their tile, as one row a tile: (columns, first history of each row).

    Items are steps from one to the next, which are small where a history is in order. Values that recur are places in a
    list of them; with `known` they are given as places in that. All is compressed byte by byte.
    """
    first = np.flatnonzero(np.append(True, tiles[1:] != tiles[:-1]))
    ends = np.cumsum(sizes)[np.append(first[1:], len(tiles)) - 1]
    if known is None:
        known, values = _places(values)
    rows = []
    for start, end in zip(np.append(0, ends[:-1]), ends):
        steps = _steps(items[start:end])
        width = _bytes_of(steps)
        rows.append((int(items[start]), width, *_coded(values[start:end], known), _squeezed(steps, width)))
    base, width, listed, coded, short = zip(*rows)
    columns = {
        "base": pa.array(base, pa.int64()),
        "width": pa.array(width, pa.int32()),
        "known": pa.array(listed, pa.binary()),
        "items": pa.array(short, pa.binary()),
        "coded": pa.array(coded, pa.binary()),
    }
    return columns, first


def unpack(base: int, width: int, known: bytes, items: bytes, coded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(items, values) of a row of `pack`."""
    return _walked(base, _whole(items, width)), _decoded(known, coded)


def pack_users(first: np.ndarray, users: np.ndarray, scales: np.ndarray, sizes: np.ndarray) -> dict[str, pa.Array]:
    """User, scale and size of the histories that `pack` puts into one row, as columns like its own."""
    known, scales = _places(scales)
    rows = []
    for start, end in zip(first, np.append(first[1:], len(users))):
        steps, n = _steps(users[start:end]), sizes[start:end].astype(np.uint64)
        widths = _bytes_of(steps), _bytes_of(n)
        rows.append((int(users[start]), *widths, _squeezed(steps, widths[0]), _squeezed(n, widths[1]), *_coded(scales[start:end], known)))
    types = {"ub": pa.int64(), "uw": pa.int32(), "nw": pa.int32(), "us": pa.binary(), "ns": pa.binary(), "pk": pa.binary(), "ps": pa.binary()}
    return {c: pa.array(v, t) for (c, t), v in zip(types.items(), zip(*rows))}


def unpack_users(ub: int, uw: int, nw: int, us: bytes, ns: bytes, pk: bytes, ps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(users, scales, sizes) of a row of `pack_users`."""
    return _walked(ub, _whole(us, uw)), _decoded(pk, ps), _whole(ns, nw).view(np.int64)


def _met(block: np.ndarray, other: np.ndarray, blocks: int) -> np.ndarray:
    """Whether `block` is the one of two blocks that pairs them: the other lies in the half of the circle ahead of it."""
    ahead = 2 * ((other - block) % blocks)
    return (ahead < blocks) | ((ahead == blocks) & (block < other))


def _spread(
    sizes, items, values, wide, blocks: int, cuts: dict[int, int], once: bool, turn: int = 0, rounds: int = 1
) -> Iterator[tuple]:
    """(tile, cut, history, sizes, items, values) of histories: a tile is (block, part) and gets the block's items and, of the others, its part.

    With `once` only the items of the blocks that this block is paired with, and no history left with a single item.
    Only the blocks of the round `turn`: every block is in one of `rounds`.
    """
    own = _deal(items, blocks)
    line = np.repeat(np.arange(len(sizes)), sizes)
    met = own * len(sizes) + line
    if wide.any():
        # A history in several pieces is taken to have items in every block.
        met = np.append(met, (np.arange(blocks)[:, None] * len(sizes) + np.flatnonzero(wide)[None, :]).ravel())
    if rounds > 1:
        met = met[met // len(sizes) % rounds == turn]
    met = np.unique(met)
    block, history = met // len(sizes), met % len(sizes)
    starts = np.cumsum(sizes) - sizes
    hot = np.isin(block, list(cuts)) if cuts else np.zeros(len(met), bool)
    plain, h = block[~hot], history[~hot]
    edges = np.cumsum(sizes[h])
    at = 0
    while at < len(h):
        # As many tiles at once as hold about SPREAD items.
        end = int(np.searchsorted(edges, (edges[at - 1] if at else 0) + SPREAD)) + 1
        end = max(end, int(np.searchsorted(plain, plain[at], side="right"))) if end < len(h) else len(h)
        some, tile = h[at:end], plain[at:end]
        rows, n = _within(starts[some], sizes[some]), sizes[some]
        if once:
            line = np.repeat(np.arange(len(some)), n)
            kept = _met(tile[line], own[rows], blocks)
            n = np.bincount(line[kept], minlength=len(some))
            left = n >= np.where(wide[some], 1, 2)
            kept &= left[line]
            some, tile, rows, n = some[left], tile[left], rows[kept], n[left]
        if len(some):
            yield tile, np.zeros(len(some), np.int64), np.ones(len(some), np.int64), some, n, items[rows], values[rows]
        at = end
    for b, cut in cuts.items():  # none is met in the rounds of other blocks
        some = history[hot & (block == b)]
        if not len(some):
            continue
        rows = _within(starts[some], sizes[some])
        part = _deal(items[rows], cut, 1)
        line = np.repeat(np.arange(len(some)), sizes[some])
        mine = own[rows] == b
        for p in range(cut):
            kept = mine | (part == p)
            if once:
                kept &= _met(b, own[rows], blocks)
            n = np.bincount(line[kept], minlength=len(some))
            left = np.flatnonzero(n)
            if len(left):
                full = np.full(len(left), b)
                yield full, np.full(len(left), p), np.full(len(left), cut), some[left], n[left], items[rows][kept], values[rows][kept]


def pair_sums(
    df: DataFrame,
    user: str,
    item: str,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    best: tuple[int, Callable[[dict[str, np.ndarray]], np.ndarray]] | None = None,
    factor: str | None = None,
    least: int = 0,
    once: bool = False,
) -> DataFrame:
    """(*by, item_i, item_j, *sums): both directions of every pair of items that a user has, summed over those users.

    `df` must be stored, distinct on (*by, user, item), and the ids integers; rows without a user or an item have no
    pairs. The value of a row is `value`, times `factor`, which is the same in all rows of a user, if that is given.
    With `best` = (k, score) only the pairs that can be among an item's k highest scores are sure to be there; `score`
    works on the arrays of the sums. With `least` pairs of fewer users are left out.
    With `once` each pair is there in one direction only, which halves what is shuffled: blocks lie on a circle, and a
    block gets the items of the half ahead of it (`best` needs all partners of an item, so it goes without).

    Items are dealt into blocks. A tile is the histories of the users that have an item in the block, so it holds all
    partners of its items: its sums are complete, and only they leave it. A history is shuffled, packed, to each block
    that it meets: rows times the smaller of blocks and a user's items, at two or three bytes each where values recur. A block of far more than
    PAIRS pairs (a very popular item) is cut by partners into several tiles, each of which has all of the block's own
    rows, so its sums are complete too. A long history is cut into pieces, so no user gathers in one row.

    With `best` the blocks take turns where a row would travel more than COPIES times: the k best of a round's items are
    written, and its shuffle goes, before the next round begins. So the disks hold about COPIES copies of the rows at a time.
    """
    if once and best is not None:
        raise ValueError("the best partners of an item need both directions")
    by, spark = list(by), df.sparkSession
    extra = [] if factor is None else [F.col(factor).cast("double").alias("p")]
    rows = df.select(*by, F.col(user).cast("bigint").alias("u"), F.col(item).cast("bigint").alias("i"), F.col(value).cast("double").alias("v"), *extra)
    rows = rows.filter("u is not null and i is not null")
    sizes = rows.groupBy(*by, "u").agg(F.count("*").alias("n"))
    sizes = stored(sizes.select(*by, "u", "n", F.ceil(F.col("n") / PIECE).cast("int").alias("c")))
    most, pieces = sizes.groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.max("c").alias("c")).agg(F.max("pairs"), F.max("c")).first()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-int(most or 0) // (2 * PAIRS if once else PAIRS)))
    if (pieces or 0) > 1:
        long = sizes.filter("c > 1").drop("n").withColumnRenamed("c", "_c")
        rows = attach_by_key(rows, long, [*by, "u"], "left").withColumn("c", F.coalesce("_c", F.lit(1))).drop("_c")
        rows = rows.withColumn("q", F.pmod(F.xxhash64("i"), F.col("c")).cast("int"))
    else:
        rows = rows.withColumns({"c": F.lit(1), "q": F.lit(0)})
    shared = [F.lit(1.0).alias("p") if factor is None else F.max("p").alias("p")]
    packed = rows.groupBy(*by, "u", "q").agg(F.collect_list(F.struct("i", "v")).alias("h"), F.max("c").alias("c"), *shared)
    packed = packed.select(*by, "u", "c", "p", F.col("h.i").alias("js"), F.col("h.v").alias("ws"))
    packed = stored(packed.join(sizes.select(*by, "u", "n"), [*by, "u"]) if (pieces or 0) > 1 else packed.withColumn("n", F.size("js").cast("bigint")))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    folds = [to_arrow_type(df.schema[c].dataType) for c in by]

    def parted(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """The rows of a batch by their `by` values."""
        if not batch.num_rows:
            return
        if not by:
            yield (), batch
            return
        groups: dict[tuple, list[int]] = {}
        for n, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by))):
            groups.setdefault(key, []).append(n)
        for key, at in groups.items():
            yield key, batch.take(pa.array(at))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in parted(batch):
                lengths, items = _lists(part.column("js"), np.int64)
                pairs = np.bincount(_deal(items, blocks), np.repeat(part.column("n").to_numpy(), lengths), blocks).astype(np.int64)
                at = np.flatnonzero(pairs)
                made = [pa.array([k] * len(at), t) for k, t in zip(key, folds)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(at), pa.array(pairs[at])], names=[*by, "a", "pairs"])

    # The pairs of a block are the sum of its rows' history lengths.
    loads = packed.mapInArrow(counted, ", ".join([*kinds, "a bigint", "pairs bigint"]))
    loads = loads.groupBy(*by, "a").agg((F.sum("pairs") / (2 if once else 1)).alias("pairs")).filter(F.col("pairs") > HOT * PAIRS)
    # Fewer rows than all pairs / (HOT * PAIRS).
    cuts: dict[tuple, dict[int, int]] = {}
    for row in loads.select(*by, "a", F.ceil(F.col("pairs") / PAIRS).alias("cut")).collect():
        cuts.setdefault(tuple(row)[: len(by)], {})[row["a"]] = row["cut"]
    at_once = SPREAD // 8
    rounds = 1
    if best is not None and blocks >= 2 * (least_blocks := 2 * spark.sparkContext.defaultParallelism):
        travels = F.sum(F.col("n") * F.least("n", F.lit(blocks))) / F.sum("n")
        rounds = max(1, min(math.ceil((sizes.agg(travels).first()[0] or 0) / COPIES), blocks // least_blocks))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        """Histories of about `at_once` items by their `by` values: (users, scales, pieces, lengths, items, values)."""
        held: dict[tuple, list[list[np.ndarray]]] = {}
        for batch in batches:
            for key, part in parted(batch):
                lengths, items = _lists(part.column("js"), np.int64)
                plain = [part.column(c).to_numpy(zero_copy_only=False) for c in ("u", "p", "c")]
                held.setdefault(key, []).append([*plain, lengths, items, _lists(part.column("ws"), np.float64)[1]])
            if sum(len(h[4]) for parts in held.values() for h in parts) >= at_once:
                yield from ((key, [np.concatenate(x) for x in zip(*parts)]) for key, parts in held.items())
                held = {}
        yield from ((key, [np.concatenate(x) for x in zip(*parts)]) for key, parts in held.items())

    def dealt(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for key, (users, scales, pieces, lengths, items, values) in gathered(batches):
            # In order of the users, and a user's items in theirs, so the steps from one to the next are small.
            order = np.argsort(users, kind="stable")
            rows = _within((np.cumsum(lengths) - lengths)[order], lengths[order])
            users, scales, pieces, lengths = (x[order] for x in (users, scales, pieces, lengths))
            rows = rows[np.lexsort((items[rows], np.repeat(np.arange(len(lengths)), lengths)))]
            items, values = items[rows], values[rows]
            ends = np.cumsum(lengths)
            at = 0
            while at < len(lengths):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once)))
                low, high = (ends[at - 1] if at else 0), ends[end - 1]
                known, places = _places(values[low:high])
                for tile, place, cut, some, n, js, ws in _spread(
                    lengths[at:end], items[low:high], places, pieces[at:end] > 1, blocks, cuts.get(key, {}), once, turn, rounds
                ):
                    columns, first = pack(tile, n, js, ws, known)
                    made = {c: pa.array([k] * len(first), t) for c, k, t in zip(by, key, folds)}
                    made |= {"a": pa.array(tile[first]), "b": pa.array(place[first]), "cut": pa.array(cut[first])}
                    made |= pack_users(first, users[at:end][some], scales[at:end][some], n)
                    yield pa.RecordBatch.from_pydict(made | columns)
                at = end

    users_schema = "ub bigint, uw int, nw int, us binary, ns binary, pk binary, ps binary"
    tile_schema = f"a bigint, b bigint, cut bigint, {users_schema}, base bigint, width int, known binary, items binary, coded binary"

    def tiles(turn: int) -> DataFrame:
        return packed.mapInArrow(lambda batches: dealt(batches, turn), ", ".join([*kinds, tile_schema]))

    names = [*by, "item_i", "item_j", *sums]
    types = [*folds, pa.int64(), pa.int64(), *([pa.float64()] * len(sums))]
    schema = ", ".join([*kinds, "item_i bigint", "item_j bigint", *(f"{s} double" for s in sums)])

    def work(key: tuple, tile: pa.Table) -> pa.Table:
        own = [unpack_users(*row) for row in zip(*(tile[c].to_pylist() for c in ("ub", "uw", "nw", "us", "ns", "pk", "ps")))]
        users, scales, lengths = (np.concatenate(x) for x in zip(*own))
        read = [unpack(*row) for row in zip(*(tile[c].to_pylist() for c in ("base", "width", "known", "items", "coded")))]
        items, values = (np.concatenate(x) for x in zip(*read))
        # In the order of users, so a pair has the same sum in both directions.
        order = np.argsort(users, kind="stable")
        rows = _within((np.cumsum(lengths) - lengths)[order], lengths[order])
        user, items = np.repeat(users[order], lengths[order]), items[rows]
        values = values[rows] * np.repeat(scales[order], lengths[order])
        own = _deal(items, blocks) == key[len(by)].as_py()
        cut, part = tile["cut"][0].as_py(), key[len(by) + 1].as_py()
        left = (user[own], items[own], values[own])
        if cut > 1:
            rest = _deal(items, cut, 1) == part
            user, items, values = user[rest], items[rest], values[rest]
        i, j, found = tile_sums(left, (user, items, values), sums)
        if once:
            at = (_deal(j, blocks) != key[len(by)].as_py()) | (i < j)
            i, j, found = i[at], j[at], [f[at] for f in found]
        if least > 1:
            at = found[list(sums).index("support")] >= least
            i, j, found = i[at], j[at], [f[at] for f in found]
        if best is not None:
            at = _best_places(i, j, best[1](dict(zip(sums, found))), best[0])
            i, j, found = i[at], j[at], [f[at] for f in found]
        made = [pa.array([k.as_py()] * len(i), t) for k, t in zip(key, folds)]
        made += [pa.array(i, pa.int64()), pa.array(j, pa.int64()), *(pa.array(f, pa.float64()) for f in found)]
        return pa.Table.from_arrays([a.cast(t) for a, t in zip(made, types)], names=names)

    parts = [tiles(turn).groupBy(*by, "a", "b").applyInArrow(work, schema) for turn in range(rounds)]
    return parts[0] if rounds == 1 else reduce(DataFrame.unionByName, [stored(part) for part in parts])


def grid(values: np.ndarray, digits: int = 9) -> np.ndarray:
    """The rounding of `steady`, for scores inside a tile."""
    scale = float(10**digits)
    return np.floor(values * scale + 0.5) / scale


__all__ = ["SUMS", "grid", "pair_sums", "tile_sums"]
