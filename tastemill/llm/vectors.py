"""Embedding near-dedup: a pigeonhole join over subspaces of rotated vectors."""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.components import connected_components
from tastemill.session import stored

#: Subspaces, leading coordinates of each that make its grid, width of a grid cell in radii.
BLOCKS, GRID, CELL = 4, 2, 4.0
#: Rows of one part of a grid cell, rows compared with a part at once, pairs measured at once.
PART, TILE, PAIRS = 32768, 512, 1 << 14
#: Copies of a placed row that are shuffled at a time.
COPIES = 2
#: What single precision may be off by.
SLACK = 1e-5


def unit_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, size, unit binary, key): unit holds doubles, null unless the vector is finite and not zero."""

    def work(batches):
        for batch in batches:
            lists = batch.column("raw").cast(pa.list_(pa.float64()))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            units, keys = [], []
            for start, end in zip(ends - lengths, ends):
                v = flat[start:end]
                top = np.abs(v).max() if len(v) else 0.0
                if np.isfinite(top) and top > 0:
                    v = v / top  # neither huge nor tiny vectors leave the range of doubles
                    units.append((v / np.sqrt(v @ v) + 0.0).astype("<f8").tobytes())
                    keys.append(xxhash.xxh64_intdigest(units[-1]) - (1 << 63))
                else:
                    units.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lengths, pa.int32()), pa.array(units, pa.binary()), pa.array(keys, pa.int64())],
                names=["id", "size", "unit", "key"],
            )

    source = df.select(F.col(id).alias("id"), F.col(vector).alias("raw"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, size int, unit binary, key bigint")


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, so that each subspace holds a like share of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def bounds(size: int) -> list[int]:
    blocks = max(1, min(BLOCKS, size))
    return [round(size * b / blocks) for b in range(blocks + 1)]


def _budget(size: int, least: float) -> float:
    """Squared distance that some subspace of two unit vectors keeps to if their cosine is `least` or more."""
    return (2 - 2 * least) / (len(bounds(size)) - 1)


def _places(batches, least: float):
    """Each vector at home in one grid cell of each subspace, and a guest in each cell that its range touches."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            part = batch.take(pa.array(at))
            units = np.frombuffer(b"".join(part.column("unit").to_pylist()), "<f8").reshape(-1, size)
            turned = units @ rotation(size).T
            edges = bounds(size)
            radius = np.sqrt(_budget(size, least)) * (1 + 1e-9) + 1e-12
            for b, start in enumerate(edges[:-1]):
                lead = turned[:, start : min(start + GRID, edges[b + 1])]
                lead = np.pad(lead, ((0, 0), (0, GRID - lead.shape[1])))
                own = np.floor(lead / (CELL * radius)).astype(np.int64)
                low = np.floor((lead - radius) / (CELL * radius)).astype(np.int64)
                high = np.floor((lead + radius) / (CELL * radius)).astype(np.int64)
                for x in (0, 1):
                    for y in (0, 1):
                        # The range is narrower than a cell, so it touches at most two in each direction.
                        ok = np.flatnonzero((low[:, 0] + x <= high[:, 0]) & (low[:, 1] + y <= high[:, 1]))
                        cell = low[ok] + [x, y]
                        made = [
                            pa.array(np.full(len(ok), b, np.int32)),
                            pa.array(cell[:, 0]),
                            pa.array(cell[:, 1]),
                            pa.array((cell == own[ok]).all(axis=1)),
                            *(part.column(c).take(pa.array(ok)) for c in ("size", "key", "copies", "unit")),
                        ]
                        yield pa.RecordBatch.from_arrays(
                            made, names=["block", "x", "y", "home", "size", "key", "copies", "unit"]
                        )


def _labels(i: np.ndarray, j: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the rows and columns that links (i, j) connect: the first row of the group."""
    own = np.arange(rows)
    while True:
        other = np.full(columns, rows)
        np.minimum.at(other, j, own[i])
        new = own.copy()
        np.minimum.at(new, i, other[j])
        if (new == own).all():
            return own, other
        own = new


def _compare(group: pa.Table, least: float):
    """(a, b, n): links counted for each home vector (b null), and enough links to connect each group.

    A matrix product in single precision gives the subspace's distances with some slack; the few pairs that it
    leaves are measured in doubles, in one fixed order, so both tasks that see a pair agree.
    """
    size, block = group["size"][0].as_py(), group["block"][0].as_py()
    home = group["home"].to_numpy(zero_copy_only=False)
    units = np.frombuffer(b"".join(group["unit"].to_pylist()), "<f8").reshape(-1, size)
    turned = units @ rotation(size).T
    keys, copies = group["key"].to_numpy(), group["copies"].to_numpy()
    edges, budget = bounds(size), _budget(size, least)
    own = turned[:, edges[block] : edges[block + 1]]
    half, one = -0.5 * (own * own).sum(axis=1, keepdims=True), np.ones((len(own), 1))
    # The product of these two is minus half the squared distance.
    first = np.hstack([own, half, one]).astype(np.float32)
    second = np.hstack([own, one, half]).astype(np.float32)
    left, right = np.flatnonzero(home), np.flatnonzero(~home)
    for start in range(0, len(left), TILE):
        rows = left[start : start + TILE]
        for at in range(0, len(right), 4 * TILE):
            columns = right[at : at + 4 * TILE]
            near = np.flatnonzero((first[rows] @ second[columns].T).ravel() >= -0.5 * budget - SLACK)
            found = []
            for k in range(0, len(near), PAIRS):
                i, j = np.divmod(near[k : k + PAIRS], len(columns))
                x, y = rows[i], columns[j]
                far = np.add.reduceat((turned[x] - turned[y]) ** 2, edges[:-1], axis=1)
                # A pair counts in the first subspace that finds it, so in one task only.
                ok = (far[:, block] <= budget) & (far[:, :block] > budget).all(axis=1) & (keys[x] != keys[y])
                i, j, x, y = i[ok], j[ok], x[ok], y[ok]
                ok = (units[x] * units[y]).sum(axis=1) >= least
                found.append((i[ok], j[ok]))
            if not any(len(i) for i, _ in found):
                continue
            i, j = (np.concatenate(f) for f in zip(*found))
            counts = np.zeros(len(rows), np.int64)
            np.add.at(counts, i, copies[columns[j]])
            linked = np.flatnonzero(counts)
            yield keys[rows[linked]], np.full(len(linked), None), counts[linked]
            for nodes, label in zip((rows, columns), _labels(i, j, len(rows), len(columns))):
                met = np.flatnonzero(label < len(rows))
                met = met[keys[nodes[met]] != keys[rows[label[met]]]]
                yield keys[nodes[met]], keys[rows[label[met]]], np.zeros(len(met), np.int64)


def _grouped(batches, columns: list[str]):
    """Tables of the consecutive rows that agree in `columns`."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        while held.num_rows:
            same = np.ones(held.num_rows, bool)
            for c in columns:
                values = held[c].to_numpy(zero_copy_only=False)
                same &= values == values[0]
            end = int(same.argmin()) if not same.all() else held.num_rows
            if end == held.num_rows:
                break
            yield held.slice(0, end)
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield held


def link_vectors(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, n) for distinct unit vectors (size, key, copies, unit): links counted and links that connect.

    Two unit vectors of cosine `least` differ by at most 2 - 2 least in squared distance, so in one of the subspaces
    by at most its share. Each subspace is joined by range: a vector meets those of its grid cell and the vectors of
    other cells whose range reaches in. A cell is cut by hash into parts of about PART rows, homes and guests each,
    and every pair of parts is a group of its own. Candidates are verified in full, in doubles.

    A row travels once for each part of the other side. Where that is more than COPIES times, groups take turns: the
    links of a round are written, and its shuffle goes, before the next round begins.
    """
    kinds = "block int, x bigint, y bigint, home boolean, size int, key bigint, copies bigint, unit binary"
    cell = ["size", "block", "x", "y"]
    placed = vectors.select("size", "key", "copies", "unit")
    placed = stored(placed.mapInArrow(lambda batches: _places(batches, least), kinds))
    counts = placed.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count("*").alias("guests"))
    counts = counts.select(
        *cell,
        "homes",
        "guests",
        F.ceil(F.col("homes") / PART).cast("int").alias("h"),
        F.ceil(F.col("guests") / PART).cast("int").alias("g"),
    )
    # A cell without homes has nothing to count.
    counts = stored(counts.filter("h > 0"))
    travels, guests, groups = counts.agg(F.sum(F.expr("homes * g + guests * h")), F.sum("guests"), F.sum(F.expr("h * g"))).first()
    rounds = min(math.ceil((travels or 0) / (COPIES * (guests or 1))), (groups or 0) // placed.sparkSession.sparkContext.defaultParallelism)
    met = placed.join(counts.drop("homes", "guests"), cell)
    hash = F.xxhash64("key", F.lit(3))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    homes = met.filter("home").withColumn("i", F.pmod(hash, F.col("h")).cast("int")).withColumn("j", F.explode(every("g")))
    guests = met.withColumn("home", F.lit(False))
    guests = guests.withColumn("j", F.pmod(hash, F.col("g")).cast("int")).withColumn("i", F.explode(every("h")))
    columns = [*cell, "i", "j", "home", "key", "copies", "unit"]
    both = homes.select(*columns).unionByName(guests.select(*columns))

    def run(batches):
        for group in _grouped(batches, [*cell, "i", "j"]):
            for a, b, n in _compare(group, least):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"]
                )

    def links(part: DataFrame) -> DataFrame:
        dealt = part.repartition(*cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
        return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")

    if rounds <= 1:
        return links(both)
    turn = F.pmod(F.xxhash64(*cell, "i", "j", F.lit(5)), F.lit(rounds))
    return reduce(DataFrame.unionByName, [stored(links(both.filter(turn == n))) for n in range(rounds)])


def vector_groups(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of `df`, linked at cosine >= `least`.

    Equal directions are one vector with a number of copies, which link with each other. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are kept; so are vectors of a length
    that no other has. component_id is the smallest id that links reach; a null id is one only if its group has no other.
    """
    rows = stored(unit_vectors(df, id, vector))
    valid = rows.filter("unit is not null")
    single = stored(
        valid.groupBy("key").agg(
            F.min("id").alias("low"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("unit").alias("unit")
        )
    )
    found = stored(link_vectors(single, least))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = stored(connected_components(found.filter("b is not null")))
    named = single.select("key", "low", "copies").join(groups, F.col("key") == F.col("node"), "left")
    named = stored(named.select("key", "low", "copies", F.coalesce("component", "key").alias("component")))
    tops = stored(named.groupBy("component").agg(F.min("low").alias("top")))
    named = named.join(tops, "component").join(counts, F.col("key") == F.col("a"), "left")
    named = stored(
        named.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("top").alias("component_id"))
    )
    joined = rows.select("id", "key").join(named, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
