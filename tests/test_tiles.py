"""Pair sums by tiles against plain loops: hot items, long histories, folds, and the k best of an item."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tastemill.operators import similarity, tiles
from tastemill.session import stored


def rated(rng, folds=2):
    """Item 0 has every user, user 0 nearly every item."""
    rows = {}
    for f in range(folds):
        for u in range(40):
            own = {0, *rng.sample(range(1, 60), 55 if u == 0 else rng.randint(0, 12))}
            rows |= {(f, u, i): float(rng.randint(-4, 4)) for i in own}
    return rows


def by_force(rows):
    histories = defaultdict(dict)
    for (f, u, i), v in rows.items():
        histories[f, u][i] = v
    out = defaultdict(lambda: [0.0] * 5)
    for (f, _), own in histories.items():
        for i, v in own.items():
            for j, w in own.items():
                if i != j:
                    out[f, i, j] = [a + b for a, b in zip(out[f, i, j], (1.0, v * w, v * v, w * w, abs(v - w)))]
    return out


@pytest.mark.parametrize("pairs, piece, at_once", [(4_000_000, 1 << 14, 1 << 21), (150, 7, 20)])
def test_sums_of_pairs(spark, monkeypatch, pairs, piece, at_once):
    for name, value in (("PAIRS", pairs), ("PIECE", piece), ("AT_ONCE", at_once)):
        monkeypatch.setattr(tiles, name, value)
    rows = rated(random.Random(3))
    df = stored(spark.createDataFrame([(*k, v) for k, v in rows.items()], "fold int, user_id bigint, item_id bigint, v double"))
    names = list(tiles.SUMS)
    found = tiles.pair_sums(df, "user_id", "item_id", "v", names, by=["fold"]).collect()
    wanted = by_force(rows)
    assert {(r.fold, r.item_i, r.item_j): [r[n] for n in names] for r in found} == wanted and len(found) == len(wanted)

    score = lambda sums: sums["dot"]
    best = tiles.pair_sums(df, "user_id", "item_id", "v", ["dot"], by=["fold"], best=(3, score)).collect()
    lists = defaultdict(list)
    for r in best:
        lists[r.fold, r.item_i].append((-r.dot, r.item_j))
    right = defaultdict(list)
    for (f, i, j), (_, dot, *_) in wanted.items():
        right[f, i].append((-dot, j))
    assert lists.keys() == right.keys() and all(sorted(lists[k])[:3] == sorted(right[k])[:3] for k in right)
    if pairs > 1000:
        assert max(map(len, lists.values())) == 3


def test_one_user_and_none(spark):
    df = stored(spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0), (2, 7, 1.0)], "user_id bigint, item_id bigint, v double"))
    found = tiles.pair_sums(df, "user_id", "item_id", "v", ["dot", "support"]).collect()
    assert sorted(map(tuple, found)) == [(5, 6, 6.0, 1.0), (6, 5, 6.0, 1.0)]
    assert tiles.pair_sums(stored(df.limit(0)), "user_id", "item_id", "v", ["dot"]).count() == 0


def test_the_k_best_places():
    item = np.array([2, 1, 2, 2, 1, 2])
    other = np.array([9, 4, 3, 1, 2, 8])
    score = np.array([5.0, 1.0, 7.0, 5.0, 1.0, 5.0])
    at = tiles._best_places(item, other, score, 2)
    assert sorted(zip(item[at], other[at])) == [(1, 2), (1, 4), (2, 1), (2, 3)]


@pytest.mark.parametrize("measure", ["adjusted_cosine", "euclidean", "manhattan", "jaccard"])
@pytest.mark.parametrize("support, weak", [(0, False), (2, False), (2, True)])
def test_top_lists_from_the_best_of_a_tile(spark, measure, support, weak):
    rows = {k[1:]: v for k, v in rated(random.Random(4), 1).items()}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "user_id bigint, item_id bigint, norm_rating double")
    lists = [
        similarity.top_neighbors(similarity.item_similarity(df, min_support=support, measure=measure, keep_weak=weak, diagonal=False, best=b), 3)
        for b in (None, 3)
    ]
    assert sorted(map(tuple, lists[0].collect())) == sorted(map(tuple, lists[1].collect()))


def test_blocks_of_even_size_hand_on_only_the_best(spark, monkeypatch):
    """Blocks a little above the planned number of pairs used to be cut by users, and then all their pairs left the tiles."""
    monkeypatch.setattr(tiles, "PAIRS", 60)
    rng = random.Random(8)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(60) for i in rng.sample(range(200), 6)]
    df = stored(spark.createDataFrame(rows, "user_id bigint, item_id bigint, v double"))
    best = tiles.pair_sums(df, "user_id", "item_id", "v", ["dot"], best=(2, lambda sums: sums["dot"])).collect()
    lists = defaultdict(list)
    for r in best:
        lists[r.item_i].append(r.item_j)
    assert max(map(len, lists.values())) == 2 and len(lists) == len({i for _, i, _ in rows})
    twice = tiles.pair_sums(df, "user_id", "item_id", "v", ["support"], least=2).collect()
    wanted = {(i, j): s[0] for (_, i, j), s in by_force({(0, u, i): v for u, i, v in rows}).items() if s[0] >= 2}
    assert {(r.item_i, r.item_j): r.support for r in twice} == wanted and len(twice) == len(wanted)


def test_a_factor_of_the_user(spark):
    rows = [(u, i, float(i % 5 + u), float(u)) for u in range(1, 9) for i in range(u, 12)]
    df = stored(spark.createDataFrame(rows, "user_id bigint, item_id bigint, v double, f double"))
    apart = tiles.pair_sums(df, "user_id", "item_id", "v", ["dot", "ii"], factor="f")
    whole = tiles.pair_sums(stored(df.selectExpr("user_id", "item_id", "v * f as v")), "user_id", "item_id", "v", ["dot", "ii"])
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("low, high", [(0, 9), (-5, 70_000), (1 << 40, (1 << 40) + 9), (-(1 << 63), (1 << 63) - 1)])
@pytest.mark.parametrize("distinct", [3, 5000])
def test_packed_histories(low, high, distinct):
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 9, 400)
    items = rng.integers(low, high, sizes.sum(), dtype=np.int64)
    items[:2] = low, high
    values = rng.integers(0, distinct, sizes.sum()) / 7 - 1
    tile = np.sort(rng.integers(0, 5, 400))
    columns, first = tiles.pack(tile, sizes, items, values)
    read = [tiles.unpack(*row) for row in zip(*(columns[c].to_pylist() for c in ("base", "width", "known", "items", "coded")))]
    assert len(read) == len(first) == 5
    assert (np.concatenate([r[0] for r in read]) == items).all() and (np.concatenate([r[1] for r in read]) == values).all()


def test_each_pair_once_moves_half(spark, monkeypatch):
    """Every pair comes in one direction with the same sums, cut blocks and long histories too, and tiles get half the items."""
    rng = np.random.default_rng(12)
    rows = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 500), rng.integers(0, 60, 500))} | {(u, 3) for u in range(30)} | {(99, i) for i in range(60)})
    df = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u, i in rows], "user_id bigint, item_id bigint, v double")
    sums = ["support", "dot", "ii", "jj", "gap"]
    both = {(r.item_i, r.item_j): r[2:] for r in tiles.pair_sums(df, "user_id", "item_id", "v", sums).collect()}
    for pairs, piece in ((4_000_000, 4096), (60, 16)):
        monkeypatch.setattr(tiles, "PAIRS", pairs)
        monkeypatch.setattr(tiles, "PIECE", piece)
        found = tiles.pair_sums(df, "user_id", "item_id", "v", sums, once=True).collect()
        keys = {(r.item_i, r.item_j) for r in found}
        assert len(keys) == len(found) == len(both) / 2 and not keys & {(j, i) for i, j in keys}
        assert all(tuple(r[2:]) == tuple(both[r.item_i, r.item_j]) for r in found)
    items, blocks = np.arange(400), 9
    moved = [sum(len(x[5]) for x in tiles._spread(np.full(10, 40), items, items * 1.0, np.zeros(10, bool), blocks, {}, once)) for once in (False, True)]
    assert moved[1] < 0.65 * moved[0]


def test_blocks_take_turns_for_the_best_partners(spark, monkeypatch):
    """The lists of a round are written, so its shuffle is gone; all of it used to lie on the disks at a time."""
    for name, value in (("PAIRS", 40), ("PIECE", 7), ("COPIES", 2)):
        monkeypatch.setattr(tiles, name, value, raising=False)
    rows = rated(random.Random(9))
    df = stored(spark.createDataFrame([(*k, v) for k, v in rows.items()], "fold int, user_id bigint, item_id bigint, v double"))
    best = tiles.pair_sums(df, "user_id", "item_id", "v", ["dot"], by=["fold"], best=(3, lambda sums: sums["dot"]))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") > 1 and "Exchange" not in plan
    found = defaultdict(list)
    for r in best.collect():
        found[r.fold, r.item_i].append((-r.dot, r.item_j))
    right = defaultdict(list)
    for (f, i, j), (_, dot, *_) in by_force(rows).items():
        right[f, i].append((-dot, j))
    assert found.keys() == right.keys() and all(sorted(found[k])[:3] == sorted(right[k])[:3] for k in right)
    assert all(len(set(found[k])) == len(found[k]) for k in found)
