"""Scoring all pairs: a tile's memory does not grow with the tile, and the lists are those of brute force."""

import tracemalloc

import numpy as np
import pytest

from tastemill.operators import search, vectors
from tests.test_search import by_force, check, frames


def test_a_large_tile_needs_little_memory():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2048, 4)), rng.standard_normal((8192, 4))
    users, items = np.arange(2048), np.arange(8192)
    tracemalloc.start()
    found = vectors.tile_scores(users, x, items, y, np.zeros(8192), None, None, 10, "dot")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_480 and most < 2048 * 8192 * 8


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_lists_of_parts_of_a_tile(monkeypatch, metric):
    monkeypatch.setattr(vectors, "CELLS", 700)
    rng = np.random.default_rng(4)
    x, y = (rng.integers(-2, 3, (n, 3)).astype(float) for n in (30, 200))
    seen = {(u, int(i)) for u in range(30) for i in rng.choice(200, 190 if u == 7 else 20 + u % 2 * 180, replace=False)}
    pairs = np.array(sorted(seen))
    y[5] = np.nan
    found = vectors.tile_scores(np.arange(30), x, np.arange(200), y, np.zeros(200), pairs[:, 0], pairs[:, 1], 5, metric)
    wanted = by_force(x, np.where(np.isnan(y), 0, y), np.zeros(200), 5, seen | {(u, 5) for u in range(30)}, metric)
    got = {u: own[["item_id", "score"]].to_records(index=False).tolist() for u, own in found.groupby("user_id")}
    assert got.keys() == {u for u, w in wanted.items() if w}
    for u, own in got.items():
        assert [i for i, _ in own] == [i for i, _ in wanted[u]]
        assert [s for _, s in own] == pytest.approx([s for _, s in wanted[u]], abs=2e-6)


def test_all_is_scored_in_wide_blocks_where_bounds_do_not_help(spark, monkeypatch):
    rng = np.random.default_rng(8)
    left, right = rng.standard_normal((40, 16)), rng.standard_normal((200, 16))
    right /= np.linalg.norm(right, axis=1, keepdims=True)
    seen = {(u, int(i)) for u in range(40) for i in rng.choice(200, 10, replace=False)}
    s = spark.createDataFrame(sorted(seen), "user_id bigint, item_id bigint")
    a, b = frames(spark, left, right, np.zeros(200))
    assert search.bounded_search(a, b, 5, s, block=20, spared=search.SPARED) is None
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "WIDE", 16 * 50)
    check(search.topk(a, b, 5, s, block=20).collect(), by_force(left, right, np.zeros(200), 5, seen, "dot"), "dot")


def test_a_block_is_as_wide_as_its_numbers_allow():
    assert vectors.wide_block(900_000, 1_200_000, 64, 48) == 65_536
    assert vectors.wide_block(90_000, 120_000, 32, 48) == 15_000
    assert vectors.wide_block(10, 10, 4, 48) == vectors.BLOCK
