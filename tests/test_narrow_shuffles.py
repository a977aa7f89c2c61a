"""What tiles shuffle: narrow rows of histories."""

import numpy as np
import pytest

from tastemill.operators import tiles


def test_values_that_recur_take_little_room():
    """Over 256 distinct values used to take eight bytes each, and items of a sorted history as many as any items."""
    rng = np.random.default_rng(5)
    items = np.sort(rng.integers(0, 1_200_000, (500, 30)), axis=1).ravel()
    values = np.repeat(rng.random(500), 30) + np.tile(np.arange(30) % 5, 500)
    sizes = np.full(500, 30)
    columns, first = tiles.pack(np.zeros(500, int), sizes, items, values)
    assert sum(c.nbytes for c in columns.values()) < 6 * len(items)
    users = tiles.pack_users(first, np.sort(rng.integers(0, 900_000, 500)), np.repeat([0.25, -3.5], 250), sizes)
    assert sum(c.nbytes for c in users.values()) < 5 * len(sizes)


@pytest.mark.parametrize("ids", [[7], [-(1 << 63), (1 << 63) - 1, 0], [3, 3, 9, -4]])
def test_users_of_a_row_come_back(ids):
    users, scales = np.array(ids, np.int64), np.array([0.1, -0.0, np.nan, np.inf][: len(ids)])
    sizes, first = np.arange(1, len(ids) + 1), np.array(sorted({0, len(ids) // 2}))
    columns = tiles.pack_users(first, users, scales, sizes)
    read = [tiles.unpack_users(*row) for row in zip(*(c.to_pylist() for c in columns.values()))]
    found = [np.concatenate(x) for x in zip(*read)]
    assert (found[0] == users).all() and found[1].tobytes() == scales.tobytes() and (found[2] == sizes).all()
