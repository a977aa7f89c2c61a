"""What a task of the bounded search holds does not grow with the users of one direction."""

import numpy as np

from tastemill.operators import search
from test_search import frames


def test_users_of_one_direction_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "USERS", 100, raising=False)
    most, packed = [], search._packed

    def spied(df, key, by, more):
        if by == "_l":
            most.append(df.groupBy(by).count().agg({"count": "max"}).first()[0])
        return packed(df, key, by, more)

    monkeypatch.setattr(search, "_packed", spied)
    rng = np.random.default_rng(3)
    left, right = np.ones((3000, 3)) * rng.uniform(1, 2, (3000, 1)), rng.standard_normal((1024, 3))
    a, b = frames(spark, left, right, np.zeros(1024))
    found = search.bounded_search(a, b, 2, block=16).found.toPandas()
    best = np.argsort(-right.sum(axis=1))[:2]
    assert len(found) == 6000 and all((found.item_id == best[0]) == (found["rank"] == 1))
    assert set(found.item_id) == set(best)
    # All 3000 lie in one cell, and there are 64 cells: blocks of 1000 users and more.
    assert most and max(most) < 200

