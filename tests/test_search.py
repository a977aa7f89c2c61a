"""The bounded search against brute force: the same lists, and fewer pairs where norms or clusters allow it."""

import numpy as np
import pytest

from tastemill.operators import search


def frames(spark, left, right, bias):
    a = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(left)], "user_id bigint, vec array<double>")
    b = [(n, v.tolist(), float(x)) for n, (v, x) in enumerate(zip(right, bias))]
    return a, spark.createDataFrame(b, "item_id bigint, vec array<double>, bias double")


def by_force(left, right, bias, k, seen, metric):
    out = {}
    for u, x in enumerate(left):
        scores = -np.linalg.norm(right - x, axis=1) if metric == "l2" else right @ x + bias
        order = sorted((i for i in range(len(right)) if (u, i) not in seen), key=lambda i: (-round(scores[i], 7), i))
        out[u] = [(i, scores[i]) for i in order[:k]]
    return out


def check(found, wanted, metric):
    lists = {}
    for r in found:
        lists.setdefault(r.user_id, {})[r.rank] = (r.item_id, -r.score if metric == "l2" else r.score)
    assert lists.keys() == {u for u, w in wanted.items() if w}
    for u, own in lists.items():
        assert [own[n + 1][0] for n in range(len(own))] == [i for i, _ in wanted[u]]
        assert all(own[n + 1][1] == pytest.approx(s, abs=2e-6) for n, (_, s) in enumerate(wanted[u]))


def skewed(rng, users, items, d):
    """Items of a few directions with norms that fall off, as popularity makes them."""
    centers = rng.standard_normal((6, d))
    right = centers[rng.integers(6, size=items)] + 0.3 * rng.standard_normal((items, d))
    right *= (3.0 / (1 + np.arange(items) / 20))[rng.permutation(items)][:, None]
    return centers[rng.integers(6, size=users)] + 0.3 * rng.standard_normal((users, d)), right


@pytest.mark.parametrize("kind", ["skewed", "even", "ties", "clusters"])
def test_the_same_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(search, "CHUNK", 7)
    rng = np.random.default_rng(5)
    metric, bias = "dot", np.zeros(300)
    if kind == "skewed":
        left, right = skewed(rng, 60, 300, 6)
        bias = 0.01 * rng.standard_normal(300)
    elif kind == "even":
        left, right = rng.standard_normal((60, 8)), rng.standard_normal((300, 8))
    elif kind == "ties":
        left, right = rng.integers(-2, 3, (60, 4)).astype(float), rng.integers(-1, 2, (300, 4)).astype(float)
    else:
        left, right = skewed(rng, 60, 300, 6)
        metric = "l2"
    seen = {(u, int(i)) for u in range(60) for i in rng.choice(300, 20, replace=False)}
    s = spark.createDataFrame([*sorted(seen), (999, 1), (1, 999)], "user_id bigint, item_id bigint")
    made = search.bounded_search(*frames(spark, left, right, bias), 5, s, metric, block=10)
    check(made.found.collect(), by_force(left, right, bias, 5, seen, metric), metric)
    work = made.work.first()
    assert (work.users, work.items, work.cells) == (60, 300, 18_000) and work.scored <= work.cells
    if kind in ("skewed", "clusters"):
        assert work.scored < work.cells / 2


def test_short_and_empty_sides(spark):
    rng = np.random.default_rng(6)
    left, right = rng.standard_normal((4, 3)), rng.standard_normal((30, 3))
    a, b = frames(spark, left, right, np.zeros(30))
    seen = {(0, i) for i in range(27)} | {(1, i) for i in range(30)}
    s = spark.createDataFrame(sorted(seen), "user_id bigint, item_id bigint")
    check(search.bounded_search(a, b, 5, s, block=4).found.collect(), by_force(left, right, np.zeros(30), 5, seen, "dot"), "dot")
    assert search.bounded_search(a, b.limit(0), 5, block=4).found.count() == 0
    assert search.bounded_search(a.limit(0), b, 5, block=4).found.count() == 0
    assert search.topk(a, b, 5, s).count() == 3 + 5 + 5  # few blocks: all is scored


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for metric in ("dot", "l2"):
        x, y = rng.standard_normal((50, 5)), rng.standard_normal((40, 5)) * rng.uniform(0, 4, (40, 1))
        bias = np.zeros(40) if metric == "l2" else rng.standard_normal(40)
        center = y.mean(axis=0)
        radius = np.sqrt(((y - center) ** 2).sum(axis=1).max())
        high = search.bounds(x, center[None], np.array([radius]), np.linalg.norm(y, axis=1).max()[None], bias.max()[None], metric)
        real = -np.linalg.norm(x[:, None] - y[None], axis=2) if metric == "l2" else x @ y.T + bias
        assert (high[:, 0] >= real.max(axis=1)).all()
