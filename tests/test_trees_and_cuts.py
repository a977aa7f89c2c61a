"""Moments added in a tree, ranks within large groups, and the cut of a vocabulary by count."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import blocks, clean, linalg, similarity
from tastemill.session import stored


def test_moments_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(linalg, "FAN", 2)
    a = 1e4 + np.random.default_rng(1).standard_normal((300, 5))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(a)] + [(999, None)], "vec_id bigint, embedding array<double>")
    for parts in (1, 13, 40):
        found = linalg.moments(df.repartition(parts))
        assert found.n == 300 and np.allclose(found.mean, a.mean(axis=0), rtol=1e-12)
        assert np.allclose(found.scatter, (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)), rtol=1e-9, atol=1e-6)
        assert np.allclose(found.gram, a.T @ a, rtol=1e-12)
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0])], df.schema).repartition(3)
    with pytest.raises(ValueError, match="length"):
        linalg.moments(ragged)
    with pytest.raises(ValueError, match="no vectors"):
        linalg.moments(df.limit(0))


def test_ranks_within_a_large_group_need_no_join_on_the_group(spark):
    rows = [(0 if n % 3 else n % 7, n) for n in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = blocks.ordinal_rank(df, [F.desc("v")], within=("g",), parts=9)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)]
        assert keys and all("_part" in k for k in keys)
        found = {(r.g, r.v): r["rank"] for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g in range(7):
        own = sorted((v for x, v in rows if x == g), reverse=True)
        assert [found[g, v] for v in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("cov", [0.0, 0.3, 0.5, 0.75, 0.9, 1.0])
def test_the_cut_of_a_vocabulary(spark, cov):
    rng = random.Random(2)
    lists = [",".join(rng.sample("abcdefghijkl", rng.randint(1, 4))) + rng.choice(["", ",a", ",b,a"]) for _ in range(80)] + [None, " Z,z "]
    df = spark.createDataFrame([(n % 70, "T ", g) for n, g in enumerate(lists)], "item_id bigint, title string, genres string")
    counts = Counter(g for x in lists if x for g in x.strip().lower().split(","))
    kept, upto = set(), 0
    for genre, n in sorted(counts.items(), key=lambda p: (-p[1], p[0])):
        upto += n
        if upto / sum(counts.values()) <= cov:
            kept.add(genre)
    assert {r.genre for r in clean.kept_genres(df, cov).collect()} == kept
    wanted = Counter()
    for n, x in enumerate(lists):
        own = sorted(set((x or "").strip().lower().split(",")) & kept)
        wanted[n % 70, ",".join(own) or "none"] += 1
    found = clean.select_genres(df, cov, "none")
    assert found.columns == df.columns and Counter((r.item_id, r.genres) for r in found.collect()) == wanted
    # The one window left is over the sizes of partitions, when ties are ranked.
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(n" not in text and "collect_set" not in text


def test_density_in_one_pass(spark):
    df = stored(spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 7)], "user_id bigint, item_id bigint"))
    assert tuple(similarity.sparsity(df).first()) == (4, 3, 3, pytest.approx(1 - 4 / 9))
