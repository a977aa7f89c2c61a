import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import blocks, labels, vectors
from tastemill.session import stored


@pytest.fixture(scope="module")
def skewed(spark):
    """One user holds more than a third of all rows."""
    rng = random.Random(3)
    pairs = {(0, i) for i in range(60)}
    pairs |= {(rng.randrange(1, 12), rng.randrange(60)) for _ in range(120)}
    return spark.createDataFrame(sorted(pairs), "user_id bigint, item_id bigint"), sorted(pairs)


@pytest.mark.parametrize("chunk", [2, 7, 512])
def test_group_pairs_matches_brute_force(skewed, chunk):
    df, pairs = skewed
    valued = df.withColumn("v", (F.col("user_id") + 2 * F.col("item_id")).cast("double"))
    found = blocks.group_pairs(
        valued, ["user_id"], "item_id", ["v"],
        {"n": F.count("*"), "left": F.sum("v_i"), "dot": F.sum(F.col("v_i") * F.col("v_j"))},
        chunk=chunk,
    ).collect()
    want = {}
    for user, group in itertools.groupby(pairs, key=lambda p: p[0]):
        items = [i for _, i in group]
        for a, b in itertools.combinations(items, 2):
            va, vb = user + 2.0 * a, user + 2.0 * b
            n, left, dot = want.get((a, b), (0, 0.0, 0.0))
            want[(a, b)] = (n + 1, left + va, dot + va * vb)
    assert {(r.item_i, r.item_j): (r.n, r.left, r.dot) for r in found} == want


def test_no_join_key_gathers_a_heavy_user(skewed):
    df, _ = skewed
    chunk = 5
    found = blocks.group_pairs(
        df.withColumn("v", F.lit(1.0)), ["user_id"], "item_id", ["v"], {"n": F.count("*")}, chunk
    )
    assert found.filter("n > 12").count() == 0
    assert found.agg(F.sum("n")).first()[0] == sum(
        n * (n - 1) // 2 for n in Counter(u for u, _ in skewed[1]).values()
    )


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ordinal_rank(skewed, parts):
    df, pairs = skewed
    ranked = blocks.ordinal_rank(df, [F.asc("user_id"), F.desc("item_id")], "r", parts=parts)
    want = sorted(pairs, key=lambda p: (p[0], -p[1]))
    assert {(r.user_id, r.item_id): r.r for r in ranked.collect()} == {p: n for n, p in enumerate(want, 1)}


def test_ordinal_rank_within_a_heavy_group(skewed):
    df, pairs = skewed
    ranked = blocks.ordinal_rank(df, [F.asc("item_id")], "r", within=["user_id"], parts=8)
    seen = Counter()
    want = {}
    for user, item in pairs:
        seen[user] += 1
        want[(user, item)] = seen[user]
    assert {(r.user_id, r.item_id): r.r for r in ranked.collect()} == want


def test_attach_by_key_keeps_all_rows(skewed):
    df, pairs = skewed
    stats = df.groupBy("user_id").agg(F.count("*").alias("n"))
    joined = blocks.attach_by_key(df, stats, ["user_id"]).collect()
    sizes = Counter(u for u, _ in pairs)
    assert sorted((r.user_id, r.item_id, r.n) for r in joined) == sorted((u, i, sizes[u]) for u, i in pairs)


def test_attach_by_key_is_no_broadcast_however_small_the_estimate(spark):
    """Copies and lists are not in Spark's estimate: statistics of seven folds were sent to all as 2,517 MB at 60 times sf0.1."""
    lists = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.struct(n.cast("double").alias("p"), n.cast("double").alias("r")))
    stats = stored(spark.range(200).select(F.col("id").alias("user_id"), lists.alias("_m")))
    rows = spark.range(1000).select((F.col("id") % 250).alias("user_id"), "id")
    joined = blocks.attach_by_key(rows, stats, ["user_id"], "left")
    assert joined.count() == 1000 and joined.filter("_m is null").count() == 200
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_attach_by_key_left(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "user_id bigint, item_id bigint")
    stats = spark.createDataFrame([(1, 9)], "user_id bigint, n bigint")
    found = blocks.attach_by_key(rows, stats, ["user_id"], "left").orderBy("user_id").collect()
    assert [r.n for r in found] == [9, None]


def test_triplets_round_robin(spark):
    rows = [(1, i, 1) for i in range(5)] + [(1, 100, 0), (1, 101, 0)] + [(2, 1, 1)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int")
    found = sorted((r.pos_item, r.neg_item) for r in labels.make_triplets(df).collect())
    assert found == [(0, 100), (1, 101), (2, 100), (3, 101), (4, 100)]


@pytest.mark.parametrize("ratio", [1, 2])
def test_sample_negatives_is_exact_and_repeats(spark, skewed, ratio):
    df, _ = skewed
    positives = df.filter("item_id < 5")
    first = labels.sample_negatives(df, positives, ratio, seed=4)
    again = labels.sample_negatives(df.repartition(7), positives, ratio, seed=4)
    rows = sorted((r.user_id, r.item_id) for r in first.collect())
    assert len(rows) == len(set(rows)) == min(ratio * positives.count(), df.filter("item_id >= 5").count())
    assert rows == sorted((r.user_id, r.item_id) for r in again.collect())
    assert all(item >= 5 for _, item in rows)


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_block_topk_matches_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    left, right = rng.standard_normal((23, 6)), rng.standard_normal((57, 6))
    bias = rng.standard_normal(57) if metric == "dot" else np.zeros(57)
    seen = {(u, int(i)) for u in range(23) for i in rng.choice(57, 9, replace=False)}
    a = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(left)], "user_id bigint, vec array<double>")
    b = spark.createDataFrame(
        [(n, v.tolist(), float(bias[n])) for n, v in enumerate(right)], "item_id bigint, vec array<double>, bias double"
    )
    s = spark.createDataFrame(sorted(seen), "user_id bigint, item_id bigint")
    found = vectors.block_topk(a, b, 5, s, metric, block=10).collect()
    assert len(found) == 23 * 5
    for r in found:
        if metric == "dot":
            scores = left[r.user_id] @ right.T + bias
            order = np.argsort(-scores)
        else:
            scores = np.linalg.norm(right - left[r.user_id], axis=1)
            order = np.argsort(scores)
        best = [i for i in order if (r.user_id, i) not in seen]
        assert best[r.rank - 1] == r.item_id
        assert r.score == pytest.approx(scores[r.item_id], abs=1e-5)


def test_no_single_partition_window_on_rows(skewed):
    df, _ = skewed
    top = blocks.top_per_group(df, ["user_id"], [F.asc("item_id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "WindowGroupLimit" in plan


def test_temporary_frames_are_removed(spark):
    from pathlib import Path

    from tastemill.session import stored, temporary

    with temporary(spark):
        kept = stored(spark.range(5))
        files = [Path(f.removeprefix("file:")) for f in kept.inputFiles()]
        assert files and all(f.exists() for f in files)
    assert not any(f.exists() for f in files)
