"""Shuffles leave the disks once a frame is stored, and lists of neighbours travel packed, once for each row of the history."""

import random
import time

import pytest

from tastemill.operators import knn
from tastemill.session import stored


def shuffle_files(spark) -> set[str]:
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disks.getAllFiles().mkString(" ").split() if "/shuffle_" in name}


def test_a_stored_frame_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    df = stored(spark.range(10_000).repartition(3, "id"))
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert df.count() == 10_000 and df.agg({"id": "sum"}).first()[0] == 49_995_000


@pytest.mark.parametrize("hot", [100_000, 3])
def test_lists_of_few_items_are_salted(spark, monkeypatch, hot):
    monkeypatch.setattr(knn, "HOT", hot, raising=False)
    rng = random.Random(9)
    history = [(u, i) for u in range(20) for i in {0, *rng.sample(range(40), 4)}]
    near = {(i, j): rng.randint(1, 9) / 8 for i in range(40) for j in rng.sample(range(40), 3) if i != j}
    own = spark.createDataFrame(history, "user_id bigint, item_id bigint")
    lists = spark.createDataFrame([(*k, s) for k, s in near.items()], "item_id bigint, similar_item_id bigint, score double")
    found = knn.knn_recommend(own, own, lists, 40)
    right = {}
    for u, i in history:
        for (a, b), s in near.items():
            if i == a and (u, b) not in history:
                right[u, b] = right.get((u, b), 0.0) + s
    assert {(r.user_id, r.item_id): r.score for r in found.collect()} == right
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (hot == 3)
    # One row of the history and its list, not a row a link, is what the shuffle by the user takes.
    above, below = plan.split("RepartitionByExpression [user_id")
    assert "posexplode" in above and "posexplode" not in below and "_items" in below
