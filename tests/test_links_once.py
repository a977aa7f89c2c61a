"""Recommendations from neighbour lists: the links of a user are shuffled once."""

import random
from collections import defaultdict

import pytest

from tastemill.operators import knn


@pytest.mark.parametrize("piece", [1 << 12, 3])
@pytest.mark.parametrize("keep", [False, True])
def test_recommendations_in_one_shuffle_of_links(spark, monkeypatch, piece, keep):
    monkeypatch.setattr(knn, "PIECE", piece, raising=False)
    rng = random.Random(6)
    history = [(f, u, i) for f in (1, 2) for u in range(12) for i in rng.sample(range(20), 3 + u % 5)] + [(1, 3, None)]
    near = {(f, i, j): rng.randint(1, 9) / 8 for f in (1, 2) for i in range(20) for j in rng.sample(range(20), 4) if i != j}
    own = spark.createDataFrame(history, "fold int, user_id bigint, item_id bigint")
    lists = spark.createDataFrame([(*k, s) for k, s in near.items()], "fold int, item_id bigint, similar_item_id bigint, score double")
    wanted = own.filter("user_id % 3 = 0")
    found = knn.knn_recommend(wanted, own, lists, 5, by=["fold"], keep_seen=keep)
    scores = defaultdict(lambda: defaultdict(float))
    for f, u, i in history:
        for (g, a, b), s in near.items():
            if u % 3 == 0 and f == g and i == a and (keep or (f, u, b) not in history):
                scores[f, u][b] += s
    right = {(*key, i, n + 1): s for key, own in scores.items() for n, (i, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {(r.fold, r.user_id, r.item_id, r.rank): r.score for r in found.collect()} == right
    # Sums and seen items used to be shuffled by (user, item), and all sums again by the user.
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]
    assert keys and not any("user_id" in x and "item_id" in x for x in keys)
