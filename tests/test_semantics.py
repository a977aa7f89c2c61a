import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tastemill.operators import (
    als,
    clean,
    features,
    folds,
    hybrid,
    knn,
    labels,
    linalg,
    metrics,
    popular,
    similarity,
    vectors,
)

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def rows(spark, data):
    return spark.createDataFrame(data, "user_id bigint, item_id bigint, progress int, rating double, start_date date")


def test_rating_centring(spark):
    df = spark.createDataFrame(
        [(0, 0, 2.0), (0, 1, 2.0), (0, 2, 5.0), (1, 1, 5.0), (1, 3, 5.0)], "user_id long, item_id long, rating double"
    )
    found = clean.center_ratings(df).orderBy("user_id", "item_id").collect()
    assert [r.norm_rating for r in found] == [-1, -1, 2, 0, 0]


def test_dedupe_ignores_missing_ratings(spark):
    df = rows(spark, [(1, 1, 10, float("nan"), day(3)), (1, 1, 90, 4.0, day(5)), (1, 2, 5, float("nan"), day(1))])
    found = {r.item_id: r for r in clean.dedupe_interactions(df).collect()}
    assert (found[1].progress, found[1].rating, found[1].start_date) == (90, 4.0, day(3))
    assert found[2].rating is None


TRUTH = [("A", "m"), ("B", "f"), ("V", "g"), ("V", "r")]
LISTS = {"A": "oth", "B": "fnw", "V": "dsg"}


def test_metric_golden(spark):
    truth = spark.createDataFrame(TRUTH, "user_id string, item_id string")
    recs = spark.createDataFrame(
        [(u, i, n) for u, items in LISTS.items() for n, i in enumerate(items, 1)], "user_id string, item_id string, rank int"
    )
    found = {(r.name, r.k): r.value for r in metrics.compute_metrics(truth, recs, 3, separate_k=True).collect()}
    want = {
        ("prec", 1): 1 / 3, ("prec", 2): 1 / 6, ("prec", 3): 2 / 9,
        ("recall", 1): 1 / 3, ("recall", 2): 1 / 3, ("recall", 3): 1 / 2,
        ("MRR", 3): 4 / 9, ("MAP", 3): 7 / 18,
    }
    assert found == pytest.approx(want)


def test_metrics_of_empty_truth(spark):
    truth = spark.createDataFrame([], "user_id string, item_id string")
    recs = spark.createDataFrame([], "user_id string, item_id string, rank int")
    assert metrics.compute_metrics(truth, recs, 3).count() == 0


def test_diversity_counts_every_pair(spark):
    sets = {1: {"a", "b"}, 2: {"b"}, 3: {"c", "d", "a"}, 4: None, 5: {"a"}}
    items = spark.createDataFrame(
        [(i, ",".join(sorted(g)) if g else None) for i, g in sets.items()], "item_id bigint, genres string"
    )
    lists = {7: [1, 2, 3], 8: [4, 1, 5], 9: [2]}
    recs = spark.createDataFrame(
        [(u, i, n) for u, ids in lists.items() for n, i in enumerate(ids, 1)], "user_id bigint, item_id bigint, rank bigint"
    )
    found = {r.user_id: r.intra_list_div for r in metrics.intra_list_diversity(recs, items).collect()}
    for user, ids in lists.items():
        n = len(ids)
        if n == 1:
            assert found[user] is None
            continue
        apart = sum(len(sets[a] ^ sets[b]) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b])
        assert found[user] == pytest.approx(2 / (n * (n - 1)) * apart / 4)


def test_user_without_positive_gets_both_labels(spark):
    df = rows(spark, [(1, 1, 2, None, day(0)), (1, 2, 3, None, day(0)), (2, 1, 90, None, day(0)), (2, 3, 1, None, day(0))])
    stats = labels.user_stats(df)
    found = sorted((r.user_id, r.item_id, r.target) for r in labels.label(df, stats).collect())
    assert found == [(1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 1, 1), (2, 3, 0)]
    single = sorted((r.user_id, r.item_id, r.target) for r in labels.label(df, stats, dedupe=True).collect())
    assert single == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 0)]


def test_popularity_ties_and_segment_fallback(spark):
    df = rows(spark, [(u, i, 50, None, day(0)) for u, i in [(1, 5), (2, 5), (1, 3), (2, 3), (3, 9)]])
    pop = popular.popular(df)
    assert [(r.item_id, r.rank) for r in pop.orderBy("rank").collect()] == [(3, 1), (5, 2), (9, 3)]
    users = spark.createDataFrame([(1, "young"), (2, None), (3, "old")], "user_id bigint, age string")
    own = popular.popular_by(df, users)
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id bigint")
    recs = popular.popular_by_recommend(asked, users, own, pop, 3).orderBy("user_id", "rank").collect()
    lists = {u: [r.item_id for r in g] for u, g in itertools.groupby(recs, key=lambda r: r.user_id)}
    assert lists == {1: [3, 5, 9], 2: [3, 5, 9], 3: [9, 3, 5], 4: [3, 5, 9]}


def test_folds_and_cold_filters_agree(spark):
    rng = np.random.default_rng(0)
    pairs = {(int(rng.integers(30)), int(rng.integers(40))) for _ in range(400)}
    df = rows(spark, [(u, i, 50, None, day(int(rng.integers(60)))) for u, i in sorted(pairs)]).cache()
    table = folds.make_folds(df, 10, 3)
    first, last = df.agg(F.min("start_date"), F.max("start_date")).first()
    assert [r.end for r in table.collect()][-1] == last - dt.timedelta(days=10)
    train, test = folds.split(df, table)
    plain = folds.assign_test(df, table)
    step = folds.filter_cold(folds.filter_cold(plain, train, "user_id"), train, "item_id")
    step = folds.filter_seen(step, train)
    key = lambda t: sorted((r.fold, r.user_id, r.item_id) for r in t.collect())
    assert key(test) == key(step)
    assert folds.n_folds(df, 10, 3) == 3
    with pytest.raises(ValueError):
        folds.make_folds(df, 10, 1, start=day(5), end=day(6))


def two_blocks(spark):
    """Users 0-9 read items 0-9, users 10-19 read items 10-19; each skips one of its items."""
    data = [
        (u, i, 80, None, day(0)) for b in (0, 10) for u in range(b, b + 10) for i in range(b, b + 10) if i != u
    ]
    return rows(spark, data)


def in_block(recs):
    first = {r.user_id: r.item_id for r in recs.filter("rank = 1").collect()}
    return len(first) == 20 and all(first[u] == u for u in first)


@pytest.mark.parametrize("weighting", knn.WEIGHTINGS)
def test_neighbours_stay_in_the_block(spark, weighting):
    df = two_blocks(spark)
    assert in_block(knn.knn_recommend(df, df, knn.item_knn(df, weighting), 3))


def test_als_stays_in_the_block(spark):
    df = two_blocks(spark)
    fit = als.als_fit(df, rank=4, reg=0.05, iterations=8, alpha=10.0, seed=1, blocks=2)
    recs = als.als_recommend(fit, df, df, 1)
    assert in_block(recs)
    assert recs.join(df, ["user_id", "item_id"]).count() == 0


def test_hybrid_score_is_the_model_score(spark):
    df = two_blocks(spark).withColumn("target", ((F.col("user_id") + F.col("item_id")) % 2).cast("tinyint"))
    users = spark.createDataFrame([(u, "a" if u < 10 else None, "0") for u in range(20)], "user_id bigint, age string, sex string")
    items = spark.createDataFrame([(i, "x,y" if i % 3 else None) for i in range(20)], "item_id bigint, genres string")
    fit = hybrid.hybrid_fit(df, users, items, factors=3, iterations=3)
    from pyspark.ml.feature import CountVectorizerModel

    pairs = (
        df.select("user_id", "item_id")
        .join(fit.users.withColumnRenamed("tokens", "_ut"), "user_id")
        .join(fit.items.withColumnRenamed("tokens", "_it"), "item_id")
        .withColumn("tokens", F.concat("_ut", "_it"))
    )
    words = CountVectorizerModel.from_vocabulary(fit.vocabulary, inputCol="tokens", outputCol="features")
    wide = words.setBinary(True).transform(pairs)
    model = fit.model.transform(wide).select("user_id", "item_id", vector_to_array("rawPrediction")[1].alias("raw"))
    ids = fit.ids.model.transform(pairs.join(fit.ids.users, "user_id").join(fit.ids.items, "item_id"))
    own = {(r.user_id, r.item_id): r.prediction for r in ids.collect()}
    u = {r.user_id: (np.array(r.vec), r.bias) for r in hybrid.side_vectors(fit, "user").collect()}
    i = {r.item_id: (np.array(r.vec), r.bias) for r in hybrid.side_vectors(fit, "item").collect()}
    for r in model.collect():
        mine = fit.model.intercept + u[r.user_id][1] + i[r.item_id][1] + u[r.user_id][0] @ i[r.item_id][0]
        assert mine == pytest.approx(r.raw + own.get((r.user_id, r.item_id), 0.0), abs=1e-5)
    recs = hybrid.hybrid_recommend(fit, df, df, 4)
    assert recs.join(df, ["user_id", "item_id"]).count() == 0
    with pytest.raises(ValueError):
        hybrid.hybrid_fit(df, users, items, progress="progress")


def test_similarity_is_symmetric_and_bounded(spark):
    rng = np.random.default_rng(5)
    data = [(u, i, float(rng.integers(1, 6))) for u in range(12) for i in range(9) if rng.random() < 0.6]
    df = clean.center_ratings(spark.createDataFrame(data, "user_id long, item_id long, rating double"))
    sim = {(r.item_i, r.item_j): r.sim for r in similarity.item_similarity(df).collect()}
    assert all(abs(v) <= 1 + 1e-9 and sim[(b, a)] == v for (a, b), v in sim.items())
    assert all(sim[(i, i)] == 1.0 for i in {a for a, _ in sim})
    ordered = similarity.top_neighbors(similarity.item_similarity(df)).collect()
    last = {r.item_i: r for r in sorted(ordered, key=lambda r: r["rank"])}
    assert all(r.item_i == r.item_j for r in last.values())


@pytest.fixture(scope="module")
def matrix(spark):
    a = np.random.default_rng(2).standard_normal((40, 5))
    return a, spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(a)], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("center", [True, False])
def test_decomposition_identities(matrix, center):
    a, df = matrix
    fit = linalg.pca if center else linalg.svd
    shifted = a - a.mean(axis=0) if center else a
    values = np.linalg.eigvalsh(shifted.T @ shifted)
    full = fit(df, 5)
    assert full.v.T @ full.v == pytest.approx(np.eye(5), abs=1e-9)
    assert linalg.reconstruction_error(df, linalg.recover(full)).first()[0] == pytest.approx(0, abs=1e-9)
    errors = {r.k: r.error for r in linalg.error_by_rank(df, center=center).collect()}
    for k in (1, 3):
        found = linalg.reconstruction_error(df, linalg.recover(fit(df, k))).first()[0]
        assert found == pytest.approx(values[: 5 - k].sum(), rel=1e-6) == pytest.approx(errors[k], rel=1e-6)


def test_als_trace_reaches_the_svd_error(matrix):
    a, df = matrix
    trace = linalg.als_trace(df, k=2, steps=60).orderBy("step", "side").collect()
    assert trace[-1].error == pytest.approx(np.linalg.eigvalsh(a.T @ a)[:3].sum(), rel=1e-3)


def test_same_result_for_other_partition_counts(spark):
    df = two_blocks(spark)
    results = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        near = knn.item_knn(df, "bm25", k=4)
        results.append(sorted(map(tuple, knn.knn_recommend(df, df, near, 3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_short_lists_are_filled_past_a_long_history(spark):
    pop = spark.createDataFrame([(i, i) for i in range(1, 301)], "item_id bigint, rank bigint")
    seen = spark.createDataFrame([(1, i) for i in range(1, 251)] + [(2, 2)], "user_id bigint, item_id bigint")
    recs = spark.createDataFrame([(1, 252, 1), (2, 9, 1)], "user_id bigint, item_id bigint, rank bigint")
    found = popular.fill_short(recs, seen, pop, seen, 4).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id, r.rank, r.filled) for r in found] == [
        (1, 252, 1, False), (1, 251, 2, True), (1, 253, 3, True), (1, 254, 4, True),
        (2, 9, 1, False), (2, 1, 2, True), (2, 3, 3, True), (2, 4, 4, True),
    ]


def test_pairs_without_one_row_per_side_fail(spark):
    day = dt.date(2020, 1, 1)
    rows = [("a", 1, 5, 1, day, 0.5), ("a", 1, 6, 0, day, 0.25)]
    schema = "pair_id string, group_id bigint, item_id bigint, target int, start_date date, x double"
    good = features.pairwise_set(spark.createDataFrame(rows, schema), ["x"]).collect()
    assert [(r.pos_item, r.neg_item, r.pos_x, r.neg_x) for r in good] == [(5, 6, 0.5, 0.25)]
    bad = spark.createDataFrame([*rows, ("a", 1, 7, 0, day, 0.0)], schema)
    with pytest.raises(Exception, match="not one row per side"):
        features.pairwise_set(bad).collect()


def test_no_fold_in_the_range_is_an_error(spark):
    df = rows(spark, [(1, 1, 50, None, day(d)) for d in range(1, 20)])
    with pytest.raises(ValueError, match="no fold"):
        folds.make_folds(df, 1, 7, start=dt.date(2050, 1, 1))


def test_neighbours_within_any_segment(spark):
    data = [(s, u, i) for s in ("a", "b") for u in range(6) for i in range(4) if (u + i) % 3]
    df = spark.createDataFrame(data, "seg string, user_id bigint, item_id bigint")
    apart = knn.item_knn(df, by=["seg"])
    single = knn.item_knn(df.filter("seg = 'a'").drop("seg"))
    found = apart.filter("seg = 'b'").drop("seg").select(*single.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, single.collect()))


def test_embedding_layers_are_exact(spark):
    rng = np.random.default_rng(3)
    weights = {"w_feat": rng.normal(size=(2, 3)), "b_feat": rng.normal(size=3), "w_hid": rng.normal(size=(7, 5)),
               "b_hid": rng.normal(size=5), "w_out": rng.normal(size=(5, 2))}
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0, 0.0], [1.0, -2.0])], "item_id bigint, vec array<double>, features array<double>")
    found = vectors.embed(df, weights).first().vec
    first = np.array([1.0, -2.0]) @ weights["w_feat"] + weights["b_feat"]
    hidden = np.concatenate([[0.5, -1.0, 2.0, 0.0], first]) @ weights["w_hid"] + weights["b_hid"]
    gelu = [0.5 * h * (1 + math.erf(h / math.sqrt(2))) for h in hidden]
    assert np.allclose(found, np.array(gelu) @ weights["w_out"], atol=1e-6)


def test_hybrid_users_with_equal_features_differ(spark):
    # Two tastes; all users and items have the same features, so only the ids tell them apart.
    data = [(u, i, 1) for u in range(20) for i in range(20) if u % 2 == i % 2 and (u + i) % 8]
    data += [(u, i, 0) for u in range(20) for i in range(20) if u % 2 != i % 2 and (u + i) % 5 == 0]
    samples = spark.createDataFrame(data, "user_id bigint, item_id bigint, target int")
    users = spark.createDataFrame([(u, "x", "y") for u in range(20)], "user_id bigint, age string, sex string")
    items = spark.createDataFrame([(i, "g") for i in range(20)], "item_id bigint, genres string")
    fit = hybrid.hybrid_fit(samples, users, items, factors=2, iterations=5)
    found = [r for r in hybrid.hybrid_recommend(fit, users, samples, 2).collect() if r.rank == 1]
    assert np.mean([r.user_id % 2 == r.item_id % 2 for r in found]) >= 0.9
