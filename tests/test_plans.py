"""The plans that matter at scale: pushdown, pruning, no cross product, no Python rows."""

import datetime as dt
import re

import pytest

from tastemill.operators import clean, folds, knn, labels, metrics, popular, similarity
from tastemill.plans import inputs
from tastemill.session import stored

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inter(spark):
    return stored(inputs.interactions(spark, FOLDER))


def test_fold_dates_reach_the_scan(inter):
    made = folds.make_folds(inter, 30, 2)
    text = plan(folds.assign_test(inter, made).select("fold", "user_id"))
    assert "GreaterThanOrEqual(start_date" in text and "LessThan(start_date" in text
    assert "progress" not in text.split("ReadSchema")[-1].split(">")[0]
    assert "Join" not in text


def test_input_reads_only_its_columns(spark):
    text = plan(inputs.inter_raw(spark, FOLDER).select("user_id", "item_id"))
    assert "l_quantity" not in text and "l_shipdate" not in text and "o_totalprice" not in text


def test_no_cross_product_and_no_python(spark, inter):
    users = inputs.users(spark, FOLDER)
    made = folds.make_folds(inter, 30, 2)
    train, test = folds.split(inter, made)
    pop = popular.popular(inter)
    near = knn.item_knn(inter, "tfidf")
    rated = clean.center_ratings(inter.filter("rating is not null"))
    frames = [
        train,
        test,
        labels.label(inter, labels.user_stats(inter)),
        popular.popular_recommend(inter, pop, 10),
        popular.popular_by_recommend(inter, users, popular.popular_by(inter, users), pop, 10),
        knn.knn_recommend(inter, inter, near, 10),
        similarity.item_similarity(rated),
        metrics.compute_metrics(test, popular.popular_recommend(test, pop, 10), 5),
        folds.fold_stats(inter, made, labels=False),
    ]
    for frame in frames:
        text = plan(frame)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in text


def test_holdout_is_two_filters(inter):
    for part in folds.holdout(inter, dt.date(2000, 1, 1), dt.date(2001, 1, 1)):
        text = plan(part)
        assert "Exchange" not in text and "PushedFilters: [IsNotNull(start_date)" in text


def test_no_shuffle_on_folds_alone(spark, inter):
    """With broadcasts by size off, nothing is dealt by the fold alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = folds.make_folds(inter, 30, 2)
        train, test = folds.split(inter, made)
        text = plan(popular.popular_recommend(test, popular.popular(train, by=["fold"]), 10, ["fold"]))
        text += plan(knn.knn_weights(train, "bm25", by=["fold"]))
        keys = re.findall(r"SortMergeJoin \[([^\]]*)\]", text)
        assert all(re.sub(r"#\d+L?", "", k) != "fold" for k in keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_all_items_is_no_cross_product(spark, inter):
    from tastemill.operators import als

    text = plan(als.als_recommend(als.als_fit(inter, rank=2, iterations=1), inter, inter, 5))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
