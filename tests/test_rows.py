"""Queries without SQL: what their rows must look like."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, FOLDER)


@pytest.mark.parametrize("name", ["x2_pca", "x3_svd", "x4_error_by_rank", "x5_als_trace", "x9_embed", "x10_project"])
def test_rows_without_nulls(spark, name):
    found = rows(spark, name)
    count, *nulls = found.agg(F.count("*"), *(F.count_if(F.col(c).isNull()) for c in found.columns)).first()
    assert count > 0 and (name in ("x4_error_by_rank", "x5_als_trace") or not any(nulls))


def test_network_features_are_flags(spark):
    found = rows(spark, "jobs_network_features").groupBy("side", "id").agg(F.sum("flag").alias("n"), F.max("flag").alias("top"))
    users = found.filter("side = 'user'").agg(F.min("n"), F.max("n")).first()
    assert tuple(users) == (2, 2)  # one age and one sex
    assert found.filter("top > 1 or n = 0").count() == 0


def test_samples_have_negatives_for_every_user(spark):
    found = rows(spark, "jobs_prepare_samples").groupBy("user_id").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    assert found.filter("low <> 0").count() == 0 and found.filter("high = 1").count() > 0


def test_ranker_reports(spark):
    gains = rows(spark, "t6_importance").agg(F.sum("gain"), F.min("gain")).first()
    assert gains[0] == pytest.approx(1.0) and gains[1] >= 0


def test_similar_items_of_factors(spark):
    found = rows(spark, "r7_als_similar_items")
    assert found.filter("item_id = similar_item_id or score > 1.000001").count() == 0
    ranks = found.groupBy("item_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    assert ranks.filter("n <> last or n > 10").count() == 0 and ranks.count() > 0
