"""The factorization machine reads bounded parts, and folds of iterative models are fitted at the same time."""

import datetime as dt
import random
import threading

from pyspark.ml.classification import FMClassifier

from tastemill.operators import hybrid
from tastemill.plans import jobs


def test_samples_are_read_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "SAMPLES", 1000, raising=False)
    monkeypatch.setattr(hybrid, "ROW_GROUP", 4096, raising=False)
    parts, fit = [], FMClassifier.fit

    def spied(self, rows, *more):
        parts.extend(rows.select("label").rdd.glom().map(len).collect())
        return fit(self, rows, *more)

    monkeypatch.setattr(FMClassifier, "fit", spied)
    samples = spark.range(40_000).selectExpr("id % 200 as user_id", "id div 200 as item_id", "cast(id % 3 > 0 as int) as target")
    users = spark.range(200).selectExpr("id as user_id", "cast(id % 5 as string) as age", "cast(id % 2 as string) as sex")
    items = spark.range(200).selectExpr("id as item_id", "concat('a', id % 7, ',b', id % 3) as genres")
    made = hybrid.hybrid_fit(samples, users, items, factors=2, iterations=1)
    assert sum(parts) == 40_000 and len([p for p in parts if p]) > 8 and max(parts) < 4000
    assert len(made.vocabulary) == 5 + 7 + 3


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    meet, fit = threading.Barrier(2, timeout=30), jobs.als.als_fit

    def met(train, **params):
        meet.wait()
        return fit(train, **params)

    monkeypatch.setattr(jobs.als, "als_fit", met)
    rng = random.Random(2)
    rows = [(u, i, 50, 4.0, dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(60))) for u in range(30) for i in rng.sample(range(25), 12)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, progress int, rating double, start_date date")
    found = jobs.cross_validate(df, None, None, "als", 5, 2, 5, rank=4, iterations=2).collect()
    assert sorted({r.fold for r in found}) == [1, 2] and len({(r.fold, r.name, r.asDict().get("k")) for r in found}) == len(found)
