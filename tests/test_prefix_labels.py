"""Labels of all folds at once against the labels of train sets written out per fold."""

import datetime as dt
import random

import pytest

from tastemill.operators import folds, labels
from tastemill.plans import jobs
from tastemill.session import stored

START = dt.date(2020, 1, 1)


@pytest.mark.parametrize("rule", ["fixed", "user_mean"])
def test_same_labels_as_fold_by_fold(spark, rule):
    rng = random.Random(2)
    rows = []
    for u in [None, *range(25)]:
        for i in rng.sample(range(40), rng.randint(1, 14)):
            rated = None if rng.random() < 0.5 else float(rng.randint(1, 5))
            progress = None if rng.random() < 0.1 else rng.choice([1, 5, 9, 10, 50])
            rows.append((u, i, START + dt.timedelta(days=rng.randint(0, 99)), progress, rated))
    rows.append((1, 41, None, 5, 1.0))
    df = stored(spark.createDataFrame(rows, "user_id bigint, item_id bigint, start_date date, progress int, rating double"))
    made = jobs.labelled_folds(df, 10, 4, rule=rule)
    train, test = folds.split(df, folds.make_folds(df, 10, 4))
    stats = stored(labels.user_stats(train, by=["fold"]))
    names = ["fold", "user_id", "item_id", "start_date", "progress", "rating", "target"]
    for found, part in ((made.train, train), (made.test, test)):
        wanted = labels.label(part, stats, rule, by=["fold"])
        assert dict(found.dtypes) == dict(wanted.dtypes)
        a, b = (sorted(map(str, f.select(names).collect())) for f in (found, wanted))
        assert a == b and a
    # Stored is a row, not a row per fold.
    assert "Generate" in made.train._jdf.queryExecution().executedPlan().toString()


def test_triplets_read_their_samples_once(spark):
    """The samples are written first: the plan of the triplets does not work them out again."""
    rows = [(u, i, int(i % 3 > 0)) for u in range(5) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int").groupBy("user_id", "item_id").agg({"target": "max"})
    made = labels.make_triplets(df.withColumnRenamed("max(target)", "target"))
    assert "max(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 5 * 4
