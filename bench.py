"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tastemill.operators import knn, labels, metrics, popular, similarity
from tastemill.operators.clean import center_ratings, filter_noise
from tastemill.operators.folds import fold_stats, split
from tastemill.plans import inputs
from tastemill.plans.catalog_data import main_folds
from tastemill.schema import FOLD
from tastemill.session import build_session, stored, temporary


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = {}

    def b1():
        base["inter"] = stored(inputs.interactions(spark, folder))
        base["clean"] = stored(filter_noise(base["inter"]))

    def b2():
        noop(fold_stats(base["clean"], main_folds(base["clean"])))

    def b3():
        train, test = split(base["clean"], main_folds(base["clean"]))
        recs = popular.popular_recommend(test, popular.popular(train, by=[FOLD]), 10, [FOLD])
        noop(metrics.compute_metrics(test, recs, 10, by=[FOLD]))

    def b4():
        rated = center_ratings(base["inter"].filter("rating is not null"))
        noop(similarity.top_neighbors(similarity.item_similarity(rated, diagonal=False, best=10), 10))

    def b5():
        near = knn.item_knn(base["inter"], "bm25")
        noop(knn.knn_recommend(base["inter"], base["inter"], near, 10))

    def b6():
        marked = stored(labels.label(base["inter"], labels.user_stats(base["inter"])))
        liked = stored(labels.select_pos(marked))
        near = stored(knn.item_knn(liked, "bm25"))
        noop(labels.build_samples(marked, lambda users: knn.knn_recommend(users, liked, near, 20)))

    # Start the session's threads, code generation and Python workers before anything is timed.
    noop(spark.range(100_000).groupBy("id").count())

    jobs = {
        "b1_clean": b1,
        "b2_folds": b2,
        "b3_popular_cv": b3,
        "b4_similarity": b4,
        "b5_bm25": b5,
        "b6_samples": b6,
    }
    spent = {}
    for name, job in jobs.items():
        start = time.time()
        if name == "b1_clean":  # later jobs read what it stores
            job()
        else:
            with temporary(spark):
                job()
        spent[name] = round(time.time() - start, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
