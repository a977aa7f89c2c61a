"""Whole jobs: cross-validation, sample preparation, two-stage ranking, item-to-item lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.operators import als, clean, features, hybrid, knn, metrics, popular, ranking, similarity
from tastemill.operators.folds import (
    make_folds,
    quantile_split,
    restrict_features,
    split,
)
from tastemill.operators.labels import MASKED, build_samples, label, label_prefixes, select_pos, user_stats
from tastemill.schema import FOLD, ITEM, RANK, USER
from tastemill.session import prepare, stored

COUNT_MODELS = ("popular", "popular_by_age", *knn.WEIGHTINGS)


@dataclass(frozen=True)
class Folds:
    folds: DataFrame
    train: DataFrame
    test: DataFrame


def labelled_folds(
    df: DataFrame, interval_days: int, folds: int, start=None, rule: str = "fixed"
) -> Folds:
    """Train and test rows of all folds, labelled with the train statistics of their fold."""
    prepare(df.sparkSession)
    df = stored(df)
    table = make_folds(df, interval_days, folds, start)
    train, test = split(df, table)
    starts = [(r[FOLD], r["start"]) for r in table.collect()]
    if len(starts) <= MASKED:
        rows, stats = label_prefixes(df, starts, rule)
        return Folds(table, rows, stored(label(test, stats, rule, by=[FOLD])))
    stats = stored(user_stats(train, by=[FOLD]))
    return Folds(
        table,
        stored(label(train, stats, rule, by=[FOLD])),
        stored(label(test, stats, rule, by=[FOLD])),
    )


def _recommend(model: str, train: DataFrame, truth: DataFrame, users: DataFrame, k: int, by: list[str]):
    if model == "popular":
        return popular.popular_recommend(truth, popular.popular(train, by=by), k, by)
    if model == "popular_by_age":
        lists = popular.popular_by(train, users, by=by)
        return popular.popular_by_recommend(truth, users, lists, popular.popular(train, by=by), k, by=by)
    neighbors = knn.item_knn(train, model, by=by)
    return knn.knn_recommend(truth, select_pos(train), neighbors, k, by=by)


def cross_validate(
    df: DataFrame,
    users: DataFrame,
    items: DataFrame,
    model: str,
    interval_days: int,
    folds: int,
    k: int = 10,
    start=None,
    separate_k: bool = False,
    made: Folds | None = None,
    parallelism: int = 3,
    **params,
) -> DataFrame:
    """Metrics per fold: name[, k], value, model, start_date, end_date, fold.

    Count-based models fit all folds in one plan with the fold as a key. ALS and the hybrid model
    are iterative and of many short stages, so `parallelism` folds are fitted at a time. `made`
    takes folds that are there already.
    """
    made = made or labelled_folds(df, interval_days, folds, start)
    truth = select_pos(made.test)
    if model in COUNT_MODELS:
        recs = _recommend(model, made.train, truth, users, k, [FOLD])
        scores = metrics.compute_metrics(truth, recs, k, separate_k, by=[FOLD])
    elif model in ("als", "hybrid"):
        numbers = sorted(r[FOLD] for r in made.folds.collect())
        if not numbers:
            raise ValueError("no rows, so no folds")

        def run(number: int) -> DataFrame:
            train = made.train.filter(F.col(FOLD) == number).drop(FOLD)
            wanted = truth.filter(F.col(FOLD) == number).drop(FOLD)
            if model == "als":
                fit = als.als_fit(train, **params)
                recs = als.als_recommend(fit, wanted, select_pos(train), k)
            else:
                fit = hybrid.hybrid_fit(
                    train,
                    restrict_features(users, train, USER),
                    restrict_features(items, train, ITEM),
                    **params,
                )
                recs = hybrid.hybrid_recommend(fit, wanted, train, k)
            part = metrics.compute_metrics(wanted, recs, k, separate_k)
            # Written here: the lists are scored inside the thread, and their shuffles go with it.
            return stored(part.withColumn(FOLD, F.lit(number)))

        with ThreadPool(max(1, min(parallelism, len(numbers)))) as pool:
            parts = pool.map(inheritable_thread_target(df.sparkSession)(run), numbers, chunksize=1)
        scores = parts[0]
        for part in parts[1:]:
            scores = scores.unionByName(part)
    else:
        raise ValueError(f"unknown model {model!r}")
    names = [c for c in ("name", "k", "value") if c in scores.columns]
    return scores.join(made.folds, FOLD).select(
        *names,
        F.lit(model).alias("model"),
        F.col("start").alias("start_date"),
        F.col("end").alias("end_date"),
        F.col(FOLD).cast("smallint").alias(FOLD),
    )


def parameter_search(
    df: DataFrame,
    users: DataFrame,
    items: DataFrame,
    model: str,
    choices: Sequence[dict],
    interval_days: int,
    folds: int,
    k: int = 10,
    start=None,
) -> list[tuple[float, dict]]:
    """Mean MAP@k of each parameter set, best first. The folds are built once for all of them."""
    made = labelled_folds(df, interval_days, folds, start)
    found = []
    for params in choices:
        scores = cross_validate(df, users, items, model, interval_days, folds, k, made=made, **params)
        found.append((metrics.mean_map(scores, k).first()[0], params))
    return sorted(found, key=lambda pair: -(pair[0] or 0.0))


@dataclass(frozen=True)
class Prepared:
    samples: DataFrame
    test: DataFrame
    users: DataFrame
    items: DataFrame


def prepare_samples(
    df: DataFrame,
    users: DataFrame,
    items: DataFrame,
    interval_days: int = 7,
    k: int = 20,
    cov: float = 0.95,
) -> Prepared:
    """Training samples with guaranteed negatives, the test set, and the features both need."""
    prepare(df.sparkSession)
    users = clean.fill_user_features(users)
    items = clean.select_genres(items, cov, "unknown")
    known = clean.filter_noise(clean.restrict_to_known(df, users, items))
    made = labelled_folds(known, interval_days, 1)
    train, test = made.train.drop(FOLD), select_pos(made.test.drop(FOLD))
    positives = select_pos(train)
    neighbors = knn.item_knn(positives, "bm25")
    samples = stored(
        build_samples(train, lambda lacking: knn.knn_recommend(lacking, positives, neighbors, k))
    )
    keys = samples.select(USER, ITEM).unionByName(test.select(USER, ITEM))
    return Prepared(
        samples,
        test,
        restrict_features(users, keys, USER),
        restrict_features(items, keys, ITEM),
    )


def network_features(prepared: Prepared) -> tuple[DataFrame, DataFrame]:
    """One-hot users and multi-hot items."""
    return (
        features.one_hot(prepared.users.select(USER, "age", "sex"), ["age", "sex"]),
        features.genre_matrix(prepared.items),
    )


def two_stage(
    df: DataFrame,
    users: DataFrame,
    items: DataFrame,
    interval_days: int = 7,
    train_candidates: int = 50,
    candidates: int = 200,
    k: int = 10,
    trees: int = 20,
    **als_params,
) -> DataFrame:
    """Metrics of ALS alone and of ALS re-ranked by boosted trees, on the last interval."""
    prepare(df.sparkSession)
    known = stored(clean.filter_noise(clean.restrict_to_known(df, users, items)))
    folds = make_folds(known, interval_days, 1)
    train, test = split(known, folds)
    early, late = (stored(part) for part in quantile_split(train.drop(FOLD), 0.6))
    fit, cands = ranking.stage_one(early, late, train_candidates, **als_params)
    # Candidates are read for positives and for negatives, samples for every tree.
    samples = stored(ranking.ranker_samples(stored(cands), late, users, items))
    model = ranking.fit_ranker(samples, iterations=trees)
    truth = test.drop(FOLD).join(early.select(USER).distinct(), USER, "left_semi")
    first = stored(als.als_recommend(fit, truth, early, candidates).select(USER, ITEM, RANK))
    scored = ranking.score(model, ranking.with_features(first, users, items))
    second = ranking.rerank(scored)
    return ranking.two_stage_report(first, second, truth, k)


def item_to_item(
    ratings: DataFrame,
    items: DataFrame,
    min_support: int = 0,
    k: int | None = None,
    n: int = 30,
    score: str = "centered",
) -> DataFrame:
    """Top n items for every user by similarity to the rated history."""
    prepare(ratings.sparkSession)
    history = stored(clean.center_ratings(stored(ratings)))
    sim = stored(similarity.item_similarity(history, min_support=min_support, diagonal=False))
    near = similarity.top_neighbors(sim, k) if k is not None else sim
    cands = similarity.candidates(history, near)
    return similarity.topn_items(similarity.predict_ratings(cands, history, sim, score), items, n)


__all__ = [
    "COUNT_MODELS",
    "cross_validate",
    "item_to_item",
    "labelled_folds",
    "network_features",
    "parameter_search",
    "prepare_samples",
    "two_stage",
]
