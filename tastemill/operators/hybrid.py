"""Hybrid recommender: factors of ids from ALS, and a factorization machine over user and item features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.expressions import quantize
from tastemill.operators.als import AlsFit, als_fit
from tastemill.operators.als import factors as als_factors
from tastemill.operators.features import feature_lists
from tastemill.operators.search import topk
from tastemill.schema import ITEM, TARGET, USER
from tastemill.session import stored


#: Samples that a task of the factorization machine reads in each iteration (about 200 bytes each in memory).
SAMPLES = 1 << 18
#: Bytes of their row groups, which a scan cannot divide.
ROW_GROUP = 1 << 21


@dataclass(frozen=True)
class HybridFit:
    model: FMClassificationModel
    vocabulary: list[str]
    ids: AlsFit
    users: DataFrame  # user_id, tokens
    items: DataFrame  # item_id, tokens


def _tokens(lists: DataFrame, key: str, side: str) -> DataFrame:
    """The features of an entity, marked with their side."""
    marked = F.transform("features", lambda f: F.concat(F.lit(f"{side}="), f))
    return lists.select(key, F.array_distinct(marked).alias("tokens"))


def _spread(rows: DataFrame) -> DataFrame:
    """A stored frame, read in tasks of about SAMPLES rows: few bytes may hold many, since features recur."""
    spark = rows.sparkSession
    parts = -(-rows.count() // SAMPLES)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows
    # A session of its own: the setting holds for this scan only.
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", parts)
    own.conf.set("spark.sql.files.openCostInBytes", ROW_GROUP // 4)
    return own.read.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])


def hybrid_fit(
    samples: DataFrame,
    users: DataFrame,
    items: DataFrame,
    factors: int = 16,
    iterations: int = 12,
    step: float = 0.11,
    progress: str | None = None,
    pos_neg: str | None = TARGET,
    quant: int = 5,
    reg: float = 0.1,
    seed: int = 0,
) -> HybridFit:
    """Fit on labelled (user, item) samples.

    The label is `pos_neg` > 0, or quantised `progress` > 0; the two exclude each other. What users and items share
    (age, sex, genres) goes to a factorization machine with one place for each feature that occurs, so the model on
    the driver grows with the number of features only. What is theirs alone goes to ALS over the positive samples,
    whose factors stay in tables; there quantised progress, if it is given, is the weight of a sample.
    """
    if progress is not None and pos_neg is not None:
        raise ValueError("use either progress or pos_neg, not both")
    if progress is None and pos_neg is None:
        raise ValueError("one of progress and pos_neg is needed")
    if pos_neg is not None:
        label: Column = (F.col(pos_neg) > 0).cast("double")
    else:
        label = (quantize(progress, quant) > 0).cast("double")
    user_lists, item_lists = feature_lists(users, items)
    u, i = _tokens(user_lists, USER, "u"), _tokens(item_lists, ITEM, "i")
    marked = stored(samples.withColumn("_label", label))
    tokens = u.select("tokens").unionByName(i.select("tokens"))
    size = tokens.select(F.explode("tokens")).distinct().count()
    words = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=max(1, size), binary=True).fit(tokens)
    rows = (
        marked.select(USER, ITEM, F.col("_label").alias("label"))
        .join(u.withColumnRenamed("tokens", "_ut"), USER)
        .join(i.withColumnRenamed("tokens", "_it"), ITEM)
        .select("label", F.concat("_ut", "_it").alias("tokens"))
    )
    fm = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=step, solver="adamW", seed=seed)
    # Every iteration reads the samples.
    model = fm.fit(_spread(stored(words.transform(rows).select("features", "label"), **{"parquet.block.size": ROW_GROUP})))
    positive = marked.filter("_label > 0").drop("_label")
    ids = als_fit(positive, rank=factors, reg=reg, iterations=iterations, weight=progress, quant=quant, seed=seed)
    return HybridFit(model, words.vocabulary, ids, u, i)


def side_vectors(fit: HybridFit, side: str, keys: DataFrame | None = None) -> DataFrame:
    """(id, vec, bias) of users or items: the score of a pair is bias_u + bias_i + vec_u . vec_i.

    A vector is the sum of the features' factors, followed by the id's own factors (zeros if ALS has not seen it).
    """
    key = USER if side == "user" else ITEM
    table = fit.users if side == "user" else fit.items
    if keys is not None:
        table = table.join(keys.select(key).distinct(), key, "left_semi")
    rows = table.join(als_factors(fit.ids, side).withColumnRenamed("vec", "_own"), key, "left")
    # One row of factors for each feature, see hybrid_fit.
    places = {token: n for n, token in enumerate(fit.vocabulary)}
    factors, linear = fit.model.factors.toArray(), fit.model.linear.toArray()
    width = fit.ids.model.rank

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vecs, biases = [], []
            for tokens, own in zip(batch["tokens"], batch["_own"]):
                at = [places[t] for t in tokens if t in places]
                f = factors[at]
                total = f.sum(axis=0)
                vecs.append(np.concatenate([total, np.zeros(width) if own is None else own]))
                biases.append(linear[at].sum() + 0.5 * (total @ total - (f * f).sum()))
            yield pd.DataFrame({key: batch[key], "vec": vecs, "bias": np.array(biases)})

    return rows.select(key, "tokens", "_own").mapInPandas(run, f"{key} bigint, vec array<double>, bias double")


def hybrid_recommend(
    fit: HybridFit, users: DataFrame, seen: DataFrame | None, k: int = 10, items: DataFrame | None = None
) -> DataFrame:
    """Score all items for the given users, leave the seen ones out, rank the k best."""
    left = side_vectors(fit, "user", users).select(USER, "vec")
    right = side_vectors(fit, "item", items)
    return topk(left, right, k, seen)
