"""Samples of the learned operators: rare languages, very small shares."""

import random

from pyspark.sql import functions as F

from tastemill.llm import language
from tastemill.llm.frames import in_share


def test_rare_languages_are_learned(spark):
    rng = random.Random(15)
    styles = {"aa": ["bor", "ust", "emi"], "bb": ["zyx", "qwo", "vlj"], "cc": ["éta", "çou", "ïne"]}
    kinds = ["aa"] * 3000 + ["bb"] * 30 + ["cc"] * 2
    data = [(i, " ".join("".join(rng.choices(styles[g], k=2)) for _ in range(20)), g) for i, g in enumerate(kinds)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = language.fit(df, sample=20)
    assert model.languages == ["aa", "bb", "cc"]
    found = language.identify(df.filter("lang <> 'aa'"), model).collect()
    assert all(r.lang == r.lang_pred for r in found)


def test_a_large_language_gives_about_its_part(spark, monkeypatch):
    monkeypatch.setattr(language, "FEW", 50)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("bor ust").alias("text"), F.lit("aa").alias("lang"))
    seen = []
    monkeypatch.setattr(language, "in_share", lambda id, share: seen.append(in_share(id, share)) or seen[-1])
    language.fit(df, sample=400)
    n = df.withColumn("id", F.col("doc_id")).withColumn("share", F.lit(0.1)).filter(seen[0]).count()
    assert 330 < n < 470


def test_a_share_is_never_rounded_to_nothing(spark):
    # int(share * 1_000_000) was 0 here.
    n = spark.range(20_000_000).filter(in_share("id", F.lit(4e-7))).count()
    assert 0 < n < 30
    assert spark.range(1000).filter(in_share("id", F.lit(1.0))).count() == 1000
    assert spark.range(1000).filter(in_share("id", F.lit(0.0))).count() == 0
