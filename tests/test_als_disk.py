"""ALS drops the shuffles of an iteration when the next one is there."""

from pyspark.sql import functions as F

from tastemill.operators import als


def test_shuffles_do_not_pile_up(spark, monkeypatch):
    """With a checkpoint in every fifth iteration none of the first four dropped a shuffle."""
    rows = [(u, i) for u in range(12) for i in range(10) if (u + i) % 3]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint").withColumn("target", F.lit(1))
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    left = []
    plain = als.ALS.fit

    def fit(self, data):
        before = tracker.shuffleStatuses().size()
        model = plain(self, data)
        left.append(tracker.shuffleStatuses().size() - before)
        return model

    monkeypatch.setattr(als.ALS, "fit", fit)
    fitted = als.als_fit(df, rank=3, iterations=4, blocks=2)
    assert fitted.model.userFactors.count() == 12 and fitted.model.itemFactors.count() == 10
    assert left[0] < 8


def test_blocks_grow_with_the_data(spark, monkeypatch):
    """Ten blocks at any size gave a task the factors of nearly all ids: 7,200,000 at 360 times sf0.1."""
    assert als.block_number(0, 0, 0, 64) == als.block_number(35_400_000, 900_000, 1_200_000, 64) == 10
    assert 100 < als.block_number(212_400_000, 5_400_000, 7_200_000, 64) < 250
    monkeypatch.setattr(als, "RECEIVED", 1)
    monkeypatch.setattr(als, "BLOCKS", 2)
    asked, plain = [], als.ALS.fit

    def fit(self, data):
        asked.append((self.getNumUserBlocks(), self.getNumItemBlocks()))
        return plain(self, data)

    monkeypatch.setattr(als.ALS, "fit", fit)
    rows = [(u, i, 1) for u in range(12) for i in range(10) if (u + i) % 3]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, target int")
    fitted = als.als_fit(df, rank=32, iterations=1)
    assert asked[0][0] == asked[0][1] > 2
    assert fitted.model.userFactors.count() == 12 and fitted.model.itemFactors.count() == 10
