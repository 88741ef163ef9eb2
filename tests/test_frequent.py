"""Frequent values by bounded counters equal the exact ones, whether the bound proves them or not."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quality


@pytest.mark.parametrize("counters", [3, 20, 4096])
def test_equal_to_exact_counts(spark, counters):
    rng = random.Random(1)
    skewed = lambda: rng.choice(["a"] * 40 + ["b"] * 20 + ["c"] * 9 + [f"x{rng.randrange(400)}"] * 30)
    rows = [(skewed(), f"id{i}", rng.choice(["t", "u", None]), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "many string, id string, few string, none string").repartition(6)
    got = quality.frequent_values(df, df.columns, 3, counters)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in quality.top_values(df, df.columns, 3).collect())


def test_what_is_shuffled_is_bounded_and_nothing_is_fine(spark, monkeypatch):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("often")).otherwise(F.col("id").cast("string")).alias("v"))
    assert [tuple(r)[:4] for r in quality.frequent_values(df, ["v"], 1, 50).collect()] == [("v", 1, "often", 13333)]
    assert quality.frequent_values(df.limit(0), ["v"], 2).count() == 0
    monkeypatch.setattr(quality, "CANDIDATES", 0)
    assert quality.frequent_values(df, ["v"], 1, 50).first().n == 13333
