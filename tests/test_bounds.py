"""Operators keep all rows however many dates and scenarios there are."""

from pyspark.sql import functions as F

from ledgerloom.operators import borrowing, surveillance


def test_more_than_ten_thousand_scenarios(spark):
    n = 10_050
    scenarios = spark.range(n).select(F.concat(F.lit("S"), "id").alias("scenario_id"), F.lit("ar").alias("collateral_class"), F.lit(0.5).alias("value_multiplier"))
    collateral = spark.createDataFrame([("ar", 10.0, 10.0), ("other", 10.0, 10.0)], "collateral_class string, gross_value double, basis_value double")
    got = borrowing.scenario_collateral(collateral, scenarios).groupBy("collateral_class").agg(F.count("*").alias("n"), F.sum("basis_value").cast("long").alias("v"), F.sum("gross_value").cast("long").alias("g")).collect()
    assert {tuple(r) for r in got} == {("ar", n, 5 * n, 10 * n), ("other", n, 10 * n, 10 * n)}


def test_more_than_ten_thousand_dates(spark):
    n = 10_050
    tape = spark.range(n).select(F.expr("date_add(date'1990-01-01', cast(id as int))").alias("as_of_date"), *[F.lit("x").alias(k) for k in surveillance.KEY])
    indexed = surveillance.with_index(tape)
    assert indexed.count() == n
    assert surveillance.period_pairs(indexed, []).count() == n - 1
