"""From raw cells to published ones: availability, coverage, small-cell suppression with complements, hashes, projection, sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import population_hash

REASONS = ("no_records", "missing_required_field", "division_by_zero", "available")


def cells_of(rows: DataFrame, by: list[str], token: str, in_numerator: Column, in_denominator: Column, num: Column, den: Column) -> DataFrame:
    """Sums and *distinct* population sizes per cell: denominator, numerator and complement. Sizes are exact counts of distinct
    tokens, never sets of them; hashes of the populations are additive."""
    flagged = rows.groupBy(*by, token).agg(F.max(in_numerator).alias("__n"), F.max(in_denominator).alias("__d"), F.sum(num).alias("__num"), F.sum(den).alias("__den"))
    n, d = F.coalesce("__n", F.lit(False)), F.coalesce("__d", F.lit(False))
    return flagged.groupBy(*by).agg(
        F.sum("__num").cast("decimal(38,2)").alias("numerator"),
        F.sum("__den").cast("decimal(38,2)").alias("denominator"),
        F.sum(d.cast("long")).alias("denominator_population"),
        F.sum(n.cast("long")).alias("numerator_population"),
        F.sum((d & ~n).cast("long")).alias("complement_population"),
        population_hash(F.when(d, F.col(token))).alias("denominator_hash"),
        population_hash(F.when(n, F.col(token))).alias("numerator_hash"),
    )


def availability(eligible: Column, missing: Column, denominator: Column, null_policy: str = "exclude") -> Column:
    """The first that holds: no records, a missing required field (if the policy says so), a zero denominator."""
    blocked = missing if null_policy == "unavailable" else F.lit(False)
    return F.when(eligible == 0, "no_records").when(blocked, "missing_required_field").when(F.coalesce(denominator, F.lit(0)) == 0, "division_by_zero").otherwise("available")


def with_coverage(cells: DataFrame, least_ratio: float = 0.0, least_records: int = 0) -> DataFrame:
    """Adds coverage (observed / eligible) and turns available cells under either bound to insufficient_coverage."""
    share = F.when(F.col("eligible") > 0, F.col("observed").cast("double") / F.col("eligible").cast("double"))
    thin = (F.coalesce(share, F.lit(0.0)) < least_ratio) | (F.col("observed") < least_records)
    return cells.withColumn("coverage", share).withColumn("availability", F.when((F.col("availability") == "available") & thin, "insufficient_coverage").otherwise(F.col("availability")))


def suppress_grouped(cells: DataFrame, group: list[str], key: list[str], least: int, least_denominator: int | None = None) -> DataFrame:
    """Primary: a denominator under its least (``least``, if not given), a numerator (if any) or a complement (if any) under ``least``. Complementary: in a group with
    exactly one suppressed cell, also the not suppressed, not empty cell with the smallest numerator population."""
    small = lambda c: (F.col(c) > 0) & (F.col(c) < least)
    primary = (F.col("denominator_population") < (least if least_denominator is None else least_denominator)) | small("numerator_population") | small("complement_population")
    marked = cells.withColumn("__p", primary)
    whole = Window.partitionBy(*group)
    candidate = ~F.col("__p") & (F.col("numerator_population") > 0)
    ranked = marked.withColumn("__c", candidate).withColumn("__n", F.sum(F.col("__p").cast("int")).over(whole))
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__c").orderBy("numerator_population", *key)))
    return ranked.withColumn("suppressed", F.col("__p") | ((F.col("__n") == 1) & F.col("__c") & (F.col("__rank") == 1))).drop("__p", "__c", "__n", "__rank")


def publish(cells: DataFrame, hide: list[str]) -> DataFrame:
    """Null the figures, the counts of coverage too, of suppressed cells, and the values of unavailable ones."""
    out = cells
    for c in hide:
        shown = ~F.col("suppressed") & (F.col("availability") == "available") if c == "value" else ~F.col("suppressed")
        out = out.withColumn(c, F.when(shown, F.col(c)))
    return out.withColumn("availability", F.when(F.col("suppressed"), "suppressed").otherwise(F.col("availability")))


def cell_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def unavailable_cell(spark: SparkSession, metric: str, reason: str) -> DataFrame:
    """One cell in place of a metric that can't be computed, for instance without a prior period."""
    return spark.range(1).select(F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(reason).alias("availability"), F.lit(False).alias("suppressed"))


def project_metric(cells: DataFrame, metric: str, selectors: dict[str, str], date_key: str = "as_of_date") -> DataFrame:
    """The points of one series: available, not suppressed cells with exactly these dimensions besides the date."""
    picked = cells.where(F.col("metric") == metric)
    for k, v in selectors.items():
        picked = picked.where(F.element_at("dimensions", k) == v)
    exact = F.size("dimensions") == len(selectors) + 1
    ok = exact & (F.col("availability") == "available") & ~F.col("suppressed")
    return picked.where(ok).select(F.lit(metric).alias("metric_id"), F.element_at("dimensions", date_key).cast("date").alias("as_of_date"), "value")


def accounting(cells: DataFrame) -> DataFrame:
    """Rows, metrics, suppressed and unavailable cells of a result and, if it has denominator_hash, its distinct populations and one
    hash of them all."""
    found = [F.count("*").alias("cells"), F.count_distinct("metric").alias("metrics"), F.sum(F.col("suppressed").cast("long")).alias("suppressed"), F.sum((F.col("availability") != "available").cast("long")).alias("unavailable")]
    whole = cells.agg(*found)
    if "denominator_hash" not in cells.columns:
        return whole
    each = cells.select("denominator_hash").distinct()
    return whole.crossJoin(each.agg(F.count("denominator_hash").alias("populations"), population_hash(F.col("denominator_hash")).alias("populations_hash")))
