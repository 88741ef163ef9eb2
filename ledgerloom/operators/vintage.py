"""Vintage curves by cohort and month on book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cohort, months_between_calendar, nz, ratio, total


def observations(tape: DataFrame, grain: str, max_mob: int, key: list[str]) -> DataFrame:
    """The latest row of each loan and month on book, from 0 to ``max_mob``."""
    rows = tape.withColumn("cohort", cohort("origination_date", grain)).withColumn("mob", months_between_calendar("origination_date", "as_of_date"))
    inside = rows.where((F.col("mob") >= 0) & (F.col("mob") <= max_mob))
    latest = Window.partitionBy(*key, "mob").orderBy(F.col("as_of_date").desc())
    return inside.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn")


def conflicts(tape: DataFrame, key: list[str]) -> DataFrame:
    """Must be empty: loans whose origination or original balance changes, or with two different rows of one date."""
    moved = tape.groupBy(*key).agg(F.count_distinct("origination_date").alias("dates"), F.count_distinct("original_balance").alias("originals")).where("dates > 1 or originals > 1")
    twice = tape.groupBy(*key, "as_of_date").agg(F.count_distinct(F.to_json(F.struct("*"))).alias("n")).where("n > 1")
    return moved.select(*key).union(twice.select(*key)).distinct()


def refused(tape: DataFrame, key: list[str]) -> DataFrame:
    """The tape, which ends the run where ``conflicts`` has a row. Adds of each row its month on book (``mob``), whether it is the loan's
    latest of that month (``newest``) and of all (``only``), and the loan's first origination and greatest original balance (``o``,
    ``b``): one shuffle and one sort by loan and date serve all of it. Months go with dates, as a loan has one origination here."""
    loan = Window.partitionBy(*key)
    back = loan.orderBy(F.col("as_of_date").desc())
    moved = ~F.min("origination_date").over(loan).eqNullSafe(F.max("origination_date").over(loan)) | ~F.min("original_balance").over(loan).eqNullSafe(F.max("original_balance").over(loan))
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(tape.columns)])
    twice = F.lag("as_of_date").over(back).eqNullSafe(F.col("as_of_date")) & (F.lag("__row").over(back) != F.col("__row"))
    later = F.last("mob", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    more = {"newest": ~later.eqNullSafe(F.col("mob")), "only": F.row_number().over(back) == 1, "o": F.min("origination_date").over(loan), "b": F.max("original_balance").over(loan)}
    why = F.when(moved, "a loan's origination or original balance changes").when(twice, "a loan has two different rows of one date")
    marked = tape.withColumns({"__row": content, "mob": months_between_calendar("origination_date", "as_of_date")}).withColumns(more | {"__why": why})
    return marked.where(F.when(F.col("__why").isNotNull(), F.raise_error(F.col("__why")).cast("boolean")).otherwise(F.lit(True))).drop("__row", "__why")


def vintage(tape: DataFrame, key: list[str], as_of: Column, grain: str = "month", max_mob: int = 12, dpd_threshold: int = 30, strict: bool = False) -> DataFrame:
    """A dense grid of cohorts and months on book: loans, observed loans, original and current balance, factor, net loss and
    rate, delinquent balance and rate. Points that can't have been seen by ``as_of`` or that nobody reported are null.

    ``strict``: contradictory rows end the run. Denominators are fixed per cohort: every loan once, by its original balance. The grid is cohorts times months, so it is
    joined on the aggregated side only.
    """
    if strict:
        tape = refused(tape, key)
        seen = tape.where(f"newest AND mob BETWEEN 0 AND {int(max_mob)}").withColumn("cohort", cohort("origination_date", grain))
        loans = tape.where("only")
    else:
        seen = observations(tape, grain, max_mob, key)
        loans = tape.groupBy(*key).agg(F.min("origination_date").alias("o"), F.max("original_balance").alias("b"))
    cohorts = loans.groupBy(cohort("o", grain).alias("cohort")).agg(F.count("*").alias("loans"), total("b").alias("original"))
    late = F.col("days_past_due") >= dpd_threshold
    points = seen.groupBy("cohort", "mob").agg(
        F.count("*").alias("observed"),
        total("outstanding_balance").alias("current"),
        total(nz("charge_off_amount") - nz("recovery_amount")).alias("net_loss"),
        total(F.when(late, F.col("outstanding_balance")).otherwise(0)).alias("delinquent"),
    )
    grid = cohorts.withColumn("mob", F.explode(F.sequence(F.lit(0), F.lit(max_mob))))
    seasoned = F.col("mob") <= months_between_calendar("cohort", as_of)
    shown = lambda c: F.when(F.col("seasoned"), F.col(c))
    joined = grid.join(points, ["cohort", "mob"], "left").withColumn("seasoned", seasoned)
    return joined.select(
        "cohort",
        "mob",
        "loans",
        "original",
        "seasoned",
        shown("observed").alias("observed"),
        shown("current").alias("current"),
        F.when(F.col("seasoned"), ratio("current", "original")).alias("factor"),
        shown("net_loss").alias("net_loss"),
        F.when(F.col("seasoned"), ratio("net_loss", "original")).alias("loss_rate"),
        shown("delinquent").alias("delinquent"),
        F.when(F.col("seasoned"), ratio("delinquent", "current")).alias("delinquency_rate"),
    )


def vintage_live(tape: DataFrame, grain: str = "month", max_mob: int = 12, least: int = 1) -> DataFrame:
    """The older form: the denominator is the sum of the largest original balance of each loan; only observed points; points of
    cohorts under ``least`` are hidden."""
    rows = observations(tape, grain, max_mob, ["loan_id"])
    loans = tape.groupBy("loan_id").agg(F.max("original_balance").alias("b"), F.min(cohort("origination_date", grain)).alias("cohort"))
    cohorts = loans.groupBy("cohort").agg(F.count("*").alias("loans"), total("b").alias("original"))
    points = rows.groupBy("cohort", "mob").agg(F.count("*").alias("observed"), total(nz("outstanding_balance")).alias("current"))
    small = F.col("loans") < least
    return points.join(cohorts, "cohort").select("cohort", "mob", F.when(~small, F.col("observed")).alias("observed"), F.when(~small, ratio("current", "original")).alias("factor"), small.alias("suppressed"))
