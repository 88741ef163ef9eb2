"""Disclosure control between releases, budgets, and checks of evidence and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import after_key, running


def differencing(candidates: DataFrame, releases: DataFrame, cell: list[str], k: int, recent: int = 500) -> DataFrame:
    """permit, or deny for a small cell or for members that differ from one of the last ``recent`` releases of the cell by fewer
    than ``k``.

    Membership is in rows (cell, token), releases also have release_id and released_at: sizes of differences come from counts
    of shared tokens, |a - b| = |a| - |a & b|, so no set of members is ever held.
    """
    size = candidates.groupBy(*cell).agg(F.count_distinct("token").alias("n"))
    # The last releases are found by their dates alone; tokens of older ones go no further.
    dated = releases.groupBy(*cell, "release_id").agg(F.max("released_at").alias("at"))
    chosen = dated.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("at").desc(), "release_id"))).where(F.col("rank") <= recent).select(*cell, "release_id")
    releases = releases.join(chosen, [*cell, "release_id"], "left_semi")
    last = releases.groupBy(*cell, "release_id").agg(F.count_distinct("token").alias("m"))
    both = candidates.select(*cell, "token").distinct().join(releases.select(*cell, "release_id", "token").distinct(), [*cell, "token"]).groupBy(*cell, "release_id").agg(F.count("*").alias("shared"))
    pairs = last.join(size, cell).join(both, [*cell, "release_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    gap = lambda c: (F.col(c) - F.col("shared") > 0) & (F.col(c) - F.col("shared") < k)
    risky = pairs.where(gap("n") | gap("m")).select(*cell).distinct().withColumn("risky", F.lit(True))
    out = size.join(risky, cell, "left")
    return out.select(*cell, "n", F.when(F.col("n") < k, "deny_small_cell").when(F.col("risky"), "deny_differencing_risk").otherwise("permit").alias("decision"))


def budget(log: DataFrame, scope: list[str], rows: int) -> DataFrame:
    """Rows disclosed so far, in order, and whether each page still fits the budget. One scope may hold any share of the log."""
    run = running(log, scope, [("seq", True)], {"disclosed": ("sum", F.col("rows"))}, "budget")
    return run.withColumn("allowed", F.col("disclosed") <= rows)


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a stable order; Spark keeps only offset + limit rows of each task."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], last: dict | None, limit: int) -> DataFrame:
    """The page that follows the row with the keys ``last`` (the first page without it), by name and ascending or not: each task keeps
    ``limit`` rows, however deep the page. The keys must be unique and not null."""
    rows = df.where(after_key(keys, last)) if last else df
    return rows.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, up in keys]).limit(limit)


def total_order(df: DataFrame, order: list[tuple[str, str, str]]) -> DataFrame:
    """Keys with a direction (asc, desc) and a place for nulls (first, last) each."""
    return df.orderBy(*[getattr(F.col(c), f"{d}_nulls_{n}")() for c, d, n in order])


def unbacked(observations: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Observations that no stored cell equals in all keys and the value."""
    return observations.join(cells.select(*keys, "value").distinct(), [*keys, "value"], "left_anti")


def sidecar_problems(facts: DataFrame, definitions: DataFrame, trusted: DataFrame) -> DataFrame:
    """(problem, metric_id): unknown, repeated or missing metrics, and evidence that isn't trusted."""
    p = lambda df, name: df.select(F.lit(name).alias("problem"), "metric_id")
    known = definitions.select("metric_id").distinct()
    out = p(facts.join(known, "metric_id", "left_anti").select("metric_id").distinct(), "unknown")
    out = out.union(p(facts.groupBy("metric_id").count().where("count > 1"), "duplicate"))
    out = out.union(p(known.join(facts, "metric_id", "left_anti"), "missing"))
    refs = facts.select("metric_id", F.explode("evidence").alias("ref"))
    return out.union(p(refs.join(trusted.select("ref").distinct(), "ref", "left_anti").select("metric_id").distinct(), "untrusted"))


def unbacked_lineage(cells: DataFrame, certified: DataFrame) -> DataFrame:
    """(cell_id, population_hash): source populations of report cells that aren't certified."""
    each = cells.select("cell_id", F.explode("populations").alias("population_hash"))
    return each.join(certified.select("population_hash").distinct(), "population_hash", "left_anti").select("cell_id", "population_hash").distinct()


def report_table(cells: DataFrame, rows: str, columns: str, labels: list[str], value: str = "value") -> DataFrame:
    """Cells of two dimensions as a wide table; suppressed cells are null and counted."""
    shown = cells.withColumn("__v", F.when(~F.col("suppressed"), F.col(value)))
    wide = shown.groupBy(rows).pivot(columns, labels).agg(F.max("__v"))
    hidden = cells.groupBy(rows).agg(F.sum(F.col("suppressed").cast("long")).alias("suppressed_cells"))
    return wide.join(hidden, rows)


def report_problems(cells: DataFrame, dims: list[str]) -> DataFrame:
    """(problem, n), must be empty: repeated dimension rows, suppressed cells with a value, counts that aren't whole."""
    twice = cells.groupBy(*dims).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_row").alias("problem"), "n")
    flags = cells.agg(F.sum((F.col("suppressed") & F.col("value").isNotNull()).cast("long")).alias("a"), F.sum(((F.col("unit") == "count") & (F.col("value") % 1 != 0)).cast("long")).alias("b"))
    rows = flags.select(F.explode(F.array(F.struct(F.lit("suppressed_value").alias("problem"), F.coalesce("a", F.lit(0)).alias("n")), F.struct(F.lit("fractional_count").alias("problem"), F.coalesce("b", F.lit(0)).alias("n")))).alias("x")).select("x.*")
    return twice.union(rows).where("n > 0")


def comparison(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """delta = right - left where both are shown."""
    a, b = left.select(*keys, F.col("value").alias("left_value")), right.select(*keys, F.col("value").alias("right_value"))
    return a.join(b, keys, "full").withColumn("delta", F.col("right_value") - F.col("left_value"))


def members_differ(a: Column, b: Column) -> Column:
    """Sizes of both differences of two small member arrays."""
    return F.struct(F.size(F.array_except(a, b)).alias("only_left"), F.size(F.array_except(b, a)).alias("only_right"))
