"""Corrections, bundles of snapshots, and bitemporal exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import settled
from .running import running


def terminal_revisions(manifests: DataFrame, known_at: Column, scope: list[str]) -> DataFrame:
    """The last revision of each chain that was known at the cutoff.

    manifests: scope, manifest_id, content_hash, sequence, corrects_id, corrects_hash, known_at. A revision is terminal if none
    that was known corrects it: one anti-join, no walk along the chain.
    """
    seen = manifests.where(F.col("known_at") <= known_at)
    corrected = seen.where("corrects_id is not null").select(*scope, F.col("corrects_id").alias("manifest_id")).distinct()
    return seen.join(corrected, [*scope, "manifest_id"], "left_anti")


def chain_violations(manifests: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, problem), must be empty: not one original, forks, gaps, a parent that is missing or differs in hash or sequence,
    one id with two contents."""
    base = manifests.groupBy(*scope).agg(F.sum(F.col("corrects_id").isNull().cast("int")).alias("originals"), F.max("sequence").alias("last"), F.count_distinct("manifest_id").alias("n"))
    wrong = base.select(*scope, F.explode(F.array_compact(F.array(F.when(F.col("originals") != 1, "originals"), F.when(F.col("last") != F.col("n") - 1, "gap")))).alias("problem"))
    forks = manifests.where("corrects_id is not null").groupBy(*scope, "corrects_id").agg(F.count_distinct("manifest_id").alias("n")).where("n > 1").select(*scope, F.lit("fork").alias("problem"))
    parent = manifests.select(*scope, F.col("manifest_id").alias("corrects_id"), F.col("content_hash").alias("corrects_hash"), (F.col("sequence") + 1).alias("sequence"))
    orphans = manifests.where("corrects_id is not null").join(parent, [*scope, "corrects_id", "corrects_hash", "sequence"], "left_anti").select(*scope, F.lit("parent").alias("problem"))
    clash = manifests.groupBy(*scope, "manifest_id").agg(F.count_distinct("content_hash").alias("n")).where("n > 1").select(*scope, F.lit("conflict").alias("problem"))
    return wrong.union(forks).union(orphans).union(clash).distinct()


def bundle(terminals: DataFrame, dataset: str = "dataset_id", date: str = "as_of_date") -> DataFrame:
    """One row per dataset: dates, first, last, and whether each date has one terminal of one source and scope."""
    per = terminals.groupBy(dataset, date).agg(F.count("*").alias("n"))
    one = per.groupBy(dataset).agg(F.count("*").alias("dates"), F.min(date).alias("first"), F.max(date).alias("last"), (F.max("n") == 1).alias("unique_dates"))
    source = terminals.groupBy(dataset).agg((F.count_distinct("source_system") == 1).alias("one_source"))
    return one.join(source, dataset)


def rates_as_of(rows: DataFrame, rates: DataFrame, base: str = "currency", at: str = "as_of_date", known: str = "known_at", same: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the rate (rate, effective_on) that was effective at its date and received by its cutoff: the latest
    effective, then the latest received, then the greatest hash; null if there is none. rates: base, effective_on, received_at,
    rate, rate_hash, and whatever else must agree (``same``: quote currency, rate type, definition and its hash).

    A dominance join without a product. Times of receipt are ranked, and a cutoff that c of them come before is the blocks of
    2^j ranks for which bit j of c is set: about log2(quotes) blocks, in each of which every quote is known. A quote is in one
    block of each size. Within a block, quotes and dates asked for run in order of time, and the running maximum of (effective,
    received, hash) is the block's answer; the greatest of the blocks is the row's. The work is (quotes + distinct dates and
    cutoffs) times that logarithm, in ranges that split any key.
    """
    keys = [base, *same]
    # Ranges are sampled before they are dealt, and what is asked is looked at by rank and by block: found once.
    asked = settled(rows.select(*keys, at, known).distinct(), "asked")
    quotes = rates.withColumnRenamed("base", base).where(F.col(base).isNotNull() & F.col("effective_on").isNotNull() & F.col("received_at").isNotNull())
    time = lambda df, c, mark: df.select(*keys, F.col(c).alias("t"), F.lit(mark).alias("late")).distinct()
    ranked = running(time(quotes, "received_at", 0).union(time(asked, known, 1)), keys, [("t", True), ("late", True)], {"c": ("sum", 1 - F.col("late"))}, "ranks")
    ranked = settled(ranked, "ranks")
    levels = int(ranked.agg(F.max("c")).first()[0] or 0).bit_length()
    steps = F.sequence(F.lit(0), F.lit(max(0, levels - 1)))
    at_rank = lambda late, c: ranked.where(F.col("late") == late).select(*keys, F.col("t").alias(c), F.col("c").cast("long").alias("c"))
    held = quotes.join(at_rank(0, "received_at"), [*keys, "received_at"]).withColumn("j", F.explode(steps))
    # Only blocks of an even number are ever asked for.
    held = held.withColumn("block", F.call_function("shiftright", F.col("c") - 1, F.col("j"))).where("block % 2 = 0")
    held = held.select(*keys, "j", "block", F.col("effective_on").alias(at), F.lit(0).alias("asks"), F.struct("effective_on", "received_at", "rate_hash", "rate").alias("quote"))
    want = asked.join(at_rank(1, known), [*keys, known]).withColumn("j", F.explode(steps)).withColumn("block", F.call_function("shiftright", F.col("c"), F.col("j")) - 1).where("block % 2 = 0 and block >= 0")
    want = want.select(*keys, "j", "block", at, F.lit(1).alias("asks"), F.lit(None).cast(held.schema["quote"].dataType).alias("quote"), known)
    merged = held.withColumn(known, F.lit(None).cast(want.schema[known].dataType)).unionByName(want)
    found = running(merged, [*keys, "j", "block"], [(at, True), ("asks", True)], {"last": ("max", F.col("quote"))}, "quotes")
    placed = found.where("asks = 1").groupBy(*keys, at, known).agg(F.max("last").alias("last")).select(*keys, at, known, "last.rate", "last.effective_on")
    return rows.join(placed, [*keys, at, known], "left")


def convert(amount: Column, rate: Column, places: int = 2, inverse: bool = False) -> Column:
    """Half-even to ``places``; inverse divides by the rate instead."""
    wide = amount.cast("decimal(20,6)") / rate.cast("decimal(16,8)") if inverse else amount.cast("decimal(20,6)") * rate.cast("decimal(16,8)")
    return F.bround(wide, places)


def normalise_quotes(rates: DataFrame, base: str) -> DataFrame:
    """Quotes in the direction ``base`` to other: quotes the other way round are inverted to 12 places, half-even."""
    inverse = F.bround(F.lit(1).cast("decimal(20,12)") / F.col("source_rate").cast("decimal(16,8)"), 12)
    flip = F.col("quote") == base
    return rates.select("*", F.when(flip, F.col("base")).otherwise(F.col("quote")).alias("other"), F.when(flip, inverse).otherwise(F.col("source_rate").cast("decimal(20,12)")).alias("normal_rate"))
