"""Stratifications: balance, share and weighted averages per bucket, with small cells and one complement hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WIDE, amount, nz, ratio, total


def suppress_flat(groups: DataFrame, key: str, count: str, least: int) -> DataFrame:
    """Adds suppressed: groups under ``least``; if that is exactly one group, also the smallest other (ties by key).

    Works on the aggregated side: its one window holds as many rows as there are groups.
    """
    small = groups.withColumn("__small", F.col(count) < least)
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(Window.partitionBy("__small").orderBy(F.col(count), F.col(key)))
    marked = small.withColumn("__n", F.sum(F.col("__small").cast("int")).over(everything)).withColumn("__rank", rank)
    hidden = F.col("__small") | ((F.col("__n") == 1) & ~F.col("__small") & (F.col("__rank") == 1))
    return marked.withColumn("suppressed", hidden).drop("__small", "__n", "__rank")


def stratify(df: DataFrame, bucket: Column, balance: str = "outstanding_balance", averages: tuple[str, ...] = (), least: int = 1, by: tuple[str, ...] = ("as_of_date",), strict: bool = False) -> DataFrame:
    """Per bucket: loans, balance, share of the date's balance, and balance-weighted averages over rows that have the value.

    A null balance ends the run if ``strict``, else it adds nothing; ``balance_conflicts`` lists them. Hidden cells are null but for
    their bucket. One shuffle: partial sums by bucket; the share is a window over the buckets of a date.
    """
    if len(averages) > 5:
        raise ValueError("at most five averages")
    if strict:
        df = df.withColumn(balance, F.coalesce(F.col(balance), F.raise_error(F.lit(f"{balance} is required")).cast(df.schema[balance].dataType)))
    aggs = [F.count("*").alias("loans"), total(balance).alias("balance")]
    for a in averages:
        has = F.col(a).isNotNull()
        aggs += [F.sum(F.when(has, F.col(a) * F.col(balance))).alias(f"__n_{a}"), F.sum(F.when(has, F.col(balance))).alias(f"__d_{a}")]
    grouped = df.groupBy(*by, bucket.alias("bucket")).agg(*aggs)
    shared = grouped.withColumn("share", ratio("balance", F.sum("balance").over(Window.partitionBy(*by))))
    # Suppression is per date: the key and the date together are one flat list.
    w = Window.partitionBy(*by)
    small = F.col("loans") < least
    rank = F.row_number().over(Window.partitionBy(*by, "__small").orderBy("loans", "bucket"))
    marked = shared.withColumn("__small", small).withColumn("__one", F.sum(F.col("__small").cast("int")).over(w) == 1).withColumn("__rank", rank)
    hidden = F.col("__small") | (F.col("__one") & ~F.col("__small") & (F.col("__rank") == 1))
    show = lambda c: F.when(~F.col("suppressed"), c)
    out = marked.withColumn("suppressed", hidden)
    return out.select(*by, "bucket", show(F.col("loans")).alias("loans"), show(F.col("balance")).alias("balance"), show(F.col("share")).alias("share"), *[show(ratio(f"__n_{a}", f"__d_{a}")).alias(f"wa_{a}") for a in averages], "suppressed")


def balance_conflicts(df: DataFrame, balance: str = "outstanding_balance") -> DataFrame:
    """Must be empty: rows without a balance."""
    return df.where(F.col(balance).isNull())


def stratify_live(df: DataFrame, bucket: Column, balance: str = "outstanding_balance", least: int = 1, most: int = 200) -> DataFrame:
    """The older form: null balances count as 0, largest balance first, at most ``most`` buckets and one to show that there are more,
    buckets under ``least`` hidden without a complement."""
    grouped = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("loans"), F.sum(nz(amount(balance))).cast(WIDE).alias("balance"))
    top = grouped.orderBy(F.col("balance").desc(), "bucket").limit(most + 1)
    small = F.col("loans") < least
    return top.select("bucket", F.when(~small, F.col("loans")).alias("loans"), F.when(~small, F.col("balance")).alias("balance"), small.alias("suppressed"))


def over_limit(groups: DataFrame, most: int) -> DataFrame:
    """Must be empty: the row after the last that a publication may have. Reads no further than that."""
    return groups.limit(most + 1).agg(F.count("*").alias("n")).where(F.col("n") > most)
