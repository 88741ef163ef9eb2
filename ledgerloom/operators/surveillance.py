"""Portfolio surveillance: metrics over consecutive snapshots of one book.

Every period-to-period metric reads ``period_pairs``: each row beside the loan's row of the next period, by one shuffle on the
loan key and without a join. Labels of a matrix are a spine on the aggregated side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import latest_periods, population_filter
from ..functions.scalars import Bin, days_between, months_until, numeric_bin, nz, ratio, total

KEY = ["source_system", "facility_id", "loan_id"]


def with_index(tape: DataFrame) -> DataFrame:
    """Adds period_idx: the rank of the date among the distinct dates, which are few."""
    dates = tape.select("as_of_date").distinct()
    ranked = dates.withColumn("period_idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("as_of_date")) - 1)
    return tape.drop("period_idx").join(F.broadcast(ranked), "as_of_date")


def period_pairs(tape: DataFrame, fields: list[str], how: str = "left", key: list[str] = KEY, periods: DataFrame | None = None) -> DataFrame:
    """Each loan of a period (``f``) with itself in the next (``f_next``); found says whether it is there. The last period has no next.

    ``left`` keeps loans that leave, ``full`` also those that come (was is false). to_date is the later date. periods (period_idx,
    as_of_date) spares a scan for the dates, where the caller knows them. One shuffle by loan: the next row of a loan counts if
    it is of the next period. A loan has one row a period; rows without a whole key meet no other.
    """
    dates = periods if periods is not None else tape.select("period_idx", "as_of_date").distinct()
    ends = F.broadcast(dates.agg(F.min("period_idx").alias("__first"), F.max("period_idx").alias("__last")))
    by = Window.partitionBy(*key).orderBy("period_idx")
    rows = tape.select(*key, "period_idx", *[f for f in fields if f not in key])
    rows = rows.withColumn("__next", F.lead(F.struct("period_idx", *fields)).over(by)).withColumn("__before", F.lag("period_idx").over(by))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    found = F.coalesce(whole & (F.col("__next.period_idx") == F.col("period_idx") + 1), F.lit(False))
    goes = F.struct((F.col("period_idx") + 1).alias("pair"), *[F.col(f) for f in fields], *[F.when(found, F.col(f"__next.{f}")).alias(f"{f}_next") for f in fields], found.alias("found"), F.lit(True).alias("was"))
    goes = F.when(F.col("period_idx") < F.col("__last"), goes)
    if how == "full":
        new = (F.col("period_idx") > F.col("__first")) & ~F.coalesce(whole & (F.col("__before") == F.col("period_idx") - 1), F.lit(False))
        nothing = [F.when(F.lit(False), F.col(f)).alias(f) for f in fields]
        comes = F.struct(F.col("period_idx").alias("pair"), *nothing, *[F.col(f).alias(f"{f}_next") for f in fields], F.lit(True).alias("found"), F.lit(False).alias("was"))
        pairs = F.explode(F.array_compact(F.array(goes, F.when(new, comes))))
    else:
        pairs = goes
    keys = [k for k in key if k not in fields]
    out = rows.crossJoin(ends).select(*keys, pairs.alias("__p")).where("__p is not null").select(*keys, "__p.*")
    return out.join(F.broadcast(dates.select(F.col("period_idx").alias("pair"), F.col("as_of_date").alias("to_date"))), "pair")


def matrix(pairs: DataFrame, before: Column, after: Column, balance: str, labels: DataFrame | None = None) -> DataFrame:
    """Share of each from-label's observed balance that moved to each to-label, zero cells included.

    labels: (from_label, to_label) of the spine; without it, the labels of a pair of periods are the from-labels and the
    observed to-labels of that pair. Eligible loans are all of the from-label; observed ones are there in the next period.
    """
    rows = pairs.select("to_date", before.alias("from_label"), F.when(F.col("found"), after).alias("to_label"), F.col(balance).alias("b"), "found")
    # One aggregation of the pairs; what follows is a row a date, whose maps hold the labels, which are few.
    cells = rows.groupBy("to_date", "from_label", "to_label", "found").agg(total("b").alias("moved"), F.count("*").alias("loans"))
    seen = F.col("found")
    moved = F.map_from_entries(F.collect_list(F.when(seen, F.struct("to_label", F.struct("moved", "loans").alias("c")))))
    whole = cells.groupBy("to_date", "from_label").agg(total(F.when(seen, F.col("moved"))).alias("denominator"), F.sum("loans").alias("eligible"), F.sum(F.when(seen, F.col("loans")).otherwise(0)).alias("observed"), moved.alias("to"))
    dates = whole.groupBy("to_date").agg(F.map_from_entries(F.collect_list(F.struct("from_label", F.struct("denominator", "eligible", "observed", "to").alias("w")))).alias("w"))
    if labels is None:
        names = F.array_distinct(F.concat(F.map_keys("w"), F.flatten(F.transform(F.map_values("w"), lambda x: F.map_keys(x["to"])))))
        spine = dates.withColumn("from_label", F.explode(names)).withColumn("to_label", F.explode(names))
    else:
        spine = dates.crossJoin(F.broadcast(labels))
    spine = spine.withColumn("w", F.try_element_at("w", F.col("from_label"))).withColumn("c", F.try_element_at("w.to", F.col("to_label")))
    full = spine.select("to_date", "from_label", "to_label", "w.denominator", "w.eligible", "w.observed", "c.moved", "c.loans")
    return full.select(
        "to_date", "from_label", "to_label", nz("moved").cast("decimal(38,2)").alias("numerator"), nz("denominator").cast("decimal(38,2)").alias("denominator"), ratio(nz("moved"), "denominator").alias("value"), nz("loans").alias("loans"), nz("eligible").alias("eligible"), nz("observed").alias("observed")
    )


def roll_cure(tape: DataFrame, bins: list[Bin], balance: str = "outstanding_balance", periods: DataFrame | None = None) -> DataFrame:
    """Roll and cure between delinquency bands; direction by the order of the bands."""
    spark = tape.sparkSession
    names = [b.label for b in bins] + ["Unknown", "Outside"]
    order = {n: i for i, n in enumerate(names)}
    labels = spark.createDataFrame([(a, b, "stay" if a == b else "other" if max(order[a], order[b]) >= len(bins) else "roll" if order[b] > order[a] else "cure") for a in names for b in names], "from_label string, to_label string, movement string")
    pairs = period_pairs(tape.where(F.col(balance).isNotNull()), [balance, "days_past_due"], periods=periods)
    band = lambda c: numeric_bin(c, bins, "Unknown", "Outside")
    out = matrix(pairs, band("days_past_due"), band("days_past_due_next"), balance, labels.select("from_label", "to_label"))
    return out.join(F.broadcast(labels), ["from_label", "to_label"])


def rating_migration(tape: DataFrame, rating: str = "risk_rating", balance: str = "outstanding_balance", periods: DataFrame | None = None) -> DataFrame:
    """Migration by prior balance; loans without a rating are ``Unrated``."""
    label = lambda c: F.coalesce(F.col(c), F.lit("Unrated"))
    return matrix(period_pairs(tape.where(F.col(balance).isNotNull()), [balance, rating], periods=periods), label(rating), label(f"{rating}_next"), balance)


def default_incidence(tape: DataFrame, basis: str = "count", balance: str = "outstanding_balance", periods: DataFrame | None = None) -> DataFrame:
    """Loans not in default that are in default one period later. An unknown flag at the start is eligible, not observed."""
    pairs = period_pairs(tape, ["default_flag", balance], periods=periods).where(~F.coalesce(F.col("default_flag"), F.lit(False)))
    observed = F.col("found") & F.col("default_flag").isNotNull() & F.col("default_flag_next").isNotNull()
    weight = F.lit(1).cast("decimal(20,2)") if basis == "count" else F.col(balance)
    sums = pairs.groupBy("to_date").agg(total(F.when(observed & F.col("default_flag_next"), weight).otherwise(0)).alias("numerator"), total(F.when(observed, weight).otherwise(0)).alias("denominator"), F.count("*").alias("eligible"), F.sum(observed.cast("long")).alias("observed"))
    return sums.withColumn("value", ratio("numerator", "denominator"))


def ever_dpd(tape: DataFrame, thresholds: list[int]) -> DataFrame:
    """Share of present loans that have ever reached a threshold, in the history given; any unknown in it makes a loan unobserved."""
    history = Window.partitionBy(*KEY).orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    run = tape.select("as_of_date", *KEY, F.max("days_past_due").over(history).alias("worst"), F.max(F.col("days_past_due").isNull()).over(history).alias("gap"))
    aggs = [F.count("*").alias("eligible"), F.sum((~F.col("gap")).cast("long")).alias("observed")] + [F.sum((~F.col("gap") & (F.col("worst") >= t)).cast("long")).alias(f"t{t}") for t in thresholds]
    wide = run.groupBy("as_of_date").agg(*aggs)
    long = wide.select("as_of_date", "eligible", "observed", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("numerator")) for t in thresholds])).alias("x"))
    return long.select("as_of_date", "x.threshold", "x.numerator", "observed", "eligible", ratio("x.numerator", "observed").alias("value"))


def loss_recovery(tape: DataFrame, flows: str = "period", exposure: str = "outstanding_balance", null_policy: str = "exclude") -> DataFrame:
    """Gross and net loss rates, recoveries and the recovery-weighted days since default, per date.

    ``cumulative`` flows are differences from the prior snapshot: a loan that was absent starts at 0, one whose prior value is
    unknown stays unknown. Gross losses count also where the exposure is unknown, their denominator doesn't; the net
    denominator needs all three.
    """
    fill = (lambda c: nz(c)) if null_policy == "zero" else (lambda c: c)
    rows = tape.select("as_of_date", "period_idx", *KEY, fill(F.col("charge_off_amount")).alias("loss"), fill(F.col("recovery_amount")).alias("rec"), F.col(exposure).alias("exposure"), "default_date")
    if flows == "cumulative":
        # The loan's row before, if it is of the period before: one shuffle by loan, no join.
        before = F.lag(F.struct("period_idx", "loss", "rec")).over(Window.partitionBy(*KEY).orderBy("period_idx"))
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEY])
        had = F.coalesce(whole & (F.col("was.period_idx") == F.col("period_idx") - 1), F.lit(False))
        step = lambda c: F.col(c) - F.when(had, F.col(f"was.{c}")).otherwise(0)
        rows = rows.withColumn("was", before).withColumns({"loss": step("loss"), "rec": step("rec")})
    lag = days_between("default_date", "as_of_date")
    dated = F.col("rec").isNotNull() & (F.col("rec") > 0) & F.col("default_date").isNotNull()
    all3 = F.col("loss").isNotNull() & F.col("rec").isNotNull() & F.col("exposure").isNotNull()
    sums = rows.groupBy("as_of_date").agg(
        total("loss").alias("gross_loss"),
        total(F.when(F.col("loss").isNotNull(), F.col("exposure"))).alias("gross_exposure"),
        total("rec").alias("recovery"),
        total(F.when(all3, F.col("exposure"))).alias("net_exposure"),
        total(F.when(dated, F.col("rec") * lag)).alias("lag_sum"),
        total(F.when(dated, F.col("rec"))).alias("lag_weight"),
    )
    net = nz("gross_loss") - nz("recovery")
    return sums.select("as_of_date", "gross_loss", "recovery", ratio("gross_loss", "gross_exposure").alias("gross_loss_rate"), ratio(net, "net_exposure").alias("net_loss_rate"), ratio("lag_sum", "lag_weight").alias("recovery_lag_days"))


def paydown_prepayment(tape: DataFrame, balance: str = "outstanding_balance", scheduled: str | None = "scheduled_principal_amount", periods: DataFrame | None = None) -> DataFrame:
    """Paydown and prepayment by pair of periods. A loan that left is paid to zero; a prepayment needs the later row and its
    scheduled principal, over the paydown denominator; without a scheduled field it is unavailable (null)."""
    fields = [balance] + ([scheduled] if scheduled else [])
    pairs = period_pairs(tape, fields, periods=periods).where(F.col(balance).isNotNull() & (~F.col("found") | F.col(f"{balance}_next").isNotNull()))
    decline = F.greatest(F.col(balance) - nz(f"{balance}_next"), F.lit(0))
    pre = F.when(F.col("found") & F.col(f"{scheduled}_next").isNotNull(), F.greatest(decline - F.col(f"{scheduled}_next"), F.lit(0))) if scheduled else F.lit(None).cast("decimal(20,2)")
    sums = pairs.groupBy("to_date").agg(total(decline).alias("paydown"), total(pre).alias("prepayment"), total(balance).alias("denominator"), F.count("*").alias("loans"))
    return sums.withColumn("paydown_rate", ratio("paydown", "denominator")).withColumn("prepayment_rate", ratio("prepayment", "denominator"))


def balance_utilisation(tape: DataFrame, by: Column | None = None) -> DataFrame:
    """Balance, remaining factor and utilisation, of rows that have all three amounts; long form, one row per metric."""
    whole = tape.where(F.col("outstanding_balance").isNotNull() & F.col("original_balance").isNotNull() & F.col("commitment_amount").isNotNull())
    grouped = whole.groupBy("as_of_date", (by if by is not None else F.lit("All")).alias("cohort")).agg(total("outstanding_balance").alias("b"), total("original_balance").alias("o"), total("commitment_amount").alias("c"))
    metric = lambda name, num, den, value: F.struct(F.lit(name).alias("metric"), num.alias("numerator"), den.alias("denominator"), value.alias("value"))
    none = F.lit(None).cast("decimal(38,2)")
    rows = F.array(metric("balance", F.col("b"), none, F.col("b").cast("double")), metric("remaining_factor", F.col("b"), F.col("o"), ratio("b", "o")), metric("utilisation", F.col("b"), F.col("c"), ratio("b", "c")))
    return grouped.select("as_of_date", F.col("cohort").cast("string").alias("cohort"), F.explode(rows).alias("m")).select("as_of_date", "cohort", "m.*")


def maturity_wall(tape: DataFrame, windows: list[tuple[str, int]], balance: str = "outstanding_balance") -> DataFrame:
    """Share of balance by months until maturity: the first window whose end is not passed, Matured, Beyond or Unknown; zero cells kept."""
    months = months_until("as_of_date", "maturity_date")
    label = F.when(F.col("maturity_date").isNull(), "Unknown").when(months < 0, "Matured")
    for name, end in windows:
        label = label.when(months <= end, name)
    rows = tape.where(F.col(balance).isNotNull()).groupBy("as_of_date", label.otherwise("Beyond").alias("window")).agg(total(balance).alias("numerator"), F.count("*").alias("loans"))
    names = [n for n, _ in windows] + ["Matured", "Beyond", "Unknown"]
    spine = rows.select("as_of_date").distinct().withColumn("window", F.explode(F.array(*[F.lit(n) for n in names])))
    full = spine.join(rows, ["as_of_date", "window"], "left").select("as_of_date", "window", nz("numerator").cast("decimal(38,2)").alias("numerator"), nz("loans").alias("loans"))
    return full.withColumn("share", ratio("numerator", F.sum("numerator").over(Window.partitionBy("as_of_date"))))


def concentration(tape: DataFrame, category: Column, top: int, balance: str = "outstanding_balance") -> DataFrame:
    """Shares of the ``top`` categories by amount (ties by name) and of the rest as Other, with the Herfindahl index over all
    categories, before any are put together."""
    groups = tape.where(F.col(balance).isNotNull()).groupBy("as_of_date", category.alias("category")).agg(total(balance).alias("amount"), F.count("*").alias("loans"))
    date = Window.partitionBy("as_of_date")
    ranked = groups.withColumn("rank", F.row_number().over(date.orderBy(F.col("amount").desc(), "category"))).withColumn("whole", F.sum("amount").over(date).cast("decimal(38,2)"))
    squared = F.pow(ratio("amount", "whole"), 2)
    named = ranked.withColumn("sq", squared).withColumn("shown", F.when(F.col("rank") <= top, F.col("category")).otherwise("Other"))
    rows = named.groupBy("as_of_date", "shown").agg(total("amount").alias("amount"), F.sum("loans").alias("loans"), F.max("whole").alias("whole"), F.sum("sq").alias("sq"))
    return rows.select("as_of_date", F.col("shown").alias("category"), "amount", "loans", ratio("amount", "whole").alias("share"), F.sum("sq").over(date).alias("hhi"))


def resolve_entities(tape: DataFrame, entities: DataFrame, field: str = "borrower_id") -> DataFrame:
    """Adds entity (canonical id, else the source id) and resolved. entities: (source_system, source_id, entity_id)."""
    named = entities.select("source_system", F.col("source_id").alias(field), "entity_id")
    joined = tape.join(named, ["source_system", field], "left")
    return joined.withColumn("entity", F.coalesce("entity_id", F.col(field))).withColumn("resolved", F.col("entity_id").isNotNull()).drop("entity_id")


DRIVERS = ["new_exposure", "exit", "increase", "decrease", "unchanged"]


def period_change(tape: DataFrame, segment: str, balance: str = "outstanding_balance", periods: DataFrame | None = None) -> DataFrame:
    """Change of balance between periods per segment and driver. A loan that changes its segment is an exit in one and new in the other."""
    known = tape.where(F.col(balance).isNotNull())
    pairs = period_pairs(known, [balance], "full", list(dict.fromkeys([*KEY, segment])), periods=periods)
    change = nz(f"{balance}_next") - nz(balance)
    driver = F.when(~F.col("was"), "new_exposure").when(~F.col("found"), "exit").when(change > 0, "increase").when(change < 0, "decrease").otherwise("unchanged")
    rows = pairs.groupBy("to_date", F.col(segment).alias("segment"), driver.alias("driver")).agg(total(change).alias("amount"), F.count("*").alias("loans"), total(nz(balance)).alias("start"))
    held = F.map_from_entries(F.collect_list(F.struct("driver", F.struct("amount", "loans").alias("c"))))
    sums = rows.groupBy("to_date", "segment").agg(total("start").alias("start_balance"), total("amount").alias("change"), held.alias("held"))
    full = sums.withColumn("driver", F.explode(F.array(*[F.lit(d) for d in DRIVERS]))).withColumn("c", F.try_element_at("held", F.col("driver"))).withColumns({"amount": F.col("c.amount"), "loans": F.col("c.loans")})
    return full.select("to_date", "segment", "driver", nz("amount").cast("decimal(38,2)").alias("amount"), nz("loans").alias("loans"), "change", ratio("change", "start_balance").alias("change_rate"), ratio(nz("amount"), "change").alias("driver_share"))


def pack(metrics: dict[str, DataFrame]) -> DataFrame:
    """Cells of several metrics in one table: metric, dimensions (map), numerator, denominator, value. Lazy; the metrics share
    the scan of the tape if it is cached or written before."""
    cells = []
    for name, df in metrics.items():
        measures = {"numerator", "denominator", "value"}
        dims = [c for c in df.columns if c not in measures | {"eligible", "observed", "loans"}]
        pairs = [x for d in dims for x in (F.lit(d), F.col(d).cast("string"))]
        num = lambda c, df=df: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        cells.append(df.select(F.lit(name).alias("metric"), F.create_map(*pairs).alias("dimensions"), num("numerator").alias("numerator"), num("denominator").alias("denominator"), num("value").alias("value")))
    return reduce(DataFrame.unionByName, cells)


#: What a definition may name; each takes the rows of its population, with period_idx, and its parameters.
METRICS = {
    "default_incidence": default_incidence, "ever_dpd": ever_dpd, "roll_cure": roll_cure, "rating_migration": rating_migration, "balance_utilisation": balance_utilisation,
    "loss_recovery": loss_recovery, "paydown_prepayment": paydown_prepayment, "maturity_wall": maturity_wall, "period_change": period_change,
}


def run_pack(tape: DataFrame, definitions: list[dict]) -> DataFrame:
    """Cells of several metric definitions in one table, as ``pack`` has them.

    A definition: id, metric (of METRICS), params, filter (a population filter), latest (periods of its population, all if
    absent), most_cells (more end the run). Lazy; write the tape, or the part of it that the definitions share, before.
    """
    out = []
    for d in definitions:
        rows = tape.where(population_filter(d["filter"])) if d.get("filter") else tape
        rows = with_index(latest_periods(rows, d["latest"]) if d.get("latest") else rows)
        cells = pack({d["id"]: METRICS[d["metric"]](rows, **d.get("params", {}))})
        if most := d.get("most_cells"):
            n = F.broadcast(cells.agg(F.count("*").alias("__n")))
            too_many = F.when(F.col("__n") > most, F.raise_error(F.lit(f"{d['id']} has more than {most} cells")))
            cells = cells.crossJoin(n).where(too_many.cast("string").isNull()).drop("__n")
        out.append(cells)
    return reduce(DataFrame.unionByName, out)
