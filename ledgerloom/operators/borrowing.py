"""Borrowing bases for many facilities, dates and scenarios at once.

``SCOPE`` columns (facility and date, and whatever else is given) key every step; what is one row of state in a policy
document is one row per scope here. Record-level steps are window expressions over debtor or group within a scope.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import eligibility_condition
from ..functions.scalars import WIDE, ratio
from .running import running, same_keys

M = "decimal(24,6)"


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(M)


def lit(v: str | int) -> Column:
    return F.lit(str(v)).cast(M)


@dataclass
class ArPolicy:
    """rules: (rule_id, priority, condition tree). allocation of a concentration excess: invoice, largest or oldest first."""

    rules: list[tuple[str, int, dict]]
    advance_rate: str
    sublimit: str
    reserve: str
    commitment: str
    cross_age_days: int = 90
    cross_age_ratio: str | None = None
    concentration: str | None = None
    allocation: str = "invoice"


def ar_receivables(receivables: DataFrame, policy: ArPolicy, scope: list[str]) -> DataFrame:
    """Each receivable with the rule that excludes it (the first by priority and id), the rules it matches, what cross-aging and
    the concentration cap take, and what stays eligible. One debtor may hold any share of the invoices.

    Cross-aging looks at gross amounts before any exclusion; the cap is a share of all that is left before it, and its excess
    is taken in order until it is used up (a running sum, no loop).
    """
    rules = sorted(policy.rules, key=lambda r: (r[1], r[0]))
    hits = [eligibility_condition(tree) for _, _, tree in rules]
    first = reduce(lambda acc, rh: acc.when(rh[1], rh[0][0]), list(zip(rules, hits, strict=True))[1:], F.when(hits[0], rules[0][0]))
    matched = F.array_compact(F.array(*[F.when(h, r[0]) for r, h in zip(rules, hits, strict=True)]))
    rows = receivables.withColumn("gross", money("outstanding_amount")).withColumn("rule_id", first).withColumn("matched", matched)
    rows = rows.withColumn("left1", F.when(F.col("rule_id").isNull(), F.col("gross")).otherwise(0).cast(M))
    # Debtors and scopes are grouped sums joined back, so that no task has to hold one.
    debtor = [*scope, "debtor_id"]
    old = F.sum(F.when(F.col("days_past_due") >= policy.cross_age_days, F.col("gross")).otherwise(0))
    per = rows.groupBy(*debtor).agg(F.sum("gross").alias("__gross"), old.alias("__old"), F.sum("left1").alias("__left"))
    aged = F.lit(False)
    if policy.cross_age_ratio is not None:
        aged = F.coalesce((F.col("__gross") > 0) & (F.col("__old") >= F.col("__gross") * lit(policy.cross_age_ratio)), F.lit(False))
    per = per.withColumn("__aged", aged).withColumn("__left", F.when(F.col("__aged"), F.lit(0)).otherwise(F.col("__left")))
    per = per.select(*debtor, "__aged", "__left")
    if policy.concentration is not None:
        whole = per.groupBy(*scope).agg(F.sum("__left").alias("__whole"))
        per = per.alias("a").join(whole.alias("b"), same_keys("a", "b", scope)).select("a.*", "__whole")
        per = per.withColumn("__excess", F.greatest(F.col("__left") - F.col("__whole") * lit(policy.concentration), F.lit(0))).drop("__whole")
    rows = rows.alias("a").join(per.alias("b"), same_keys("a", "b", debtor)).select("a.*", *[f"b.{c}" for c in per.columns if c not in debtor])
    rows = rows.withColumn("cross_aged", F.when(F.col("__aged"), F.col("left1")).otherwise(0).cast(M)).withColumn("left2", (F.col("left1") - F.col("cross_aged")).cast(M))
    rows = rows.drop("__aged", "__left")
    if policy.concentration is None:
        return rows.withColumn("concentration", lit(0)).withColumn("eligible", F.col("left2"))
    order = {"invoice": [("receivable_id", True)], "largest": [("left2", False), ("receivable_id", True)], "oldest": [("days_past_due", False), ("receivable_id", True)]}[policy.allocation]
    # Only debtors over the cap need an order.
    over = running(rows.where("__excess > 0"), debtor, order, {"__upto": ("sum", F.col("left2"))}, "allocation")
    rows = over.unionByName(rows.where("not (__excess > 0)").withColumn("__upto", F.col("left2").cast(over.schema["__upto"].dataType)))
    taken = F.greatest(F.least(F.col("left2"), F.col("__excess") - (F.col("__upto") - F.col("left2"))), F.lit(0)).cast(M)
    return rows.withColumn("concentration", taken).withColumn("eligible", (F.col("left2") - taken).cast(M)).drop("__excess", "__upto")


def ar_base(receivables: DataFrame, usage: DataFrame, policy: ArPolicy, scope: list[str]) -> DataFrame:
    """One row per scope: gross down to excess availability and overadvance, each step in a column."""
    rows = ar_receivables(receivables, policy, scope)
    sums = rows.groupBy(*scope).agg(
        F.sum("gross").cast(M).alias("gross"), F.sum(F.col("gross") - F.col("left1")).cast(M).alias("ineligible"), F.sum("cross_aged").cast(M).alias("cross_aged"), F.sum("concentration").cast(M).alias("concentration"), F.sum("eligible").cast(M).alias("eligible")
    )
    used = usage.groupBy(*scope).agg(F.sum(money("amount")).cast(M).alias("usage"))
    out = sums.join(used, scope, "left").withColumn("usage", F.coalesce("usage", lit(0)).cast(M))
    out = out.withColumn("advanced", (F.col("eligible") * lit(policy.advance_rate)).cast(M)).withColumn("after_sublimit", F.least("advanced", lit(policy.sublimit)))
    out = out.withColumn("reserves", F.least("after_sublimit", lit(policy.reserve))).withColumn("after_reserves", (F.col("after_sublimit") - F.col("reserves")).cast(M))
    out = out.withColumn("base", F.least("after_reserves", lit(policy.commitment)))
    net = (F.col("base") - F.col("usage")).cast(M)
    return out.withColumn("availability", net).withColumn("overadvance", F.greatest(-net, lit(0)).cast(M))


STEPS = [("ineligible", "gross"), ("cross_aged", None), ("concentration", None), ("advance", None), ("sublimit", None), ("reserves", None), ("commitment", None), ("usage", None)]


def waterfall(base: DataFrame, scope: list[str]) -> DataFrame:
    """The steps of ``ar_base`` in long form: sequence, step, before, adjustment, after."""
    d = lambda a, b: (F.col(a) - F.col(b)).cast(M)
    adjust = {"ineligible": F.col("ineligible"), "cross_aged": F.col("cross_aged"), "concentration": F.col("concentration"), "advance": d("eligible", "advanced"), "sublimit": d("advanced", "after_sublimit"), "reserves": F.col("reserves"), "commitment": d("after_reserves", "base"), "usage": F.col("usage")}
    steps = F.array(*[F.struct(F.lit(i + 1).alias("sequence"), F.lit(n).alias("step"), (-a).cast(M).alias("adjustment")) for i, (n, a) in enumerate(adjust.items())])
    long = base.select(*scope, "gross", F.explode(steps).alias("s")).select(*scope, "gross", "s.*")
    run = Window.partitionBy(*scope).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    after = (F.col("gross") + F.sum("adjustment").over(run)).cast(M)
    return long.withColumn("after", after).withColumn("before", (F.col("after") - F.col("adjustment")).cast(M)).select(*scope, "sequence", "step", "before", "adjustment", "after")


@dataclass
class Component:
    collateral_class: str
    advance_rate: str
    sublimit: str | None = None
    #: (ceiling or None for open, cap share): the first tier whose ceiling the group's amount does not pass.
    tiers: list[tuple[str | None, str]] = field(default_factory=list)


@dataclass
class Policy:
    components: list[Component]
    #: (reserve_id, formula): fixed, percentage (basis), amount_above (basis, threshold, rate), sum (args).
    reserves: list[tuple[str, dict]]
    commitment: str
    #: (trigger_id, metric excess|overadvance|utilisation, threshold, amount blocked or ``cash_dominion``): strictly below for excess,
    #: strictly above for the others.
    triggers: list[tuple[str, str, str, str]] = field(default_factory=list)


def tier_cap(amount: Column, tiers: list[tuple[str | None, str]]) -> Column:
    out = None
    for ceiling, share in tiers:
        hit = F.lit(True) if ceiling is None else amount <= lit(ceiling)
        out = F.when(hit, lit(share)) if out is None else out.when(hit, lit(share))
    return out if out is not None else lit(1)


def _per_class(policy: Policy, name: str, default: str | None) -> Column:
    out = F.lit(None).cast(M)
    for c in policy.components:
        v = getattr(c, name)
        out = F.when(F.col("collateral_class") == c.collateral_class, F.lit(v if v is not None else default).cast(M)).otherwise(out)
    return out


def component_base(collateral: DataFrame, policy: Policy, scope: list[str], levers: DataFrame | None = None) -> DataFrame:
    """Per class: gross, eligible before the cap, concentration excess, eligible, advanced and contribution.

    levers: per scope and class what ``reprice`` takes. Groups are summed first (rows without a group are one); each group's cap is its tier's share of the class.
    """
    rows = collateral.where("eligible").withColumn("concentration_group", F.coalesce("concentration_group", F.lit("Ungrouped")))
    groups = rows.groupBy(*scope, "collateral_class", "concentration_group").agg(F.sum(money("basis_value")).cast(M).alias("g"))
    whole = Window.partitionBy(*scope, "collateral_class")
    cap = F.lit(None).cast(M)
    for c in policy.components:
        if c.tiers:
            cap = F.when(F.col("collateral_class") == c.collateral_class, tier_cap(F.col("g"), c.tiers)).otherwise(cap)
    capped = groups.withColumn("whole", F.sum("g").over(whole).cast(M)).withColumn("excess", F.coalesce(F.greatest(F.col("g") - F.col("whole") * cap, lit(0)), lit(0)).cast(M))
    eligible = capped.groupBy(*scope, "collateral_class").agg(F.sum("g").cast(M).alias("pre_concentration"), F.sum("excess").cast(M).alias("concentration_excess"))
    gross = collateral.groupBy(*scope, "collateral_class").agg(F.sum(money("gross_value")).cast(M).alias("gross"))
    out = gross.join(eligible, [*scope, "collateral_class"], "left").na.fill(0, ["pre_concentration", "concentration_excess"])
    out = out.withColumn("eligible", (F.col("pre_concentration") - F.col("concentration_excess")).cast(M))
    return reprice(out if levers is None else out.join(levers, [*scope, "collateral_class"], "left"), policy)


def reserve_amount(formula: dict, depth: int = 1) -> Column:
    """A formula over a facility's row: columns ``contribution`` and, per class, ``<class>_eligible`` and so on."""
    if depth > 4:
        raise ValueError("reserve formula is too deep")
    kind = formula["kind"]
    if kind == "fixed":
        return lit(formula["amount"])
    if kind == "percentage":
        return (F.coalesce(F.col(formula["basis"]), lit(0)) * lit(formula["rate"])).cast(M)
    if kind == "amount_above":
        return (F.greatest(F.coalesce(F.col(formula["basis"]), lit(0)) - lit(formula["threshold"]), lit(0)) * lit(formula.get("rate", "1"))).cast(M)
    if kind == "sum":
        return reduce(lambda a, b: (a + b).cast(M), [reserve_amount(a, depth + 1) for a in formula["args"]])
    raise ValueError(f"unknown reserve {kind}")


def facility_state(components: DataFrame, usage: DataFrame, policy: Policy, scope: list[str], levers: DataFrame | None = None) -> DataFrame:
    """One row per scope: contributions, reserves, capacity before and after blocks, usage, excess, overadvance and cash dominion.

    Triggers see the capacity before any block; with no capacity the utilisation is 1 if anything is used, else 0.
    levers: per scope, where given, commitment_override, reserve_delta (added), extra_block (added), and for a reserve r the amount
    ``override_<r>`` in its place or ``waived_<r>``.
    """
    classes = [c.collateral_class for c in policy.components]
    measures = ("gross", "eligible", "contribution")
    wide = components.groupBy(*scope).agg(
        F.sum("contribution").cast(M).alias("contribution"),
        *[F.sum(F.when(F.col("collateral_class") == c, F.col(m)).otherwise(0)).cast(M).alias(f"{c}_{m}") for c in classes for m in measures],
    )
    used = usage.groupBy(*scope).agg(F.sum(money("amount")).cast(M).alias("usage"))
    row = wide.join(used, scope, "left").withColumn("usage", F.coalesce("usage", lit(0)).cast(M))
    row = row if levers is None else row.join(levers, scope, "left")
    lever = lambda name, kind, default: F.coalesce(F.col(name).cast(kind), default) if name in row.columns else default
    reserves = lever("reserve_delta", M, lit(0))
    for name, formula in policy.reserves:
        amount = lever(f"override_{name}", M, reserve_amount(formula))
        reserves = (reserves + F.when(lever(f"waived_{name}", "boolean", F.lit(False)), lit(0)).otherwise(amount)).cast(M)
    row = row.withColumn("reserves", reserves)
    before = F.least(F.greatest(F.col("contribution") - F.col("reserves"), lit(0)), lever("commitment_override", M, lit(policy.commitment))).cast(M)
    row = row.withColumn("capacity_before_blocks", before).withColumn("excess_before_blocks", (before - F.col("usage")).cast(M))
    share = F.when(F.col("capacity_before_blocks") > 0, ratio("usage", "capacity_before_blocks")).otherwise(F.when(F.col("usage") > 0, 1.0).otherwise(0.0))
    row = row.withColumn("utilisation", share)
    blocks, fired, dominion = lever("extra_block", M, lit(0)), [], F.lit(False)
    for name, metric, bound, action in policy.triggers:
        excess = F.col("excess_before_blocks")
        hit = {"excess": excess < lit(bound), "overadvance": F.greatest(-excess, lit(0)) > lit(bound), "utilisation": F.col("utilisation") > float(bound)}[metric]
        if action == "cash_dominion":
            dominion = dominion | hit
        else:
            blocks = (blocks + F.when(hit, lit(action)).otherwise(lit(0))).cast(M)
        fired.append(F.when(hit, name))
    row = row.withColumn("blocks", blocks).withColumn("triggers", F.array_join(F.array_compact(F.array(*fired)), ",") if fired else F.lit("")).withColumn("cash_dominion", dominion)
    capacity = F.greatest(F.col("capacity_before_blocks") - F.col("blocks"), lit(0)).cast(M)
    net = (capacity - F.col("usage")).cast(M)
    return row.withColumn("capacity", capacity).withColumn("excess", net).withColumn("overadvance", F.greatest(-net, lit(0)).cast(M))


def scenario_collateral(collateral: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each record once per scenario with its eligible basis scaled; gross values stay. scenarios: (scenario_id, collateral_class,
    value_multiplier); classes without a row, or with a null in it, keep their values."""
    names = scenarios.select("scenario_id").distinct()
    each = collateral.crossJoin(names).join(scenarios.where("collateral_class is not null").select("scenario_id", "collateral_class", money("value_multiplier").alias("__by")), ["scenario_id", "collateral_class"], "left")
    return each.withColumn("basis_value", (money("basis_value") * F.coalesce("__by", lit(1))).cast(M)).drop("__by")


def run_scenarios(collateral: DataFrame, usage: DataFrame, policy: Policy, scope: list[str], scenarios: DataFrame, assumptions: DataFrame) -> DataFrame:
    """``facility_state`` under every scenario, each beside its difference from the unchanged state (``<metric>_change``).

    scenarios: scenario_id, reserve_delta, commitment_override (null keeps the policy's). assumptions: scenario_id,
    collateral_class, value_multiplier, rate_multiplier (null keeps). Value multipliers scale the eligible basis alone, and since the
    caps are shares of tiers of that basis, records are scaled before they are summed. A scenario is one more copy of the
    collateral, so their number is a factor of the work; Spark sends the small tables to the tasks by itself.
    """
    more = ["scenario_id", *scope]
    named = scenarios.select("scenario_id", money("reserve_delta").alias("reserve_delta"), money("commitment_override").alias("commitment_override"))
    each = scenario_collateral(collateral, named.join(assumptions.select("scenario_id", "collateral_class", "value_multiplier"), "scenario_id", "left"))
    priced = assumptions.select("scenario_id", "collateral_class", money("rate_multiplier").alias("rate_multiplier"))
    bases = component_base(each, policy, more, each.select(*more).distinct().join(priced, "scenario_id"))
    state = facility_state(bases, usage.crossJoin(named.select("scenario_id")), policy, more, each.select(*more).distinct().join(named, "scenario_id"))
    metrics = ["contribution", "reserves", "capacity", "excess", "overadvance"]
    before = facility_state(component_base(collateral, policy, scope), usage, policy, scope).select(*scope, *[F.col(m).alias(f"was_{m}") for m in metrics])
    both = state.join(before, scope)
    return both.select(*state.columns, *[(F.col(m) - F.col(f"was_{m}")).cast(M).alias(f"{m}_change") for m in metrics])


def compare_states(left: DataFrame, right: DataFrame, scope: list[str], metrics: list[str]) -> DataFrame:
    """Variance (right - left) of each metric; a scope or metric on one side only has a null on the other."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), money(m).alias(name)) for m in metrics])
        return df.select(*scope, F.explode(cells).alias("c")).select(*scope, "c.*")

    both = long(left, "left_value").join(long(right, "right_value"), [*scope, "metric"], "full")
    return both.withColumn("variance", (F.col("right_value") - F.col("left_value")).cast(M))


def submitted_states(certificates: DataFrame, commitment: Column | str) -> DataFrame:
    """Certificates of borrowers (contribution, reserves, blocks, capacity, usage, excess) with whether their own figures tie:
    capacity is contributions less reserves, at most the commitment, less blocks; excess is capacity less usage. Adds
    expected_capacity, capacity_ties, excess_ties and overadvance; one that doesn't tie must not be used."""
    bound = commitment if isinstance(commitment, Column) else lit(commitment)
    left = F.least(F.greatest(money("contribution") - money("reserves"), lit(0)), bound)
    expected = F.greatest(left - money("blocks"), lit(0)).cast(M)
    out = certificates.withColumn("expected_capacity", expected)
    ties = out.withColumn("capacity_ties", F.col("expected_capacity") == money("capacity")).withColumn("excess_ties", money("excess") == (money("capacity") - money("usage")).cast(M))
    return ties.withColumn("overadvance", F.greatest(-money("excess"), lit(0)).cast(M))


def covenants(tests: DataFrame) -> DataFrame:
    """headroom and pass or breach of (comparator gte or lte, actual, threshold)."""
    head = F.when(F.col("comparator") == "gte", F.col("actual") - F.col("threshold")).otherwise(F.col("threshold") - F.col("actual"))
    return tests.withColumn("headroom", head).withColumn("status", F.when(F.col("headroom") >= 0, "pass").otherwise("breach"))


def ticklers(items: DataFrame, as_of: Column, soon_days: int = 30) -> DataFrame:
    """completed, waived, overdue, due_soon or current."""
    left = F.datediff("due_date", as_of)
    status = F.when(F.col("completed_on").isNotNull() & (F.col("completed_on") <= as_of), "completed").when(F.coalesce("waived", F.lit(False)), "waived").when(left < 0, "overdue").when(left <= soon_days, "due_soon").otherwise("current")
    return items.withColumn("status", status)


FAMILIES = {"advance_rate_override": "rate", "component_sublimit_override": "sublimit", "component_sublimit_waiver": "sublimit", "reserve_override": "reserve", "reserve_waiver": "reserve"}


def _active(adjustments: DataFrame, as_of: Column) -> DataFrame:
    on = adjustments.where((F.col("effective_from") <= as_of) & (F.col("effective_to").isNull() | (as_of <= F.col("effective_to"))))
    return on.withColumn("family", F.element_at(F.create_map(*[F.lit(x) for kv in [*FAMILIES.items(), ("availability_block", "block")] for x in kv]), F.col("kind")))


def active_conflicts(adjustments: DataFrame, as_of: Column, scope: list[str]) -> DataFrame:
    """Targets with more than one active adjustment of a family; blocks add up and never conflict. Must be empty."""
    return _active(adjustments, as_of).where("family <> 'block'").groupBy(*scope, "family", "target").count().where("count > 1")


def adjustment_levers(adjustments: DataFrame, as_of: Column, policy: Policy, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(levers of ``component_base``, levers of ``facility_state``) of the adjustments active on a day (inclusive end).

    kinds: advance_rate_override, component_sublimit_override and _waiver (target: a class), reserve_override and _waiver (target: a
    reserve), availability_block. Two active ones for one target end the run.
    """
    on = _active(adjustments, as_of)
    of = lambda kind, name: F.max(F.when((F.col("kind") == kind) & (F.col("target") == name) if name else F.col("kind") == kind, money("value")))
    is_on = lambda kind, name: F.coalesce(F.bool_or((F.col("kind") == kind) & ((F.col("target") == name) if name else F.lit(True))), F.lit(False))
    by_class = on.where(F.col("family").isin("rate", "sublimit")).groupBy(*scope, F.col("target").alias("collateral_class")).agg(
        of("advance_rate_override", None).alias("rate_override"), of("component_sublimit_override", None).alias("sublimit_override"), is_on("component_sublimit_waiver", None).alias("sublimit_waived"),
        F.count_if(F.col("family") == "rate").alias("rates"), F.count_if(F.col("family") == "sublimit").alias("sublimits"),
    )
    names = [n for n, _ in policy.reserves]
    by_scope = on.where(F.col("family").isin("reserve", "block")).groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(F.col("family") == "block", money("value"))), lit(0)).cast(M).alias("extra_block"),
        *[x for n in names for x in (of("reserve_override", n).alias(f"override_{n}"), is_on("reserve_waiver", n).alias(f"waived_{n}"), F.count_if((F.col("family") == "reserve") & (F.col("target") == n)).alias(f"n_{n}"))],
    )
    one = lambda n, c: F.when(n > 1, F.raise_error(F.lit("several active adjustments for one target"))).otherwise(F.col(c)).alias(c)
    classes = by_class.select(*scope, "collateral_class", one(F.col("rates"), "rate_override"), one(F.col("sublimits"), "sublimit_override"), "sublimit_waived")
    return classes, by_scope.select(*scope, "extra_block", *[x for n in names for x in (one(F.col(f"n_{n}"), f"override_{n}"), F.col(f"waived_{n}"))])


def collateral_violations(collateral: DataFrame, classes: list[str]) -> DataFrame:
    """(rule, rows): repeated record ids, unknown classes, basis over gross, missing values. Must be empty to calculate."""
    bad = collateral.agg(
        F.sum((~F.col("collateral_class").isin(classes)).cast("long")).alias("unknown_class"),
        F.sum((F.col("basis_value") > F.col("gross_value")).cast("long")).alias("basis_over_gross"),
        F.sum((F.col("basis_value").isNull() | F.col("gross_value").isNull()).cast("long")).alias("value_missing"),
    )
    long = bad.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(c, F.lit(0)).alias("rows")) for c in bad.columns])).alias("x")).select("x.*")
    twice = collateral.groupBy("record_id").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit("record_id_repeated").alias("rule"), "rows")
    return long.union(twice).where("rows > 0")


def reconcile_cash(cash: DataFrame, scope: list[str], tolerance: str = "0") -> DataFrame:
    """Cash by kind (opening, receipt, application, paydown, reported), unapplied cash, expected ending balance and breaks."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, money("amount"))), lit(0)).cast(M).alias(k)
    t = cash.groupBy(*scope).agg(*[of(k) for k in ("opening", "receipt", "application", "paydown", "reported")])
    t = t.withColumn("unapplied", (F.col("receipt") - F.col("application")).cast(M)).withColumn("expected", (F.col("opening") - F.col("paydown")).cast(M))
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) > lit(tolerance)
    breaks = F.array_compact(F.array(F.when(F.abs("unapplied") > lit(tolerance), "unapplied_cash"), F.when(far("application", "paydown"), "application_paydown"), F.when(far("expected", "reported"), "ending_balance")))
    return t.withColumn("breaks", F.array_join(breaks, ",")).withColumn("passed", F.size(breaks) == 0)


def as_amounts(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast(WIDE))
    return df


def reprice(components: DataFrame, policy: Policy) -> DataFrame:
    """advanced and contribution from eligible. Where these columns are given and not null: rate_override in place of the
    policy's rate, rate_multiplier on it (a rate over 1 ends the run), sublimit_override, sublimit_waived."""
    has = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), default) if c in components.columns else default
    rate = (has("rate_override", M, _per_class(policy, "advance_rate", None)) * has("rate_multiplier", "decimal(10,6)", lit(1).cast("decimal(10,6)"))).cast(M)
    rate = F.when(rate > 1, F.raise_error(F.lit("an advance rate exceeds 1")).cast(M)).otherwise(rate)
    limit = F.when(~has("sublimit_waived", "boolean", F.lit(False)), has("sublimit_override", M, _per_class(policy, "sublimit", None)))
    out = components.withColumn("advanced", (F.col("eligible") * rate).cast(M))
    out = out.withColumn("contribution", F.least("advanced", F.coalesce(limit, F.col("advanced"))).cast(M))
    return out.drop("rate_override", "rate_multiplier", "sublimit_override", "sublimit_waived")
