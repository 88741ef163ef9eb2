"""All metrics of a surveillance pack in one pass over the tape, finalised: availability, coverage, suppression and hashes.

A loan's rows meet once, by a shuffle on the loan: each row gets the loan's row of the next and of the prior date, and these rows are
written to the shared folder. Each contribution of a definition is then a filter and a sum by cell over the few columns it names, all
of them in one job; expanding each row into all its contributions made one method that the JVM does not compile, and a wide decimal
sum for each digest. Denominators, coverage and populations of a cell's group are sums over its cells. A loan contributes to a cell
once, so populations are counts, and their hashes sums of token digests: no set of tokens is ever held. Digests are summed as halves
of 64 bits in longs within a task, as decimals over tasks.
The summed cells are written to the shared folder, and whatever compares cells reads that small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import population_filter
from ..functions.scalars import Bin, days_between, definition_hash, entity_token, months_until, numeric_bin, row_token
from ..functions.tables import settled

KEY = ["source_system", "facility_id", "loan_id"]
LANES = 4
CELL = ["d", "m", "i", "g", "s"]
#: Per metric its unit, the group in which one suppressed cell would be given away (with the cell's own group or
#: not), and whether a zero denominator makes it unavailable.
METRICS = {
    "transition_share": ("ratio", "transition", True, True),
    "default_incidence": ("ratio", "default", False, True),
    "ever_dpd_incidence": ("ratio", "ever_dpd", False, True),
    "gross_loss_rate": ("ratio", "loss-rate", False, True),
    "net_loss_rate": ("ratio", "loss-rate", False, True),
    "recovery_amount": ("currency", "recovery", False, False),
    "recovery_lag_days": ("days", "recovery", False, True),
    "paydown_rate": ("ratio", "cashflow", False, True),
    "prepayment_rate": ("ratio", "cashflow", False, True),
    "rating_transition_share": ("ratio", "rating", True, True),
    "outstanding_balance": ("currency", "balance", False, False),
    "remaining_balance_factor": ("ratio", "balance", False, True),
    "utilization": ("ratio", "balance", False, True),
    "maturity_balance_share": ("ratio", "maturity", False, True),
    "concentration_share": ("ratio", "concentration", False, True),
    "concentration_hhi": ("ratio", "hhi", False, True),
    "portfolio_change_amount": ("currency", "change", True, False),
    "portfolio_change_rate": ("ratio", "change", True, True),
    "period_driver_amount": ("currency", "drivers", True, False),
    "period_driver_share": ("ratio", "driver-shares", True, True),
}
DRIVERS = ["new_exposure", "exit", "balance_increase", "balance_decrease"]


@dataclass(frozen=True)
class Definition:
    """One metric of a pack. ``family`` is a key of FAMILIES, ``params`` its fields; ``population`` a filter tree, ``latest`` the number of
    dates that it sees. Null amounts count as zero under ``zero``; under ``unavailable`` one unknown makes a cell unavailable."""

    id: str
    family: str
    params: dict = field(default_factory=dict)
    version: int = 1
    population: dict | None = None
    latest: int = 120
    null_policy: str = "exclude"
    least_cell: int = 5
    complementary: bool = True
    least_ratio: float = 0.0
    least_records: int = 0
    most_cells: int | None = None

    def get(self, name: str, default=None):
        return self.params.get(name, default)


class Part(NamedTuple):
    """A contribution: the rows that make it; definition, metric, date, group and label of the cell; whether eligible, observed, in the
    population and in the numerator's; amounts. What is the same for all rows is no column."""

    when: Column
    d: int
    m: str
    i: Column
    g: Column | str
    s: Column | str
    el: Column | bool
    ob: Column | bool
    dn: Column | bool
    nm: Column | bool
    num: Column | int
    den: Column | int
    aux: Column | int


class _Row:
    """What definition ``d`` sees of a row: its own fields, and those of the loan's next and prior row of its population."""

    def __init__(self, d: int, definition: Definition, start: int, last: int):
        self.d, self.of, self.start, self.last = d, definition, start, last
        self.i, self.here = F.col("i"), F.col(f"in_{d}")
        near = lambda side, i: F.col(f"{side}.i").isNotNull() & (F.col(f"{side}.i") == i) & F.col(f"{side}.in_{d}")
        self.has_next, self.has_prior = F.coalesce(near("nxt", self.i + 1), F.lit(False)), F.coalesce(near("prv", self.i - 1), F.lit(False))
        self.starts, self.ends = self.here & (self.i < last), self.here & (self.i > start)
        self.single = last - start < 1

    def amount(self, name: str, side: str = "") -> Column:
        c = F.col(f"{side}{name}").cast("decimal(38,2)")
        return F.coalesce(c, F.lit(0).cast("decimal(38,2)")) if self.of.null_policy == "zero" else c

    def part(self, when: Column, metric: str, i: Column, g: Column | str = "", s: Column | str = "", el=True, ob=True, dn=True, nm=False, num=0, den=0, aux=0) -> Part:
        return Part(when, self.d, metric, i, g, s, el, ob, dn, nm, num, den, aux)

    def nothing_before(self, *metrics: str) -> list[Part]:
        """A metric over pairs where there is one date only: the whole population, nothing observed."""
        return [self.part(self.here, m, F.lit(-1), ob=False) for m in metrics]


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _transition(r: _Row) -> list[Part]:
    """Share of each from-band's observed balance that went to each to-band."""
    if r.single:
        return r.nothing_before("transition_share")
    dpd, bins = r.of.get("delinquency", "days_past_due"), r.of.params["bins"]
    band = lambda c: numeric_bin(c, bins, *_outside(r.of))
    balance = r.amount(r.of.get("balance", "outstanding_balance"))
    seen = r.has_next & F.col(dpd).isNotNull() & balance.isNotNull() & F.col(f"nxt.{dpd}").isNotNull()
    return [r.part(r.starts, "transition_share", r.i + 1, band(dpd), F.when(seen, band(f"nxt.{dpd}")), ob=seen, nm=seen, num=F.when(seen, balance), den=F.when(seen, balance))]


def _outside(d: Definition) -> tuple[str, str]:
    return d.get("unknown", "Unknown"), d.get("other", "Outside")


def _default(r: _Row) -> list[Part]:
    """Incidence of default between dates, and of ever having reached a number of days past due."""
    flag, dpd, balance = r.of.get("default_flag", "default_flag"), r.of.get("delinquency", "days_past_due"), r.amount(r.of.get("balance", "outstanding_balance"))
    weight = F.lit(1) if r.of.get("basis", "count") == "count" else balance
    seen = r.has_next & F.col(flag).isNotNull() & balance.isNotNull() & F.col(f"nxt.{flag}").isNotNull()
    event = seen & _is(F.col(f"nxt.{flag}"))
    out = [
        r.part(r.here & (r.i == r.start), "default_incidence", r.i, ob=False),
        r.part(r.starts & ~_is(F.col(flag)), "default_incidence", r.i + 1, ob=seen, dn=seen, nm=event, num=F.when(event, weight), den=F.when(seen, weight)),
    ]
    known = balance.isNotNull() & ~F.col(f"gap_{r.d}")
    for t in r.of.get("thresholds", ()):
        event = known & _is(F.col(f"worst_{r.d}") >= t)
        out.append(r.part(r.here, "ever_dpd_incidence", r.i, str(t), ob=known, dn=known, nm=event, num=F.when(event, weight), den=F.when(known, weight)))
    return out


def _loss(r: _Row) -> list[Part]:
    """Gross and net loss rates, recoveries and their lag; cumulative flows are differences from the prior date."""
    fields = [r.of.get("loss", "charge_off_amount"), r.of.get("recovery", "recovery_amount")]
    loss, rec = (r.amount(f) for f in fields)
    if r.of.get("flows", "period") == "cumulative":
        back = r.has_prior & (r.i > r.start)
        loss, rec = (now - F.when(back, r.amount(f, "prv.")).otherwise(F.lit(0).cast("decimal(38,2)")) for now, f in zip((loss, rec), fields, strict=True))
    exposure, date = r.amount(r.of.get("exposure", "outstanding_balance")), r.of.get("default_date", "default_date")
    gross, both = loss.isNotNull() & exposure.isNotNull(), loss.isNotNull() & rec.isNotNull() & exposure.isNotNull()
    zero = F.lit(0).cast("decimal(38,2)")
    paid = _is(rec > 0)
    dated = paid & F.col(date).isNotNull()
    lag = days_between(date, "as_of_date")
    lag = F.when(lag < 0, F.raise_error(F.lit("a default date is after its snapshot")).cast("int")).otherwise(lag)
    return [
        r.part(r.here, "gross_loss_rate", r.i, ob=gross, dn=gross, nm=gross & (loss != 0), num=loss, den=F.when(gross, exposure)),
        r.part(r.here, "net_loss_rate", r.i, ob=both, dn=both, nm=both & (loss != rec), num=F.coalesce(loss, zero) - F.coalesce(rec, zero), den=F.when(both, exposure)),
        r.part(r.here, "recovery_amount", r.i, ob=rec.isNotNull(), dn=rec.isNotNull(), nm=_is(rec != 0), num=rec),
        r.part(r.here, "recovery_lag_days", r.i, el=paid, ob=dated, dn=dated, nm=dated, num=F.when(dated, rec * lag), den=F.when(dated, rec), aux=rec),
    ]


def _paydown(r: _Row) -> list[Part]:
    """Declines of balance, and what of them is beyond the scheduled principal; a loan that left is paid to zero."""
    if r.single:
        return r.nothing_before("paydown_rate", "prepayment_rate")
    name, plan = r.of.get("balance", "outstanding_balance"), r.of.get("scheduled")
    before, after = r.amount(name), F.when(r.has_next, r.amount(name, "nxt.")).otherwise(F.lit(0).cast("decimal(38,2)"))
    seen = before.isNotNull() & after.isNotNull()
    fall = F.greatest(before - after, F.lit(0).cast("decimal(38,2)"))
    due = r.amount(plan, "nxt.") if plan else F.lit(None).cast("decimal(38,2)")
    known = seen & r.has_next & due.isNotNull()
    over = F.greatest(fall - due, F.lit(0).cast("decimal(38,2)"))
    return [
        r.part(r.starts, "paydown_rate", r.i + 1, ob=seen, dn=seen, nm=seen & (fall > 0), num=F.when(seen, fall), den=F.when(seen, before)),
        r.part(r.starts, "prepayment_rate", r.i + 1, ob=known, dn=known, nm=known & (over > 0), num=F.when(known, over), den=F.when(seen, before)),
    ]


def _present(name: str) -> Column:
    c = F.col(name).cast("string")
    return F.when(c != "", c)


def _rating(r: _Row) -> list[Part]:
    """Share of each rating's observed balance that went to each rating; loans without a rating at the start take no part."""
    if r.single:
        return r.nothing_before("rating_transition_share")
    name, balance = r.of.get("rating", "risk_rating"), r.amount(r.of.get("balance", "outstanding_balance"))
    before, after = _present(name), F.when(r.has_next, _present(f"nxt.{name}"))
    seen = after.isNotNull() & balance.isNotNull()
    return [r.part(r.starts & before.isNotNull(), "rating_transition_share", r.i + 1, before, after, ob=seen, dn=seen, nm=seen, num=F.when(seen, balance), den=F.when(seen, balance))]


def _balance(r: _Row) -> list[Part]:
    """Balance, its share of the original balance and of the commitment, by cohort if asked for."""
    now, original, limit = (r.amount(r.of.get(k, v)) for k, v in (("balance", "outstanding_balance"), ("original", "original_balance"), ("commitment", "commitment_amount")))
    grain = r.of.get("grain")
    group = F.trunc(r.of.get("cohort", "origination_date"), grain).cast("string") if grain else F.lit("Portfolio")
    seen = now.isNotNull() & original.isNotNull() & limit.isNotNull()
    held = lambda m, den: r.part(r.here & group.isNotNull(), m, r.i, group, ob=seen, dn=seen, nm=seen, num=F.when(seen, now), den=F.when(seen, den))
    return [held("outstanding_balance", F.lit(0)), held("remaining_balance_factor", original), held("utilization", limit)]


def _maturity(r: _Row) -> list[Part]:
    """Share of balance by the first window that the months to maturity don't pass."""
    date, balance = r.of.get("maturity", "maturity_date"), r.amount(r.of.get("balance", "outstanding_balance"))
    months = months_until("as_of_date", date)
    label = F.when(months < 0, "Matured")
    for name, end in r.of.params["windows"]:
        label = label.when(months <= end, name)
    seen = F.col(date).isNotNull() & balance.isNotNull() & (F.lit(r.of.get("matured", True)) | _is(months >= 0))
    return [r.part(r.here, "maturity_balance_share", r.i, "", F.when(seen, label.otherwise("Beyond")), ob=seen, dn=seen, nm=seen, num=F.when(seen, balance), den=F.when(seen, balance))]


def _concentration(r: _Row) -> list[Part]:
    """Balance by category; ids only through their resolved tokens."""
    name, balance = r.of.params["field"], r.amount(r.of.get("balance", "outstanding_balance"))
    if name in ("borrower_id", "account_debtor_id") and not r.of.get("resolved"):
        return [r.part(r.here, "concentration_share", F.lit(-2), ob=False)]
    if r.of.get("bins"):
        label = numeric_bin(name, r.of.params["bins"], *_outside(r.of))
    elif r.of.get("resolved"):
        known = F.col(r.of.params["resolved"])
        label = F.when(_present(name).isNotNull(), entity_token(r.of.get("tenant", ""), name, F.coalesce(known, F.concat_ws("\u001f", F.coalesce(_present("source_system"), F.lit("default")), name)), known.isNotNull()))
    else:
        label = _present(name)
    seen = balance.isNotNull() & label.isNotNull()
    return [r.part(r.here, "concentration_share", r.i, "", F.when(seen, label), ob=seen, dn=seen, nm=seen, num=F.when(seen, balance), den=F.when(seen, balance))]


def _comparison(r: _Row) -> list[Part]:
    """Change of balance by segment and driver. A loan that changes its segment leaves one and is new in the other."""
    if r.single:
        return r.nothing_before("portfolio_change_amount")
    name, balance = r.of.get("field"), r.of.get("balance", "outstanding_balance")
    segment = lambda side="": _present(f"{side}{name}") if name else F.lit("Portfolio")
    mine, amount = segment(), r.amount(balance)
    counted = mine.isNotNull() & amount.isNotNull()
    same = lambda side, has: has & _is(segment(side) == mine) & r.amount(balance, side).isNotNull()
    stays, new = same("nxt.", r.has_next), ~same("prv.", r.has_prior & (r.i > r.start))
    change = F.when(stays, r.amount(balance, "nxt.")).otherwise(F.lit(0).cast("decimal(38,2)")) - amount
    driver = F.when(~stays, "exit").when(change > 0, "balance_increase").when(change < 0, "balance_decrease")
    out = []
    for metric, split, share in (("portfolio_change_amount", False, False), ("portfolio_change_rate", False, True), ("period_driver_amount", True, False), ("period_driver_share", True, True)):
        out.append(r.part(r.starts & counted, metric, r.i + 1, mine, driver if split else "", nm=driver.isNotNull(), num=change, den=amount if share else 0, aux=stays.cast("int")))
        out.append(r.part(r.ends & counted & new, metric, r.i, mine, "new_exposure" if split else "", el=False, dn=not share, nm=True, num=amount, aux=1))
    return out


#: Per family: its contributions, and the parameters that name fields of the tape, with their defaults.
FAMILIES = {
    "roll_cure": (_transition, {"delinquency": "days_past_due", "balance": "outstanding_balance"}),
    "default_ever": (_default, {"default_flag": "default_flag", "delinquency": "days_past_due", "balance": "outstanding_balance"}),
    "loss_recovery": (_loss, {"loss": "charge_off_amount", "recovery": "recovery_amount", "exposure": "outstanding_balance", "default_date": "default_date"}),
    "paydown_prepayment": (_paydown, {"balance": "outstanding_balance", "scheduled": None}),
    "rating_migration": (_rating, {"rating": "risk_rating", "balance": "outstanding_balance"}),
    "balance_utilization": (_balance, {"balance": "outstanding_balance", "original": "original_balance", "commitment": "commitment_amount", "cohort": "origination_date"}),
    "maturity_wall": (_maturity, {"maturity": "maturity_date", "balance": "outstanding_balance"}),
    "concentration": (_concentration, {"field": None, "balance": "outstanding_balance", "resolved": None}),
    "period_comparison": (_comparison, {"field": None, "balance": "outstanding_balance"}),
}


#: Parameters whose fields are looked at in a loan's next, and in its prior row.
NEXT = {"delinquency", "balance", "default_flag", "scheduled", "rating", "field"}
PRIOR = {"loss", "recovery", "balance", "field"}


def _check(definitions: list[Definition]) -> None:
    if len({d.id for d in definitions}) != len(definitions):
        raise ValueError("one version of a definition may run")
    for d in definitions:
        if d.family not in FAMILIES:
            raise ValueError(f"unknown family {d.family}")
        if d.null_policy not in ("exclude", "zero", "unavailable"):
            raise ValueError(f"unknown null policy {d.null_policy}")
        name = d.get("field") or ""
        if name.endswith("_id") and (d.family == "period_comparison" or d.family == "concentration" and name not in ("borrower_id", "account_debtor_id")):
            raise ValueError(f"{d.id}: {name} is an identifier")


def contributions(tape: DataFrame, definitions: list[Definition], dates: list) -> DataFrame:
    """The rows that contributions are taken from: the tape's, with what definitions see of the loan's rows of the next (``nxt``) and prior date (``prv``) and the digest of its
    token, as four longs. A loan of two rows on one date, or without an id, ends the run."""
    spark, n = tape.sparkSession, len(dates)
    named = lambda kinds: {v for d in definitions for k, default in FAMILIES[d.family][1].items() if k in kinds and (v := d.get(k, default))}
    fields = named({k for _, kinds in FAMILIES.values() for k in kinds})
    names = sorted((fields | {"as_of_date"}) - set(KEY))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    loan = F.coalesce(F.col("loan_id").cast("string"), F.raise_error(F.lit("loan_id is required")).cast("string"))
    starts = [max(0, n - d.latest) for d in definitions]
    index = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(dates)], "as_of_date date, i int"))
    rows = tape.join(index, "as_of_date")
    flags = [((population_filter(d.population) if d.population else F.lit(True)) & (F.col("i") >= s)).alias(f"in_{k}") for k, (d, s) in enumerate(zip(definitions, starts, strict=True))]
    token = row_token(*KEY)
    lanes = [F.conv(F.substring("token", 16 * j + 1, 16), 16, -10).cast("long").alias(f"t{j}") for j in range(LANES)]
    rows = rows.select(text("source_system").alias("source_system"), text("facility_id").alias("facility_id"), loan.alias("loan_id"), "i", *names, *flags, token.alias("token"))
    by = Window.partitionBy(*KEY).orderBy("i")
    near = lambda kinds: F.struct("i", *sorted(named(kinds)), *[f"in_{k}" for k in range(len(definitions))])
    rows = rows.withColumns({"nxt": F.lead(near(NEXT)).over(by), "prv": F.lag(near(PRIOR)).over(by)})
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    for k, d in enumerate(definitions):
        if d.family == "default_ever":
            dpd, mine = F.col(d.get("delinquency", "days_past_due")), F.col(f"in_{k}")
            rows = rows.withColumns({f"worst_{k}": F.max(F.when(mine, dpd)).over(so_far), f"gap_{k}": F.coalesce(F.max(mine & dpd.isNull()).over(so_far), F.lit(False))})
    twice = F.col("prv.i") == F.col("i")
    rows = rows.withColumn("i", F.when(_is(twice), F.raise_error(F.lit("a loan has two rows on one date")).cast("int")).otherwise(F.col("i")))
    held = [c for c in rows.columns if c != "token" and (c not in KEY or c in fields or c == "source_system")]
    return rows.select(*held, *lanes)


def parts(definitions: list[Definition], n: int) -> list[Part]:
    """The contributions of all definitions to ``n`` dates."""
    return [p for k, d in enumerate(definitions) for p in FAMILIES[d.family][0](_Row(k, d, max(0, n - d.latest), n - 1))]


def _spine(spark, definitions: list[Definition], n: int) -> DataFrame:
    """A contribution of nothing for every cell that is there whatever the rows: labels by dates."""
    rows = []
    for k, d in enumerate(definitions):
        start = max(0, n - d.latest)
        single, each, pairs = n - 1 - start < 1, range(start, n), range(start + 1, n)
        if d.family == "roll_cure":
            labels = [b.label for b in d.params["bins"]] + list(_outside(d))
            rows += [(k, "transition_share", -1, "", "")] if single else [(k, "transition_share", i, a, b) for i in pairs for a in labels for b in labels]
        elif d.family == "default_ever":
            rows += [(k, "default_incidence", i, "", "") for i in each] + [(k, "ever_dpd_incidence", i, str(t), "") for i in each for t in d.get("thresholds", ())]
        elif d.family == "loss_recovery":
            rows += [(k, m, i, "", "") for i in each for m in ("gross_loss_rate", "net_loss_rate", "recovery_amount", "recovery_lag_days")]
        elif d.family == "paydown_prepayment":
            rows += [(k, m, i, "", "") for i in ([-1] if single else pairs) for m in ("paydown_rate", "prepayment_rate")]
        elif d.family == "balance_utilization" and not d.get("grain"):
            pass  # a date without rows has no cell
        elif d.family == "maturity_wall":
            labels = (["Matured"] if d.get("matured", True) else []) + [w for w, _ in d.params["windows"]] + ["Beyond"]
            rows += [(k, "maturity_balance_share", i, "", w) for i in each for w in labels]
        elif d.family == "concentration":
            closed = d.params["field"] in ("borrower_id", "account_debtor_id") and not d.get("resolved")
            rows += [(k, "concentration_share", -2, "", "")] if closed else [(k, "concentration_share", i, "", None) for i in each]
        elif single and d.family == "rating_migration":
            rows.append((k, "rating_transition_share", -1, "", ""))
        elif single and d.family == "period_comparison":
            rows.append((k, "portfolio_change_amount", -1, "", ""))
    return spark.createDataFrame(rows, "d int, m string, i int, g string, s string")


_SUMS = ["el", "ob", "dn", "nm", "both", "num", "den", "aux", *[f"d{j}" for j in range(LANES)], *[f"n{j}" for j in range(LANES)]]


_KINDS = {c: "long" if c in ("el", "ob", "dn", "nm", "both") else "decimal(38,2)" if c in ("num", "den", "aux") else "decimal(38,0)" for c in _SUMS}


def _sum(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in _KINDS.items()])


def _nothing(rows: DataFrame) -> DataFrame:
    """The same types to the digit: a union of decimals of other scales would round."""
    return rows.select(*CELL, *[F.lit(0).cast(kind).alias(c) for c, kind in _KINDS.items()])


def summed_cells(tape: DataFrame, definitions: list[Definition], dates: list) -> DataFrame:
    """Sums by cell; a null ``s`` holds what belongs to the group alone."""
    rows = settled(contributions(tape, definitions, dates), "rows")
    halves = [f"{half} AS {side}{j}" for j in range(LANES) for side, half in (("h", f"shiftrightunsigned(t{j}, 32)"), ("l", f"t{j} & 4294967295L"))]
    rows = rows.selectExpr(*[c for c in rows.columns if c not in {f"t{j}" for j in range(LANES)}], *halves, "spark_partition_id() AS task")
    sums = [part_sums(rows, p) for p in parts(definitions, len(dates))]
    return _sum(reduce(DataFrame.unionByName, sums, _nothing(_spine(tape.sparkSession, definitions, len(dates)))), CELL)


def part_sums(rows: DataFrame, p: Part) -> DataFrame:
    """Sums of one contribution by cell and task. A task's sums of 32-bit halves stay far below the end of a long."""
    given = p._asdict()
    columns = {k: c for k, c in given.items() if isinstance(c, Column) and k != "when"}
    amounts, flags = [k for k in ("num", "den", "aux") if k in columns], ("el", "ob", "dn", "nm")
    each = rows.where(p.when).select("task", *[f"{side}{j}" for j in range(LANES) for side in "hl"], *[c.alias(k) for k, c in columns.items()])
    # What is no column is the same for all rows; where one population is the other, its digests are summed once.
    of = {k: f"CAST(COALESCE({k}, FALSE) AS BIGINT)" if k in columns else f"{int(given[k])}L" for k in flags}
    sides = ["dn"] if p.nm is p.dn or p.nm is False else ["dn", "nm"]
    sums = {k: of[k] for k in flags} | {"n": "1L", "both": f"{of['dn']} * {of['nm']}"} | {k: f"CAST({k} AS DECIMAL(38,2))" for k in amounts}
    sums |= {f"{side}_{half}{j}": f"{half}{j} * {of[side]}" for side in sides for half in "hl" for j in range(LANES)}
    by = [k for k in ("i", "g", "s") if k in columns]
    found = each.groupBy(*by, "task").agg(*[F.expr(f"SUM({v}) AS {k}") for k, v in sums.items()])
    whole = lambda side, j: f"CAST({side}_h{j} AS DECIMAL(20,0)) * CAST(4294967296 AS DECIMAL(10,0)) + CAST({side}_l{j} AS DECIMAL(20,0))"
    out = {k: k for k in (*flags, "both")} | {k: f"COALESCE({k}, 0)" if k in amounts else f"n * {given[k]}" for k in ("num", "den", "aux")}
    out |= {f"d{j}": whole("dn", j) for j in range(LANES)} | {f"n{j}": "0" if p.nm is False else whole(sides[-1], j) for j in range(LANES)}
    place = [k if k in columns else f"'{given[k]}' AS {k}" for k in ("g", "s")]
    return found.selectExpr(f"{p.d} AS d", f"'{p.m}' AS m", "CAST(i AS INT) AS i", *place, *[f"CAST({out[k]} AS {kind}) AS {k}" for k, kind in _KINDS.items()])


def _completed(cells: DataFrame, definitions: list[Definition]) -> DataFrame:
    """Cells that only the data name: every pair of ratings of a date, every driver of a segment; and the top of a concentration."""
    ratings = cells.where((F.col("m") == "rating_transition_share") & (F.col("i") >= 0))
    names = ratings.select("d", "m", "i", F.explode(F.array_compact(F.array("g", "s"))).alias("x")).distinct()
    pairs = names.withColumnRenamed("x", "g").join(names.withColumnRenamed("x", "s"), ["d", "m", "i"]).select(*CELL)
    segments = cells.where(F.col("m").isin("period_driver_amount", "period_driver_share")).select("d", "m", "i", "g").distinct()
    drivers = segments.select("d", "m", "i", "g", F.explode(F.array(*[F.lit(x) for x in DRIVERS])).alias("s"))
    whole = _sum(cells.unionByName(_nothing(pairs.union(drivers))), CELL)
    shares = (F.col("m") == "concentration_share") & (F.col("i") >= 0) & F.col("s").isNotNull()
    top = F.coalesce(*[F.when(F.col("d") == k, F.lit(d.get("top", 10))) for k, d in enumerate(definitions)], F.lit(0))
    ranked = whole.where(shares).withColumn("rank", F.row_number().over(Window.partitionBy("d", "i").orderBy(F.col("num").desc(), "s")))
    shown = ranked.withColumn("s", F.when(F.col("rank") <= top, F.col("s")).otherwise("Other")).drop("rank")
    return whole.where(~F.coalesce(shares, F.lit(False))).unionByName(_sum(shown, CELL))


def _per(definitions: list[Definition], value) -> Column:
    """A value of the definition, as an expression on ``d``."""
    return F.element_at(F.array(*[F.lit(value(d)) for d in definitions]), F.col("d") + 1)


def _dimensions(definitions: list[Definition], dates: list) -> Column:
    """The cell's dimensions as JSON with sorted keys."""
    day = lambda back: F.get(F.array(*[F.lit(str(x)) for x in dates]), F.col("i") - back)
    m, now, before = F.col("m"), day(0), F.when(F.col("i") > 0, day(1))
    order = _per(definitions, lambda d: [b.label for b in d.get("bins", ())] + list(_outside(d)) if d.family == "roll_cure" else [""])
    place = lambda c: F.array_position(order, F.col(c))
    movement = F.when(place("s") > place("g"), "roll").when(place("s") < place("g"), "cure").otherwise("stable")
    of = lambda name, default=None: _per(definitions, lambda d: str(d.get(name, default) or ""))
    json = lambda **names: F.to_json(F.struct(*[v.alias(k) for k, v in names.items()]))
    first = _per(definitions, lambda d: max(0, len(dates) - d.latest))
    cohort = _per(definitions, lambda d: bool(d.get("grain")))
    return (
        F.when(F.col("i") == -1, F.lit("{}"))
        .when(F.col("i") == -2, json(dimension=of("field")))
        .when(m == "transition_share", json(current_as_of_date=now, from_band=F.col("g"), movement=movement, previous_as_of_date=before, to_band=F.col("s")))
        .when((m == "default_incidence") & (F.col("i") == first), json(current_as_of_date=now))
        .when(m == "default_incidence", json(basis=of("basis", "count"), current_as_of_date=now, previous_as_of_date=before))
        .when(m == "ever_dpd_incidence", json(as_of_date=now, basis=of("basis", "count"), threshold_days=F.col("g")))
        .when(m.isin("gross_loss_rate", "net_loss_rate", "recovery_amount", "recovery_lag_days"), json(as_of_date=now, flow_semantics=of("flows", "period")))
        .when(m.isin("paydown_rate", "prepayment_rate"), json(current_as_of_date=now, previous_as_of_date=before))
        .when(m == "rating_transition_share", json(current_as_of_date=now, from_rating=F.col("g"), previous_as_of_date=before, to_rating=F.col("s")))
        .when(m.isin("outstanding_balance", "remaining_balance_factor", "utilization") & ~cohort, json(as_of_date=now))
        .when(m.isin("outstanding_balance", "remaining_balance_factor", "utilization"), json(as_of_date=now, cohort=F.col("g")))
        .when(m == "maturity_balance_share", json(as_of_date=now, maturity_window=F.col("s")))
        .when(m == "concentration_share", json(as_of_date=now, category=F.col("s"), dimension=of("field")))
        .when(m == "concentration_hhi", json(as_of_date=now, dimension=of("field")))
        .when(m.startswith("portfolio_change"), json(current_as_of_date=now, previous_as_of_date=before, segment=F.col("g")))
        .otherwise(json(current_as_of_date=now, driver=F.col("s"), previous_as_of_date=before, segment=F.col("g")))
    )


def raw_cells(summed: DataFrame, definitions: list[Definition], dates: list) -> DataFrame:
    """Figures, populations and availability of every cell, before anything is hidden."""
    whole = _completed(summed, definitions)
    group = Window.partitionBy("d", "m", "i", "g")
    over = {f"g_{c}": F.sum(c).over(group) for c in ("el", "ob", "dn", "den", "aux", *[f"d{j}" for j in range(LANES)])}
    cells = whole.withColumns(over)
    # The index of a concentration is over all categories, so over the cells before the top is taken.
    squares = summed.where((F.col("m") == "concentration_share") & (F.col("i") >= 0)).withColumn("whole", F.sum("den").over(Window.partitionBy("d", "i")))
    share = F.when(F.col("whole") != 0, F.col("num").cast("double") / F.col("whole").cast("double"))
    hhi = squares.groupBy("d", "i").agg(F.sum(F.when(F.col("s").isNotNull(), F.pow(share, 2))).alias("hhi"))
    one = cells.where((F.col("m") == "concentration_share") & (F.col("i") >= 0)).withColumn("first", F.row_number().over(group.orderBy("s"))).where("first = 1").drop("first")
    one = one.join(hhi, ["d", "i"]).withColumns({"m": F.lit("concentration_hhi"), "s": F.lit(""), "nm": F.col("g_dn"), "both": F.col("g_dn"), **{f"n{j}": F.col(f"g_d{j}") for j in range(LANES)}})
    cells = cells.where("s is not null").withColumn("hhi", F.lit(None).cast("double")).unionByName(one.select(*cells.columns, "hhi"))

    m, el, ob, den = F.col("m"), F.col("g_el"), F.col("g_ob"), F.col("g_den")
    el = F.when(m.startswith("portfolio_change") | m.startswith("period_driver"), F.greatest(el, F.col("g_aux").cast("long"))).otherwise(el)
    el = F.when(F.col("i") == -1, F.col("g_el")).otherwise(el)
    needs = m.isin(*[k for k, v in METRICS.items() if v[3]])
    strict = _per(definitions, lambda d: d.null_policy == "unavailable")
    first = _per(definitions, lambda d: max(0, len(dates) - d.latest))
    planned = _per(definitions, lambda d: bool(d.get("scheduled")))
    reason = (
        F.when((F.col("i") == -1) | (m == "default_incidence") & (F.col("i") == first), "no_prior_period")
        .when(F.col("i") == -2, "entity_resolution_unapproved")
        .when(m == "recovery_lag_days", F.when(den != 0, "available").when(F.col("g_aux") > 0, "missing_required_field").otherwise("no_records"))
        .when((m == "prepayment_rate") & ~planned, "missing_required_field")
        .when(el == 0, "no_records")
        .when(ob == 0, "missing_required_field")
        .when(strict & (ob < el), "missing_required_field")
        .when(needs & (den == 0), "division_by_zero")
        .otherwise("available")
    )
    amount = m.isin(*[k for k, v in METRICS.items() if v[0] == "currency"])
    value = F.when(m == "concentration_hhi", F.col("hhi")).when(amount, F.col("num").cast("double")).when(den != 0, F.col("num").cast("double") / den.cast("double"))
    unit, tag = (reduce(lambda c, kv, k=k: c.when(m == kv[0], kv[1][k]), list(METRICS.items())[1:], F.when(m == "transition_share", METRICS["transition_share"][k])) for k in (0, 1))
    own = m.isin(*[k for k, v in METRICS.items() if v[2]])
    alone = (F.col("i") < 0) | (m == "default_incidence") & (F.col("i") == first)
    return cells.select(
        "d",
        m.alias("metric"),
        unit.alias("unit"),
        _dimensions(definitions, dates).alias("dimensions"),
        F.concat_ws("\u001f", F.when(alone, F.lit("alone")), F.when(alone, m), "i", tag, F.when(own, F.col("g"))).alias("suppression_group"),
        F.when(m == "concentration_hhi", F.col("hhi")).otherwise(F.col("num").cast("double")).alias("numerator"),
        F.when(m == "concentration_hhi", F.lit(1.0)).when(~amount, den.cast("double")).alias("denominator"),
        value.alias("value"),
        ob.alias("observed"),
        el.alias("eligible"),
        F.col("g_dn").alias("denominator_population"),
        F.col("nm").alias("numerator_population"),
        (F.col("g_dn") - F.col("both")).alias("complement_population"),
        _hash("nm", "n").alias("numerator_hash"),
        _hash("g_dn", "g_d").alias("denominator_hash"),
        reason.alias("availability"),
    )


def _hash(count: str, lane: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col(count).cast("string"), *[F.col(f"{lane}{j}").cast("string") for j in range(LANES)]), 256)


def finalised(raw: DataFrame, definitions: list[Definition]) -> DataFrame:
    """Coverage, then primary and complementary suppression by each definition's bounds; hidden cells show no figure and no count."""
    least = _per(definitions, lambda d: d.least_cell)
    small = lambda c: (F.col(c) > 0) & (F.col(c) < least)
    rows = raw.withColumn("primary", small("denominator_population") | small("numerator_population") | small("complement_population"))
    group = Window.partitionBy("d", "suppression_group")
    rows = rows.withColumns({"hidden": F.sum(F.col("primary").cast("int")).over(group), "next": ~F.col("primary") & (F.col("numerator_population") > 0)})
    rank = F.row_number().over(Window.partitionBy("d", "suppression_group", "next").orderBy("numerator_population", "metric", "dimensions"))
    also = _per(definitions, lambda d: d.complementary) & (F.col("hidden") == 1) & F.col("next") & (rank == 1)
    rows = rows.withColumn("suppressed", F.col("primary") | also)
    ratio = F.when(F.col("eligible") > 0, F.col("observed").cast("double") / F.col("eligible").cast("double"))
    thin = ratio.isNull() | (ratio < _per(definitions, lambda d: float(d.least_ratio))) | (F.col("observed") < _per(definitions, lambda d: d.least_records))
    reason = F.when(F.col("suppressed"), "suppressed").when((F.col("availability") == "available") & thin, "insufficient_coverage").otherwise(F.col("availability"))
    seen = lambda c: F.when(reason == "available", F.col(c)).alias(c)
    shown = lambda c, name: F.when(~F.col("suppressed"), c).alias(name)
    out = rows.select(
        _per(definitions, lambda d: d.id).alias("definition_id"),
        _per(definitions, lambda d: d.version).alias("definition_version"),
        "metric", "unit", "dimensions", seen("numerator"), seen("denominator"), seen("value"),
        shown(F.col("observed"), "observed_count"), shown(F.col("eligible"), "eligible_count"), shown(ratio, "coverage"),
        reason.alias("availability"), "suppressed", "numerator_hash", "denominator_hash",
        F.sha2(F.concat_ws("\u001f", _per(definitions, lambda d: d.id), _per(definitions, lambda d: str(d.version)), "metric", "dimensions"), 256).alias("cell_id"),
        _per(definitions, lambda d: definition_hash([d.id, d.version, d.family, d.params, d.population, d.latest, d.null_policy])).alias("definition_hash"),
        "d",
    )
    most = _per(definitions, lambda d: -1 if d.most_cells is None else d.most_cells)
    n = F.count("*").over(Window.partitionBy("d"))
    over = (most >= 0) & (n > most)
    return out.withColumn("metric", F.when(over, F.raise_error(F.concat("definition_id", F.lit(" has more cells than it may"))).cast("string")).otherwise(F.col("metric"))).drop("d")


def run_pack(tape: DataFrame, definitions: list[Definition], most_dates: int = 120) -> DataFrame:
    """The finalised cells of all definitions. The tape is scanned once for its dates (one column) and once for everything else;
    more than ``most_dates`` snapshots end the run. Rows of one loan and date must be one."""
    _check(definitions)
    found = [r[0] for r in tape.select(F.col("as_of_date").cast("date").alias("x")).distinct().orderBy("x").limit(most_dates + 1).collect()]
    if len(found) > most_dates:
        raise ValueError(f"more than {most_dates} snapshots")
    if not found:
        raise ValueError("no snapshot")
    cells = settled(summed_cells(tape, definitions, found), "cells")
    return finalised(raw_cells(cells, definitions, found), definitions)
