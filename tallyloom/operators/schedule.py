"""Expected billings from contract rules.

Contracts: client_id, contract_id, base_amount, frequency, start_date, end_date,
esc_pct, esc_after, discounts array<struct<percentage, duration_months>>. A contract
without start date or amount has no billings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import calendar_months
from tallyloom.functions.money import CENTS, cents, factor_up, money_text, percent_down, percent_number, scaled, undo_percent_down

PERIODS = {"monthly": 1, "quarterly": 3, "annual": 12}
LONGEST = 1200
#: months that a contract without an end is billed for where no window is given
HORIZON = 12


NO_DISCOUNTS = "array<struct<percentage:decimal(9,6),duration_months:int>>"


def _rises(elapsed: Column, compound: bool = True) -> Column:
    """How often the price has risen after so many months."""
    after = F.col("esc_after")
    due = (after > 0) & F.col("esc_pct").isNotNull() & (elapsed >= after)
    return F.coalesce(F.when(due, F.floor(elapsed / after) if compound else F.lit(1)).cast("int"), F.lit(0))


def _discounted(rate: Column, elapsed: Column) -> Column:
    """struct(amount, pct): the discounts that hold taken off, each rounded; the last one's rate."""
    none = F.struct(rate.alias("amount"), F.lit(0).cast("decimal(9,6)").alias("pct"))
    off = F.aggregate(
        F.coalesce("discounts", F.array().cast(NO_DISCOUNTS)),
        none,
        lambda a, d: F.when(
            (elapsed >= 0) & (elapsed < d["duration_months"]),
            F.struct(percent_down(a["amount"], d["percentage"]).alias("amount"), d["percentage"].cast("decimal(9,6)").alias("pct")),
        ).otherwise(a),
    )
    return F.when((elapsed >= 0) & (elapsed < F.col("_until")), off).otherwise(none)


def with_bounds(contracts: DataFrame, window_start: str | Column | None, window_end: str | Column | None, horizon: int = HORIZON) -> DataFrame:
    """Contracts that can bill, with ``_low`` and ``_high``: the window (a date, or a column of
    the contracts), or the contract's own start and its end, or ``horizon`` months where it has
    none. Its end always holds."""
    day = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("date")
    known = contracts.filter("start_date IS NOT NULL AND base_amount IS NOT NULL")
    known = known.withColumn("_low", F.coalesce(day(window_start), "start_date"))
    open_end = F.add_months("_low", max(horizon - 1, 0))
    return known.withColumn("_high", F.least(F.coalesce(day(window_end), "end_date", open_end), "end_date"))


def expected_timeline(contracts: DataFrame, window_start: str | Column | None = None, window_end: str | Column | None = None, compound: bool = True, horizon: int = HORIZON) -> DataFrame:
    """Recurring billings in the window, stepped from the contract's start (month ends
    clamp to the anchor's day). One-time and unknown frequencies bill once, on the start.

    The rates after 0, 1, 2 ... rises are worked out once for a contract; a billing picks
    its own. ``previous_amount`` is what it would have cost one rise ago, at today's discount.
    """
    known = with_bounds(contracts, window_start, window_end, horizon)
    pairs = [F.lit(x) for k, v in PERIODS.items() for x in (k, v)]
    period = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("frequency")), F.lit(0))
    months = F.least(F.greatest(F.lit(0), calendar_months(F.col("start_date"), F.col("_high"))), F.lit(12 * LONGEST))
    steps = F.when(period > 0, F.least(F.lit(LONGEST), F.floor(months / F.greatest(period, F.lit(1))))).otherwise(0)
    most = F.greatest(_rises(months), F.lit(1))  # one rise at least, for schedules that raise once
    # the factor stands in the array, so that it is worked out once and not with every rise
    rates = F.aggregate(
        F.array_repeat(factor_up(F.col("esc_pct")), most), F.array(cents(F.col("base_amount"))), lambda a, up: F.concat(a, F.array(scaled(F.element_at(a, -1), up)))
    )
    until = F.array_max(F.transform("discounts", lambda d: d["duration_months"]))
    known = known.withColumns({"_rates": rates, "_until": F.coalesce(until, F.lit(0)), "_period": period})
    due = known.withColumn("_i", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    due = due.withColumn("billing_date", F.add_months("start_date", F.col("_i") * F.col("_period")))
    due = due.filter((F.col("billing_date") >= F.col("_low")) & (F.col("billing_date") <= F.col("_high")))
    now = calendar_months(F.col("start_date"), F.col("billing_date"))
    then = now - F.col("esc_after")
    due = due.withColumn("_n", _rises(now, compound))
    due = due.withColumns(
        {
            "_now": _discounted(F.get("_rates", F.col("_n")), now),
            "_then": F.when((F.col("esc_after") > 0) & F.col("esc_pct").isNotNull(), _discounted(F.get("_rates", _rises(then)), then)),
        }
    )
    bare = F.when(F.col("_then.pct") > 0, undo_percent_down(F.col("_then.amount"), F.col("_then.pct"))).otherwise(F.col("_then.amount"))
    before = F.when(F.col("_now.pct") > 0, percent_down(bare, F.col("_now.pct"))).otherwise(bare)
    return due.select(
        *contracts.columns, "billing_date", F.col("_now.amount").alias("expected_amount"), (F.col("_n") > 0).alias("applied_escalation"),
        F.col("_now.pct").alias("applied_discount_pct"), before.alias("previous_amount"), F.lit("recurring").alias("payment_type"),
    )


def milestone_rows(contracts: DataFrame, milestones: DataFrame, window_start: str | Column | None = None, window_end: str | Column | None = None, horizon: int = HORIZON) -> DataFrame:
    """Dated milestones (contract_id, amount, due_date) in the window, as timeline rows."""
    known = with_bounds(contracts, window_start, window_end, horizon)
    dated = known.join(milestones.filter("due_date IS NOT NULL"), "contract_id")
    dated = dated.filter((F.col("due_date") >= F.col("_low")) & (F.col("due_date") <= F.col("_high")))
    return dated.select(
        *[F.col(c) for c in contracts.columns], F.col("due_date").alias("billing_date"), cents(F.col("amount")).alias("expected_amount"),
        F.lit(False).alias("applied_escalation"), F.lit(0).cast("decimal(9,6)").alias("applied_discount_pct"),
        F.lit(None).cast(CENTS).alias("previous_amount"), F.lit("milestone").alias("payment_type"),
    )


def timeline(contracts: DataFrame, milestones: DataFrame, window_start: str | None = None, window_end: str | None = None, horizon: int = HORIZON) -> DataFrame:
    """Recurring billings and milestones together."""
    rows = expected_timeline(contracts, window_start, window_end, horizon=horizon)
    return rows.unionByName(milestone_rows(contracts, milestones, window_start, window_end, horizon))


def note(amount: Column) -> Column:
    """The line that explains a recurring billing's amount."""
    off, pct = F.col("applied_discount_pct"), F.col("esc_pct")
    plain = ~F.col("applied_escalation") & (off == 0)
    return F.concat_ws(
        " \u00b7 ", F.concat(F.lit("Base "), money_text(F.col("base_amount"))),
        F.when(F.col("applied_escalation"), F.concat(F.lit("+"), percent_number(pct), F.lit("% escalation applied"))),
        F.when(off > 0, F.concat(F.lit("-"), percent_number(off), F.lit("% discount active"))),
        F.when(plain, "contract rate, no adjustment"), F.concat(F.lit("= "), money_text(amount)),
    )


def row_clause(base: Column, escalation: Column, discounts: Column) -> Column:
    """Clause that explains a billing's amount: the rise's, else that of the discount with the
    rate taken off (discounts: array of struct(percentage, clause_id)), else the base fee's."""
    off = F.col("applied_discount_pct")
    match = F.get(F.filter(discounts, lambda d: d["percentage"] == off), 0)["clause_id"]
    return F.when(F.col("applied_escalation"), F.coalesce(escalation, base)).when(off > 0, F.coalesce(match, base)).otherwise(base)


def unresolved_milestones(milestones: DataFrame) -> DataFrame:
    return milestones.filter("due_date IS NULL")


def previous_rate(timeline: DataFrame) -> Column:
    """What a billing of the timeline would have cost one escalation step ago, at today's discount."""
    return timeline["previous_amount"]
