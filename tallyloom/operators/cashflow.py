"""Baseline, recovery and what a new cost would leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import month_key
from tallyloom.functions.money import cents


def revenue_by_month(receipts: DataFrame) -> DataFrame:
    """Months that have rows, with what came in; unattributed rows count."""
    return receipts.groupBy(month_key(F.col("transaction_date")).alias("month")).agg(F.sum("amount").cast("decimal(18,2)").alias("revenue"))


def baseline(monthly: DataFrame, expenses: float | None, months: int = 12) -> DataFrame:
    """One row over the last observed months: mean, count, surplus (null without expenses)."""
    last = monthly.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("month")))).filter(F.col("_r") <= months)
    one = last.agg(F.count("*").alias("months_observed"), cents(F.avg("revenue")).alias("monthly_revenue"))
    n = F.col("months_observed")
    cost = F.lit(expenses).cast("decimal(18,2)")
    return one.withColumns(
        {
            "monthly_revenue": F.coalesce("monthly_revenue", F.lit(0).cast("decimal(18,2)")),
            "confidence": F.when(n == 0, "none").when(n < 3, "low").otherwise("ok"),
        }
    ).withColumn("surplus", F.when((n > 0) & cost.isNotNull(), F.col("monthly_revenue") - cost))


def recovery(findings: DataFrame, months: Column) -> DataFrame:
    """Confirmed, unverified and rejected findings; confirmed money by month covered."""
    f = findings.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "confirmed", F.col("gap"))), F.lit(0)).cast("decimal(18,2)").alias("confirmed_total"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "unverified", F.col("gap"))), F.lit(0)).cast("decimal(18,2)").alias("unverified_total"),
        F.count_if(F.col("status") == "unverified").alias("unverified_count"),
        F.count_if(F.col("status") == "false_positive").alias("rejected_count"),
    )
    return f.withColumn("monthly", F.when(months > 0, cents(F.col("confirmed_total") / months)).otherwise(F.lit(0).cast("decimal(18,2)")))


def verdicts(base: DataFrame, recovered: DataFrame, costs: DataFrame) -> DataFrame:
    """costs(scenario, monthly_cost) against one baseline and one recovery row."""
    df = costs.crossJoin(base).crossJoin(recovered.select("monthly"))
    df = df.withColumn("after", F.col("surplus") + F.col("monthly") - F.col("monthly_cost"))
    # without known expenses a cost can only be held against revenue
    basis = F.when(F.col("confidence") != "none", F.coalesce("surplus", "monthly_revenue"))
    corrected = F.col("monthly_revenue") + F.col("monthly")
    return df.withColumns(
        {
            "basis": basis,
            "on_revenue": F.col("surplus").isNull(),
            "verdict": F.when(F.col("after").isNull(), "unknown").when(F.col("after") > 0, "yes").otherwise("no"),
            "why": F.when(F.col("after").isNull(), "no_history_or_expenses").when(F.col("after") <= 0, "does_not_fit")
            .when(F.col("surplus") > F.col("monthly_cost"), "fits_already").otherwise("fits_with_recovery"),
            "cost_share": F.when(
                (F.col("confidence") != "none") & (corrected != 0), F.round(F.col("monthly_cost").cast("double") / corrected.cast("double"), 4)
            ),
        }
    )


def projection(df: DataFrame, horizon: int = 12) -> DataFrame:
    """Running money with and without recovery for each scenario and month ahead: of the
    surplus, or of revenue where expenses are unknown. Without history there is none."""
    if horizon < 1:
        raise ValueError("horizon must be at least one month")
    ahead = df.filter("basis IS NOT NULL").withColumn("month_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    left = F.col("basis") - F.col("monthly_cost")
    return ahead.withColumns(
        {
            "with_recovery": (F.col("month_ahead") * (left + F.col("monthly"))).cast("decimal(18,2)"),
            "without_recovery": (F.col("month_ahead") * left).cast("decimal(18,2)"),
        }
    )


def allowed_figures(df: DataFrame) -> Column:
    """Sorted distinct figures that a sentence on a verdict may state: its amounts, shares as
    fraction and per cent, yearly cost and recovery, and the size of each."""
    cents = lambda c: F.round(c.cast("double"), 2)
    c = F.col
    stated = [c(x) for x in ("monthly_revenue", "surplus", "monthly", "months_observed", "monthly_cost", "after", "cost_share")]
    stated += [c("cost_share") * 100, c("monthly_cost") * 12, c("monthly") * 12, c("surplus") + c("monthly")]
    values = F.array_compact(F.array(*[cents(x) for x in stated]))
    return F.array_sort(F.array_distinct(F.concat(values, F.transform(values, F.abs))))


def offending(numbers: Column, allowed: Column, share: Column) -> Column:
    """Numbers that are not allowed: whole ones up to 12 are words, a share may lose decimals."""
    pct = share * 100
    short = F.array_compact(F.array(F.round(pct, 1), F.round(pct, 0), F.floor(pct).cast("double")))
    return F.filter(numbers, lambda n: ~(F.array_contains(allowed, n) | F.array_contains(short, n) | ((n <= 12) & (n == F.floor(n)))))
