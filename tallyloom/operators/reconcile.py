"""Payments against billings: bucket, sum, classify.

The bucket join has an equality on client and a month key: a billing is reachable from
its own month and, within the tolerance, from the months beside it, so each billing is
listed under the months its window touches. A client with very many payments is
thereby spread over its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import month_number
from tallyloom.functions.money import cents, percent_down
from tallyloom.operators.schedule import previous_rate

TOLERANCE_DAYS = 15


def best_bucket(entries: DataFrame, payments: DataFrame, tolerance_days: int = TOLERANCE_DAYS, within: tuple[str, ...] = ()) -> DataFrame:
    """(txn_id, entry_id, lag, amount): the billing each payment answers.

    Same client and same calendar month, or at most ``tolerance_days`` apart; a billing
    already issued beats one to come, then the nearest, then the earlier, then the
    smaller entry id. ``within``: columns (the run) that both have to share, too.
    """
    e = entries.select("entry_id", "client_id", "billing_date", *within)
    reach = [month_number(d) for d in (F.date_sub("billing_date", tolerance_days), F.date_add("billing_date", tolerance_days))]
    e = e.withColumn("_m", F.explode(F.sequence(*reach)))
    p = payments.select("txn_id", "client_id", "transaction_date", "amount", *within).withColumn("_m", month_number(F.col("transaction_date")))
    both = p.join(e, ["client_id", "_m", *within])
    lag = F.datediff("transaction_date", "billing_date")
    same = month_number(F.col("billing_date")) == F.col("_m")
    both = both.withColumn("lag", lag).filter(same | (F.abs("lag") <= tolerance_days))
    order = F.struct(F.when(F.col("lag") >= 0, 0).otherwise(1), F.abs("lag"), "billing_date", "entry_id", "lag", "amount")
    # by the keys of the join, too: a payment's billings are all in one place already
    best = both.groupBy("client_id", "_m", *within, "txn_id").agg(F.min(order).alias("_b"))
    return best.select("txn_id", "_b.entry_id", "_b.lag", "_b.amount")


def bucket_totals(entries: DataFrame, payments: DataFrame, tolerance_days: int = TOLERANCE_DAYS, within: tuple[str, ...] = ()) -> DataFrame:
    """Every entry with paid, n_payments and the largest payment's id; empty ones stay."""
    hit = best_bucket(entries, payments, tolerance_days, within)
    sums = hit.groupBy("entry_id").agg(
        F.sum("amount").cast("decimal(18,2)").alias("paid"), F.count("*").alias("n_payments"),
        F.max_by("txn_id", F.struct("amount", -F.col("txn_id"))).alias("representative_id"),
    )
    out = entries.join(sums, "entry_id", "left")
    return out.withColumn("paid", F.coalesce("paid", F.lit(0).cast("decimal(18,2)"))).fillna(0, ["n_payments"])


def unmatched(entries: DataFrame, payments: DataFrame, tolerance_days: int = TOLERANCE_DAYS, within: tuple[str, ...] = ()) -> DataFrame:
    """Attributed payments that answer no billing."""
    return payments.join(best_bucket(entries, payments, tolerance_days, within), "txn_id", "left_anti").filter("client_id IS NOT NULL")


def billing_span(entries: DataFrame, by: tuple[str, ...] = (), tolerance_days: int = 0) -> DataFrame:
    """First and last billing date, ``tolerance_days`` wider: where to look for payments. No row
    without billings."""
    out = entries.groupBy(*by).agg(F.date_sub(F.min("billing_date"), tolerance_days).alias("first_day"), F.date_add(F.max("billing_date"), tolerance_days).alias("last_day"))
    return out.filter("first_day IS NOT NULL")


def review_queue(findings: DataFrame, limit: int, status: str = "unverified") -> DataFrame:
    """The findings to look at next: those of one status, most money first, at most ``limit``."""
    return findings.filter(F.col("status") == status).orderBy(F.desc("gap"), "entry_id").limit(limit)


def _close(target: Column, pct: float = 1.0) -> Column:
    return F.greatest(target * F.lit(pct / 100).cast("decimal(6,4)"), F.lit(0.01).cast("decimal(18,4)"))


def _gap() -> Column:
    return (F.col("expected_amount") - F.col("paid")).cast("decimal(18,2)")


def is_short(tolerance_pct: float = 1.0) -> Column:
    """Whether ``classify`` gives a bucket an anomaly_type, from what is owed and paid alone."""
    owed, paid = F.col("expected_amount"), F.col("paid")
    held = lambda c: F.coalesce(c, F.lit(False))
    return ~held(owed <= 0) & (held(paid <= 0) | ~held(_gap() <= _close(owed, tolerance_pct)))


def classify(buckets: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Add gap, anomaly_type (null: fine, or overpaid), confidence and clause_role."""
    owed, paid = F.col("expected_amount"), F.col("paid")
    df = buckets.withColumn("gap", _gap()).withColumn("_prev", previous_rate(buckets))
    raise_off = F.abs(paid - F.col("_prev"))
    raised = F.when(F.col("applied_escalation") & (raise_off <= _close(F.col("_prev"))), raise_off)
    offs = F.transform(
        F.filter(F.coalesce("discounts", F.array().cast("array<struct<percentage:decimal(9,6),duration_months:int>>")), lambda d: d["percentage"] > 0),
        lambda d: F.when(
            F.abs(paid - percent_down(owed, d["percentage"])) <= _close(percent_down(owed, d["percentage"])),
            F.abs(paid - percent_down(owed, d["percentage"])),
        ),
    )
    lapsed = F.when(F.col("applied_discount_pct") == 0, F.array_min(offs))
    df = df.withColumn("_raise", raised).withColumn("_disc", lapsed)
    late = F.col("_raise").isNotNull() & (F.col("_disc").isNull() | (F.col("_raise") <= F.col("_disc")))
    fine = (owed <= 0) | (F.col("gap") <= _close(owed, tolerance_pct))
    kind = (
        F.when(owed <= 0, F.lit(None)).when(paid <= 0, "ghost_invoice").when(fine, F.lit(None))
        .when(late, "forgotten_raise").when(F.col("_disc").isNotNull(), "zombie_discount").otherwise("short_change")
    )
    df = df.withColumn("anomaly_type", kind)
    exact = F.when(F.when(late, F.col("_raise")).otherwise(F.col("_disc")) <= 0.01, 0.95).otherwise(0.85)
    short = F.round(0.5 + 0.4 * F.least(F.col("gap").cast("double") / owed.cast("double"), F.lit(1.0)), 2)
    t = F.col("anomaly_type")
    return df.withColumns(
        {
            "confidence": F.when(t == "ghost_invoice", 0.9).when(t == "short_change", short).when(t.isNotNull(), exact),
            "clause_role": F.when(t == "forgotten_raise", "escalation").when(t == "zombie_discount", "discount").when(t.isNotNull(), "base_fee"),
        }
    ).drop("_prev", "_raise", "_disc")


def reconcile(entries: DataFrame, payments: DataFrame, tolerance_days: int = TOLERANCE_DAYS, tolerance_pct: float = 1.0, within: tuple[str, ...] = ()) -> DataFrame:
    return classify(bucket_totals(entries, payments, tolerance_days, within), tolerance_pct)


def shortfalls(entries: DataFrame, payments: DataFrame, tolerance_days: int = TOLERANCE_DAYS, tolerance_pct: float = 1.0, within: tuple[str, ...] = ()) -> DataFrame:
    """``reconcile`` less what is fine: only billings that are short get classified."""
    return classify(bucket_totals(entries, payments, tolerance_days, within).filter(is_short(tolerance_pct)), tolerance_pct)


def score_against(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Answer key against findings: ok, missed, spurious, mistyped or misvalued."""
    f = found.select(*keys, F.col("anomaly_type").alias("f_type"), F.col("gap").alias("f_gap"))
    t = truth.select(*keys, F.col("anomaly_type").alias("t_type"), F.col("gap").alias("t_gap"))
    both = t.join(f, keys, "full_outer")
    verdict = (
        F.when(F.col("f_type").isNull(), "missed").when(F.col("t_type").isNull(), "spurious")
        .when(F.col("f_type") != F.col("t_type"), "mistyped").when(F.abs(F.col("f_gap") - F.col("t_gap")) > 0.01, "misvalued").otherwise("ok")
    )
    return both.withColumn("verdict", verdict)
