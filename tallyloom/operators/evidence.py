"""Searches that support or refute a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_band(payments: DataFrame, low: float, high: float) -> DataFrame:
    """Payments of any client in an amount band; reversed bounds are swapped."""
    a, b = (F.lit(x).cast("decimal(18,2)") for x in (low, high))
    return payments.filter(F.col("amount").between(F.least(a, b), F.greatest(a, b)))


def ledger(payments: DataFrame, client_id: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One client's payments (None: those of all clients), both days included; a missing
    bound does not hold."""
    rows = payments if client_id is None else payments.filter(F.col("client_id") == client_id)
    rows = rows if start is None else rows.filter(F.col("transaction_date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("transaction_date") <= F.lit(end).cast("date"))


def split_payments(targets: DataFrame, payments: DataFrame, tol: float = 0.02) -> DataFrame:
    """targets(client_id, target, start, end) -> combinations of one, two or three
    payments of the window, refunds among them, whose sum is within tol of the target. A
    target of 0 or less has none. Rows: client_id, size, ids.

    The last payment of a combination is looked up by what is missing: amounts lie in
    steps twice the slack wide, so it is in the step of the missing amount or one beside.
    Before that, payments and pairs go that the client's smallest or largest payments in
    their stead could not complete either.
    """
    t = targets.filter("target > 0").withColumn("slack", F.col("target") * F.lit(tol).cast("decimal(6,4)"))
    p = payments.join(t, "client_id").filter(F.col("transaction_date").between(F.col("start"), F.col("end")))
    p = p.select("client_id", "txn_id", "amount", "target", "slack")
    ends = p.groupBy("client_id").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    p = p.join(ends, "client_id")

    def step(x):
        return F.floor(x.cast("double") / (2 * F.col("slack").cast("double")))

    def fits(total, more: int):
        lacking = F.col("target") - total
        return (lacking + F.col("slack") >= more * F.col("low")) & (lacking - F.col("slack") <= more * F.col("high"))

    def completed(some: DataFrame, ids: list[str], total) -> DataFrame:
        lacking = F.col("target") - total
        beside = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: step(F.col("amount")) + i))
        last = p.filter(fits(F.col("amount"), len(ids))).select("client_id", F.col("txn_id").alias("id_z"), F.col("amount").alias("amount_z"), beside.alias("_k"))
        hit = some.withColumn("_k", step(lacking)).join(last, ["client_id", "_k"])
        hit = hit.filter((F.col(ids[-1]) < F.col("id_z")) & (F.abs(lacking - F.col("amount_z")) <= F.col("slack")))
        return hit.select("client_id", F.lit(len(ids) + 1).alias("size"), F.array(*ids, "id_z").alias("ids"))

    one = p.filter(F.abs(F.col("amount") - F.col("target")) <= F.col("slack"))
    one = one.select("client_id", F.lit(1).alias("size"), F.array("txn_id").alias("ids"))
    two = completed(p.filter(fits(F.col("amount"), 1)), ["txn_id"], F.col("amount"))
    a = p.filter(fits(F.col("amount"), 2))
    b = a.select("client_id", F.col("txn_id").alias("id_b"), F.col("amount").alias("amount_b"))
    both = F.col("amount") + F.col("amount_b")
    three = completed(a.join(b, "client_id").filter("txn_id < id_b").filter(fits(both, 1)), ["txn_id", "id_b"], both)
    return one.unionByName(two).unionByName(three)


def amount_range(gap, expected, slack_pct: float | None = None):
    """(low, high) around the missing amount, or around what was due if nothing is missing."""
    target = F.when(gap > 0, gap).otherwise(expected).cast("decimal(18,2)")
    slack = max(slack_pct or 15.0, 1.0) / 100
    return tuple(F.round(target * F.lit(x).cast("decimal(9,6)"), 2).cast("double") for x in (1 - slack, 1 + slack))


def search_window(billing_date, widen_days: int = 0):
    """(first, last) day that a search around a billing looks at."""
    days = 45 + max(widen_days, 0)
    return F.date_sub(billing_date, days), F.date_add(billing_date, days)


def confidence_after(confidence, verdict):
    """A confirmed finding is sure at least, a rejected one weak at most."""
    return F.when(verdict == "confirmed", F.greatest(confidence, F.lit(0.9))).when(verdict == "false_positive", F.least(confidence, F.lit(0.1))).otherwise(confidence)
