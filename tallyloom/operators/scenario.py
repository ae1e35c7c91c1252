"""Scenarios with known answers: payments that follow a schedule except where a leak is planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.money import CENTS, cents, percent_down

NO_PAYMENTS = f"array<struct<days:int,amount:{CENTS}>>"


def planted(entries: DataFrame, plants: DataFrame) -> DataFrame:
    """entries as from ``expected_timeline`` with single rises; plants(client_id, month, kind,
    split) -> entries with kind (null: paid in full), paid and gap: the answer key.

    A ghost pays nothing, a forgotten raise the base amount, a zombie discount the first
    discount once more, a short change four fifths (``split``: in two payments)."""
    e = entries.withColumn("month", F.month("billing_date")).join(plants, ["client_id", "month"], "left")
    owed, kind = F.col("expected_amount"), F.col("kind")
    off = F.coalesce(F.get("discounts", 0)["percentage"], F.lit(0).cast("decimal(9,6)"))
    paid = (
        F.when(kind == "ghost_invoice", F.lit(0).cast(CENTS)).when(kind == "forgotten_raise", cents(F.col("base_amount")))
        .when(kind == "zombie_discount", percent_down(owed, off)).when(kind == "short_change", percent_down(owed, F.lit(20).cast("decimal(9,6)"))).otherwise(owed)
    )
    return e.withColumn("paid", paid).withColumn("gap", (owed - F.col("paid")).cast(CENTS))


def bank_lines(key: DataFrame, names: DataFrame, noisy: bool = False) -> DataFrame:
    """The answer key as bank lines: transaction_date, description, amount. names(client_id,
    variants array<string>): how a client writes itself, by turns. ``noisy``: payments come
    one to six days late, the same ones in every run."""
    late = lambda salt: F.when(F.lit(noisy), F.pmod(F.xxhash64("client_id", "month", F.lit(salt)), F.lit(6)).cast("int") + 1).otherwise(0)
    half = percent_down(F.col("expected_amount"), F.lit(50).cast("decimal(9,6)"))
    row = lambda days, amount: F.struct(days.cast("int").alias("days"), amount.cast(CENTS).alias("amount"))
    split = F.array(row(late(1), half), row(10 + late(2), F.col("paid") - half))
    rows = F.when(F.col("paid") == 0, F.array().cast(NO_PAYMENTS)).when(F.coalesce("split", F.lit(False)), split).otherwise(F.array(row(late(1), F.col("paid"))))
    out = key.join(names, "client_id").withColumn("_p", F.explode(rows))
    name = F.get("variants", F.col("month") % F.size("variants"))
    number = F.concat(F.lit("INV-"), F.date_format("billing_date", "yyyyMM"))
    return out.select(F.date_add("billing_date", F.col("_p.days")).alias("transaction_date"), F.concat_ws(" ", name, number).alias("description"), F.col("_p.amount").alias("amount"))


def summary(key: DataFrame) -> DataFrame:
    """What a scenario plants: findings and money by kind."""
    return key.filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.sum("gap").cast(CENTS).alias("gap"))
