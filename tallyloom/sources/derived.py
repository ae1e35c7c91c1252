"""Contracts and payments derived from the order tables.

The tables hold no contracts, so each customer gets one: the fee from the key, the
rhythm from the segment, the start from the first order. Payments follow the billings
with shortfalls planted by the billing's ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.money import percent_down
from tallyloom.operators.schedule import expected_timeline, previous_rate

WINDOW = ("1995-01-01", "2001-12-31")
RHYTHM = {"AUTOMOBILE": "monthly", "BUILDING": "quarterly", "FURNITURE": "annual", "HOUSEHOLD": "one_time"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("client_id")).agg(F.min("o_orderdate").cast("date").alias("start_date"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "client_id")
    rhythm = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in RHYTHM.items()], F.lit("unknown"))
    discount = F.struct(F.lit(10).cast("decimal(9,6)").alias("percentage"), F.lit(3).alias("duration_months"))
    return c.join(first, "client_id").select(
        "client_id", F.col("client_id").alias("contract_id"), F.col("c_name").alias("client_name"),
        (1000 + 100 * (F.col("client_id") % 50)).cast("decimal(18,2)").alias("base_amount"),
        rhythm.alias("frequency"), "start_date", F.lit(None).cast("date").alias("end_date"),
        (2 + F.col("c_nationkey") % 7).cast("decimal(9,6)").alias("esc_pct"), F.lit(12).alias("esc_after"),
        F.when(F.col("client_id") % 2 == 0, F.array(discount)).alias("discounts"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline with entry_ord within the client and a unique entry_id."""
    # few small rows make many: they are dealt to more tasks first (as many as the join has would be no new deal)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = expected_timeline(contracts(spark, sf_dir).repartition(tasks, "client_id"), *WINDOW)
    w = Window.partitionBy("client_id").orderBy("billing_date", "payment_type")
    line = line.withColumn("entry_ord", F.row_number().over(w) - 1)
    return line.withColumn("entry_id", F.col("client_id") * 1000 + F.col("entry_ord"))


def planted(timeline: DataFrame) -> DataFrame:
    """Timeline -> truth: planted type, amount paid (null: nothing) and date."""
    kind = (F.col("entry_ord") + F.col("client_id")) % 10
    lapsed = F.col("discounts").isNotNull() & (F.col("applied_discount_pct") == 0)
    t = timeline.withColumn(
        "planted_type",
        F.when(kind == 0, "ghost_invoice").when((kind == 1) & F.col("applied_escalation"), "forgotten_raise")
        .when((kind == 2) & lapsed, "zombie_discount").when(kind == 3, "short_change"),
    )
    owed = F.col("expected_amount")
    paid = (
        F.when(F.col("planted_type") == "ghost_invoice", F.lit(None))
        .when(F.col("planted_type") == "forgotten_raise", previous_rate(timeline))
        .when(F.col("planted_type") == "zombie_discount", percent_down(owed, F.lit(10).cast("decimal(9,6)")))
        .when(F.col("planted_type") == "short_change", percent_down(owed, F.lit(20).cast("decimal(9,6)")))
        .otherwise(owed)
    )
    return t.withColumn("paid_amount", paid).withColumn("paid_on", F.date_add("billing_date", (F.col("client_id") % 7).cast("int")))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_of(entries(spark, sf_dir))


def payments_of(timeline: DataFrame) -> DataFrame:
    t = planted(timeline).filter("paid_amount IS NOT NULL")
    return t.select(
        F.col("entry_id").alias("txn_id"), "client_id", F.col("paid_on").alias("transaction_date"),
        F.col("paid_amount").alias("amount"), F.col("client_name").alias("description"), F.lit("bank").alias("source_type"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw bank receipts."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").cast("decimal(18,6)").cast("decimal(18,2)").alias("amount"), F.col("o_orderpriority").alias("description"),
    )
