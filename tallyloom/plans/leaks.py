"""Queries from contracts to leaked money, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.money import shown
from tallyloom.operators import reconcile as rec
from tallyloom.operators import schedule as sch
from tallyloom.sources import derived as src
from tallyloom.sources.lineage import written

# rate after n rises, each rounded to cents; eight years hold at most seven rises
_RATES = ", ".join(
    f"CAST(round(r{k - 1} * (1 + esc_pct / 100), 2) AS DECIMAL(18,2)) AS r{k}" for k in range(1, 9)
)
BASE = f"""
WITH contracts AS (
  SELECT c_custkey AS client_id, c_name AS client_name, CAST(1000 + 100 * (c_custkey % 50) AS DECIMAL(18,2)) AS base_amount,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'monthly' WHEN 'BUILDING' THEN 'quarterly' WHEN 'FURNITURE' THEN 'annual'
      WHEN 'HOUSEHOLD' THEN 'one_time' ELSE 'unknown' END AS frequency,
    CAST(min(o_orderdate) AS DATE) AS start_date, CAST(2 + c_nationkey % 7 AS DECIMAL(9,6)) AS esc_pct, c_custkey % 2 = 0 AS has_disc
  FROM customer JOIN orders ON o_custkey = c_custkey
  GROUP BY c_custkey, c_name, c_mktsegment, c_nationkey
), rates AS (
  SELECT *, base_amount AS r0, {_RATES} FROM contracts
), due AS (
  SELECT c.*, CAST(c.start_date + to_months(CAST(i * CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 WHEN 'annual' THEN 12 ELSE 0 END AS INTEGER)) AS DATE) AS billing_date
  FROM rates c CROSS JOIN range(0, 84) t(i)
  WHERE i = 0 OR frequency IN ('monthly', 'quarterly', 'annual')
), aged AS (
  SELECT *, (year(billing_date) * 12 + month(billing_date)) - (year(start_date) * 12 + month(start_date)) AS elapsed
  FROM due WHERE billing_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
), rated AS (
  SELECT *, [r0, r1, r2, r3, r4, r5, r6, r7, r8][elapsed // 12 + 1] AS rate,
    CASE WHEN elapsed >= 12 THEN [r0, r1, r2, r3, r4, r5, r6, r7, r8][(elapsed - 12) // 12 + 1] END AS rate_before
  FROM aged
), entries AS (
  SELECT *, CASE WHEN has_disc AND elapsed < 3 THEN CAST(round(rate * 0.90, 2) AS DECIMAL(18,2)) ELSE rate END AS expected_amount,
    elapsed >= 12 AS applied_escalation, CASE WHEN has_disc AND elapsed < 3 THEN 10.0 ELSE 0.0 END AS applied_discount_pct,
    row_number() OVER (PARTITION BY client_id ORDER BY billing_date) - 1 AS entry_ord
  FROM rated
), keyed AS (
  SELECT *, client_id * 1000 + entry_ord AS entry_id,
    -- the rate one step ago, with a discount that held then taken off again
    CASE WHEN has_disc AND elapsed - 12 BETWEEN 0 AND 2
      THEN CAST(round(CAST(round(rate_before * 0.90, 2) AS DECIMAL(18,2)) / 0.90, 2) AS DECIMAL(18,2)) ELSE rate_before END AS prev
  FROM entries
), truth AS (
  SELECT *, CASE WHEN (entry_ord + client_id) % 10 = 0 THEN 'ghost_invoice'
    WHEN (entry_ord + client_id) % 10 = 1 AND applied_escalation THEN 'forgotten_raise'
    WHEN (entry_ord + client_id) % 10 = 2 AND has_disc AND applied_discount_pct = 0 THEN 'zombie_discount'
    WHEN (entry_ord + client_id) % 10 = 3 THEN 'short_change' END AS planted_type
  FROM keyed
), paid_rows AS (
  SELECT entry_id AS txn_id, client_id, CAST(billing_date + to_days(CAST(client_id % 7 AS INTEGER)) AS DATE) AS transaction_date, client_name AS description,
    CAST(CASE planted_type WHEN 'forgotten_raise' THEN prev WHEN 'zombie_discount' THEN round(expected_amount * 0.90, 2)
      WHEN 'short_change' THEN round(expected_amount * 0.80, 2) ELSE expected_amount END AS DECIMAL(18,2)) AS amount
  FROM truth WHERE planted_type IS NULL OR planted_type <> 'ghost_invoice'
), hits AS (
  SELECT p.txn_id, e.entry_id, p.amount, CAST(p.transaction_date - e.billing_date AS INTEGER) AS lag,
    row_number() OVER (PARTITION BY p.txn_id ORDER BY CASE WHEN p.transaction_date >= e.billing_date THEN 0 ELSE 1 END,
      abs(p.transaction_date - e.billing_date), e.billing_date, e.entry_id) AS r
  FROM paid_rows p JOIN keyed e ON p.client_id = e.client_id
    AND (abs(p.transaction_date - e.billing_date) <= 15 OR date_trunc('month', p.transaction_date) = date_trunc('month', e.billing_date))
), buckets AS (
  SELECT e.*, coalesce(h.paid, 0) AS paid, coalesce(h.n_payments, 0) AS n_payments, h.representative_id
  FROM keyed e LEFT JOIN (
    SELECT entry_id, sum(amount) AS paid, count(*) AS n_payments, arg_max(txn_id, (amount, -txn_id)) AS representative_id
    FROM hits WHERE r = 1 GROUP BY entry_id) h USING (entry_id)
), offs AS (
  SELECT *, expected_amount - paid AS gap,
    CASE WHEN applied_escalation AND abs(paid - prev) <= greatest(prev * 0.01, 0.01) THEN abs(paid - prev) END AS raise_off,
    CASE WHEN has_disc AND applied_discount_pct = 0 AND abs(paid - round(expected_amount * 0.90, 2)) <= greatest(round(expected_amount * 0.90, 2) * 0.01, 0.01)
      THEN abs(paid - round(expected_amount * 0.90, 2)) END AS disc_off
  FROM buckets
), typed AS (
  SELECT *, CASE WHEN expected_amount <= 0 THEN NULL WHEN paid <= 0 THEN 'ghost_invoice'
    WHEN gap <= greatest(expected_amount * 0.01, 0.01) THEN NULL
    WHEN raise_off IS NOT NULL AND (disc_off IS NULL OR raise_off <= disc_off) THEN 'forgotten_raise'
    WHEN disc_off IS NOT NULL THEN 'zombie_discount' ELSE 'short_change' END AS anomaly_type
  FROM offs
), findings AS (
  SELECT *, CASE anomaly_type WHEN 'ghost_invoice' THEN 0.9 WHEN 'short_change' THEN round(0.5 + 0.4 * least(CAST(gap AS DOUBLE) / CAST(expected_amount AS DOUBLE), 1.0), 2)
      WHEN 'forgotten_raise' THEN CASE WHEN raise_off <= 0.01 THEN 0.95 ELSE 0.85 END
      WHEN 'zombie_discount' THEN CASE WHEN disc_off <= 0.01 THEN 0.95 ELSE 0.85 END END::DOUBLE AS confidence,
    CASE anomaly_type WHEN 'forgotten_raise' THEN 'escalation' WHEN 'zombie_discount' THEN 'discount' WHEN 'ghost_invoice' THEN 'base_fee' WHEN 'short_change' THEN 'base_fee' END AS clause_role
  FROM typed WHERE anomaly_type IS NOT NULL
)
"""


#: of the timeline, what payments and findings are made of
BILLING = (
    "client_id", "client_name", "discounts", "billing_date", "expected_amount", "applied_escalation", "applied_discount_pct", "previous_amount", "entry_ord", "entry_id",
)


def billings(spark: SparkSession, d: str) -> DataFrame:
    """The timeline worked out once and written: payments and all joins on it read the table."""
    return written(src.entries(spark, d).select(*BILLING), "billings")


def findings(spark: SparkSession, d: str, timeline: DataFrame | None = None) -> DataFrame:
    """``timeline``: the billings, where the query has them already."""
    timeline = billings(spark, d) if timeline is None else timeline
    return rec.shortfalls(timeline, src.payments_of(timeline))


def schedule_expected_timeline(spark: SparkSession, d: str) -> DataFrame:
    return src.entries(spark, d).select(
        "client_id", "entry_id", "billing_date", shown(F.col("expected_amount")).alias("expected_amount"), "applied_escalation",
        F.col("applied_discount_pct").cast("double").alias("applied_discount_pct"),
    )


def schedule_single_rise(spark: SparkSession, d: str) -> DataFrame:
    """The schedule variant that raises once and stays."""
    return sch.expected_timeline(src.contracts(spark, d), *src.WINDOW, compound=False).groupBy("frequency").agg(
        F.count("*").alias("n"), shown(F.sum("expected_amount")).alias("total")
    )


def reconcile_best_bucket(spark: SparkSession, d: str) -> DataFrame:
    return rec.best_bucket(src.entries(spark, d), src.payments(spark, d)).drop("amount")


def reconcile_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = rec.bucket_totals(src.entries(spark, d), src.payments(spark, d))
    return b.select("entry_id", shown(F.col("paid")).alias("paid"), "n_payments", "representative_id")


def reconcile_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Raw receipts that answer no billing of their client."""
    r = rec.unmatched(src.entries(spark, d), src.receipts(spark, d))
    return r.select("txn_id", "client_id", "transaction_date", shown(F.col("amount")).alias("amount"))


def classify_gaps(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select(
        "entry_id", "client_id", "billing_date", "anomaly_type", shown(F.col("gap")).alias("gap"), "confidence", "clause_role"
    )


def leak_total_by_type(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("anomaly_type").agg(F.count("*").alias("n"), shown(F.sum("gap")).alias("total_gap"))


def score_planted(spark: SparkSession, d: str) -> DataFrame:
    truth = src.planted(src.entries(spark, d)).filter("planted_type IS NOT NULL").select(
        "entry_id", F.col("planted_type").alias("anomaly_type"),
        (F.col("expected_amount") - F.coalesce("paid_amount", F.lit(0))).alias("gap"),
    )
    return rec.score_against(findings(spark, d), truth, ["entry_id"]).groupBy("verdict").agg(F.count("*").alias("n"))


def findings_by_gap(spark: SparkSession, d: str) -> DataFrame:
    """Findings with client and timeline columns, rank by gap (ties by id)."""
    f = findings(spark, d)
    return f.select(
        "entry_id", "client_name", "anomaly_type", shown(F.col("expected_amount")).alias("expected"), shown(F.col("paid")).alias("actual"),
        shown(F.col("gap")).alias("gap"), F.round("confidence", 3).alias("confidence"),
    ).orderBy(F.desc("gap"), "entry_id")


def findings_groups(spark: SparkSession, d: str) -> DataFrame:
    """By type in the fixed display order, with subtotals."""
    order = F.array(*map(F.lit, ("ghost_invoice", "forgotten_raise", "zombie_discount", "short_change")))
    g = findings(spark, d).groupBy("anomaly_type").agg(F.count("*").alias("n"), shown(F.sum("gap")).alias("subtotal"))
    position = F.array_position(order, F.col("anomaly_type"))  # 0 for an unknown type, which comes last
    return g.withColumn("position", F.when(position > 0, position).otherwise(F.size(order) + 1)).orderBy("position")


def dash_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: everything the run page counts, from one pass over the findings."""
    f = findings(spark, d).agg(
        shown(F.sum("gap")).alias("total_gap"), F.count("*").alias("n_findings"), F.count_if(F.col("confidence") < 0.9).alias("n_unsure"),
        F.count_if(F.col("clause_role") == "base_fee").alias("n_base_fee"), F.count_distinct("client_id").alias("clients_affected"),
        F.max("billing_date").alias("latest"),
    )
    return f.crossJoin(src.contracts(spark, d).agg(F.count("*").alias("clients_total")))


def dash_client_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per client: contracts, received, gap, share of all received (null if none)."""
    got = src.payments(spark, d).groupBy("client_id").agg(F.sum("amount").alias("received"))
    gap = findings(spark, d).groupBy("client_id").agg(F.sum("gap").alias("gap"))
    c = src.contracts(spark, d).groupBy("client_id", "client_name").agg(F.count("*").alias("contracts"))
    out = c.join(got, "client_id", "left").join(gap, "client_id", "left")
    total = got.agg(F.sum("received").alias("all_received"))
    out = out.crossJoin(total)
    share = F.when(F.col("all_received") > 0, F.round(F.coalesce(F.col("received").cast("double"), F.lit(0.0)) / F.col("all_received").cast("double"), 4))
    return out.select("client_id", "client_name", "contracts", shown(F.col("received")).alias("received"), shown(F.col("gap")).alias("gap"), share.alias("revenue_share"))


def invoice_feed(spark: SparkSession, d: str) -> DataFrame:
    """One row per payment, ordinal in its client-month; flagged months carry what was due."""
    p = src.payments(spark, d).withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    due = findings(spark, d).groupBy("client_id", F.date_format("billing_date", "yyyy-MM").alias("month")).agg(F.sum("expected_amount").alias("due"))
    w = Window.partitionBy("client_id", "month").orderBy("transaction_date", "txn_id")
    return p.withColumn("ordinal", F.row_number().over(w)).join(due, ["client_id", "month"], "left").select(
        "txn_id", "client_id", "month", F.col("ordinal").cast("long").alias("ordinal"), F.col("due").cast("double").alias("due"), shown(F.col("amount")).alias("amount")
    )


QUERIES = {
    f.__name__: f
    for f in (
        schedule_expected_timeline, schedule_single_rise, reconcile_best_bucket, reconcile_buckets, reconcile_unmatched, classify_gaps,
        leak_total_by_type, score_planted, findings_by_gap, findings_groups, dash_summary, dash_client_totals, invoice_feed,
    )
}
SQL = {
    "schedule_expected_timeline": BASE + """SELECT client_id, entry_id, billing_date, CAST(expected_amount AS DOUBLE) AS expected_amount,
      applied_escalation, CAST(applied_discount_pct AS DOUBLE) AS applied_discount_pct FROM keyed""",
    "schedule_single_rise": BASE + """SELECT frequency, count(*) AS n, CAST(sum(CASE WHEN has_disc AND elapsed < 3 THEN round(r0 * 0.90, 2)
      WHEN elapsed >= 12 THEN r1 ELSE r0 END) AS DOUBLE) AS total FROM aged GROUP BY frequency""",
    "reconcile_best_bucket": BASE + "SELECT txn_id, entry_id, lag FROM hits WHERE r = 1",
    "reconcile_buckets": BASE + "SELECT entry_id, CAST(paid AS DOUBLE) AS paid, n_payments, representative_id FROM buckets",
    "reconcile_unmatched": BASE + """SELECT o_orderkey AS txn_id, o_custkey AS client_id, CAST(o_orderdate AS DATE) AS transaction_date,
      CAST(CAST(CAST(o_totalprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders o
      WHERE NOT EXISTS (SELECT 1 FROM keyed e WHERE e.client_id = o.o_custkey AND (abs(CAST(o.o_orderdate AS DATE) - e.billing_date) <= 15
        OR date_trunc('month', o.o_orderdate) = date_trunc('month', e.billing_date)))""",
    "classify_gaps": BASE + "SELECT entry_id, client_id, billing_date, anomaly_type, CAST(gap AS DOUBLE) AS gap, confidence, clause_role FROM findings",
    "leak_total_by_type": BASE + "SELECT anomaly_type, count(*) AS n, CAST(sum(gap) AS DOUBLE) AS total_gap FROM findings GROUP BY anomaly_type",
    "score_planted": BASE + """SELECT CASE WHEN t.anomaly_type IS NULL THEN 'missed' WHEN t.planted_type IS NULL THEN 'spurious'
        WHEN t.anomaly_type <> t.planted_type THEN 'mistyped' ELSE 'ok' END AS verdict, count(*) AS n
      FROM typed t WHERE t.anomaly_type IS NOT NULL OR t.planted_type IS NOT NULL GROUP BY 1""".replace("t.planted_type", "p.planted_type").replace(
        "FROM typed t WHERE", "FROM typed t JOIN truth p USING (entry_id) WHERE"
    ),
    "findings_by_gap": BASE + """SELECT entry_id, client_name, anomaly_type, CAST(expected_amount AS DOUBLE) AS expected, CAST(paid AS DOUBLE) AS actual,
      CAST(gap AS DOUBLE) AS gap, round(confidence, 3) AS confidence FROM findings""",
    "findings_groups": BASE + """SELECT anomaly_type, count(*) AS n, CAST(sum(gap) AS DOUBLE) AS subtotal,
      CAST(CASE anomaly_type WHEN 'ghost_invoice' THEN 1 WHEN 'forgotten_raise' THEN 2 WHEN 'zombie_discount' THEN 3 WHEN 'short_change' THEN 4 ELSE 5 END AS BIGINT) AS position FROM findings GROUP BY anomaly_type""",
    "dash_summary": BASE + """SELECT CAST(sum(gap) AS DOUBLE) AS total_gap, count(*) AS n_findings, count(*) FILTER (confidence < 0.9) AS n_unsure,
      count(*) FILTER (clause_role = 'base_fee') AS n_base_fee, count(DISTINCT client_id) AS clients_affected, max(billing_date) AS latest,
      (SELECT count(*) FROM contracts) AS clients_total FROM findings""",
    "dash_client_totals": BASE + """, got AS (SELECT client_id, sum(amount) AS received FROM paid_rows GROUP BY client_id),
      lost AS (SELECT client_id, sum(gap) AS gap FROM findings GROUP BY client_id)
      SELECT client_id, client_name, CAST(1 AS BIGINT) AS contracts, coalesce(CAST(received AS DOUBLE), 0) AS received, coalesce(CAST(gap AS DOUBLE), 0) AS gap,
        round(coalesce(CAST(received AS DOUBLE), 0) / CAST((SELECT sum(received) FROM got) AS DOUBLE), 4) AS revenue_share
      FROM contracts LEFT JOIN got USING (client_id) LEFT JOIN lost USING (client_id)""",
    "invoice_feed": BASE + """, due2 AS (SELECT client_id, strftime(billing_date, '%Y-%m') AS month, sum(expected_amount) AS due FROM findings GROUP BY 1, 2)
      SELECT p.txn_id, p.client_id, strftime(p.transaction_date, '%Y-%m') AS month,
        row_number() OVER (PARTITION BY p.client_id, strftime(p.transaction_date, '%Y-%m') ORDER BY p.transaction_date, p.txn_id) AS ordinal,
        CAST(d.due AS DOUBLE) AS due, CAST(p.amount AS DOUBLE) AS amount
      FROM paid_rows p LEFT JOIN due2 d ON d.client_id = p.client_id AND d.month = strftime(p.transaction_date, '%Y-%m')""",
}
