"""Cash flow, evidence and statement queries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, text
from tallyloom.functions.money import cents, shown
from tallyloom.operators import cashflow, evidence
from tallyloom.operators.attribution import attribute
from tallyloom.plans.leaks import BASE, findings
from tallyloom.sources import derived as src
from tallyloom.sources import ingest
from tallyloom.sources.lineage import shared_dir
from tallyloom.sources.stored import Store

RECEIPTS = """receipts AS (SELECT o_orderkey AS txn_id, o_custkey AS client_id, CAST(o_orderdate AS DATE) AS transaction_date,
  CAST(CAST(o_totalprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS amount, o_orderpriority AS description FROM orders)"""
EXPENSES = 1_000_000.0


def revenue_by_month(spark: SparkSession, d: str) -> DataFrame:
    return cashflow.revenue_by_month(src.receipts(spark, d)).select("month", shown(F.col("revenue")).alias("revenue"))


def cash_baseline(spark: SparkSession, d: str) -> DataFrame:
    b = cashflow.baseline(cashflow.revenue_by_month(src.receipts(spark, d)), EXPENSES)
    return b.select("months_observed", shown(F.col("monthly_revenue")).alias("monthly_revenue"), F.col("surplus").cast("double").alias("surplus"), "confidence")


def _recovery(spark: SparkSession, d: str) -> DataFrame:
    """Findings settled by their confidence: sure ones confirmed, weak ones rejected."""
    f = findings(spark, d).withColumn(
        "status", F.when(F.col("confidence") >= 0.9, "confirmed").when(F.col("confidence") < 0.6, "false_positive").otherwise("unverified")
    )
    return cashflow.recovery(f, F.lit(84))


def cash_recovery(spark: SparkSession, d: str) -> DataFrame:
    r = _recovery(spark, d)
    return r.select(*[F.col(c).cast("double").alias(c) if c in ("confirmed_total", "unverified_total", "monthly") else c for c in r.columns])


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    costs = src.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("scenario")).agg(cents(F.sum(F.col("s_acctbal").cast("decimal(18,2)") * 10)).alias("monthly_cost"))
    base = cashflow.baseline(cashflow.revenue_by_month(src.receipts(spark, d)), EXPENSES)
    return cashflow.verdicts(base, _recovery(spark, d), costs)


def cash_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("scenario", shown(F.col("monthly_cost")).alias("monthly_cost"), F.col("after").cast("double").alias("after"), "verdict", "why", "cost_share")


def cash_on_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Half a year ahead where expenses are unknown: costs are held against revenue."""
    costs = src.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("scenario")).agg(cents(F.sum(F.col("s_acctbal").cast("decimal(18,2)") * 10)).alias("monthly_cost"))
    base = cashflow.baseline(cashflow.revenue_by_month(src.receipts(spark, d)), None)
    p = cashflow.projection(cashflow.verdicts(base, _recovery(spark, d), costs), 6)
    return p.select("scenario", "month_ahead", F.col("with_recovery").cast("double").alias("with_recovery"), F.col("without_recovery").cast("double").alias("without_recovery"))


def verdict_figures(spark: SparkSession, d: str) -> DataFrame:
    """A sentence on each verdict held against the figures it may state: by turns all stand, one
    does not, two do not."""
    v = _verdicts(spark, d)
    v = v.withColumn("allowed", cashflow.allowed_figures(v))
    k = F.col("scenario") % 3
    wrong = F.concat(F.lit(", or "), F.format_number(F.abs("after") + F.lit(1000.5), 2))
    said = F.concat(
        F.lit("After $"), F.format_number("monthly_cost", 2), F.lit(" a month for 12 months, "), F.format_number(F.abs("after"), 2), F.lit(" is left"), F.when(k > 0, wrong).otherwise(""),
        F.when(k == 2, F.concat(F.lit(" at $"), F.format_number(F.col("monthly_cost") + F.lit(77.25), 2))).otherwise(""),
        F.lit("; that is "), F.round(F.col("cost_share") * 100, 1).cast("decimal(9,1)").cast("string"), F.lit("% of revenue."),
    )
    v = v.withColumn("bad", cashflow.offending(text.amounts_in(said), F.col("allowed"), F.col("cost_share")))
    return v.select("scenario", F.size("bad").cast("long").alias("n_offending"), F.get("bad", 0).alias("first"), F.get("bad", 1).alias("second"))


def cash_projection(spark: SparkSession, d: str) -> DataFrame:
    p = cashflow.projection(_verdicts(spark, d))
    return p.select("scenario", "month_ahead", F.col("with_recovery").cast("double").alias("with_recovery"), F.col("without_recovery").cast("double").alias("without_recovery"))


def months_spanned(spark: SparkSession, d: str) -> DataFrame:
    r = src.receipts(spark, d)
    return r.groupBy("client_id").agg(F.count_distinct(dates.month_number(F.col("transaction_date"))).alias("months"))


def transaction_window(spark: SparkSession, d: str) -> DataFrame:
    """First day of the first month to the last date, and the window 15 days wider by month."""
    r = src.receipts(spark, d)
    low, high = dates.month_window(F.max("transaction_date"))
    return r.agg(
        F.trunc(F.min("transaction_date"), "month").alias("first_day"), F.max("transaction_date").alias("last_day"), low.alias("month_low"), high.alias("month_high")
    )


def band_search(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of any client in an amount band given the wrong way round."""
    return evidence.in_band(src.receipts(spark, d), 50_000, 49_000).select("txn_id", "client_id", shown(F.col("amount")).alias("amount"))


def client_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers of all clients, both days included."""
    r = evidence.ledger(src.receipts(spark, d), None, "1996-01-01", "1998-12-31")
    return r.select("client_id", "txn_id", "transaction_date", shown(F.col("amount")).alias("amount"))


def evidence_split_payments(spark: SparkSession, d: str) -> DataFrame:
    """Up to three receipts of a client that add up to twice its smallest receipt, within 2%."""
    r = src.receipts(spark, d)
    t = r.groupBy("client_id").agg((2 * F.min("amount")).cast("decimal(18,2)").alias("target"), F.min("transaction_date").alias("start"), F.max("transaction_date").alias("end"))
    return evidence.split_payments(t, r).select("client_id", "size", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def statement_clean(spark: SparkSession, d: str) -> DataFrame:
    """Event values written as a bank writes them, read back to numbers; unreadable rows go."""
    e = src.table(spark, d, "events")
    v = F.format_number("value", 2)
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("$"), v)).when(k == 1, F.concat(F.lit("("), v, F.lit(")"))).when(k == 2, F.lit("n/a")).when(k == 3, F.concat(v, F.lit(" USD"))).otherwise(v)
    line = F.concat_ws(" ", F.upper("event_type"), F.lit("ACH"), F.concat(F.lit("INV-"), F.col("user_id").cast("string")))
    out = e.select("event_id", F.col("ts").cast("date").alias("day"), text.clean_amount(raw).alias("amount"), text.clean_description(line).alias("description"))
    return out.filter("amount IS NOT NULL")


def statements_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Events as statement files of three layouts, uploaded in two batches and once more: the
    first layout is known, the second gets confirmed afterwards, the third never."""
    e = src.table(spark, d, "events")
    file = F.floor(F.col("event_id") / 500)
    amount = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.floor("value").cast("long").cast("string"))
    row = F.struct("event_id", F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), amount, F.concat(F.lit('"'), "event_type", F.lit(', card"'))).alias("line"))
    rows = e.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    heads = {0: ("Date", "Amount", "Text"), 1: ("Posted", "Value", "Memo"), 2: ("When", "Sum", "Note")}
    head = F.element_at(F.array(*[F.lit(",".join(h)) for h in heads.values()]), (F.col("file") % 3 + 1).cast("int"))
    content = F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).cast("binary")
    files = rows.select((F.col("file") % 2).cast("int").alias("run_id"), F.concat(F.lit("s"), F.col("file").cast("string"), F.lit(".csv")).alias("filename"), content.alias("content"))
    known = lambda k: spark.createDataFrame([(list(heads[k]), dict(zip(ingest.FIELDS, heads[k])))], "h array<string>, mapping map<string,string>").select(text.header_signature(F.col("h")).alias("signature"), "mapping")
    store = Store(spark, f"{shared_dir(spark)}/statements-{uuid.uuid4().hex}")
    for part in (files.filter("filename LIKE '%1.csv'"), files):
        ingest.ingest(store, part, known(0))
    ingest.confirm(store, known(1))
    sums = store.read("lines").groupBy("run_id", "filename").agg(F.sum("amount").cast("double").alias("total"), F.max("transaction_date").alias("last"))
    aside = store.read("set_aside").groupBy("run_id", "filename").agg(F.count("*").alias("set_aside"))
    out = store.read("documents").select("run_id", "filename", "status", "n_lines").join(sums, ["run_id", "filename"], "left").join(aside, ["run_id", "filename"], "left")
    return out.fillna(0, ["set_aside"])


def statement_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the columns each event names, as a header cache would key them."""
    e = src.table(spark, d, "events")
    cols = F.array(F.concat(F.lit(" "), F.upper("event_type")), F.lit("Date"), F.concat(F.lit("Amount "), (F.col("user_id") % 7).cast("string")))
    return e.groupBy(text.header_signature(cols).alias("signature")).agg(F.count("*").alias("n"))


def attribute_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bank lines made from supplier names, attributed to suppliers."""
    s = src.table(spark, d, "supplier").withColumn("word", F.sha2(F.col("s_name"), 256))
    # readable names from the key: two invented words and a suffix
    syllables = F.array(*map(F.lit, "bar cen dol fen gar hal jor kel lum mer nor pol ras sed tor vel".split()))
    part = lambda i: F.element_at(syllables, (F.conv(F.substring("word", i, 2), 16, 10).cast("int") % 16) + 1)
    name = F.concat_ws(" ", F.initcap(F.concat(part(1), part(3), part(5))), F.initcap(F.concat(part(7), part(9), part(11))), F.lit("Holdings Inc."))
    clients = s.select(F.col("s_suppkey").alias("client_id"), name.alias("name"))
    lines = clients.select(
        F.col("client_id").alias("txn_id"), F.when(F.col("client_id") % 11 == 0, F.col("client_id")).alias("client_id"),
        F.upper(F.concat_ws(" ", F.substring(F.split("name", " ")[0], 1, 6), F.split("name", " ")[1], F.lit("ACH INV-20250101"))).alias("description"),
    )
    return attribute(lines, clients)


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
    parts = [src.table(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vocabulary_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside a closed vocabulary, by table and value."""
    o = src.table(spark, d, "orders").filter(~F.col("o_orderstatus").isin("O", "F")).select(F.lit("orders").alias("name"), F.col("o_orderstatus").alias("value"))
    e = src.table(spark, d, "events").filter(~F.col("event_type").isin("click", "view")).select(F.lit("events").alias("name"), F.col("event_type").alias("value"))
    return o.unionByName(e).groupBy("name", "value").agg(F.count("*").alias("n"))


def filer_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most three documents a source, the first by id, of at least 3000 characters."""
    docs = src.table(spark, d, "documents").filter(F.length("text") >= 3000)
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("source", "doc_id", F.col("_r").cast("long").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        revenue_by_month, cash_baseline, cash_recovery, cash_verdicts, cash_projection, cash_on_revenue, verdict_figures, months_spanned, transaction_window, band_search,
        client_ledger, evidence_split_payments, statement_clean, statements_ingested, statement_signature, attribute_lines, table_counts, vocabulary_violations, filer_cap,
    )
}
_MONTHLY = RECEIPTS + ", monthly AS (SELECT strftime(transaction_date, '%Y-%m') AS month, sum(amount) AS revenue FROM receipts GROUP BY 1)"
_BASELINE = _MONTHLY + f""", base AS (SELECT count(*) AS months_observed, CAST(round(CAST(avg(revenue) AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS monthly_revenue
  FROM (SELECT * FROM monthly ORDER BY month DESC LIMIT 12)), base2 AS (SELECT *, monthly_revenue - CAST({EXPENSES} AS DECIMAL(18,2)) AS surplus,
  CASE WHEN months_observed = 0 THEN 'none' WHEN months_observed < 3 THEN 'low' ELSE 'ok' END AS confidence FROM base)"""
_RECOVERY = """, rec AS (SELECT coalesce(sum(gap) FILTER (confidence >= 0.9), 0) AS confirmed_total, count(*) FILTER (confidence >= 0.9) AS confirmed_count,
  coalesce(sum(gap) FILTER (confidence >= 0.6 AND confidence < 0.9), 0) AS unverified_total, count(*) FILTER (confidence >= 0.6 AND confidence < 0.9) AS unverified_count,
  count(*) FILTER (confidence < 0.6) AS rejected_count FROM findings),
  rec2 AS (SELECT *, CAST(round(CAST(confirmed_total / 84 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS monthly FROM rec)"""
_VERDICT = BASE + ", " + _BASELINE + _RECOVERY + """, costs AS (SELECT s_nationkey AS scenario, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2)) * 10) AS DECIMAL(18,2)) AS monthly_cost
  FROM supplier GROUP BY s_nationkey), v AS (SELECT *, surplus + monthly - monthly_cost AS after FROM costs, base2, (SELECT monthly FROM rec2))"""
SQL = {
    "revenue_by_month": f"WITH {_MONTHLY} SELECT month, CAST(revenue AS DOUBLE) AS revenue FROM monthly",
    "cash_baseline": f"WITH {_BASELINE} SELECT months_observed, CAST(monthly_revenue AS DOUBLE) AS monthly_revenue, CAST(surplus AS DOUBLE) AS surplus, confidence FROM base2",
    "cash_recovery": BASE + _RECOVERY + """ SELECT CAST(confirmed_total AS DOUBLE) AS confirmed_total, confirmed_count, CAST(unverified_total AS DOUBLE) AS unverified_total,
      unverified_count, rejected_count, CAST(monthly AS DOUBLE) AS monthly FROM rec2""",
    "cash_verdicts": _VERDICT + """ SELECT scenario, CAST(monthly_cost AS DOUBLE) AS monthly_cost, CAST(after AS DOUBLE) AS after, CASE WHEN after > 0 THEN 'yes' ELSE 'no' END AS verdict,
      CASE WHEN after <= 0 THEN 'does_not_fit' WHEN surplus > monthly_cost THEN 'fits_already' ELSE 'fits_with_recovery' END AS why,
      round(CAST(monthly_cost AS DOUBLE) / CAST(monthly_revenue + monthly AS DOUBLE), 4) AS cost_share FROM v""",
    "cash_on_revenue": _VERDICT + """ SELECT scenario, CAST(i AS INTEGER) AS month_ahead, CAST(i * (monthly_revenue + monthly - monthly_cost) AS DOUBLE) AS with_recovery,
      CAST(i * (monthly_revenue - monthly_cost) AS DOUBLE) AS without_recovery FROM v CROSS JOIN range(1, 7) t(i)""",
    "verdict_figures": _VERDICT + """ SELECT scenario, CAST(scenario % 3 AS BIGINT) AS n_offending, CASE WHEN scenario % 3 > 0 THEN round(CAST(abs(after) AS DOUBLE) + 1000.5, 2) END AS "first",
      CASE WHEN scenario % 3 = 2 THEN round(CAST(monthly_cost AS DOUBLE) + 77.25, 2) END AS second FROM v""",
    "cash_projection": _VERDICT + """ SELECT scenario, CAST(i AS INTEGER) AS month_ahead, CAST(i * after AS DOUBLE) AS with_recovery,
      CAST(i * (after - monthly) AS DOUBLE) AS without_recovery FROM v CROSS JOIN range(1, 13) t(i)""",
    "months_spanned": f"WITH {RECEIPTS} SELECT client_id, count(DISTINCT date_trunc('month', transaction_date)) AS months FROM receipts GROUP BY client_id",
    "transaction_window": f"""WITH {RECEIPTS} SELECT CAST(date_trunc('month', min(transaction_date)) AS DATE) AS first_day, max(transaction_date) AS last_day,
      CAST(date_trunc('month', max(transaction_date)) - INTERVAL 15 DAY AS DATE) AS month_low, CAST(last_day(max(transaction_date)) + INTERVAL 15 DAY AS DATE) AS month_high FROM receipts""",
    "band_search": f"WITH {RECEIPTS} SELECT txn_id, client_id, CAST(amount AS DOUBLE) AS amount FROM receipts WHERE amount BETWEEN 49000 AND 50000",
    "client_ledger": f"WITH {RECEIPTS} SELECT client_id, txn_id, transaction_date, CAST(amount AS DOUBLE) AS amount FROM receipts WHERE transaction_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    "evidence_split_payments": f"""WITH {RECEIPTS}, t AS (SELECT client_id, 2 * min(amount) AS target FROM receipts GROUP BY client_id),
      p AS (SELECT r.client_id, txn_id, amount, target, target * 0.02 AS slack FROM receipts r JOIN t USING (client_id))
      SELECT client_id, 1 AS size, CAST(txn_id AS VARCHAR) AS ids FROM p WHERE abs(amount - target) <= slack
      UNION ALL SELECT a.client_id, 2, a.txn_id || ',' || b.txn_id FROM p a JOIN p b ON a.client_id = b.client_id AND a.txn_id < b.txn_id
        WHERE abs(a.amount + b.amount - a.target) <= a.slack
      UNION ALL SELECT a.client_id, 3, a.txn_id || ',' || b.txn_id || ',' || c.txn_id FROM p a JOIN p b ON a.client_id = b.client_id AND a.txn_id < b.txn_id
        JOIN p c ON a.client_id = c.client_id AND b.txn_id < c.txn_id WHERE abs(a.amount + b.amount + c.amount - a.target) <= a.slack""",
    "statements_ingested": """WITH e AS (SELECT event_id // 500 AS file, event_id % 10 = 3 AS bad, CAST(floor(value) AS BIGINT) AS amount, CAST(ts AS DATE) AS day FROM events)
      SELECT CAST(file % 2 AS INTEGER) AS run_id, 's' || file || '.csv' AS filename, CASE WHEN file % 3 = 2 THEN 'pending' ELSE 'complete' END AS status,
        count(*) FILTER (NOT bad AND file % 3 < 2) AS n_lines, CAST(sum(amount) FILTER (NOT bad AND file % 3 < 2) AS DOUBLE) AS total, max(day) FILTER (NOT bad AND file % 3 < 2) AS "last",
        count(*) FILTER (bad AND file % 3 < 2) AS set_aside FROM e GROUP BY file""",
    "statement_clean": """SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 5 = 1 THEN -abs(round(value, 2)) ELSE round(value, 2) END AS amount,
      upper(event_type) AS description FROM events WHERE event_id % 5 <> 2""",
    "statement_signature": """SELECT sha256(array_to_string(list_sort([lower(event_type), 'date', 'amount ' || (user_id % 7)]), '|')) AS signature, count(*) AS n FROM events GROUP BY 1""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
    ),
    "vocabulary_violations": """SELECT 'orders' AS name, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 2
      UNION ALL SELECT 'events', event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 2""",
    "filer_cap": """SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
      FROM documents WHERE length(text) >= 3000) WHERE place <= 3""",
}
