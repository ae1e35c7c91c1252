"""The tables of a run, derived from the order tables: a region is a run, a customer a client.

Contracts, billings and payments are those of ``derived``; here they get documents,
clauses with pages, milestones, statuses and bank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.leaks import findings
from tallyloom.sources import derived as src

KINDS = {"base_fee": 1, "escalation": 2, "discount": 3}


def runs(spark: SparkSession, d: str) -> DataFrame:
    r = src.table(spark, d, "region")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("r_regionkey") * 7 % 5).cast("int"))
    return r.select(F.col("r_regionkey").alias("run_id"), F.col("r_name").alias("label"), day.alias("created_on"))


def clients(spark: SparkSession, d: str) -> DataFrame:
    c, n = src.table(spark, d, "customer"), src.table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("client_id"), F.col("n_regionkey").alias("run_id"), F.col("c_name").alias("name"))


def _contracts(spark: SparkSession, d: str, contracts: DataFrame | None) -> DataFrame:
    return src.contracts(spark, d) if contracts is None else contracts


def rules(spark: SparkSession, d: str, contracts: DataFrame | None = None) -> DataFrame:
    c = _contracts(spark, d, contracts)
    document = F.when(F.col("client_id") % 13 != 0, F.col("client_id"))
    return c.select(F.col("client_id").alias("rule_id"), "client_id", document.alias("document_id"), "client_name", "base_amount", "frequency", "start_date", "end_date")


def escalations(spark: SparkSession, d: str, contracts: DataFrame | None = None) -> DataFrame:
    """Two a contract, of which the earlier counts."""
    c = _contracts(spark, d, contracts)
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("esc_after").alias("after")), F.struct(F.lit(1).alias("k"), (F.col("esc_after") + 12).alias("after"))))
    c = c.select("client_id", "esc_pct", both.alias("_x"))
    return c.select(
        (F.col("client_id") * 2 + F.col("_x.k")).alias("id"), F.col("client_id").alias("rule_id"), (F.col("client_id") * 10 + KINDS["escalation"]).alias("clause_id"),
        (F.col("esc_pct") + F.col("_x.k")).cast("decimal(9,6)").alias("percentage"), F.col("_x.after").alias("after_months"),
    )


def discounts(spark: SparkSession, d: str, contracts: DataFrame | None = None) -> DataFrame:
    c = _contracts(spark, d, contracts).select("client_id", F.posexplode("discounts").alias("i", "x"))
    return c.select(
        (F.col("client_id") * 10 + F.col("i")).alias("id"), F.col("client_id").alias("rule_id"), (F.col("client_id") * 10 + KINDS["discount"]).alias("clause_id"),
        "x.percentage", "x.duration_months",
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("client_id")
    status = F.when(k % 11 == 0, "failed").when(k % 7 == 0, "processing").otherwise("complete")
    c = src.contracts(spark, d).select("client_id").join(clients(spark, d), "client_id")
    return c.select(
        k.alias("document_id"), "run_id", F.concat(F.lit("contract_"), k, F.when(k % 17 == 0, ".csv").otherwise(".txt")).alias("filename"), F.lit("contract").alias("category"),
        status.alias("extraction_status"), F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")).alias("uploaded_on"),
    )


def clause_text(kind: Column) -> Column:
    amount, pct = F.col("base_amount").cast("int").cast("string"), F.col("esc_pct").cast("int").cast("string")
    return (
        F.when(kind == "base_fee", F.concat(F.lit("The "), F.col("frequency"), F.lit(" fee is $"), amount, F.lit(".")))
        .when(kind == "escalation", F.concat(F.lit("The fee of $"), amount, F.lit(" shall increase by "), pct, F.lit("% every 12 months.")))
        .otherwise(F.lit("A discount of 10% applies for the first 3 months."))
    )


def clauses(spark: SparkSession, d: str, contracts: DataFrame | None = None) -> DataFrame:
    c = _contracts(spark, d, contracts)
    kinds = F.array(*[F.when((F.lit(k) != "discount") | F.col("discounts").isNotNull(), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"))) for k, n in KINDS.items()])
    c = c.withColumn("_k", F.explode(F.array_compact(kinds))).withColumn("id", F.col("client_id") * 10 + F.col("_k.n"))
    box = F.when(F.col("id") % 5 != 0, F.array(*map(F.lit, (72.0, 90.0, 300.0, 110.0)))).otherwise(F.array().cast("array<double>"))
    placed = F.col("id") % 4 != 0
    return c.select(
        "id", F.col("client_id").alias("rule_id"), F.when(F.col("client_id") % 13 != 0, F.col("client_id")).alias("document_id"), F.col("_k.kind").alias("kind"),
        clause_text(F.col("_k.kind")).alias("text"), F.when(placed, (F.col("id") % 9).cast("int")).alias("page"), F.when(placed, box).alias("bbox"),
        F.when(~placed, "failed").when(F.col("id") % 4 == 1, "fuzzy").otherwise("exact").alias("method"),
    )


def milestones(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders as milestones; those by a key divisible by five have no date yet."""
    o = src.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    due = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(F.col("o_orderdate").cast("date"), 30))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contract_id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("description"),
        F.col("o_totalprice").cast("decimal(18,6)").cast("decimal(18,2)").alias("amount"), F.when(F.col("o_orderstatus") == "O", "on delivery").alias("due_condition"), due.alias("due_date"),
    )


def lines(spark: SparkSession, d: str, timeline: DataFrame | None = None) -> DataFrame:
    """Payments as bank lines: every thirteenth came without a payer and says nothing."""
    paid = src.payments(spark, d) if timeline is None else src.payments_of(timeline)
    # merge: payments look as small as the contracts that they come from, and would go through the driver
    p = paid.join(clients(spark, d).select("client_id", "run_id").hint("merge"), "client_id")
    noise = F.col("txn_id") % 13 == 5
    return p.select(
        "txn_id", "run_id", F.when(~noise, F.col("client_id")).alias("client_id"), "transaction_date", "amount",
        F.when(noise, "BANK SVC FEE").otherwise(F.col("description")).alias("description"), F.when(F.col("client_id") % 13 != 0, F.col("client_id")).alias("document_id"),
    )


def trading_name(key: Column, shared: bool = True) -> Column:
    """Two words of letters from a key; ``shared``: a key divisible by three has the name of the
    one before."""
    of = (key - F.when(F.lit(shared) & (key % 3 == 0), 1).otherwise(0)).cast("string")
    word = F.translate(F.md5(of.cast("binary")), "0123456789", "ghijklmnop")
    return F.concat(F.initcap(F.substring(word, 1, 8)), F.lit(" "), F.initcap(F.substring(word, 9, 8)), F.lit(" Ltd."))


def trading_clients(spark: SparkSession, d: str) -> DataFrame:
    return clients(spark, d).withColumn("name", trading_name(F.col("client_id")))


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bank lines of which a third name their payer in the text alone, as banks write it."""
    unknown = (F.col("txn_id") % 3 == 1) & F.col("client_id").isNotNull()
    name = F.regexp_replace(trading_name(F.col("client_id")), " Ltd[.]$", "")
    told = F.when(F.col("txn_id") % 2 == 0, F.concat(F.upper(name), F.lit(" ACH PMT 4711"))).otherwise(F.concat(F.substring(name, 1, 4), F.substring(name, 6, 20)))
    return lines(spark, d).withColumns({"description": F.when(unknown, told).otherwise(F.col("description")), "client_id": F.when(~unknown, F.col("client_id"))})


def run_findings(spark: SparkSession, d: str, timeline: DataFrame | None = None) -> DataFrame:
    """Findings with run, clause (null for every seventeenth) and a status: by key open or to be
    reviewed, else from their confidence."""
    role = F.col("clause_role")
    n = F.when(role == "escalation", KINDS["escalation"]).when(role == "discount", KINDS["discount"]).otherwise(KINDS["base_fee"])
    sure = F.col("confidence")
    f = findings(spark, d, timeline).join(clients(spark, d).select("client_id", "run_id"), "client_id")
    return f.withColumns({
        "clause_id": F.when(F.col("entry_id") % 17 != 0, F.col("client_id") * 10 + n),
        "status": F.when(F.col("entry_id") % 7 == 0, "needs_review").when(F.col("entry_id") % 5 == 0, "unverified").when(sure >= 0.9, "confirmed").when(sure < 0.6, "false_positive").otherwise("unverified"),
    })
