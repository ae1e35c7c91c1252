"""Views over the tables of a run, the run itself, marks and checks, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, money, text
from tallyloom.functions.money import shown
from tallyloom.operators import evidence, grounding, run, schedule
from tallyloom.plans.leaks import BASE, billings
from tallyloom.sources import derived as src
from tallyloom.sources import run_tables as tables
from tallyloom.sources import scenarios
from tallyloom.sources.lineage import cut, shared_dir, written
from tallyloom.sources.stored import Change, Store

#: The order in which kinds of leaks are shown.
TYPE_ORDER = run.VOCABULARIES["anomaly_type"]
#: Verdicts after which a finding is settled.
SETTLED = ("confirmed", "false_positive")


def run_list(spark: SparkSession, d: str) -> DataFrame:
    """Runs, newest first; the one shown is the newest."""
    place = F.row_number().over(Window.orderBy(F.desc("created_on"), F.desc("run_id")))
    return tables.runs(spark, d).withColumn("place", place.cast("long")).withColumn("is_shown", F.col("place") == 1)


def run_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by run, newest first, with the path an upload of that name takes and
    whether its text can be extracted from."""
    csv = F.lower("filename").endswith(".csv")
    ready = (F.col("category") == "contract") & (F.col("extraction_status") == "complete")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("uploaded_on"), F.desc("document_id")))
    return tables.documents(spark, d).select(
        "document_id", "run_id", "filename", "extraction_status", F.when(csv, "statement").otherwise("invoice").alias("path"), ready.alias("can_extract"), place.cast("long").alias("place")
    )


def document_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("extraction_status")
    return tables.documents(spark, d).groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(s == "complete").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("pending", "processing")).alias("in_flight")
    )


def run_clients(spark: SparkSession, d: str) -> DataFrame:
    """Clients with their number of contracts, none included, by name."""
    r = tables.rules(spark, d).groupBy("client_id").agg(F.count("*").alias("contracts"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("name", "client_id"))
    out = tables.clients(spark, d).join(r, "client_id", "left").withColumn("contracts", F.coalesce("contracts", F.lit(0)))
    return out.select("client_id", "run_id", "name", text.normalise_name(F.col("name")).alias("normalized_name"), "contracts", place.cast("long").alias("place"))


def run_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a window with client and document where there are such, oldest first."""
    t = evidence.ledger(tables.lines(spark, d), None, "1997-01-01", None)
    out = t.join(tables.clients(spark, d).select("client_id", "name"), "client_id", "left")
    out = out.join(tables.documents(spark, d).select("document_id", "filename"), "document_id", "left")
    return out.select("txn_id", "run_id", "transaction_date", "name", "filename", shown(F.col("amount")).alias("amount")).orderBy("transaction_date", "txn_id")


def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clauses with their document's name and whether they stand on a page in a box."""
    grounded = F.col("page").isNotNull() & (F.size(F.coalesce("bbox", F.array().cast("array<double>"))) > 0)
    c = tables.clauses(spark, d).join(tables.documents(spark, d).select("document_id", "filename"), "document_id", "left")
    return c.select("id", "rule_id", "kind", "text", "page", "method", "filename", grounded.alias("is_grounded"))


def clause_rates(spark: SparkSession, d: str) -> DataFrame:
    return grounding.rates(tables.clauses(spark, d))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row a run, zeros where nothing was found."""
    f = tables.run_findings(spark, d)
    c = tables.clauses(spark, d).select(F.col("id").alias("clause_id"), F.col("page").isNull().alias("_lost"))
    f = f.join(c, "clause_id", "left")
    types = [F.count_if(F.col("anomaly_type") == t).alias(f"n_{t}") for t in TYPE_ORDER]
    f = f.groupBy("run_id").agg(
        F.sum("gap").alias("_gap"), F.count("*").alias("findings"), F.count_if(F.col("status") == "unverified").alias("unverified"),
        F.count_if(F.col("clause_id").isNull()).alias("unlinked"), F.count_if(F.col("_lost")).alias("unlocatable"), F.count_distinct("client_id").alias("affected"), *types,
    )
    n = tables.clients(spark, d).groupBy("run_id").agg(F.count("*").alias("clients"))
    docs = tables.documents(spark, d).groupBy("run_id").agg(F.count("*").alias("documents"))
    out = tables.runs(spark, d).select("run_id").join(f, "run_id", "left").join(n, "run_id", "left").join(docs, "run_id", "left")
    out = out.withColumn("total_gap", shown(F.col("_gap"))).drop("_gap").fillna(0)
    grounded = F.col("findings") - F.col("unlinked") - F.col("unlocatable")
    return out.withColumns({
        "grounded": grounded, "grounding_rate": F.when(F.col("findings") > 0, F.round(grounded / F.col("findings"), 3)).otherwise(0.0),
        "affected_of": F.concat_ws(" of ", F.col("affected").cast("string"), F.col("clients").cast("string")),
    })


def run_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table by run; those without a run are counted through their rule's client.
    Lines and findings are of one timeline, worked out once."""
    timeline = billings(spark, d)
    owner = tables.rules(spark, d).select("rule_id", "client_id").join(tables.clients(spark, d).select("client_id", "run_id"), "client_id").select("rule_id", "run_id")
    own = {"clients": tables.clients, "documents": tables.documents, "lines": lambda *at: tables.lines(*at, timeline), "findings": lambda *at: tables.run_findings(*at, timeline)}
    hung = {"clauses": tables.clauses, "escalations": tables.escalations, "discounts": tables.discounts}
    parts = [f(spark, d).select("run_id", F.lit(n).alias("name")) for n, f in own.items()] + [owner.select("run_id", F.lit("rules").alias("name"))]
    parts += [f(spark, d).select("rule_id").join(owner, "rule_id").select("run_id", F.lit(n).alias("name")) for n, f in hung.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("run_id", "name").agg(F.count("*").alias("n"))


def findings_view(spark: SparkSession, d: str) -> DataFrame:
    """Findings that are not rejected, as once a run has rejected ones, with their places in
    three orders: by amount, by client, by period (newest first, none last)."""
    f = tables.run_findings(spark, d)
    rejected = F.max((F.col("status") == "false_positive").cast("int")).over(Window.partitionBy("run_id"))
    f = f.withColumn("_any", rejected).filter((F.col("_any") == 0) | (F.col("status") != "false_positive"))

    def place(*by):
        return F.row_number().over(Window.partitionBy("run_id").orderBy(*by, "entry_id")).cast("long")

    hay = F.lower(F.concat_ws(" ", "client_name", "anomaly_type", "status"))
    return f.select(
        "entry_id", "run_id", place(F.desc("gap")).alias("by_amount"), place(F.lower("client_name"), F.desc("gap")).alias("by_client"),
        place(F.desc_nulls_last("billing_date"), F.desc("gap")).alias("by_date"), hay.alias("haystack"),
    )


def findings_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Findings of one kind and status whose words hold a search text."""
    f = tables.run_findings(spark, d).filter((F.col("status") == "unverified") & (F.col("anomaly_type") == "short_change"))
    return f.filter(F.contains(F.lower(F.concat_ws(" ", "client_name", "anomaly_type")), F.lit("7"))).select("entry_id", "run_id")


def finding_texts(spark: SparkSession, d: str) -> DataFrame:
    """A finding as it is written out."""
    f = tables.run_findings(spark, d)
    return f.select(
        "entry_id", money.money_text(F.col("expected_amount")).alias("expected"), money.gap_text(F.col("gap")).alias("gap"), money.percent_text(F.col("confidence")).alias("confidence"),
        dates.month_name(F.col("billing_date")).alias("period"), dates.day_month(F.col("billing_date")).alias("day"), money.dashed(F.col("clause_id")).alias("clause"),
        money.counted(F.col("n_payments"), "payment").alias("payments"), text.emphasised(F.concat(F.lit("Short by $"), money.money_text(F.col("gap")), F.lit(" & 10% off"))).alias("sentence"),
    )


def finding_context(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer may read on a finding: clause text or why there is none, where and for
    how much to search, and how sure it is after each verdict."""
    f = tables.run_findings(spark, d)
    c = tables.clauses(spark, d).select(F.col("id").alias("clause_id"), "text", F.lit(True).alias("_there"))
    f = f.join(c, "clause_id", "left")
    said = F.when(F.col("clause_id").isNull(), "No clause reference is attached to this finding.").when(
        F.col("_there").isNull(), F.concat(F.lit("Clause reference "), F.col("clause_id"), F.lit(" does not exist."))
    ).otherwise(F.col("text"))
    low, high = evidence.amount_range(F.col("gap"), F.col("expected_amount"))
    first, last = evidence.search_window(F.col("billing_date"), 10)
    sure = F.col("confidence")
    return f.select(
        "entry_id", said.alias("clause"), low.alias("amount_low"), high.alias("amount_high"), first.alias("first_day"), last.alias("last_day"),
        evidence.confidence_after(sure, F.lit("confirmed")).alias("if_confirmed"), evidence.confidence_after(sure, F.lit("false_positive")).alias("if_rejected"),
    )


def finding_windows(spark: SparkSession, d: str) -> DataFrame:
    """What a client paid in the month of a finding, 15 days wider, where that differs from
    what was matched to it."""
    f = tables.run_findings(spark, d).select("entry_id", "client_id", "billing_date", "paid")
    low, high = dates.month_window(F.col("billing_date"))
    f = f.withColumns({"_low": low, "_high": high})
    f = f.withColumn("_m", F.explode_outer(F.sequence(dates.month_number(F.col("_low")), dates.month_number(F.col("_high")))))
    t = src.payments(spark, d).select("client_id", "transaction_date", "amount").withColumn("_m", dates.month_number(F.col("transaction_date")))
    near = F.when(F.col("transaction_date").between(F.col("_low"), F.col("_high")), F.col("amount"))
    out = f.join(t, ["client_id", "_m"], "left").groupBy("entry_id", "paid").agg(F.sum(near).alias("seen"))
    total = F.coalesce("seen", F.lit(0).cast("decimal(18,2)"))
    return out.filter(F.abs(total - F.col("paid")) >= 0.005).select("entry_id", shown(total).alias("window_total"), shown(F.col("paid")).alias("matched"))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by verdict in a run, and the value of true findings that a reviewer rejected."""
    f = tables.run_findings(spark, d)
    truth = src.planted(src.entries(spark, d)).filter("planted_type IS NOT NULL").select("entry_id", F.col("planted_type").alias("anomaly_type"))
    # a billing has one planted type at most, so the join repeats no finding
    f = f.join(truth.withColumn("_real", F.lit(True)), ["entry_id", "anomaly_type"], "left")
    s = F.col("status")
    lost = F.sum(F.when(F.col("_real") & (s == "false_positive"), F.col("gap")))
    return f.groupBy("run_id").agg(
        F.count_if(s == "confirmed").alias("confirmed"), F.count_if(s == "false_positive").alias("rejected"), F.count_if(s == "unverified").alias("open"),
        shown(F.sum(F.when(F.col("_real"), F.col("gap")))).alias("planted_value"), shown(lost).alias("destroyed_value"),
    )


def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Which screen a run has earned: empty, review, clean or processing. Runs here are ten
    customers each, as their keys follow on."""
    home = src.table(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.floor(F.col("c_custkey") / 10).alias("batch"))
    docs = tables.documents(spark, d).join(home, F.col("document_id") == F.col("client_id")).groupBy("batch").agg(
        F.count("*").alias("docs"), F.bool_and(F.col("extraction_status") == "complete").alias("read")
    )
    found = tables.run_findings(spark, d).filter("anomaly_type = 'zombie_discount'").join(home, "client_id").groupBy("batch").agg(F.count("*").alias("found"))
    out = home.groupBy("batch").agg(F.count("*").alias("clients")).join(docs, "batch", "left").join(found, "batch", "left").fillna(0, ["docs", "found"])
    state = F.when(F.col("docs") == 0, "empty").when(F.col("found") > 0, "review").when(F.col("read") & (F.col("clients") > 0), "clean").otherwise("processing")
    return out.select("batch", state.alias("state"))


def schedule_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Billings and dated milestones of all contracts, in order of date and kind."""
    t = schedule.timeline(src.contracts(spark, d), tables.milestones(spark, d).select("contract_id", "amount", "due_date"), *src.WINDOW)
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("billing_date", "payment_type", "expected_amount"))
    return t.select("client_id", "billing_date", "payment_type", shown(F.col("expected_amount")).alias("expected_amount"), place.cast("long").alias("place"))


def schedule_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Billings where no window is given: twelve months from each contract's start."""
    t = schedule.expected_timeline(src.contracts(spark, d))
    return t.groupBy("client_id").agg(F.count("*").alias("n"), F.max("billing_date").alias("last"), shown(F.sum("expected_amount")).alias("total"))


def milestones_open(spark: SparkSession, d: str) -> DataFrame:
    """Milestones that no date has been found for."""
    m = schedule.unresolved_milestones(tables.milestones(spark, d))
    return m.groupBy("contract_id").agg(F.count("*").alias("n"), shown(F.sum("amount")).alias("total"), F.count_if(F.col("due_condition").isNull()).alias("unconditional"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    c = written(src.contracts(spark, d), "contracts")
    return run.contract_plans(*[t(spark, d, c) for t in (tables.rules, tables.escalations, tables.discounts, tables.clauses)])


def contract_plans(spark: SparkSession, d: str) -> DataFrame:
    """Contracts rebuilt from their child tables."""
    p = _plans(spark, d)
    return p.select(
        "contract_id", F.col("esc_pct").cast("double").alias("esc_pct"), "esc_after", F.size(F.coalesce("discounts", F.array().cast(schedule.NO_DISCOUNTS))).alias("n_discounts"),
        "base_clause", "esc_clause", F.get("disc_clauses", 0)["clause_id"].alias("disc_clause"),
    )


def schedule_notes(spark: SparkSession, d: str) -> DataFrame:
    """Billings with the clause and the line that explain their amount."""
    p = _plans(spark, d)
    t = schedule.expected_timeline(p, *src.WINDOW)
    clause = schedule.row_clause(F.col("base_clause"), F.col("esc_clause"), F.col("disc_clauses"))
    return t.select("client_id", "billing_date", clause.alias("clause_id"), schedule.note(F.col("expected_amount")).alias("note"))


def _computed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return run.compute_run(_plans(spark, d), tables.trading_clients(spark, d), tables.statement_lines(spark, d), window=src.WINDOW)


def run_findings(spark: SparkSession, d: str) -> DataFrame:
    """Runs computed from their tables, kept apart: contracts reloaded, bank lines attributed,
    billings held against them, findings with the clause that proves them."""
    f = _computed(spark, d)["findings"]
    return f.select("run_id", "client_id", "billing_date", "anomaly_type", shown(F.col("gap")).alias("gap"), "confidence", "clause_id")


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the computed runs count of themselves."""
    n = run.counters(_plans(spark, d), tables.trading_clients(spark, d), tables.statement_lines(spark, d), _computed(spark, d))
    return n.withColumn("total_gap", shown(F.col("total_gap")))


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")


def _passes(spark: SparkSession, counts: list[DataFrame]) -> DataFrame:
    out = counts[0].withColumn("pass", F.lit(1))
    for k, c in enumerate(counts[1:], 2):
        out = out.unionByName(c.withColumn("pass", F.lit(k)))
    return out.filter("n > 0")


def run_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Rows stored, changed and kept by two recomputes in a row: the second changes none."""
    store = _store(spark)
    lines = tables.statement_lines(spark, d).select("run_id", "txn_id", "client_id", "transaction_date", "amount", "description")
    store.merge({"lines": Change(lines, ("txn_id",))})
    plans, clients = written(_plans(spark, d), "plans"), written(tables.trading_clients(spark, d), "clients")
    return _passes(spark, [run.recompute(store, plans, clients, window=src.WINDOW) for _ in range(2)])


def scenarios_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A scenario a nation, its contracts and payments with planted leaks, written to folders,
    read back and computed: what was planted and what is found."""
    home = src.table(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.concat(F.lit("nation-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("scenario"))
    c = src.contracts(spark, d).join(home, "client_id").withColumn("name", tables.trading_name(F.col("client_id"), False))
    said = {n: tables.clause_text(F.lit(n)) for n in tables.KINDS}
    rise = F.struct(F.col("esc_pct").alias("percentage"), F.col("esc_after").alias("after_months"), said["escalation"].alias("clause_text"))
    offs = F.transform("discounts", lambda x: F.struct(x["percentage"], x["duration_months"], said["discount"].alias("clause_text")))
    rules = F.struct(F.col("start_date").alias("contract_start_date"), F.col("base_amount"), F.col("frequency").alias("billing_frequency"), said["base_fee"].alias("base_clause"), rise.alias("escalation"), offs.alias("discounts"))
    contract = F.concat_ws("\n", said["base_fee"], said["escalation"], F.when(F.col("discounts").isNotNull(), said["discount"]))
    clients = c.select("scenario", "name", rules.alias("rules"), contract.alias("contract"))
    entries = written(src.entries(spark, d), "entries")
    p = src.payments_of(entries).drop("description").join(c.select("client_id", "scenario", F.upper(F.regexp_replace("name", " Ltd[.]$", " ACH")).alias("description")), "client_id")
    t = src.planted(entries).filter("planted_type IS NOT NULL").join(home, "client_id")
    truth = t.groupBy("scenario").agg(F.count("*").alias("n"), F.sum(F.col("expected_amount") - F.coalesce("paid_amount", F.lit(0))).cast("decimal(18,2)").alias("gap"))
    folder = f"{shared_dir(spark)}/scenarios-{uuid.uuid4().hex}"
    scenarios.write_scenarios(scenarios.scenario_files(clients, p, truth), folder)
    back = scenarios.read_scenarios(spark, folder)
    found = run.compute_run(scenarios.plans_of(back), back["clients"], back["lines"], window=src.WINDOW)["findings"]
    found = found.groupBy("run_id").agg(F.count("*").alias("found"), shown(F.sum("gap")).alias("found_gap"))
    n = back["lines"].groupBy("run_id").agg(F.count("*").alias("lines")).join(back["clients"].groupBy("run_id").agg(F.count("*").alias("clients")), "run_id")
    out = back["truth"].join(n, "run_id").join(found, "run_id", "left")
    return out.select("scenario", "clients", "lines", F.col("n").alias("planted"), shown(F.col("gap")).alias("planted_gap"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("found_gap", F.lit(0.0)).alias("found_gap"))


def verdicts_written(spark: SparkSession, d: str) -> DataFrame:
    """Stored findings after a reviewer's verdicts, some on findings that are gone."""
    store = _store(spark)
    f = cut(tables.run_findings(spark, d).select(*run.FINDING, "status"))
    blank = {"reasoning": F.lit(None).cast("string"), "verified_at": F.lit(None).cast("timestamp")}
    store.merge({"findings": Change(f.withColumns({"status": F.lit("unverified"), **blank}).select(*[c for c in run.FINDING if c in f.columns], "status", *blank), ("entry_id",))})
    said = {"reasoning": F.concat(F.lit("seen: "), "anomaly_type"), "verified_at": F.lit("2025-02-01").cast("timestamp")}
    sure = F.when(F.col("status") != "unverified", evidence.confidence_after(F.col("confidence"), F.col("status")))
    v = f.withColumns({**said, "confidence": sure}).select("run_id", "entry_id", "status", "reasoning", "confidence", "verified_at")
    run.write_verdicts(store, v.unionByName(v.withColumn("entry_id", -1 - F.col("entry_id"))))
    after = store.read("findings")
    return after.groupBy("run_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"), F.count("reasoning").alias("reasoned"), F.max("verified_at").cast("date").alias("verified_on"))


def places_written(spark: SparkSession, d: str) -> DataFrame:
    """Clauses placed on the pages of their documents and written back, twice."""
    store = _store(spark)
    home = tables.rules(spark, d).select("rule_id", "client_id").join(tables.clients(spark, d).select("client_id", "run_id"), "client_id").select("rule_id", "run_id")
    c = cut(tables.clauses(spark, d).join(home, "rule_id").select("run_id", "id", "document_id", "kind", "text", "page", "bbox", "method"))
    store.merge({"clauses": Change(c, ("id",))})
    each = c.filter("document_id IS NOT NULL").withColumn("page", F.when(F.col("kind") == "discount", 1).otherwise(0))
    pages = each.groupBy(F.col("document_id").alias("doc_id"), "page").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    at = grounding.locate(c.filter("document_id IS NOT NULL").select(F.col("id").alias("clause_id"), F.col("document_id").alias("doc_id"), F.col("text").alias("clause_text")), pages)
    at = cut(c.select("run_id", "id").join(at.select(F.col("clause_id").alias("id"), "page", "method"), "id", "left").withColumn("method", F.coalesce("method", F.lit("failed"))))
    _passes(spark, [run.write_places(store, at), run.write_places(store, at)])
    counts = _passes(spark, [run.write_places(store, at)]).groupBy("run_id").agg(F.sum("n").alias("kept"))
    after = store.read("clauses").groupBy("run_id", "method", "page").agg(F.count("*").alias("n"), F.count("bbox").alias("boxed"))
    return after.join(counts, "run_id")


def run_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of every table when run 2 is deleted."""
    all_ = {n: getattr(tables, n)(spark, d) for n in ("clients", "documents", "rules", "clauses", "escalations", "discounts", "lines")}
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in run.without_run(all_, 2).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clients_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers entered as clients of the run of their nation, beside the customers."""
    s, n = src.table(spark, d, "supplier"), src.table(spark, d, "nation")
    names = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("run_id"), F.explode(F.array(F.col("s_name"), F.concat("s_name", F.lit(", Inc.")), F.upper("s_name"))).alias("name"))
    c = run.upsert_clients(tables.clients(spark, d), names)
    return c.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("client_id").alias("ids"), F.count_distinct("normalized_name").alias("names"))


def vocabulary_checks(spark: SparkSession, d: str) -> DataFrame:
    """Values outside the six vocabularies, of values as a feed spells them: some are none. Then
    what the stored findings and clauses hold outside the settled verdicts and the exact method."""
    k = F.col("c_custkey")
    raw = src.table(spark, d, "customer").select(
        F.when(k % 4 == 0, "underpaid").otherwise("ghost_invoice").alias("anomaly_type"), F.when(k % 5 == 0, "open").when(k % 5 == 1, "needs_review").otherwise("confirmed").alias("status"),
        F.when(k % 3 == 0, "guessed").when(k % 3 == 1, "fuzzy").alias("method"), F.when(k % 6 == 0, "one-off").otherwise("milestone").alias("payment_type"),
        F.lower("c_mktsegment").alias("frequency"), F.when(k % 7 == 0, "done").otherwise("complete").alias("extraction_status"),
    )
    parts = [run.violations(raw, name, allowed) for name, allowed in run.VOCABULARIES.items()]
    parts += [run.violations(tables.run_findings(spark, d), "status", SETTLED), run.violations(tables.clauses(spark, d), "method", ("exact",))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two readers to every contract, right and wrong by rule, with the key's."""
    c = src.contracts(spark, d).withColumn("has_disc", F.col("discounts").isNotNull())
    k = F.col("client_id")
    quote = {n: tables.clause_text(F.lit(n)) for n in tables.KINDS}
    c = c.withColumns({"q_base": quote["base_fee"], "q_esc": quote["escalation"], "q_disc": F.when(F.col("has_disc"), quote["discount"])})
    c = c.withColumn("document", F.concat_ws("\n ", "q_base", "q_esc", "q_disc")).withColumn("model", F.explode(F.array(F.lit("plain"), F.lit("tuned"))))
    plain = F.col("model") == "plain"
    return c.select(
        "model", k, "document", (~(plain & (k % 19 == 0))).alias("usable"), F.col("base_amount").cast("double").alias("want_amount"),
        F.when(plain & (k % 3 == 0), F.col("base_amount") + 500).when(k % 29 != 0, F.col("base_amount")).cast("double").alias("amount"),
        F.col("frequency").alias("want_frequency"), F.when(plain, "monthly").otherwise(F.col("frequency")).alias("frequency"),
        F.col("esc_pct").cast("double").alias("want_pct"), F.when(~(plain & (k % 4 == 0)), F.when(k % 31 == 0, F.col("esc_pct") + 1).otherwise(F.col("esc_pct"))).cast("double").alias("pct"),
        F.when(plain & (k % 5 == 0), "The fee may go up from time to time as both sides agree.").when(k % 23 == 0, "null").otherwise(F.col("q_esc")).alias("esc_quote"),
        F.col("q_disc").alias("disc_quote"),
    )


def _quotes(a: DataFrame) -> DataFrame:
    """All quotes of the answers: of the rise, if one is named, and of the discount."""
    esc = F.when(F.col("pct").isNotNull(), F.struct(F.lit("escalation").alias("kind"), F.col("esc_quote").alias("quote"), F.col("pct").cast("decimal(9,6)").alias("percentage")))
    disc = F.when(F.col("disc_quote").isNotNull(), F.struct(F.lit("discount").alias("kind"), F.col("disc_quote").alias("quote"), F.lit(10).cast("decimal(9,6)").alias("percentage")))
    return a.filter("usable").select("model", "client_id", "document", F.explode(F.array_compact(F.array(esc, disc))).alias("_q")).select("model", "client_id", "document", "_q.*")


def grounding_filter(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the quotes of the answers, by reader, kind and status."""
    g = grounding.ground(_quotes(answers(spark, d)))
    return g.groupBy("model", "kind", "status").agg(F.count("*").alias("n"), F.count_if("grounded").alias("grounded"))


def exam_marks(spark: SparkSession, d: str) -> DataFrame:
    """Each answer marked after its quotes were checked: a rise that its quote does not bear
    out is not given. Absent is right where the key has none."""
    a = answers(spark, d)
    g = grounding.ground(_quotes(a)).groupBy("model", "client_id").agg(
        F.count_if((F.col("kind") == "escalation") & (F.col("status") == "kept")).alias("_rise"), F.count_if(F.col("status") == "kept").alias("quotes")
    )
    a = a.join(g, ["model", "client_id"], "left").withColumn("_p", F.when(F.col("_rise") > 0, F.col("pct")))
    right = lambda c: F.col("usable") & c
    return a.select(
        "model", "client_id", "usable", right(money.same_money(F.col("amount"), F.col("want_amount"))).alias("amount"), right(F.col("frequency") == F.col("want_frequency")).alias("frequency"),
        right(money.same_money(F.col("_p"), F.col("want_pct"))).alias("escalation"), right(F.col("amount").isNotNull() | F.col("_p").isNotNull() | F.col("disc_quote").isNotNull()).alias("found"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"),
    )


def exam_report(spark: SparkSession, d: str) -> DataFrame:
    """Marks by reader: counts and per cent of each measure, and what always naming the
    commonest rhythm would score."""
    m = exam_marks(spark, d)
    n = F.count("*")
    pct = lambda c: F.round(100.0 * F.count_if(c) / n, 1)
    r = m.groupBy("model").agg(
        n.alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("usable", "amount", "frequency", "escalation", "found")],
        *[pct(F.col(c)).alias(f"pct_{c}") for c in ("amount", "frequency", "escalation")], F.sum("quotes").alias("quotes"),
    )
    mix = src.contracts(spark, d).groupBy("frequency").agg(F.count("*").alias("n")).agg(F.round(100.0 * F.max("n") / F.sum("n"), 1).alias("majority_pct"))
    return r.crossJoin(mix)


def extraction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that extractions of contracts come to in the rule and child tables."""
    a = answers(spark, d).filter("model = 'tuned'")
    offs = F.array(F.struct(F.lit(10.0).alias("percentage"), F.lit(3).alias("duration_months"), F.col("disc_quote").alias("quote")))
    x = a.select(
        F.col("client_id").alias("rule_id"), F.col("client_id").alias("document_id"), F.col("amount").alias("base_amount"), F.col("pct").alias("esc_pct"), F.lit(12).alias("esc_after"),
        "esc_quote", F.when(F.col("disc_quote").isNotNull(), offs).alias("discounts"), "document",
    )
    t = run.normalised(x)
    key = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).cast("long") * 100 + F.split_part(c, F.lit(":"), F.lit(2)).cast("long")
    out = t["clauses"].groupBy(F.concat_ws(" ", F.lit("clause"), "kind", F.coalesce("method", F.lit("present"))).alias("name")).agg(F.count("*").alias("n"), F.sum(key("id")).alias("ids"))
    for kind in ("escalations", "discounts"):
        out = out.unionByName(t[kind].agg(F.lit(kind).alias("name"), F.count("*").alias("n"), F.sum(key("clause_id")).alias("ids")))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        run_list, run_documents, document_status, run_clients, run_transactions, clause_rows, clause_rates, run_summary, run_table_counts, findings_view, findings_filtered,
        finding_texts, finding_context, finding_windows, verdict_counts, run_states, schedule_milestones, schedule_horizon, milestones_open, contract_plans, schedule_notes,
        run_findings, run_counters, run_recomputed, scenarios_round_trip, verdicts_written, places_written, run_deleted, clients_upserted, vocabulary_checks, grounding_filter, exam_marks, exam_report, extraction_rows,
    )
}

_RUN = BASE + """, rc AS (
  SELECT c_custkey AS client_id, n_regionkey AS run_id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
), docs AS (
  SELECT client_id AS document_id, run_id, 'contract_' || client_id || CASE WHEN client_id % 17 = 0 THEN '.csv' ELSE '.txt' END AS filename,
    CASE WHEN client_id % 11 = 0 THEN 'failed' WHEN client_id % 7 = 0 THEN 'processing' ELSE 'complete' END AS extraction_status,
    CAST(DATE '2025-01-01' + to_days(CAST(client_id % 300 AS INTEGER)) AS DATE) AS uploaded_on
  FROM contracts JOIN rc USING (client_id)
), said AS (
  SELECT *, 'The ' || frequency || ' fee is $' || CAST(base_amount AS INTEGER) || '.' AS q_base,
    'The fee of $' || CAST(base_amount AS INTEGER) || ' shall increase by ' || CAST(esc_pct AS INTEGER) || '% every 12 months.' AS q_esc,
    CASE WHEN has_disc THEN 'A discount of 10% applies for the first 3 months.' END AS q_disc FROM contracts
), cl AS (
  SELECT client_id * 10 + n AS id, client_id AS rule_id, CASE WHEN client_id % 13 <> 0 THEN client_id END AS document_id, kind,
    CASE n WHEN 1 THEN q_base WHEN 2 THEN q_esc ELSE q_disc END AS text,
    CASE WHEN (client_id * 10 + n) % 4 <> 0 THEN CAST((client_id * 10 + n) % 9 AS INTEGER) END AS page,
    (client_id * 10 + n) % 4 <> 0 AND (client_id * 10 + n) % 5 <> 0 AS is_grounded,
    CASE (client_id * 10 + n) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'fuzzy' ELSE 'exact' END AS method
  FROM said, (VALUES (1, 'base_fee'), (2, 'escalation'), (3, 'discount')) v(n, kind) WHERE n <> 3 OR has_disc
), fr AS (
  SELECT f.*, rc.run_id, CASE WHEN entry_id % 17 <> 0 THEN f.client_id * 10 + CASE clause_role WHEN 'escalation' THEN 2 WHEN 'discount' THEN 3 ELSE 1 END END AS clause_id,
    CASE WHEN entry_id % 7 = 0 THEN 'needs_review' WHEN entry_id % 5 = 0 THEN 'unverified' WHEN confidence >= 0.9 THEN 'confirmed' WHEN confidence < 0.6 THEN 'false_positive' ELSE 'unverified' END AS status
  FROM findings f JOIN rc USING (client_id)
), ms AS (
  SELECT o_orderkey AS id, o_custkey AS contract_id, CAST(CAST(o_totalprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS amount,
    CASE WHEN o_orderstatus = 'O' THEN 'on delivery' END AS due_condition, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) END AS due_date
  FROM orders WHERE o_orderpriority = '1-URGENT'
), tl AS (
  SELECT p.txn_id, run_id, CASE WHEN txn_id % 13 <> 5 THEN p.client_id END AS client_id, transaction_date, amount,
    CASE WHEN p.client_id % 13 <> 0 THEN p.client_id END AS document_id FROM paid_rows p JOIN rc ON rc.client_id = p.client_id
)"""
# the runs' own reconciliation: lines without a payer are left out, and those that name one of two of a run
_TWICE = """SELECT c_custkey FROM (SELECT c_custkey, count(*) OVER (PARTITION BY n_regionkey, c_custkey - CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS same
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE same > 1"""
_PAID = "(planted_type IS NULL OR planted_type <> 'ghost_invoice')"
_LOST = f"(entry_id % 13 = 5 OR (entry_id % 3 = 1 AND client_id IN ({_TWICE})))"
_OWN = BASE.replace(f"FROM truth WHERE {_PAID[1:-1]}", f"FROM truth WHERE {_PAID} AND NOT {_LOST}") + """, rc AS (
  SELECT c_custkey AS client_id, n_regionkey AS run_id FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
_COUNTED = f"""SELECT run_id, count(*) FILTER ({_PAID} AND {_LOST}) AS unattributed, count(*) FILTER ({_PAID} AND NOT {_LOST} AND entry_id % 3 = 1) AS newly,
  count(*) FILTER ({_PAID}) AS lines, count(*) AS billings FROM truth JOIN rc USING (client_id) GROUP BY run_id"""
_ANSWERS = _RUN + """, a AS (
  SELECT model, client_id, concat_ws(chr(10) || ' ', q_base, q_esc, q_disc) AS document, NOT (model = 'plain' AND client_id % 19 = 0) AS usable,
    CAST(base_amount AS DOUBLE) AS want_amount, CAST(CASE WHEN model = 'plain' AND client_id % 3 = 0 THEN base_amount + 500 WHEN client_id % 29 <> 0 THEN base_amount END AS DOUBLE) AS amount,
    frequency AS want_frequency, CASE WHEN model = 'plain' THEN 'monthly' ELSE frequency END AS frequency, CAST(esc_pct AS DOUBLE) AS want_pct,
    CAST(CASE WHEN model = 'plain' AND client_id % 4 = 0 THEN NULL WHEN client_id % 31 = 0 THEN esc_pct + 1 ELSE esc_pct END AS DOUBLE) AS pct,
    CASE WHEN model = 'plain' AND client_id % 5 = 0 THEN 'The fee may go up from time to time as both sides agree.' WHEN client_id % 23 = 0 THEN 'null' ELSE q_esc END AS esc_quote, q_disc
  FROM said, (VALUES ('plain'), ('tuned')) v(model)
), q AS (
  SELECT model, client_id, document, 'escalation' AS kind, esc_quote AS quote, pct FROM a WHERE usable AND pct IS NOT NULL
  UNION ALL SELECT model, client_id, document, 'discount', q_disc, 10 FROM a WHERE usable AND q_disc IS NOT NULL
), g AS (
  SELECT *, CASE WHEN lower(quote) = 'null' THEN 'blank' WHEN NOT contains(lower(regexp_replace(document, '\\s+', ' ', 'g')), lower(quote)) THEN 'dropped'
    WHEN NOT contains(quote, CAST(CAST(pct AS INTEGER) AS VARCHAR) || '%') THEN 'bad_figure' ELSE 'kept' END AS status FROM q
), m AS (
  SELECT a.*, CASE WHEN r.rise > 0 THEN pct END AS p, coalesce(r.quotes, 0) AS quotes FROM a LEFT JOIN (
    SELECT model, client_id, count(*) FILTER (kind = 'escalation' AND status = 'kept') AS rise, count(*) FILTER (status = 'kept') AS quotes FROM g GROUP BY 1, 2) r USING (model, client_id)
), marks AS (
  SELECT model, client_id, usable, usable AND coalesce(abs(amount - want_amount) <= 0.01, false) AS amount, usable AND frequency = want_frequency AS frequency,
    usable AND coalesce(abs(p - want_pct) <= 0.01, false) AS escalation, usable AND (amount IS NOT NULL OR p IS NOT NULL OR q_disc IS NOT NULL) AS found, quotes FROM m
)"""
_COUNTS = " UNION ALL ".join(
    [f"SELECT run_id, '{n}' AS name FROM {t}" for n, t in (("clients", "rc"), ("documents", "docs"), ("lines", "tl"), ("findings", "fr"))]
    + ["SELECT run_id, 'rules' FROM contracts JOIN rc USING (client_id)", "SELECT run_id, 'clauses' FROM cl JOIN rc ON rc.client_id = cl.rule_id",
       "SELECT run_id, 'escalations' FROM contracts JOIN rc USING (client_id), range(2)", "SELECT run_id, 'discounts' FROM contracts JOIN rc USING (client_id) WHERE has_disc"]
)
SQL = {
    "run_list": """SELECT *, row_number() OVER (ORDER BY created_on DESC, run_id DESC) AS place, row_number() OVER (ORDER BY created_on DESC, run_id DESC) = 1 AS is_shown
      FROM (SELECT r_regionkey AS run_id, r_name AS label, CAST(DATE '2025-01-01' + to_days(CAST(r_regionkey * 7 % 5 AS INTEGER)) AS DATE) AS created_on FROM region)""",
    "run_documents": _RUN + """SELECT document_id, run_id, filename, extraction_status, CASE WHEN filename LIKE '%.csv' THEN 'statement' ELSE 'invoice' END AS path,
      extraction_status = 'complete' AS can_extract, row_number() OVER (PARTITION BY run_id ORDER BY uploaded_on DESC, document_id DESC) AS place FROM docs""",
    "document_status": _RUN + """SELECT run_id, count(*) AS n, count(*) FILTER (extraction_status = 'complete') AS done, count(*) FILTER (extraction_status = 'failed') AS failed,
      count(*) FILTER (extraction_status = 'processing') AS in_flight FROM docs GROUP BY run_id""",
    "run_clients": _RUN + """SELECT rc.client_id, run_id, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS normalized_name, CAST(CASE WHEN c.client_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS contracts,
      row_number() OVER (PARTITION BY run_id ORDER BY name, rc.client_id) AS place FROM rc LEFT JOIN contracts c USING (client_id)""",
    "run_transactions": _RUN + """SELECT txn_id, tl.run_id, transaction_date, name, filename, CAST(amount AS DOUBLE) AS amount FROM tl LEFT JOIN rc USING (client_id)
      LEFT JOIN docs USING (document_id) WHERE transaction_date >= DATE '1997-01-01'""",
    "clause_rows": _RUN + "SELECT id, rule_id, kind, text, page, method, filename, is_grounded FROM cl LEFT JOIN docs USING (document_id)",
    "clause_rates": _RUN + "SELECT count(*) AS n, " + ", ".join(
        f"round(100.0 * count(*) FILTER (method {c}) / count(*), 1)::DOUBLE AS {n}_pct" for n, c in (("exact", "= 'exact'"), ("fuzzy", "= 'fuzzy'"), ("failed", "= 'failed'"), ("grounded", "<> 'failed'"))
    ) + " FROM cl",
    "run_summary": _RUN + """, s AS (SELECT fr.run_id, sum(gap) AS g, count(*) AS findings, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (clause_id IS NULL) AS unlinked,
        count(*) FILTER (cl.id IS NOT NULL AND page IS NULL) AS unlocatable, count(DISTINCT client_id) AS affected, """ + ", ".join(
        f"count(*) FILTER (anomaly_type = '{t}') AS n_{t}" for t in TYPE_ORDER
    ) + """ FROM fr LEFT JOIN cl ON cl.id = fr.clause_id GROUP BY fr.run_id),
      z AS (SELECT r_regionkey AS run_id, coalesce(s.findings, 0) AS findings, coalesce(unverified, 0) AS unverified, coalesce(unlinked, 0) AS unlinked, coalesce(unlocatable, 0) AS unlocatable,
        coalesce(affected, 0) AS affected, """ + ", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in TYPE_ORDER) + """, coalesce(n, 0) AS clients, coalesce(nd, 0) AS documents, coalesce(CAST(g AS DOUBLE), 0) AS total_gap
        FROM region LEFT JOIN s ON s.run_id = r_regionkey LEFT JOIN (SELECT run_id, count(*) AS n FROM rc GROUP BY 1) c ON c.run_id = r_regionkey
        LEFT JOIN (SELECT run_id, count(*) AS nd FROM docs GROUP BY 1) dd ON dd.run_id = r_regionkey)
      SELECT *, findings - unlinked - unlocatable AS grounded, CASE WHEN findings > 0 THEN round((findings - unlinked - unlocatable) / findings, 3) ELSE 0.0 END AS grounding_rate,
        affected || ' of ' || clients AS affected_of FROM z""",
    "run_table_counts": _RUN + f"SELECT run_id, name, count(*) AS n FROM ({_COUNTS}) GROUP BY run_id, name",
    "findings_view": _RUN + """, v AS (SELECT *, bool_or(status = 'false_positive') OVER (PARTITION BY run_id) AS any_no FROM fr)
      SELECT entry_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY gap DESC, entry_id) AS by_amount, row_number() OVER (PARTITION BY run_id ORDER BY lower(client_name), gap DESC, entry_id) AS by_client,
        row_number() OVER (PARTITION BY run_id ORDER BY billing_date DESC NULLS LAST, gap DESC, entry_id) AS by_date, lower(concat_ws(' ', client_name, anomaly_type, status)) AS haystack
      FROM v WHERE NOT any_no OR status <> 'false_positive'""",
    "findings_filtered": _RUN + "SELECT entry_id, run_id FROM fr WHERE status = 'unverified' AND anomaly_type = 'short_change' AND contains(lower(client_name || ' ' || anomaly_type), '7')",
    "finding_texts": _RUN + """SELECT entry_id, format('{:,.2f}', CAST(expected_amount AS DOUBLE)) AS expected, CASE WHEN abs(gap) < 0.005 THEN '—' ELSE '(' || format('{:,.2f}', CAST(abs(gap) AS DOUBLE)) || ')' END AS gap,
        CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS confidence, strftime(billing_date, '%B %Y') AS period, strftime(billing_date, '%d %b') AS day,
        coalesce(CAST(clause_id AS VARCHAR), '—') AS clause, n_payments || CASE WHEN n_payments = 1 THEN ' payment' ELSE ' payments' END AS payments,
        'Short by <b>$' || format('{:,.2f}', CAST(gap AS DOUBLE)) || '</b> &amp; <b>10%</b> off' AS sentence FROM fr""",
    "finding_context": _RUN + """SELECT entry_id, CASE WHEN clause_id IS NULL THEN 'No clause reference is attached to this finding.' WHEN cl.id IS NULL THEN 'Clause reference ' || clause_id || ' does not exist.' ELSE text END AS clause,
        CAST(round(t * 0.85, 2) AS DOUBLE) AS amount_low, CAST(round(t * 1.15, 2) AS DOUBLE) AS amount_high, CAST(billing_date - 55 AS DATE) AS first_day, CAST(billing_date + 55 AS DATE) AS last_day,
        greatest(confidence, 0.9) AS if_confirmed, least(confidence, 0.1) AS if_rejected
      FROM (SELECT *, CAST(CASE WHEN gap > 0 THEN gap ELSE expected_amount END AS DECIMAL(18,2)) AS t FROM fr) f LEFT JOIN cl ON cl.id = f.clause_id""",
    "finding_windows": _RUN + """, w AS (SELECT f.entry_id, any_value(f.paid) AS paid, coalesce(sum(p.amount), 0) AS seen FROM fr f LEFT JOIN paid_rows p ON p.client_id = f.client_id
        AND p.transaction_date BETWEEN date_trunc('month', f.billing_date) - INTERVAL 15 DAY AND last_day(f.billing_date) + INTERVAL 15 DAY GROUP BY f.entry_id)
      SELECT entry_id, CAST(seen AS DOUBLE) AS window_total, CAST(paid AS DOUBLE) AS matched FROM w WHERE abs(seen - paid) >= 0.005""",
    "verdict_counts": _RUN + """SELECT run_id, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'false_positive') AS rejected, count(*) FILTER (status = 'unverified') AS open,
        coalesce(CAST(sum(gap) FILTER (t.entry_id IS NOT NULL) AS DOUBLE), 0) AS planted_value, coalesce(CAST(sum(gap) FILTER (t.entry_id IS NOT NULL AND status = 'false_positive') AS DOUBLE), 0) AS destroyed_value
      FROM fr LEFT JOIN (SELECT entry_id, planted_type FROM truth WHERE planted_type IS NOT NULL) t ON t.entry_id = fr.entry_id AND t.planted_type = fr.anomaly_type GROUP BY run_id""",
    "run_states": _RUN + """, x AS (SELECT c_custkey // 10 AS batch, count(d.document_id) AS docs, bool_and(extraction_status = 'complete') FILTER (d.document_id IS NOT NULL) AS done, count(f.client_id) AS found
        FROM customer LEFT JOIN docs d ON d.document_id = c_custkey LEFT JOIN (SELECT DISTINCT client_id FROM fr WHERE anomaly_type = 'zombie_discount') f ON f.client_id = c_custkey GROUP BY 1)
      SELECT batch, CASE WHEN docs = 0 THEN 'empty' WHEN found > 0 THEN 'review' WHEN done THEN 'clean' ELSE 'processing' END AS state FROM x""",
    "schedule_milestones": _RUN + """, t AS (SELECT client_id, billing_date, 'recurring' AS payment_type, expected_amount FROM keyed UNION ALL
        SELECT contract_id, due_date, 'milestone', amount FROM ms JOIN contracts ON client_id = contract_id WHERE due_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31')
      SELECT client_id, billing_date, payment_type, CAST(expected_amount AS DOUBLE) AS expected_amount, row_number() OVER (PARTITION BY client_id ORDER BY billing_date, payment_type, expected_amount) AS place FROM t""",
    "schedule_horizon": BASE + """, h AS (SELECT client_id, start_date, r0, has_disc, CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 WHEN 'annual' THEN 12 ELSE 100 END AS step FROM rates),
        b AS (SELECT *, CAST(start_date + to_months(CAST(i * step AS INTEGER)) AS DATE) AS billing_date, i * step AS m FROM h, range(0, 12) t(i) WHERE i * step <= 11)
      SELECT client_id, count(*) AS n, max(billing_date) AS "last", CAST(sum(CASE WHEN has_disc AND m < 3 THEN CAST(round(r0 * 0.90, 2) AS DECIMAL(18,2)) ELSE r0 END) AS DOUBLE) AS total
      FROM b WHERE billing_date <= CAST(start_date + INTERVAL 11 MONTH AS DATE) GROUP BY client_id""",
    "milestones_open": _RUN + "SELECT contract_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, count(*) FILTER (due_condition IS NULL) AS unconditional FROM ms WHERE due_date IS NULL GROUP BY contract_id",
    "contract_plans": BASE + """SELECT client_id AS contract_id, CAST(esc_pct AS DOUBLE) AS esc_pct, CAST(12 AS INTEGER) AS esc_after, CAST(CASE WHEN has_disc THEN 1 ELSE 0 END AS INTEGER) AS n_discounts,
      client_id * 10 + 1 AS base_clause, client_id * 10 + 2 AS esc_clause, CASE WHEN has_disc THEN client_id * 10 + 3 END AS disc_clause FROM contracts""",
    "schedule_notes": BASE + """SELECT client_id, billing_date, client_id * 10 + CASE WHEN applied_escalation THEN 2 WHEN applied_discount_pct > 0 THEN 3 ELSE 1 END AS clause_id,
      concat_ws(' · ', 'Base ' || format('{:,.2f}', CAST(base_amount AS DOUBLE)), CASE WHEN applied_escalation THEN '+' || CAST(esc_pct AS INTEGER) || '% escalation applied' END,
        CASE WHEN applied_discount_pct > 0 THEN '-10% discount active' END, CASE WHEN NOT applied_escalation AND applied_discount_pct = 0 THEN 'contract rate, no adjustment' END,
        '= ' || format('{:,.2f}', CAST(expected_amount AS DOUBLE))) AS note FROM keyed""",
    "run_findings": _OWN + """SELECT run_id, client_id, billing_date, anomaly_type, CAST(gap AS DOUBLE) AS gap, confidence,
      client_id * 10 + CASE clause_role WHEN 'escalation' THEN 2 WHEN 'discount' THEN 3 ELSE 1 END AS clause_id FROM findings JOIN rc USING (client_id)""",
    "run_counters": _OWN + f""", k AS ({_COUNTED}), f AS (SELECT run_id, count(*) AS findings, CAST(sum(gap) AS DOUBLE) AS total_gap, """ + ", ".join(
        f"count(*) FILTER (anomaly_type = '{t}') AS n_{t}" for t in TYPE_ORDER
    ) + """ FROM findings JOIN rc USING (client_id) GROUP BY run_id),
      c AS (SELECT run_id, count(*) AS contracts FROM contracts JOIN rc USING (client_id) GROUP BY run_id)
      SELECT run_id, contracts, CAST(0 AS BIGINT) AS skipped, billings AS timeline_rows, unattributed, newly AS newly_attributed, CAST(0 AS BIGINT) AS unmatched, findings, total_gap, """
    + ", ".join(f"n_{t}" for t in TYPE_ORDER) + " FROM k JOIN f USING (run_id) JOIN c USING (run_id)",
    "run_recomputed": _OWN + f""", k AS ({_COUNTED}), f AS (SELECT run_id, count(*) AS n FROM findings JOIN rc USING (client_id) GROUP BY run_id),
      r AS (SELECT 'findings' AS name, run_id, 1 AS pass, 'inserted' AS kind, n FROM f UNION ALL SELECT 'findings', run_id, 2, 'kept', n FROM f
        UNION ALL SELECT 'timeline', run_id, 1, 'inserted', billings FROM k UNION ALL SELECT 'timeline', run_id, 2, 'kept', billings FROM k
        UNION ALL SELECT 'lines', run_id, 1, 'changed', newly FROM k UNION ALL SELECT 'lines', run_id, 1, 'kept', lines - newly FROM k)
      SELECT name, CAST(run_id AS BIGINT) AS run_id, CAST(pass AS INTEGER) AS pass, kind, n FROM r WHERE n > 0""",
    "scenarios_round_trip": BASE + """, h AS (SELECT c_custkey AS client_id, 'nation-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS scenario FROM customer),
        c AS (SELECT scenario, count(*) AS clients FROM contracts JOIN h USING (client_id) GROUP BY 1), l AS (SELECT scenario, count(*) AS lines FROM paid_rows JOIN h USING (client_id) GROUP BY 1),
        t AS (SELECT scenario, count(*) AS planted, CAST(sum(expected_amount - coalesce(amount, 0)) AS DOUBLE) AS planted_gap
          FROM truth JOIN h USING (client_id) LEFT JOIN paid_rows p ON p.txn_id = truth.entry_id WHERE planted_type IS NOT NULL GROUP BY 1),
        f AS (SELECT scenario, count(*) AS found, CAST(sum(gap) AS DOUBLE) AS found_gap FROM findings JOIN h USING (client_id) GROUP BY 1)
      SELECT scenario, clients, lines, coalesce(planted, 0) AS planted, coalesce(planted_gap, 0) AS planted_gap, coalesce(found, 0) AS found, coalesce(found_gap, 0) AS found_gap
      FROM c JOIN l USING (scenario) LEFT JOIN t USING (scenario) LEFT JOIN f USING (scenario)""",
    "verdicts_written": _RUN + """SELECT run_id, status, count(*) AS n, round(sum(CASE status WHEN 'confirmed' THEN greatest(confidence, 0.9) WHEN 'false_positive' THEN least(confidence, 0.1) ELSE confidence END), 2)::DOUBLE AS confidence,
      count(*) AS reasoned, DATE '2025-02-01' AS verified_on FROM fr GROUP BY run_id, status""",
    "places_written": _RUN + """, c AS (SELECT rc.run_id, cl.*, CASE WHEN cl.document_id IS NOT NULL THEN CASE kind WHEN 'discount' THEN 1 ELSE 0 END END AS seat FROM cl JOIN rc ON rc.client_id = cl.rule_id)
      SELECT run_id, CASE WHEN seat IS NULL THEN 'failed' ELSE 'exact' END AS method, CAST(seat AS INTEGER) AS page, count(*) AS n,
        count(*) FILTER ((page IS NOT DISTINCT FROM seat) AND id % 4 <> 0) AS boxed, any_value(kept) AS kept
      FROM c JOIN (SELECT run_id, count(*) AS kept FROM c GROUP BY run_id) USING (run_id) GROUP BY run_id, seat""",
    "run_deleted": _RUN + """, k AS (SELECT client_id FROM rc WHERE run_id <> 2) SELECT 'clients' AS name, count(*) AS n FROM k UNION ALL SELECT 'documents', count(*) FROM docs WHERE run_id <> 2
      UNION ALL SELECT 'rules', count(*) FROM contracts JOIN k USING (client_id) UNION ALL SELECT 'clauses', count(*) FROM cl JOIN k ON client_id = rule_id
      UNION ALL SELECT 'escalations', 2 * count(*) FROM contracts JOIN k USING (client_id) UNION ALL SELECT 'discounts', count(*) FROM contracts JOIN k USING (client_id) WHERE has_disc
      UNION ALL SELECT 'lines', count(*) FROM tl WHERE run_id <> 2""",
    "clients_upserted": """WITH c AS (SELECT n_regionkey AS run_id, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
        SELECT n_regionkey, -1 - s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT run_id, count(*) AS n, count(*) AS ids, count(*) AS names FROM c GROUP BY run_id""",
    "vocabulary_checks": _RUN + """SELECT 'status' AS name, status AS value, count(*) AS n FROM fr WHERE status NOT IN ('confirmed', 'false_positive') GROUP BY 2
      UNION ALL SELECT 'method', method, count(*) FROM cl WHERE method <> 'exact' GROUP BY 2
      UNION ALL SELECT name, value, count(*) FROM customer, (VALUES ('anomaly_type', 4, 'underpaid'), ('status', 5, 'open'), ('method', 3, 'guessed'), ('payment_type', 6, 'one-off'), ('extraction_status', 7, 'done'))
        v(name, step, value) WHERE c_custkey % step = 0 GROUP BY name, value
      UNION ALL SELECT 'frequency', lower(c_mktsegment), count(*) FROM customer GROUP BY 2""",
    "grounding_filter": _ANSWERS + " SELECT model, kind, status, count(*) AS n, count(*) FILTER (status IN ('bad_figure', 'kept')) AS grounded FROM g GROUP BY model, kind, status",
    "exam_marks": _ANSWERS + " SELECT * FROM marks",
    "exam_report": _ANSWERS + " SELECT model, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in ("usable", "amount", "frequency", "escalation", "found")) + ", " + ", ".join(
        f"round(100.0 * count(*) FILTER ({c}) / count(*), 1)::DOUBLE AS pct_{c}" for c in ("amount", "frequency", "escalation")
    ) + """, CAST(sum(quotes) AS BIGINT) AS quotes, (SELECT round(100.0 * max(n) / sum(n), 1)::DOUBLE FROM (SELECT frequency, count(*) AS n FROM contracts GROUP BY 1)) AS majority_pct FROM marks GROUP BY model""",
    "extraction_rows": _ANSWERS + """, t AS (SELECT *, coalesce(contains(esc_quote, CAST(CAST(amount AS INTEGER) AS VARCHAR)), false) AS named FROM a WHERE model = 'tuned'),
      c AS (SELECT 'clause base_fee present' AS name, client_id * 100 AS id FROM t WHERE named
        UNION ALL SELECT CASE WHEN esc_quote = 'null' THEN 'clause escalation failed' ELSE 'clause escalation present' END, client_id * 100 + 1 FROM t
        UNION ALL SELECT 'clause discount present', client_id * 100 + 2 FROM t WHERE q_disc IS NOT NULL
        UNION ALL SELECT 'escalations', client_id * 100 + 1 FROM t UNION ALL SELECT 'discounts', client_id * 100 + 2 FROM t WHERE q_disc IS NOT NULL)
      SELECT name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM c GROUP BY name""",
}
