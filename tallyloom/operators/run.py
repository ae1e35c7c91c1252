"""A run from its tables to findings with their clauses.

Tables (each with run_id or reaching it by its client): clients(client_id, run_id, name),
rules(rule_id, client_id, document_id, base_amount, frequency, start_date, end_date),
escalations(id, rule_id, clause_id, percentage, after_months), discounts(id, rule_id,
clause_id, percentage, duration_months), milestones(id, rule_id, clause_id, description,
amount, due_condition, due_date), clauses(id, rule_id, document_id, kind, text, page, bbox,
method), lines(txn_id, run_id, client_id, transaction_date, amount, description).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import normalise_name, stands_in
from tallyloom.operators import reconcile as rec
from tallyloom.operators import schedule
from tallyloom.operators.attribution import attribute
from tallyloom.sources.lineage import written
from tallyloom.sources.stored import Change, Store

#: Closed vocabularies of the tables.
VOCABULARIES = {
    "anomaly_type": ("ghost_invoice", "forgotten_raise", "zombie_discount", "short_change"),
    "status": ("unverified", "confirmed", "false_positive", "needs_review"),
    "method": ("exact", "fuzzy", "failed"),
    "payment_type": ("recurring", "milestone"),
    "frequency": ("monthly", "quarterly", "annual", "one_time", "unknown"),
    "extraction_status": ("pending", "processing", "complete", "failed"),
}


QUOTES = "array<struct<kind:string,place:int,text:string>>"


def contract_plans(rules: DataFrame, escalations: DataFrame, discounts: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row a rule: its terms as one nested record, and the clauses that prove them. Of
    several escalations the earliest counts; of several base fee clauses the first."""
    esc = escalations.groupBy("rule_id").agg(F.min_by(F.struct("percentage", "after_months", "clause_id"), F.struct("after_months", "id")).alias("_e"))
    off = discounts.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("id", "percentage", "duration_months", "clause_id"))).alias("_d"))
    base = clauses.filter("kind = 'base_fee'").groupBy("rule_id").agg(F.min("id").alias("base_clause"))
    out = rules.join(esc, "rule_id", "left").join(off, "rule_id", "left").join(base, "rule_id", "left")
    terms = F.transform("_d", lambda d: F.struct(d["percentage"].cast("decimal(9,6)").alias("percentage"), d["duration_months"].cast("int").alias("duration_months")))
    return out.select(
        *rules.columns, F.col("rule_id").alias("contract_id"), F.col("_e.percentage").cast("decimal(9,6)").alias("esc_pct"),
        F.col("_e.after_months").cast("int").alias("esc_after"), terms.alias("discounts"), "base_clause", F.col("_e.clause_id").alias("esc_clause"),
        F.transform("_d", lambda d: F.struct(d["percentage"].alias("percentage"), d["clause_id"].alias("clause_id"))).alias("disc_clauses"),
    )


def proving_clause(role: Column, inherited: Column) -> Column:
    """The clause that explains a finding's kind: the rise's, the first discount's that has
    one, else the base fee's, else what the billing carried."""
    first = F.get(F.filter("disc_clauses", lambda d: d["clause_id"].isNotNull()), 0)["clause_id"]
    return (
        F.when(role == "escalation", F.coalesce("esc_clause", inherited, "base_clause"))
        .when(role == "discount", F.coalesce(first, inherited, "base_clause")).otherwise(F.coalesce("base_clause", inherited))
    )


def windows_of(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` (the run), first day of the first month and last date of its lines."""
    return lines.groupBy(*by).agg(F.trunc(F.min("transaction_date"), "month").alias("_first"), F.max("transaction_date").alias("_last"))


TERMS = ("client_id", "contract_id", "base_amount", "frequency", "start_date", "end_date", "esc_pct", "esc_after", "discounts")
BILLED = ("client_id", "contract_id", "discounts", "billing_date", "expected_amount", "applied_escalation", "applied_discount_pct", "previous_amount", "payment_type")


def compute_run(
    plans: DataFrame, clients: DataFrame, lines: DataFrame, milestones: DataFrame | None = None, window: tuple[str, str] | None = None
) -> dict[str, DataFrame]:
    """timeline, attributions, changes, findings: billings in the span of the lines, lines attributed
    to clients, those of them that had another client or none, what is short of its billing with
    the clause that proves it. What else a contract says joins on by contract_id.

    Where lines and clients have a run_id, all runs are computed in one plan and kept apart:
    each has the window of its own lines (a run without lines those of its contracts), its lines
    meet its own clients alone. Billings and attributions are written once. plans: as from ``contract_plans``, their run that of the client;
    milestones: contract_id, amount, due_date."""
    runs = ("run_id",) if "run_id" in clients.columns and "run_id" in lines.columns else ()
    # narrow terms go through the schedule; clauses join on afterwards
    wide = ("base_clause", "esc_clause", "disc_clauses")
    terms = plans.select(*TERMS)
    if runs:
        terms = terms.join(clients.select("client_id", "run_id").distinct(), "client_id")
    low, high = F.col("_first"), F.col("_last")
    if window:
        terms = terms.withColumns({"_first": F.lit(window[0]).cast("date"), "_last": F.lit(window[1]).cast("date")})
    elif runs:
        terms = terms.join(windows_of(lines, runs), "run_id", "left")
    else:
        terms = terms.crossJoin(F.broadcast(windows_of(lines)))  # one row
    # dealt by contract before the billings are listed: they are numbered and get their clause in place
    tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = terms.repartition(tasks, "contract_id")
    entries = schedule.expected_timeline(terms, low, high)
    if milestones is not None:
        entries = entries.unionByName(schedule.milestone_rows(terms, milestones.select("contract_id", "amount", "due_date"), low, high))
    entries = entries.select(*runs, *BILLED)
    order = Window.partitionBy("contract_id", *runs).orderBy("billing_date", "payment_type", "expected_amount")
    place = F.row_number().over(order)
    entries = entries.withColumn("entry_id", F.concat_ws(":", *runs, "contract_id", F.lpad(place.cast("string"), 10, "0")))
    clause = schedule.row_clause(F.col("base_clause"), F.col("esc_clause"), F.col("disc_clauses"))
    clause = F.when(F.col("payment_type") == "recurring", clause).otherwise(F.col("base_clause"))
    timeline = written(entries.join(plans.select("contract_id", *wide), "contract_id").withColumn("clause_id", clause), "timeline")
    told = lines.select("txn_id", "client_id", F.col("client_id").alias("_told"), "description", "transaction_date", "amount", *runs)
    who = attribute(told, clients.select("client_id", "name", *runs), within=runs, decide=True, keep=("transaction_date", "amount", "_told"))
    who = written(who, "attributions")
    found = rec.shortfalls(timeline, who.filter("client_id IS NOT NULL"), within=runs)
    found = found.withColumn("clause_id", proving_clause(F.col("clause_role"), F.col("clause_id"))).drop(*wide)
    changes = who.filter(F.col("client_id").isNotNull() & ~F.col("client_id").eqNullSafe(F.col("_told"))).select(*runs, "txn_id", "client_id")
    return {"timeline": timeline.drop(*wide), "attributions": who.drop("transaction_date", "amount", "_told"), "changes": changes, "findings": found}


def written_back(lines: DataFrame, attributions: DataFrame) -> DataFrame:
    """Lines with the attributed client, and whether that is new."""
    a = attributions.select("txn_id", F.col("client_id").alias("_who"))
    out = lines.join(a, "txn_id", "left").withColumn("changed", F.col("_who").isNotNull() & ~F.col("_who").eqNullSafe(F.col("client_id")))
    return out.withColumn("client_id", F.coalesce("_who", "client_id")).drop("_who")


def counters(plans: DataFrame, clients: DataFrame, lines: DataFrame, computed: dict[str, DataFrame]) -> DataFrame:
    """What a computed run counts of itself, by run: contracts, those that cannot bill, billings,
    lines newly attributed, attributed to nobody and answering no billing, findings by kind."""
    home = clients.select("client_id", "run_id").distinct()
    back = written_back(lines, computed["attributions"])
    paid = back.filter("client_id IS NOT NULL")
    loose = rec.unmatched(computed["timeline"], paid, within=("run_id",)).groupBy("run_id").agg(F.count("*").alias("unmatched"))
    kinds = [F.count_if(F.col("anomaly_type") == k).alias(f"n_{k}") for k in VOCABULARIES["anomaly_type"]]
    parts = [
        plans.drop("run_id").join(home, "client_id").groupBy("run_id").agg(F.count("*").alias("contracts"), F.count_if(F.col("start_date").isNull() | F.col("base_amount").isNull()).alias("skipped")),
        computed["timeline"].groupBy("run_id").agg(F.count("*").alias("timeline_rows")),
        back.groupBy("run_id").agg(F.count_if(F.col("client_id").isNull()).alias("unattributed"), F.count_if("changed").alias("newly_attributed")), loose,
        computed["findings"].groupBy("run_id").agg(F.count("*").alias("findings"), F.sum("gap").alias("total_gap"), *kinds),
    ]
    out = clients.select("run_id").distinct()
    for p in parts:
        out = out.join(p, "run_id", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("run_id", "total_gap")]).withColumn("total_gap", F.coalesce("total_gap", F.lit(0).cast("decimal(18,2)")))


FINDING = ("run_id", "entry_id", "client_id", "billing_date", "anomaly_type", "expected_amount", "paid", "gap", "confidence", "clause_id")
BILLING = ("run_id", "entry_id", "client_id", "contract_id", "billing_date", "expected_amount", "payment_type", "clause_id")


def recompute(store: Store, plans: DataFrame, clients: DataFrame, milestones: DataFrame | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """Runs computed anew from the stored lines; findings, timeline and the lines' clients are
    stored in one step. Findings start over: a verdict goes with the finding it was passed on.
    Returns rows inserted, changed, deleted and kept by table and run."""
    lines = store.read("lines")
    x = compute_run(plans, clients, lines, milestones, window)
    runs = sorted(r[0] for r in clients.select("run_id").distinct().collect())
    found = x["findings"].select(*FINDING).withColumns({"status": F.lit("unverified"), "reasoning": F.lit(None).cast("string"), "verified_at": F.lit(None).cast("timestamp")})
    return store.merge({
        "findings": Change(found, ("entry_id",), "replace", runs), "timeline": Change(x["timeline"].select(*BILLING), ("entry_id",), "replace", runs, True),
        "lines": Change(x["changes"], ("txn_id",), "update", at_rest=True),
    })


def write_verdicts(store: Store, verdicts: DataFrame) -> DataFrame:
    """verdicts(run_id, entry_id, status, reasoning, confidence, verified_at): a null confidence
    leaves the finding's; a finding that is gone is passed over."""
    was = store.read("findings").select("run_id", "entry_id", F.col("confidence").alias("_was"))
    out = verdicts.join(was, ["run_id", "entry_id"]).withColumn("confidence", F.coalesce("confidence", "_was")).drop("_was")
    return store.merge({"findings": Change(out, ("entry_id",), "update")})


def write_places(store: Store, located: DataFrame) -> DataFrame:
    """located(run_id, id, page, method): page and method of each clause, none where it was not
    found; boxes of clauses that have lost their page go."""
    box = store.read("clauses").select("run_id", "id", F.col("page").alias("_page"), "bbox")
    out = located.join(box, ["run_id", "id"]).withColumn("bbox", F.when(F.col("page").eqNullSafe(F.col("_page")), F.col("bbox"))).drop("_page")
    return store.merge({"clauses": Change(out, ("id",), "update")})


def dangling(findings: DataFrame, timeline: DataFrame) -> DataFrame:
    """Findings whose billing is not there: none after a recompute or a delete."""
    return findings.join(timeline.select("run_id", "entry_id"), ["run_id", "entry_id"], "left_anti")


def upsert_clients(known: DataFrame, names: DataFrame) -> DataFrame:
    """known(client_id, run_id, name) and names(run_id, name[, position]): those known, then a
    client for each new normalised name, numbered on from the largest id. The first spelling by
    position stays; without positions the smallest."""
    first = F.struct(*([F.col("position")] if "position" in names.columns else []), F.col("name"))
    key = normalise_name(F.col("name"))
    have = known.withColumn("normalized_name", key)
    new = names.withColumn("normalized_name", key).groupBy("run_id", "normalized_name").agg(F.min(first)["name"].alias("name"))
    new = new.join(have.select("run_id", "normalized_name"), ["run_id", "normalized_name"], "left_anti")
    top = known.agg(F.coalesce(F.max("client_id"), F.lit(0)).alias("_top"))
    # numbered inside cells, so that no single task orders all new names
    cell = F.pmod(F.xxhash64("run_id", "normalized_name"), F.lit(1024))
    new = new.withColumn("_cell", cell).withColumn("_k", F.row_number().over(Window.partitionBy("_cell").orderBy("run_id", "normalized_name")))
    before = new.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = before.withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = new.join(F.broadcast(before.drop("_n")), "_cell").crossJoin(top)
    new = new.select((F.col("_top") + F.col("_at") + F.col("_k")).alias("client_id"), "run_id", "name", "normalized_name")
    return have.select("client_id", "run_id", "name", "normalized_name").unionByName(new)


def normalised(extractions: DataFrame) -> dict[str, DataFrame]:
    """One row an extraction (rule_id, document_id, base_amount, esc_pct, esc_after, esc_quote,
    discounts array<struct<percentage, duration_months, quote>>, document) to the rows of its
    rule and child tables. A child without a quote falls back to the base fee's clause: the
    first quote that names the amount. A quote that is not in the document has failed."""
    plain = F.col("base_amount").cast("decimal(18,2)")
    needles = [F.format_number(plain, 0), F.format_number(plain, 2), plain.cast("decimal(18,0)").cast("string")]
    quotes = F.concat(F.coalesce(F.transform("discounts", lambda d: d["quote"]), F.array().cast("array<string>")), F.array("esc_quote"))
    names = lambda q: F.coalesce(F.greatest(*[F.contains(q, n) for n in needles]), F.lit(False))
    x = extractions.withColumn("_base", F.when(plain.isNotNull(), F.get(F.filter(quotes, names), 0)))
    every = F.concat(
        F.array(F.struct(F.lit("base_fee").alias("kind"), F.lit(0).alias("place"), F.col("_base").alias("text")),
                F.struct(F.lit("escalation").alias("kind"), F.lit(1).alias("place"), F.col("esc_quote").alias("text"))),
        F.coalesce(F.transform("discounts", lambda d, i: F.struct(F.lit("discount").alias("kind"), (i + 2).alias("place"), d["quote"].alias("text"))), F.array().cast(QUOTES)),
    )
    c = x.select("rule_id", "document_id", "document", F.explode(every).alias("_c"))
    c = c.select("rule_id", "document_id", "_c.*", "document").filter(F.trim("text") != "")
    c = c.withColumn("id", F.concat_ws(":", "rule_id", "place"))
    c = c.withColumn("method", F.when(~stands_in(F.col("text"), F.col("document")), "failed")).drop("document")
    ids = c.groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "id"))).alias("_ids"))
    at = lambda place: F.coalesce(F.try_element_at("_ids", place), F.try_element_at("_ids", F.lit(0)))
    x = x.join(ids, "rule_id", "left")
    esc = x.filter("esc_pct IS NOT NULL").select(F.col("rule_id").alias("id"), "rule_id", at(F.lit(1)).alias("clause_id"), F.col("esc_pct").alias("percentage"), F.col("esc_after").alias("after_months"))
    off = x.select("rule_id", "_ids", F.posexplode("discounts").alias("_i", "_d"))
    off = off.select(F.concat_ws(":", "rule_id", "_i").alias("id"), "rule_id", at(F.col("_i") + 2).alias("clause_id"), "_d.percentage", "_d.duration_months")
    return {"rules": x.select("rule_id", "document_id", "base_amount"), "clauses": c, "escalations": esc, "discounts": off}


def without_run(tables: dict[str, DataFrame], run_id: int) -> dict[str, DataFrame]:
    """All tables less one run: tables without run_id lose what hangs off its clients."""
    gone = tables["clients"].filter(F.col("run_id") == run_id).select("client_id")
    rules = tables["rules"].join(gone, "client_id", "left_semi").select("rule_id")
    out = {}
    for name, df in tables.items():
        if "run_id" in df.columns:
            out[name] = df.filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))
        elif name == "rules":
            out[name] = df.join(gone, "client_id", "left_anti")
        else:
            out[name] = df.join(rules, "rule_id", "left_anti") if "rule_id" in df.columns else df
    return out


def violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Values outside a closed vocabulary, with their number."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return bad.groupBy(F.lit(column).alias("name"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
