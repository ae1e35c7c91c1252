"""Scenarios with known totals, corrected meanings, and operators that SQL does not cover."""

import datetime as dt
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, money, questions, text
from tallyloom.operators import cashflow, corpus, evidence, grounding, reconcile, run, scenario, schedule
from tallyloom.sources import statements

#: Name, fee, start, rise in per cent after a year, discount in per cent for a year.
CLIENTS = {
    1: ("GameznFlix Inc.", 5000, dt.date(2024, 3, 1), 10, None), 2: ("RMD Technologies Inc.", 2000, dt.date(2024, 5, 1), 10, None),
    3: ("CBS Outdoor Americas Inc.", 12500, dt.date(2024, 2, 1), 3, None), 4: ("Central Garden & Pet Co.", 5000, dt.date(2024, 4, 1), 2, None),
    5: ("Vision Hydrogen Corp.", 100000, dt.date(2024, 6, 1), 5, None), 6: ("Regal Entertainment Group", 6000, dt.date(2024, 8, 1), 8, None),
    7: ("Cellteck Inc.", 5000, dt.date(2024, 1, 1), None, 30),
}
EASY = {1: ("forgotten_raise", (3, 4, 5), False), 3: ("ghost_invoice", (7,), False), 2: ("short_change", (9,), False), 7: ("zombie_discount", (5, 6), False)}
REALISTIC = {5: ("forgotten_raise", (6, 7, 8), False), 6: ("ghost_invoice", (10,), False), 4: ("short_change", (8,), True), 1: None}
EDGE = {2: None, 7: None}
VARIANTS = {
    5: ["VISION HYDROGEN CORP", "Vision Hydrogen", "VISIONHYDROGEN CORP WIRE"], 6: ["REGAL ENTERTAINMENT GRP", "Regal Entertainment", "REGAL ENT GROUP ACH"],
    4: ["CENTRAL GARDEN & PET", "Central Garden Pet Co", "CTRL GARDEN PET CO"], 1: ["GAMEZNFLIX INC", "GameznFlix", "GAMEZNFLIX INC ACH PMT"],
}
NOISE = [(dt.date(2025, 2, 11), "BANK SVC FEE", Decimal(-35)), (dt.date(2025, 6, 3), "INTEREST CREDIT", Decimal("4.12")), (dt.date(2025, 9, 20), "CHECK #1042 DEPOSIT", Decimal(900))]


def run_tables(spark, ids):
    rules = [(i, i, None, CLIENTS[i][0], Decimal(CLIENTS[i][1]), "monthly", CLIENTS[i][2], None) for i in ids]
    rules = spark.createDataFrame(rules, "rule_id long, client_id long, document_id long, client_name string, base_amount decimal(18,2), frequency string, start_date date, end_date date")
    esc = [(i, i, 10 * i + 2, Decimal(CLIENTS[i][3]), 12) for i in ids if CLIENTS[i][3]] + [(100 + i, i, None, Decimal(50), 36) for i in ids if CLIENTS[i][3]]
    esc = spark.createDataFrame(esc, "id long, rule_id long, clause_id long, percentage decimal(9,6), after_months int")
    off = spark.createDataFrame([(i, i, 10 * i + 3, Decimal(CLIENTS[i][4]), 12) for i in ids if CLIENTS[i][4]], "id long, rule_id long, clause_id long, percentage decimal(9,6), duration_months int")
    clauses = spark.createDataFrame([(10 * i + k, i, "base_fee") for i in ids for k in (1, 9)], "id long, rule_id long, kind string")
    clients = spark.createDataFrame([(i, 1, CLIENTS[i][0]) for i in ids], "client_id long, run_id int, name string")
    return run.contract_plans(rules, esc, off, clauses), clients


@pytest.mark.parametrize("plants,noisy,found,total", [(EASY, False, 7, 17815.00), (REALISTIC, True, 5, 22500.00), (EDGE, False, 0, 0.00)])
def test_scenarios_have_their_known_totals(spark, plants, noisy, found, total):
    plans, clients = run_tables(spark, list(plants))
    entries = schedule.expected_timeline(plans, "2025-01-01", "2025-12-31", compound=False)
    rows = [(c, m, p[0], p[2]) for c, p in plants.items() if p for m in p[1]]
    key = scenario.planted(entries, spark.createDataFrame(rows, "client_id long, month int, kind string, split boolean"))
    names = spark.createDataFrame([(i, VARIANTS[i] if noisy else [CLIENTS[i][0].upper()]) for i in plants], "client_id long, variants array<string>")
    lines = scenario.bank_lines(key, names, noisy)
    if noisy:
        lines = lines.unionByName(spark.createDataFrame(NOISE, "transaction_date date, description string, amount decimal(18,2)"))
    lines = [(i, None, r.transaction_date, r.amount, r.description) for i, r in enumerate(lines.collect())]
    lines = spark.createDataFrame(lines, "txn_id long, client_id long, transaction_date date, amount decimal(18,2), description string")
    got = run.compute_run(plans, clients, lines)
    f = got["findings"].collect()
    assert len(f) == found and float(sum(r.gap for r in f)) == total
    assert {(r.client_id, r.billing_date.month, r.anomaly_type) for r in f} == {(c, m, k) for c, m, k, _ in rows}
    clause = {"forgotten_raise": 2, "zombie_discount": 3, "ghost_invoice": 1, "short_change": 1}
    assert all(r.clause_id == 10 * r.client_id + clause[r.anomaly_type] for r in f)
    assert got["attributions"].filter("client_id IS NULL").count() == (3 if noisy else 0)
    assert scenario.summary(key).agg(F.sum("n")).first()[0] == (found or None)
    back = run.written_back(lines, got["attributions"])
    assert back.filter("changed").count() == lines.count() - (3 if noisy else 0)


def test_milestones_join_the_schedule(spark):
    plans, _ = run_tables(spark, [1, 7])
    m = [(1, Decimal(900), dt.date(2025, 3, 1)), (1, Decimal(5), None), (7, Decimal(70), dt.date(2026, 3, 1)), (9, Decimal(1), dt.date(2025, 3, 1))]
    m = spark.createDataFrame(m, "contract_id long, amount decimal(18,2), due_date date")
    t = schedule.timeline(plans, m, "2025-02-15", "2025-03-31").orderBy("client_id", "billing_date", "payment_type").collect()
    assert [(r.client_id, str(r.billing_date), r.payment_type, float(r.expected_amount)) for r in t] == [
        (1, "2025-03-01", "milestone", 900.0), (1, "2025-03-01", "recurring", 5500.0), (7, "2025-03-01", "recurring", 5000.0)]
    assert schedule.unresolved_milestones(m).count() == 1
    assert schedule.expected_timeline(plans).filter("client_id = 1").agg(F.max("billing_date")).first()[0] == dt.date(2025, 2, 1)
    ended = plans.withColumn("end_date", F.lit("2024-05-31").cast("date"))
    assert schedule.expected_timeline(ended, "2024-01-01", "2025-01-01").filter("client_id = 1").count() == 3


def test_a_wide_tolerance_reaches_all_months(spark):
    e = spark.createDataFrame([(1, 1, dt.date(2025, 3, 1))], "entry_id long, client_id long, billing_date date")
    days = [dt.date(2025, 1, 2), dt.date(2025, 2, 3), dt.date(2025, 4, 28)]
    p = spark.createDataFrame([(i, 1, d, Decimal(1)) for i, d in enumerate(days)], "txn_id long, client_id long, transaction_date date, amount decimal(18,2)")
    assert reconcile.best_bucket(e, p, 60).count() == 3 and reconcile.best_bucket(e, p).count() == 0


def test_split_payments_with_refunds_and_brute_force(spark):
    from itertools import combinations

    d = dt.date(2025, 3, 5)
    r = random.Random(3)
    amounts = [6500, -500, 6050] + [r.randrange(-900, 6500) for _ in range(40)]
    p = spark.createDataFrame([(i, 1, d, Decimal(a)) for i, a in enumerate(amounts)], "txn_id long, client_id long, transaction_date date, amount decimal(18,2)")
    t = spark.createDataFrame([(1, Decimal(6000), d, d)], "client_id long, target decimal(18,2), start date, end date")
    got = sorted(tuple(x.ids) for x in evidence.split_payments(t, p).collect())
    want = sorted(c for n in (1, 2, 3) for c in combinations(range(len(amounts)), n) if abs(sum(amounts[i] for i in c) - 6000) <= 120)
    assert got == want and (0, 1) in got and (2,) in got


def test_payments_that_cannot_complete_a_sum_are_not_paired(spark):
    d = dt.date(2025, 3, 5)
    p = spark.createDataFrame([(i, 1, d, Decimal(n)) for i, n in enumerate([10, 11, *range(1000, 15_000)])], "txn_id long, client_id long, transaction_date date, amount decimal(18,2)")
    t = spark.createDataFrame([(1, Decimal(21), d, d)], "client_id long, target decimal(18,2), start date, end date")
    began = time.time()
    assert [tuple(r) for r in evidence.split_payments(t, p).collect()] == [(1, 2, [0, 1])] and time.time() - began < 30


def test_cost_share_counts_recovery_and_revenue_basis(spark):
    months = spark.createDataFrame([(f"2025-{m:02d}", Decimal(10000)) for m in range(1, 13)], "month string, revenue decimal(18,2)")
    rec = cashflow.recovery(spark.createDataFrame([("confirmed", Decimal(120000))], "status string, gap decimal(18,2)"), F.lit(12))
    costs = spark.createDataFrame([(1, Decimal(5000))], "scenario int, monthly_cost decimal(18,2)")
    for expenses in (4000.0, None):
        v = cashflow.verdicts(cashflow.baseline(months, expenses), rec, costs)
        assert v.first().cost_share == 0.25
        last = cashflow.projection(v, 2).orderBy("month_ahead").collect()[-1]
        with_, without = ((10000 + (10000 - 4000)) - 5000, 6000 - 5000) if expenses else (20000 - 5000, 10000 - 5000)
        assert (float(last.with_recovery), float(last.without_recovery)) == (2 * with_, 2 * without)
    none = cashflow.verdicts(cashflow.baseline(months.limit(0), 1.0), rec, costs)
    assert none.first().cost_share is None and cashflow.projection(none).count() == 0
    with pytest.raises(ValueError):
        cashflow.projection(none, 0)


@pytest.mark.parametrize(
    "asked,amount,month",
    [
        ("Can we hire after 2026?", None, None), ("hire before 2025 for 3,000", 3000.0, None), ("$500 now or $5k later", 5000.0, None), ("2000 a month from 2026-03?", 2000.0, "2026-03"),
        ("in 2026.5 units", 2026.5, None), ("in 2026k by May", 2026000.0, "May"), ("costs 12.5m", 12500000.0, None), ("$12,500 monthly", 12500.0, None), ("a march of 7", 7.0, "March"),
    ],
)
def test_amounts_and_months_of_questions(spark, asked, amount, month):
    r = spark.createDataFrame([(asked,)], "q string").select(questions.parsed(F.col("q")).alias("p")).first().p
    assert (r.cost, r.start_month) == (amount, month)
    assert r.source == ("none" if amount is None else "pattern")


def test_tiers_look_at_squeezed_text(spark):
    rows = [("price\nincrease and a monthly\nfee", "template"), ("The fee\nshall increase by 5% annually; $5,000 per\nmonth", "gold"), (None, "reject"), ("no terms", "reject")]
    got = [r.tier for r in corpus.tiers(spark.createDataFrame(rows, "text string, want string")).collect()]
    assert got == [w for _, w in rows]


def test_rate_cards_and_funds_are_no_questions(spark):
    fee = "A monthly fee of $6,000 is due. "
    rows = [(1, fee), (2, fee + "fund accounting, transfer agent and net asset value"), (3, fee + " ".join(f"${k},000" for k in range(1, 25))), (4, "no fee"), (5, None)]
    assert [r.doc_id for r in corpus.usable_questions(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [1]


def test_entities_and_blocks(spark):
    h = '<style>p{}</style><P>a&mdash;b &#8220;c&#x201D; &unknown; &lt;i&gt;</P>\n\n\n<br/>d &nbsp; e<script>x<y</script>&'
    assert spark.createDataFrame([(h,)], "h string").select(text.html_to_text(F.col("h"))).first()[0] == "a—b “c” &unknown; <i>\n\nd e &"


def test_text_helpers(spark):
    def one(c, **values):
        return spark.createDataFrame([tuple(values.values())], list(values) if values else ["x"]).select(c).first()[0]

    assert one(text.filer_of(F.col("x")), x="ACME_EX_CO_EX-10.1_0001") == "ACME_EX_CO"
    assert one(text.figures(F.col("x")), x="$1,250.50 and 3.0% of 12,000") == ["12000", "1250.5", "3"]
    assert one(text.amounts_in(F.col("x")), x="1,2,3 and 1,234.5") == [1.0, 2.0, 3.0, 1234.5]
    assert one(text.absent_quote(F.col("x")), x=" 'N/A'. ") and not one(text.absent_quote(F.col("x")), x="a fee")
    assert one(text.stands_folded(F.col("q"), F.col("d")), q="the “fee”—due", d='x the  "FEE"-due y')
    assert one(text.safe_name(F.col("x")), x="Résumé (v2).pdf") == "Resume_v2.pdf"
    assert one(text.masked(F.col("x")), x="abcdefghijkl") == "abcd...ijkl" and one(text.masked(F.col("x")), x="abc") == "•••"
    assert one(text.fold_typography(F.col("x")), x="a b c") == "a b c"
    assert one(money.gap_text(F.col("x")), x=0.0) == "—" and one(money.gap_text(F.col("x")), x=480.0) == "(480.00)"
    assert one(dates.month_name(F.col("x").cast("date")), x="2026-01-08") == "January 2026" and one(dates.day_month(F.col("x").cast("date")), x="2026-01-08") == "08 Jan"


def test_filled_blanks_and_fees(spark):
    t = "A fee of $[***] per annum rises [*]% within [redacted] days; [***] stays."
    r = spark.createDataFrame([(t, 4)], "t string, k int").select(corpus.filled(F.col("t"), F.col("k")).alias("x"), corpus.filled(F.col("t"), F.col("k")).alias("y")).first()
    assert r.x == r.y and r.x.n_filled == 3 and r.x.text.endswith("; [***] stays.") and "$[" not in r.x.text
    amount = int(r.x.text.split("$")[1].split(" ")[0].replace(",", ""))
    assert amount in corpus.YEARLY_FEES
    d = "Car allowance of $1,000 per month. " + "x " * 100 + "A monthly fee of $5,000 and then a $700.50 per month fee."
    assert spark.createDataFrame([(d,)], "t string").select(corpus.candidate_fees(F.col("t"))).first()[0] == [700.5, 5000.0]


def test_tiers_are_worked_out_once_for_a_filter(spark):
    rows = [(1, corpus.CLAUSES[0]), (2, corpus.CLAUSES[1]), (3, corpus.CLAUSES[5]), (4, None), (5, "The  Monthly fee of\n[***] will be INCREASED annually")]
    kept = corpus.tiers(spark.createDataFrame(rows, "doc_id long, text string")).filter("tier <> 'reject'").withColumn("low", F.col("tier") == "template")
    assert sorted((x.doc_id, x.tier, x.redacted, x.low) for x in kept.collect()) == [(1, "gold", False, False), (2, "template", True, True), (5, "template", True, True)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count(corpus.CONCRETE_RISE[0]) == 1


def test_first_of_filer_and_clause_is_greedy(spark):
    r = random.Random(8)
    rows = [(i, i, f"f{r.randrange(12)}", f"c{r.randrange(12)}") for i in range(120)]
    filers, clauses, want = set(), set(), []
    for i, _, f, c in rows:
        if f not in filers and c not in clauses:
            filers.add(f), clauses.add(c), want.append(i)
    got = corpus.keep_first_of_each(spark.createDataFrame(rows, "doc_id long, ord long, filer string, clause string"))
    assert sorted(x.doc_id for x in got.collect()) == want


def test_a_long_chain_is_decided_in_few_rounds(spark, monkeypatch):
    # each document shares its filer with the one before it and its clause with the one after
    rows = [(i, i, f"f{i // 2}", f"c{(i + 1) // 2}") for i in range(10_000)]
    writes = []
    monkeypatch.setattr(corpus, "cut", lambda df, f=corpus.cut: writes.append(1) or f(df))
    got = corpus.keep_first_of_each(spark.createDataFrame(rows, "doc_id long, ord long, filer string, clause string").repartition(4))
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 10_000, 2)) and len(writes) < 40
    assert corpus.keep_first_of_each(spark.createDataFrame([], "doc_id long, ord long, filer string, clause string")).count() == 0


def test_verbatim_has_a_second_tier(spark):
    doc = "Before. The monthly retainer shall increase by five percent on each anniversary of this agreement. " * 3
    rows = [("The monthly retainer  shall increase by FIVE percent", True), ("The month1y retainer shall increase by five percent on each anniversary", True),
            ("A quarterly charge may be lowered if both of the parties agree", False), ("The monthly", False), (None, False)]
    df = spark.createDataFrame([(q, doc, w) for q, w in rows], "quote string, document string, want boolean")
    assert all(r.verbatim == r.want for r in grounding.is_verbatim(df).collect())
    assert grounding.partial_ratio("abcdefghijklmnopqrstuvwxyz", "xx abcdefghijklm-nopqrstuvwxyz yy") >= 92


def test_grounding_statuses(spark):
    doc = "The monthly retainer shall increase by five percent on each anniversary. Delivery is paid on launch."
    q = "The monthly retainer shall increase by five percent"
    rows = [("escalation", q, 5.0), ("escalation", q, 1.0), ("escalation", q, 0.0), ("discount", "null", 5.0), ("discount", "A rebate of ten percent holds for a year", 10.0),
            ("milestone", "Delivery is paid on launch", None)]
    df = spark.createDataFrame([(k, x, None if p is None else Decimal(p), doc) for k, x, p in rows], "kind string, quote string, percentage decimal(9,6), document string")
    got = [(r.status, r.grounded) for r in grounding.ground(df).collect()]
    assert got == [("kept", True), ("bad_figure", True), ("bad_figure", True), ("blank", False), ("dropped", False), ("kept", True)]


def test_statements_are_read_file_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("When,Sum\n31/01/2025,1\n02/03/2025,2\n")
    (tmp_path / "b.csv").write_text("When,Sum\n02/03/2025,3\n2025-05-06,4\n")
    got = statements.read_statement(spark, str(tmp_path), {"date": "When", "amount": "Sum"}).orderBy("amount").collect()
    assert [str(r.transaction_date) for r in got] == ["2025-01-31", "2025-03-02", "2025-02-03", "2025-05-06"]


def test_uploads_keys_and_recompute(spark, tmp_path):
    up = spark.createDataFrame([(1, "a.csv", 2), (1, "a.csv", 1), (1, "b.txt", 3), (1, "old.txt", 4)], "run_id int, filename string, position int")
    new = statements.new_uploads(up, spark.createDataFrame([(1, "old.txt")], "run_id int, filename string")).orderBy("position").collect()
    assert [(r.filename, r.position, r.status) for r in new] == [("a.csv", 1, "pending"), ("b.txt", 3, "complete")]
    key = spark.range(1).select(statements.object_key(F.lit(7), F.lit("x").cast("binary"), F.lit("n.txt"))).first()[0]
    assert key == "7/2d711642b726_n.txt"
    path = str(tmp_path / "t")
    statements.replace_run(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, v string"), path)
    statements.replace_run(spark.createDataFrame([(2, "c")], "run_id int, v string"), path)
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_clients_are_entered_once(spark):
    known = spark.createDataFrame([(4, 1, "Acme, Inc.")], "client_id long, run_id int, name string")
    names = spark.createDataFrame([(1, "ACME"), (1, "Zeta LLC"), (1, "zeta"), (2, "Acme")], "run_id int, name string")
    got = sorted((r.client_id, r.run_id, r.normalized_name) for r in run.upsert_clients(known, names).collect())
    assert [g[0] for g in got] == [4, 5, 6] and {g[1:] for g in got} == {(1, "acme"), (1, "zeta"), (2, "acme")}


def test_allowed_figures(spark):
    v = spark.createDataFrame([(10000.0, 6000.0, 500.0, 12, 5000.0, -200.0, 0.2128)], "monthly_revenue double, surplus double, monthly double, months_observed int, monthly_cost double, after double, cost_share double")
    said = "A shortfall of $200.00 on $10,000: 21.3% or 21% of it, 60000 a year, not $201.50 and 7 weeks"
    bad = v.withColumn("a", cashflow.allowed_figures(v)).select(cashflow.offending(text.amounts_in(F.lit(said)), F.col("a"), F.col("cost_share"))).first()[0]
    assert bad == [201.5]


def test_statement_stream_counts_lines_once(spark, tmp_path):
    from tallyloom.streaming import statements as live

    rows = [("l1", dt.datetime(2025, 1, 2), "$10.00", "FEE ACH"), ("l1", dt.datetime(2025, 1, 2), "$10.00", "FEE ACH"), ("l2", dt.datetime(2025, 1, 3), "oops", "x")]
    spark.createDataFrame(rows, "line_id string, ts timestamp, raw_amount string, raw_description string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("line_id string, ts timestamp, raw_amount string, raw_description string").parquet(str(tmp_path / "in"))
    q = live.clean_stream(lines).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.line_id, r.amount, r.description) for r in spark.table("cleaned").collect()] == [("l1", 10.0, "FEE")]


def test_findings_are_worked_out_once(spark):
    from tallyloom.plans import runs

    for name in ("verdict_counts", "finding_windows"):
        plan = runs.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("min(struct(") == 1, name
