"""Scenario folders: written whole or not at all, read back, computed to their known totals."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import run, scenario, schedule
from tallyloom.sources import scenarios
from tests.test_runs import CLIENTS, EASY, EDGE, NOISE, REALISTIC, VARIANTS, run_tables

TOTALS = {"easy": (EASY, False, 7, 17815.00), "edge": (EDGE, False, 0, 0.00), "realistic": (REALISTIC, True, 5, 22500.00)}


def files_of(spark, name):
    plants, noisy, n, total = TOTALS[name]
    plans, _ = run_tables(spark, list(plants))
    entries = schedule.expected_timeline(plans, "2025-01-01", "2025-12-31", compound=False)
    key = scenario.planted(entries, spark.createDataFrame([(c, m, p[0], p[2]) for c, p in plants.items() if p for m in p[1]], "client_id long, month int, kind string, split boolean"))
    names = spark.createDataFrame([(i, VARIANTS[i] if noisy else [CLIENTS[i][0].upper()]) for i in plants], "client_id long, variants array<string>")
    lines = scenario.bank_lines(key, names, noisy)
    if noisy:
        lines = lines.unionByName(spark.createDataFrame(NOISE, "transaction_date date, description string, amount decimal(18,2)"))
    rows = []
    for i in plants:
        who, fee, start, up, off = CLIENTS[i]
        rules = {"contract_start_date": str(start), "base_amount": fee, "billing_frequency": "monthly", "base_clause": f"The fee is ${fee}."}
        rules |= {"escalation": {"percentage": up, "after_months": 12, "clause_text": f'It rises by "{up}%".'}} if up else {}
        rules |= {"discounts": [{"percentage": off, "duration_months": 12, "clause_text": "Less at first."}]} if off else {}
        rows.append((name, who, json.dumps(rules), f"Contract of\n{who}" if i != 1 else None))
    clients = spark.createDataFrame(rows, "scenario string, name string, rules string, contract string")
    clients = clients.withColumn("rules", F.from_json("rules", scenarios.RULES))
    truth = scenario.summary(key).agg(F.lit(name).alias("scenario"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gap"))
    return scenarios.scenario_files(clients, lines.withColumn("scenario", F.lit(name)), truth)


def test_three_scenarios_written_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/all"
    files = files_of(spark, "easy").unionByName(files_of(spark, "edge")).unionByName(files_of(spark, "realistic"))
    scenarios.write_scenarios(files, folder)
    scenarios.write_scenarios(files_of(spark, "edge"), folder)  # in place of the first
    assert sorted(p.name for p in (tmp_path / "all").iterdir() if p.name != "_staging") == sorted(TOTALS)
    manifest = json.loads((tmp_path / "all" / "realistic" / "manifest.json").read_text())
    assert manifest["name"] == "realistic" and sum(k.startswith("contracts/") for k in manifest["files"]) == 3
    back = scenarios.read_scenarios(spark, folder)
    got = run.compute_run(scenarios.plans_of(back), back["clients"], back["lines"])
    found = {r.run_id: (r.n, float(r.gap)) for r in got["findings"].groupBy("run_id").agg(F.count("*").alias("n"), F.sum("gap").alias("gap")).collect()}
    truth = {r.scenario: (r.run_id, r.n, float(r.gap)) for r in back["truth"].collect()}
    for name, (_, noisy, n, total) in TOTALS.items():
        run_id, *planted = truth[name]
        assert tuple(planted) == (n, total) and found.get(run_id, (0, 0.0)) == (n, total)
        assert got["attributions"].filter((F.col("run_id") == run_id) & F.col("client_id").isNull()).count() == (3 if noisy else 0)
    assert back["clauses"].filter("text LIKE '%\"10\\%\"%'").count() == 4
    docs = {r.text for r in back["documents"].collect()}
    assert None in docs and "Contract of\nRegal Entertainment Group\n" in docs


def test_a_failed_write_leaves_no_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/some"
    files = files_of(spark, "edge")
    bad = files.unionByName(files.withColumn("scenario", F.lit("bad")).withColumn("line", F.when(F.col("file") != "actuals.csv", F.col("line"))))
    with pytest.raises(Exception, match="unsupported operand"):
        scenarios.write_scenarios(bad, folder)
    assert not [p for p in (tmp_path / "some").glob("*") if p.name != "_staging"] and not list((tmp_path / "some").glob("_staging/*"))
    assert scenarios.read_scenarios(spark, folder)["lines"].count() == 0


def test_folders_are_read_once_in_shares_and_batches(spark, tmp_path):
    folder, n = f"file://{tmp_path}/big", 2 * scenarios.BATCH + 7
    lines = spark.range(n).selectExpr("'big' AS scenario", "date'2025-01-01' AS transaction_date", "lpad(string(id), 6, '0') || ', \"x\"' AS description", "CAST(id AS decimal(18,2)) AS amount")
    rules = F.from_json(F.lit('{"base_amount": 5, "base_clause": "The fee is $5."}'), scenarios.RULES)
    clients = spark.range(11).select(F.lit("big").alias("scenario"), F.format_string("c%02d", "id").alias("name"), rules.alias("rules"), F.when(F.col("id") != 4, F.concat(F.lit("text "), "id")).alias("contract"))
    truth = spark.createDataFrame([("big", 3, 1)], "scenario string, n long, gap int")
    scenarios.write_scenarios(scenarios.scenario_files(clients, lines, truth), folder)
    back = scenarios.read_scenarios(spark, folder)
    for name in ("lines", "clients", "clauses", "truth", "documents"):
        plan = back[name]._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" not in plan and "FileScan parquet" in plan, name
    got = back["lines"].select("txn_id", "amount", "description").orderBy("txn_id").collect()
    assert [(r.txn_id, int(r.amount), r.description) for r in got] == [((1 << 32) + k, k, f'{k:06d}, "x"') for k in range(n)]
    docs = {r.name: r.text for r in back["documents"].join(back["clients"], F.col("document_id") == F.col("client_id")).collect()}
    assert docs == {f"c{k:02d}": None if k == 4 else f"text {k}\n" for k in range(11)}
    assert [(r.n, float(r.gap)) for r in back["truth"].collect()] == [(3, 1.0)]
