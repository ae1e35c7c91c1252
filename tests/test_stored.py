"""Stored tables: merges by key, reruns, writers that die, runs kept apart."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import run
from tallyloom.sources.stored import Change, Conflict, Store

ROWS = "run_id int, k long, v string, w double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def told(counts):
    return {(r.name, r.run_id, r.kind): r.n for r in counts.collect() if r.n}


def held(store, name="t"):
    return sorted(map(tuple, store.read(name).collect()), key=repr)


def test_replace_keeps_untouched_partitions_and_unchanged_folders(spark, store):
    first = [(1, 1, "a", 1.0), (1, 2, None, None), (2, 1, "c", 3.0), (None, None, "n", 0.0)]
    assert told(store.merge({"t": Change(frame(spark, first[:3]), ("k",))})) == {("t", 1, "inserted"): 2, ("t", 2, "inserted"): 1}
    folders = store.state()["t"]["parts"]
    assert told(store.merge({"t": Change(frame(spark, first[:2]), ("k",))})) == {("t", 1, "kept"): 2}
    assert store.version() == 1 and store.state()["t"]["parts"] == folders
    got = told(store.merge({"t": Change(frame(spark, [(1, 2, "b", None), (1, 3, "x", 0.5)]), ("k",))}))
    assert got == {("t", 1, "deleted"): 1, ("t", 1, "changed"): 1, ("t", 1, "inserted"): 1}
    assert held(store) == sorted([(1, 2, "b", None), (1, 3, "x", 0.5), (2, 1, "c", 3.0)], key=repr)
    assert store.state()["t"]["parts"]["2"] == folders["2"] and store.state()["t"]["parts"]["1"] != folders["1"]
    # a run without rows any more
    assert told(store.merge({"t": Change(frame(spark, []), ("k",), "replace", [1])})) == {("t", 1, "deleted"): 2}
    assert held(store) == [(2, 1, "c", 3.0)] and list(store.state()["t"]["parts"]) == ["2"]
    assert store.tidy() > 0 and held(store) == [(2, 1, "c", 3.0)]


def test_upsert_and_update(spark, store):
    store.merge({"t": Change(frame(spark, [(1, 1, "a", 1.0), (1, None, "b", 2.0)]), ("k",))})
    assert told(store.merge({"t": Change(frame(spark, [(1, None, "B", 2.0), (1, 9, "z", 9.0)]), ("k",), "upsert")})) == {("t", 1, "changed"): 1, ("t", 1, "inserted"): 1, ("t", 1, "kept"): 1}
    some = spark.createDataFrame([(1, 1, None), (1, 77, "gone"), (3, 1, "gone")], "run_id int, k int, v string")
    assert told(store.merge({"t": Change(some, ("k",), "update")})) == {("t", 1, "changed"): 1, ("t", 1, "kept"): 2}
    assert held(store) == sorted([(1, 1, None, 1.0), (1, None, "B", 2.0), (1, 9, "z", 9.0)], key=repr)
    with pytest.raises(ValueError, match="two rows"):
        store.merge({"t": Change(frame(spark, [(1, 1, "a", 1.0), (1, 1, "b", 1.0)]), ("k",))})
    with pytest.raises(KeyError):
        store.merge({"u": Change(some, ("k",), "update")})
    with pytest.raises(ValueError, match="outside"):
        store.merge({"t": Change(frame(spark, [(1, 1, "a", 1.0)]), ("k",), "replace", [2])})


def test_a_writer_that_dies_leaves_the_old_tables(spark, store, monkeypatch):
    store.merge({"t": Change(frame(spark, [(1, 1, "a", 1.0)]), ("k",)), "u": Change(frame(spark, [(1, 1, "a", 1.0)]), ("k",))})
    old = held(store), held(store, "u")
    # a task fails in the second table, the first is written already
    bad = frame(spark, [(1, 1, "b", 1.0)]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    new = {"t": Change(frame(spark, [(1, 1, "b", 1.0)]), ("k",)), "u": Change(bad, ("k",))}
    with pytest.raises(Exception, match="lost"):
        store.merge(new)
    assert (held(store), held(store, "u")) == old and store.version() == 1
    # the driver goes just before the rename
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.merge({"t": new["t"]})
    assert (held(store), held(store, "u")) == old
    assert told(store.merge({"t": new["t"]})) == {("t", 1, "changed"): 1} and held(store) == [(1, 1, "b", 1.0)]
    # two writers: the slower one is told
    with monkeypatch.context() as m:
        m.setattr(Store, "version", lambda self: 1)
        with pytest.raises(Conflict):
            store.merge({"t": Change(frame(spark, [(1, 1, "c", 1.0)]), ("k",))})
    assert held(store) == [(1, 1, "b", 1.0)]
    store.tidy()
    assert held(store) == [(1, 1, "b", 1.0)] and held(store, "u") == old[1]


NAMES = ["Regal Entertainment Group", "Central Garden & Pet Co.", "Northwind Design"]


def runs_with_the_same_names(spark, runs):
    ids = [(10 * r + i, r, n) for r in runs for i, n in enumerate(NAMES)]
    clients = spark.createDataFrame(ids, "client_id long, run_id int, name string")
    rules = spark.createDataFrame([(c, c, None, n, Decimal(1000 + c), "monthly", dt.date(2024, 1, 1), None) for c, _, n in ids],
        "rule_id long, client_id long, document_id long, client_name string, base_amount decimal(18,2), frequency string, start_date date, end_date date")
    none = "id long, rule_id long, clause_id long, percentage decimal(9,6)"
    plans = run.contract_plans(rules, spark.createDataFrame([], none + ", after_months int"), spark.createDataFrame([], none + ", duration_months int"),
        spark.createDataFrame([(10 * c, c, "base_fee") for c, _, _ in ids], "id long, rule_id long, kind string"))
    rows = [(1000 * c + m, r, None, dt.date(2024, m, 1 + r), Decimal(1000 + c), n.upper()[:-1] + " ACH PMT") for c, r, n in ids for m in range(1, 8 + r) if (c + m) % 5]
    rows += [(r, r, None, dt.date(2024, 3, 3), Decimal(-35), "BANK SVC FEE") for r in runs]
    lines = spark.createDataFrame(rows, "txn_id long, run_id int, client_id long, transaction_date date, amount decimal(18,2), description string")
    return plans, clients, lines


def test_five_runs_are_as_five_calls(spark):
    cols = ("run_id", "client_id", "billing_date", "anomaly_type", "gap", "clause_id")
    plans, clients, lines = runs_with_the_same_names(spark, range(1, 6))
    both = run.compute_run(plans, clients, lines)
    apart = []
    for r in (1, 3, 5):
        mine = run.compute_run(plans.join(clients.filter(F.col("run_id") == r).select("client_id"), "client_id", "left_semi"), clients.filter(F.col("run_id") == r), lines.filter(F.col("run_id") == r))
        apart += [tuple(x) for x in mine["findings"].select(*cols).collect()]
    got = both["findings"].select(*cols).collect()
    assert sorted(tuple(x) for x in got if x.run_id in (1, 3, 5)) == sorted(apart) and len(apart) > 10
    n = {r.run_id: r for r in run.counters(plans, clients, lines, both).collect()}
    assert all(n[r].unattributed == 1 and n[r].contracts == 3 and n[r].newly_attributed == lines.filter(F.col("run_id") == r).count() - 1 for r in n)
    assert n[5].timeline_rows == 3 * 12 and n[1].timeline_rows == 3 * 8


def test_recompute_starts_verdicts_over_and_settles(spark, store):
    plans, clients, lines = runs_with_the_same_names(spark, (1, 2))
    store.merge({"lines": Change(lines, ("txn_id",))})
    first = told(run.recompute(store, plans, clients))
    assert first["lines", 1, "changed"] > 10 and first["findings", 2, "inserted"] > 2
    assert store.read("lines").filter("client_id IS NULL").count() == 2
    assert all(k == "kept" for _, _, k in told(run.recompute(store, plans, clients)))
    f = store.read("findings").first()
    v = [(f.run_id, f.entry_id, "confirmed", "seen", None, dt.datetime(2025, 1, 1)), (f.run_id, "nothing", "confirmed", "", 1.0, None)]
    v = spark.createDataFrame(v, "run_id int, entry_id string, status string, reasoning string, confidence double, verified_at timestamp")
    assert sum(n for (_, _, k), n in told(run.write_verdicts(store, v)).items() if k == "changed") == 1
    after = store.read("findings").filter("status = 'confirmed'").collect()
    assert len(after) == 1 and after[0].confidence == f.confidence
    assert run.dangling(store.read("findings"), store.read("timeline")).count() == 0
    again = told(run.recompute(store, plans, clients))
    assert {k: n for k, n in again.items() if k[2] != "kept"} == {("findings", f.run_id, "changed"): 1}


def test_findings_take_two_joins_and_lines_without_client_are_dealt(spark):
    plans, clients, lines = runs_with_the_same_names(spark, (1, 2))
    got = run.compute_run(plans, clients, lines)
    # billings and lines carry what findings need: payments to billings, sums to billings
    assert got["findings"]._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {r.txn_id for r in got["changes"].collect()} == {r.txn_id for r in got["attributions"].filter("client_id IS NOT NULL").collect()}


def test_equal_rows_are_kept_and_changed_ones_written_whole(spark, store):
    rows = [(r, k, None if k % 3 else "v", k / 2) for r in (1, 2) for k in range(50)]
    store.merge({"t": Change(frame(spark, rows), ("k",))})
    shut = frame(spark, rows[::-1])
    assert told(store.merge({"t": Change(shut, ("k",), at_rest=True)})) == {("t", 1, "kept"): 50, ("t", 2, "kept"): 50}
    new = [(r, k, "x" if (r, k) == (2, 7) else v, w) for r, k, v, w in rows if (r, k) != (2, 0)]
    folders = store.state()["t"]["parts"]
    assert told(store.merge({"t": Change(frame(spark, new), ("k",))})) == {("t", 1, "kept"): 50, ("t", 2, "kept"): 48, ("t", 2, "changed"): 1, ("t", 2, "deleted"): 1}
    assert store.state()["t"]["parts"]["1"] == folders["1"] and held(store) == sorted(new, key=repr)
    with pytest.raises(ValueError, match="two rows"):
        store.merge({"t": Change(frame(spark, [*new, new[3]]), ("k",))})
    assert held(store) == sorted(new, key=repr)
