"""Name groups, headers, scans and drafts on small cases, against plain loops where there are such."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import normalise_name
from tallyloom.operators import drafts, names, scan
from tallyloom.operators.attribution import indel_ratio


def test_name_groups_equal_the_plain_loop(spark):
    rng = random.Random(3)
    said = [rng.choice(["Northwind", "Norhwind", "Orthwinds", "Acme Co", "Acne", "Starter Labs, Inc.", "StarterLabs", "Starter Lab"]) + rng.choice(["", " Ltd", " s", " 2", " 22"]) for _ in range(60)]
    said = list(dict.fromkeys(said)) + ["  ", "The Co", "The Group"]
    df = spark.createDataFrame([(7, i, n) for i, n in enumerate(said)], "run_id long, ord long, name string")
    got = {r.name: r.canonical for r in names.group_clients(df).collect()}
    keys = {r.name: r.key for r in df.select("name", normalise_name(F.col("name")).alias("key")).collect()}
    groups = []
    for n in filter(str.strip, said):
        for g in groups:
            if any(keys[n] and keys[v] and indel_ratio(keys[n], keys[v]) >= 85 for v in g):
                g.append(n)
                break
        else:
            groups.append([n])
    assert got == {n: max(g, key=len) for g in groups for n in g} and len(groups) > 4


def test_name_groups_of_nothing_and_of_equal_names(spark):
    df = spark.createDataFrame([(1, 0, "Acme"), (1, 1, "Acme"), (2, 2, "Acme Inc."), (1, 3, None)], "run_id long, ord long, name string")
    assert sorted(map(tuple, names.group_clients(df).collect())) == [(1, "Acme", "Acme"), (2, "Acme Inc.", "Acme Inc.")]
    assert names.group_clients(df.limit(0)).count() == 0


def test_name_groups_of_a_large_run_need_no_square(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bar cen dol fen gar hal jor kel lum mer nor pol ras sed tor vel".split()) for _ in range(6))
    said = list(dict.fromkeys(word() for _ in range(16_000)))
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(said)], "run_id long, ord long, name string")
    began = time.time()
    assert names.group_clients(df).count() == len(said) and time.time() - began < 60


@pytest.mark.parametrize("headers, want", [
    (["Posting Date", "Details", "Debit"], {"date": "Posting Date", "description": "Details", "amount": "Debit"}),
    (["xx", "qq"], {}), ([], {}), (["Txn Date", "Value Date"], {"date": "Txn Date"}),
])
def test_header_proposals(headers, want):
    assert {f: c for f, c in names.propose(headers).items() if f in want} == want and (want or not names.propose(headers))


def test_scan_lists_four_hits_without_overlap_and_their_pages(spark):
    raw = "The monthly fee.\n\fA retainer and a retainer;\f" + "retainer " * 5 + "and net 30. Escalation procedure applies."
    df = spark.createDataFrame([(1, raw), (2, "nothing"), (3, None), (4, "")], "doc_id long, text string")
    got = [(r.category, r.page) for r in scan.hits(df).collect()]
    assert sorted(got) == [("escalation", 3), ("payment_terms", 3)] + [("recurring_fee", p) for p in (2, 2, 3, 3)]
    c = {r.doc_id: r for r in scan.categories(df).collect()}
    assert c[1].score == 3 and c[1].dispute_only and c[1].core_pair and c[3].score == 0 and c[4].score == 0


@pytest.mark.parametrize("reply, want", [
    ('```json\n{"a": {"b": "}"}} \n```', '{"a": {"b": "}"}}'), ('So: {"a": "\\"}"} done {', '{"a": "\\"}"}'), ("no object", "no object"),
    ('x {"a": 1', '{"a": 1'), ('{"a": "open }', '{"a": "open }'), ("", ""),
])
def test_json_objects_in_replies(spark, reply, want):
    df = spark.createDataFrame([(reply,), (None,)], "x string").select(drafts.json_object("x").alias("x"))
    assert [r.x for r in df.collect()] == [want, None]


DRAFT = "name long, excerpt string, client_name string, amount double, frequency string, escalation struct<percentage:double,clause_text:string>, discounts array<struct<clause_text:string>>, milestones array<struct<clause_text:string>>, drafted boolean"


def test_drafts_are_checked_and_repaired(spark):
    text = "Acme pays a fee of $5,000 per month, which rises\nby 4% a year."
    rows = [
        (1, text, "Acme", 5000.0, "monthly", (4.0, "which rises by 4% a year"), None, None, True),
        (2, text, "Acme", None, "annual", (None, "it rises"), [("not there",)], None, True),
        (3, "The car allowance is $900 per month.", "", 1.0, "monthly", None, None, [("x",)], True),
        (4, "$5,000 per month. An annual fee of $12,000.", "Z", 7.0, "monthly", None, None, None, True),
        (5, text, None, None, None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, DRAFT)
    verdict = {r.name: r.verdict for r in drafts.checks(df).collect()}
    assert verdict == {1: "clean", 2: "needs_fix", 3: "needs_fix", 4: "needs_fix", 5: "unusable"}
    fixed = {r.name: r for r in drafts.corrected(df).collect()}
    assert fixed[1].changes == [] and fixed[1].human == [] and fixed[1].escalation is not None
    assert fixed[2].amount == 5000 and fixed[2].frequency == "monthly" and fixed[2].escalation is None and len(fixed[2].changes) == 4
    assert fixed[3].amount == 1 and fixed[3].human == ["no recurring fee is stated"] and fixed[3].milestones == []
    assert fixed[4].human == ["2 competing fees"]


def test_table_text(spark):
    df = spark.range(1).select(drafts.table_text(F.array(F.array(F.lit(" a "), F.lit(None).cast("string")), F.array(F.lit(""), F.lit(" ")), F.array(F.lit("b"), F.lit("c")))).alias("x"))
    assert df.first().x == "a | \nb | c"


def test_windows_around_a_snippet(spark):
    long = "x" * 3000 + " The (monthly)\nFEE is $5. " + "y" * 3000
    rows = [(long, "the (monthly) fee is $5."), (long, "not here " * 9 + "(monthly) fee is $5. " + "y" * 3000), (long, "fee is"), (None, "a b c"), ("a b c", None)]
    got = [r.w for r in spark.createDataFrame(rows, "t string, n string").select(drafts.window_around(F.col("t"), F.col("n")).alias("w")).collect()]
    assert got[0] == long[3001 - 466 : 3001 - 466 + 1400] and got[1:] == [None] * 4
