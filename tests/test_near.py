"""Quotes near documents against all stretches of all pairs."""

import random

from tallyloom.operators import near
from tallyloom.operators.attribution import indel_ratio

rnd = random.Random(8)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def brute(a, b):
    """All stretches of the longer, those cut off at its ends, too."""
    best = 0.0
    for s, t in ((a, b), (b, a)):
        if s and len(s) <= len(t):
            parts = {t[i : i + len(s)] for i in range(len(t) - len(s) + 1)} | {t[:m] for m in range(1, len(s))} | {t[-m:] for m in range(1, len(s))}
            best = max(best, max(200 * common(s, p) / (len(s) + len(p)) for p in parts))
    return best


def altered(x, n):
    y = list(x)
    for _ in range(n):
        k = rnd.randrange(len(y) + 1)
        y[k : k + rnd.randrange(3)] = rnd.choice(("", "z", "qq", "e"))
    return "".join(y)


def words(n):
    return " ".join(rnd.choice("the fee of one year shall rise by ten per cent each month".split()) for _ in range(n))


def cases():
    quotes = {i: words(rnd.randrange(5, 14)) for i in range(14)}
    quotes |= {20: "too short", 21: None, 22: "", 23: "x" * 30, 24: "É" * 10 + words(4)}
    docs = {}
    for i, q in list(quotes.items()):
        if q and len(q) >= 20:
            docs[10 * i] = words(6) + " " + altered(q, rnd.randrange(0, 5)) + " " + words(5)
            docs[10 * i + 1] = altered(q[rnd.randrange(0, 6) :], 1) + "  \n" + words(4)
            docs[10 * i + 2] = words(3).upper() + " " + q[: len(q) - rnd.randrange(0, 7)]
            docs[10 * i + 3] = q[rnd.randrange(4) : rnd.randrange(8, 30)]
    docs |= {900: None, 901: "", 902: "f", 903: words(200), 904: words(200)[:150] + quotes[3] + words(90)}
    return quotes, docs


def flat(x):
    return " ".join((x or "").lower().split())


def test_partial_ratio_reaches_what_all_stretches_reach():
    quotes, docs = cases()
    n = 0
    for q in quotes.values():
        for d in list(docs.values())[::3]:
            a, b = flat(q), flat(d)
            if len(a) >= 20 and b:
                want, got = brute(a, b), near.partial_ratio(a, b)
                assert (want >= 92) == (got >= 92) and (want < 92 or abs(want - got) < 1e-9), (a, b)
                n += want >= 92
    assert n > 5
    assert near.partial_ratio("abcdefghijklmnopqrstuvwxyz"[:24], "mnopqrstuvwxyz and more of it") < 92


def test_all_quotes_against_all_documents(spark):
    quotes, docs = cases()
    q = spark.createDataFrame(list(quotes.items()), "item_id int, text string")
    d = spark.createDataFrame([*docs.items(), (2**63 - 1, docs[0])], "doc_id long, text string").repartition(3)
    got = {(r.item_id, r.doc_id): r.ratio for r in near.near_verbatim(q, d).collect()}
    docs[2**63 - 1] = docs[0]
    want = {}
    for i, x in quotes.items():
        for j, y in docs.items():
            a, b = flat(x), flat(y)
            if len(a) >= 20 and b and (s := brute(a, b)) >= 92:
                want[i, j] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40
    assert near.near_verbatim(q.limit(0), d).count() == 0 and near.near_verbatim(q, d.limit(0)).count() == 0


def test_hits_of_common_pieces_stay_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT_BLOCK", 500)
    monkeypatch.setattr(near, "LONG_BLOCK", 2000)
    quotes, docs = cases()
    q = spark.createDataFrame([(i, flat(x)) for i, x in quotes.items() if x and len(x) >= 20], "id int, text string")
    d = spark.createDataFrame([(i, flat(x)) for i, x in docs.items()], "id long, text string")
    df = near.near_stretches(q, d)
    want = {(r.short_id, r.long_id): r.ratio for r in df.collect()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan and len(want) > 20
    monkeypatch.undo()
    assert want == {(r.short_id, r.long_id): r.ratio for r in near.near_stretches(q, d).collect()}


def test_windows_of_the_quotes_length_are_ratios(spark):
    assert near.best_stretch("abcd", "xxabcdxx", [2]) == 100.0 and round(near.best_stretch("abcd", "xxabxdxx", [2])) == indel_ratio("abcd", "abxd")
