"""Marks in escaped text against a letter-by-letter version; pairs, excerpts and small text functions."""

import collections
import html
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions import batches, text
from tallyloom.operators import drafts, marks, pairs, reconcile, scan

rnd = random.Random(6)


def by_letters(t, quotes):
    """Each letter of the text with the quote that holds it, tried at all places."""
    owner = [None] * len(t)

    def take(k, n, fits):
        for a in range(len(t)):
            b = fits(a)
            if b and all(o is None for o in owner[a:b]):
                owner[a:b] = [(k, n)] * (b - a)
                return True
        return False

    for k, q in enumerate(quotes):
        if not q or not q.strip():
            continue
        words = q.split()[:14]
        if not take(k, "exact", lambda a: a + len(q) if t.startswith(q, a) else None) and len(words) >= 4:
            pattern = re.compile(r"\s+".join(map(re.escape, words)))
            take(k, "loose", lambda a: (m.end() if (m := pattern.match(t, a)) else None))
    out, last = "", None
    for ch, o in zip(t, owner):
        if o != last:
            out += ("</mark>" if last else "") + (marks.OPEN[o[1]] if o else "")
            last = o
        out += "<br>" if ch == "\n" else html.escape(ch)
    return out + ("</mark>" if last else "")


def cases():
    for _ in range(150):
        t = "".join(rnd.choice(["fee ", "the ", "a&b ", "<5% ", '"x" ', "é ", "\n", "  ", "\t", "of "]) for _ in range(rnd.randrange(5, 60)))
        quotes = [None, "", " "]
        for _ in range(4):
            a = rnd.randrange(len(t))
            q = t[a : a + rnd.randrange(1, 40)]
            quotes.append(rnd.choice((q, q.replace("\n", " "), " ".join(q.split()), q + "zz")))
        rnd.shuffle(quotes)
        yield t, quotes


def test_marks_equal_a_letter_by_letter_version(spark):
    rows = [(i, t, q) for i, (t, q) in enumerate(cases())] + [(900, None, ["x"]), (901, "", ["x"]), (902, "word " * 50_000 + "the very last words of it all", ["the very  last words of it all", "not here"])]
    df = spark.createDataFrame(rows, "doc_id int, text string, quotes array<string>").withColumn("marked", marks.marked(F.col("text"), F.col("quotes")))
    got = {r.doc_id: r.marked for r in df.collect()}
    loose = 0
    for i, t, q in rows[:-3]:
        assert got[i].html == by_letters(t, q), (t, q)
        loose += sum(m.how == "loose" for m in got[i].marks)
        for m in got[i].marks:
            assert " ".join(t[m.start : m.end].split()).startswith(" ".join(q[m.place].split()[:4])[:3])
    assert loose > 10 and got[900].html is None and got[901].html == "" and len(got[902].marks) == 1
    lost = {(r.doc_id, r.place) for r in marks.unmarked(df).collect()}
    assert (902, 1) in lost and (902, 0) not in lost


def test_pairs_are_dealt_evenly_and_checked(spark):
    cols = "client_id long, client_name string, base_amount decimal(18,2), frequency string, esc_pct double, off_pct double, off_months int, ms_amount long"
    rows = spark.createDataFrame([(i, f"Client {i}", 1000 + i, "monthly", 2.5, 10.0, 3, 70_000 + i) for i in range(605)], cols.replace("decimal(18,2)", "long")).withColumn("base_amount", F.col("base_amount").cast("decimal(18,2)"))
    dealt = pairs.dealt(rows, "client_id", 3)
    n = collections.Counter(r.template for r in dealt.collect())
    assert sum(n.values()) == 605 and max(n.values()) - min(n.values()) <= 1 and len(n) == 6
    assert sorted(map(tuple, dealt.select("client_id", "template").collect())) == sorted(map(tuple, pairs.dealt(rows.repartition(5), "client_id", 3).select("client_id", "template").collect()))
    p = pairs.written(dealt)
    assert p.filter(F.size(pairs.problems(p)) > 0).count() == 0
    bad = p.withColumns({"esc_pct": F.lit(9.25), "client_name": F.lit("Nobody")})
    found = collections.Counter(x for r in bad.select("template", pairs.problems(bad).alias("p")).collect() for x in r.p)
    rises = sum(v for k, v in n.items() if "rise" in pairs.TEMPLATES[k])
    assert found == {"client is not in the text": 605, "rise is not in the text": rises}
    assert pairs.dealt(rows.limit(0), "client_id", 3).count() == 0


def test_excerpts_names_masks_and_queues(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    t = "".join(f"Opening words {i}. " for i in range(110)) + "the MONTHLY\nfee is $5 and it is due. " + "".join(f"tail{i} " for i in range(300)) + "later it shall rise by five per cent. " + "end " * 300
    fee, rise = F.lit("the monthly fee is $5"), F.lit("later it shall rise by five")
    x = one(drafts.excerpt(F.col("t"), [fee, rise, fee, F.lit(None).cast("string")]), t=t)
    assert x.count("[...]") == 2 and x.startswith("Opening words 0.") and "MONTHLY" in x and "shall rise" in x
    assert one(drafts.excerpt(F.col("t"), [fee]), t="short") == "short"
    names = {"dir/Invoice v2_.PDF": "Invoice_v2.PDF", "Résumé (v2).pdf": "Resume_v2.pdf", "__x__": "x", "": "upload", "...": "upload", "ﬁle½.txt": "file12.txt", "日本.csv": "csv", "a b  c.tar.gz": "a_b_c.tar.gz", "/etc/passwd": "passwd"}
    for name, want in names.items():
        assert one(text.safe_name(F.col("n")), n=name) == want, name
    assert one(text.masked(F.col("n")), n="") == "—" and one(text.masked(F.col("n")), n="12345678") == "•" * 8
    assert one(text.page_lengths(F.col("n")), n="ab\fc\f") == [2, 1, 0]
    f = spark.createDataFrame([(1, "unverified", 5.0), (2, "unverified", 9.0), (3, "confirmed", 99.0), (4, "unverified", 9.0)], "entry_id int, status string, gap double")
    assert [r.entry_id for r in reconcile.review_queue(f, 2).collect()] == [2, 4]
    s = spark.createDataFrame([(1, 3, True, False, 5), (2, 3, False, True, 1), (3, 2, True, True, 9), (4, 4, True, True, 1)], "doc_id int, score int, core_pair boolean, gold boolean, n_chars int")
    assert [r.doc_id for r in scan.survivors(s, 3).collect()] == [4, 2, 1]


def test_categories_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, "a monthly fee")], "doc_id long, text string")
    plan = scan.categories(df).filter("score >= 2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("payment schedule|") == 1


def test_gates_stand_in_all_that_the_patterns_match():
    said = {
        "recurring_fee": ["retainer", "monthly sum", "sums of $5 per month", "$5 / month", "payable monthly", "per monthly in advance", "annual fees", "recurring revenue", "quarterly fee"],
        "escalation": ["will increase by 5%", "5% uplift", "5% adjustment", "escalator", "annually adjust", "increase by cpi", "upon each anniversary they adjust", "price adjustment"],
        "discount": ["5% discount", "discount of 5%", "discounted fee", "trial period", "initial rate", "promotional price", "introductory price", "rebate", "fee waived"],
        "milestone": ["milestone", "upon launch $", "$ upon delivery", "payment schedule", "lump-sum", "one time fee", "one-time charge"],
        "payment_terms": ["net forty five", "within 15 days of", "due within 9 days", "payment terms"],
    }
    for name, texts in said.items():
        assert all(any(re.search(p, t) for p in scan.CATEGORIES[name]) and any(g in t for g in scan.GATES[name]) for t in texts), name
        assert all(any(re.search(p, t) for t in texts) for p in scan.CATEGORIES[name]), name


def test_only_one_piece_of_a_batch_is_python_at_once():
    text = pa.array(["x" * 10_000 + str(i) for i in range(3000)] + [None, ""])
    tracemalloc.start()
    out = batches.by_row(lambda t: None if t is None else [t, t.upper()], pa.list_(pa.string()), text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * batches.PIECE < 60_000_000  # 60 million letters come out
    assert len(out) == 3002 and out[2999].as_py()[0].endswith("2999") and out[3000:].to_pylist() == [None, ["", ""]]
    assert [len(a) for a in batches.pieces([(batches.PIECE, 1), (1, 2), (1, 3)], pa.int64())] == [1, 2]
    assert batches.by_row(str, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_hits_leave_the_worker_by_pieces(spark, monkeypatch):
    said = "A monthly fee is due. " + "word " * 60 + "A discount of 10% applies."
    docs, steps = spark.createDataFrame([(1, said)], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *_: steps.append(f))
    scan.hits(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9000)), "text": [said] * 9000})
    out = list(steps[0](iter([batch, batch.slice(0, 0)])))
    assert len(out) > 2 and all(sum(map(len, b.column("snippet").to_pylist())) < 2 * batches.PIECE for b in out)
    assert [(r["doc_id"], r["category"]) for b in out for r in b.to_pylist()] == [(i, c) for i in range(9000) for c in ("recurring_fee", "discount")]
