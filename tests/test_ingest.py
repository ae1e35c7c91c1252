"""Uploads in batches and as a stream: outcomes, mappings confirmed later, files that come twice."""

import datetime as dt
from decimal import Decimal

import pytest

from tallyloom.functions.text import header_signature
from tallyloom.sources import ingest
from tallyloom.sources.stored import Store

GOOD = 'Date,Amount,Text\n2025-01-02,"$1,500.00","ACME, Inc."\n2025-01-05,(20.5),\nsoon,5,x\n2025-01-09,n/a,y\n'
FILES = {
    "good.csv": GOOD.encode(), "again.csv": b"\xef\xbb\xbfDate,Amount,Text\n13/02/2025,7,a\n14/02/2025,8,b\n", "other.csv": b"When,Sum\n2025-03-01,9\n",
    "none.csv": b"Date,Amount,Text\nx,y,z\n", "broken.csv": b'Date,Amount,Text\n"2025-01-02,1,a\n', "short.csv": b"Date,Amount,Text\n2025-04-01\n2025-04-02,3,c\n",
    "latin.txt": "Gebühr für März".encode("latin-1"), "empty.txt": b" \n", "zero.txt": b"a\x00b", "what.xyz": b"hello", "scan.pdf": b"%PDF", "ok.md": b"The fee is $10.",
}


@pytest.fixture
def mappings(spark):
    m = spark.createDataFrame([(["Date", "Amount", "Text"], {"date": "Date", "amount": "Amount", "description": "Text"})], "h array<string>, mapping map<string,string>")
    return m.select(header_signature(m.h).alias("signature"), "mapping")


def outcomes(store):
    return {r.filename: (r.status, r.error, r.n_lines) for r in store.read("documents").collect()}


def lines(store):
    return sorted((r.filename, r.place, r.transaction_date, r.amount, r.description) for r in store.read("lines").collect())


WANT = {
    "good.csv": ("complete", None, 2), "again.csv": ("complete", None, 2), "other.csv": ("pending", None, 0), "short.csv": ("complete", None, 1),
    "none.csv": ("failed", "no rows could be parsed with the confirmed mapping", 0), "broken.csv": ("failed", "the table cannot be read", 0),
    "latin.txt": ("complete", None, 0), "empty.txt": ("failed", "no extractable text", 0), "zero.txt": ("failed", "the file holds no text", 0),
    "what.xyz": ("failed", "unsupported file type: what.xyz", 0), "scan.pdf": ("failed", "no reader for this kind of file", 0), "ok.md": ("complete", None, 0),
}


def test_batches_in_any_order_give_one_result(spark, tmp_path, mappings):
    up = spark.createDataFrame([(1, n, bytearray(b)) for n, b in FILES.items()], ingest.UPLOAD)
    one = Store(spark, f"file://{tmp_path}/one")
    ingest.ingest(one, up.unionByName(up), mappings)
    assert outcomes(one) == WANT
    d = dt.date
    assert lines(one) == [
        ("again.csv", 0, d(2025, 2, 13), Decimal("7.00"), "a"), ("again.csv", 1, d(2025, 2, 14), Decimal("8.00"), "b"),
        ("good.csv", 0, d(2025, 1, 2), Decimal("1500.00"), "ACME, Inc."), ("good.csv", 1, d(2025, 1, 5), Decimal("-20.50"), None), ("short.csv", 1, d(2025, 4, 2), Decimal("3.00"), "c"),
    ]
    aside = {(r.filename, r.place): r.reason for r in one.read("set_aside").collect()}
    assert aside == {("good.csv", 2): "unreadable date", ("good.csv", 3): "unreadable amount", ("none.csv", 0): "unreadable date", ("short.csv", 0): "unreadable amount"}
    latin = one.read("documents").filter("filename = 'latin.txt'").first()
    assert latin.text == "Gebühr für März" and latin.warnings == ["not UTF-8: read as Latin-1"]
    version = one.version()
    assert {r.kind for r in ingest.ingest(one, up, mappings).collect()} <= {"kept"} and one.version() == version
    # the mapping of the other header is confirmed, first without a date
    m = spark.createDataFrame([(["When", "Sum"], {"date": "When", "amount": "Gone"})], "h array<string>, mapping map<string,string>")
    m = m.select(header_signature(m.h).alias("signature"), "mapping")
    two = Store(spark, f"file://{tmp_path}/two")
    ingest.ingest(two, up.filter("filename = 'other.csv'"), m)
    assert outcomes(two) == {"other.csv": ("failed", "map at least date and amount (missing: amount)", 0)}
    m = spark.createDataFrame([(["When", "Sum"], {"date": "When", "amount": "Sum"})], "h array<string>, mapping map<string,string>")
    ingest.confirm(one, m.select(header_signature(m.h).alias("signature"), "mapping"))
    assert outcomes(one)["other.csv"] == ("complete", None, 1) and len(lines(one)) == 6


def test_stream_of_files_equals_the_batch(spark, tmp_path, mappings):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    names = list(FILES)
    for part in (names[:5], names[5:]):
        for n in part:
            (folder / n).write_bytes(FILES[n])
        ingest.ingest_stream(spark, f"file://{folder}", store, lambda: mappings, 1, f"file://{tmp_path}/progress")
    (folder / "late").mkdir()
    (folder / "late" / "good.csv").write_bytes(b"Date,Amount,Text\n2025-01-02,1,other\n")
    # the stream forgets what it has read: every file comes once more, and one name with another content
    ingest.ingest_stream(spark, f"file://{folder}", store, lambda: mappings, 1, f"file://{tmp_path}/anew")
    up = spark.createDataFrame([(1, n, bytearray(b)) for n, b in FILES.items()], ingest.UPLOAD)
    batch = Store(spark, f"file://{tmp_path}/batch")
    ingest.ingest(batch, up, mappings)
    assert outcomes(store) == outcomes(batch) == WANT and lines(store) == lines(batch)


def test_rows_of_many_files_leave_the_worker_in_pieces():
    import pyarrow as pa

    text = "Date,Amount,Text\n" + '2025-01-02,5,"a, b"\n' * 20_000
    texts = [text, None, "", 'a\n"b', text, text, text, text, "x,y\n\n"]
    out = list(ingest._csv_rows.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["z"])])))
    assert len(out) > 2 and max(len(a) for a in out) < len(texts)
    got = [r for a in out for r in a.to_pylist()]
    assert [len(r) if r is not None else None for r in got] == [20_001, None, 0, None, 20_001, 20_001, 20_001, 20_001, 1, 1]
    assert got[0][1] == ["2025-01-02", "5", "a, b"] and got[-2:] == [[["x", "y"]], [["z"]]]
