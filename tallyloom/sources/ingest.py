"""Uploads to stored documents and statement lines: batches or a stream of files.

A batch is (run_id, filename, content). Every file has one outcome: a text or a contract is
``complete`` or ``failed`` with a reason; a statement is ``pending`` until the mapping of its
columns is known by the signature of its header, then ``complete`` or ``failed``. A name that
the run has already is passed over, so files may come twice, late, or in any batches: documents
and lines are merged by key in one step, and a batch that is played again changes nothing.

Rows of a statement whose date or amount cannot be read are set aside with the reason. Files
in another encoding than UTF-8 are read as Latin-1 with a warning.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyloom.functions.batches import pieces
from tallyloom.functions.dates import parse_dates
from tallyloom.functions.text import clean_amount, header_signature, squeeze
from tallyloom.sources.lineage import cut
from tallyloom.sources.statements import UNREAD, file_kind
from tallyloom.sources.stored import Change, Store

UPLOAD = "run_id int, filename string, content binary"
FIELDS = ("date", "amount", "description")
DOCUMENT = ("run_id", "filename", "category", "status", "error", "warnings", "text", "headers", "signature", "n_lines")
LINE = ("run_id", "filename", "place", "client_id", "transaction_date", "amount", "description")


def _rows(text: str | None) -> list[list[str]] | None:
    try:
        return None if text is None else [r for r in csv.reader(io.StringIO(text), strict=True) if r]
    except csv.Error:
        return None


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _csv_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Rows of a CSV text, the header first; null where it cannot be read as one. They leave the
    worker a piece at a time: a batch may hold thousands of files."""
    for texts in batches:
        yield from pieces(((len(t or ""), _rows(t)) for t in (x.as_py() for x in texts)), pa.list_(pa.list_(pa.string())))


def read_uploads(files: DataFrame) -> DataFrame:
    """One row a file: category, status, error, warnings, text, headers, signature, rows."""
    known = F.col("content").cast("string")
    utf8 = F.is_valid_utf8(known)
    t = F.regexp_replace(F.when(utf8, known).otherwise(F.decode("content", "ISO-8859-1")), "^﻿", "")
    kind = file_kind(F.col("filename"))
    statement = F.coalesce(kind == "csv", F.lit(False))
    out = files.withColumns({"_kind": kind, "text": F.when(F.contains(t, F.lit("\x00")), F.lit(None)).otherwise(t)})
    out = out.withColumn("rows", _csv_rows(F.when(statement, F.col("text"))))
    headers = F.get("rows", F.lit(0))
    error = (
        F.when(F.col("_kind").isNull(), F.concat(F.lit("unsupported file type: "), F.coalesce("filename", F.lit(""))))
        .when(F.col("_kind").isin("image", "pdf"), "no reader for this kind of file").when(F.col("content").isNull() | F.col("text").isNull(), "the file holds no text")
        .when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "no extractable text").when(statement & F.col("rows").isNull(), "the table cannot be read")
    )
    return out.select(
        "run_id", "filename", F.when(statement, "statement").otherwise("contract").alias("category"),
        F.when(error.isNotNull(), "failed").when(statement, "pending").otherwise("complete").alias("status"), error.alias("error"),
        F.when(~utf8 & error.isNull(), F.array(F.lit("not UTF-8: read as Latin-1"))).otherwise(F.array().cast("array<string>")).alias("warnings"), "text",
        headers.alias("headers"), F.when(error.isNull() & statement, header_signature(headers)).alias("signature"), F.when(error.isNull(), F.col("rows")).alias("rows"),
    )


def _cell(field: str) -> Column:
    """The value under the column that a mapping names for a field; null where it names none."""
    at = F.array_position("headers", F.try_element_at("mapping", F.lit(field)))
    return F.get("row", (F.coalesce(at, F.lit(0)) - 1).cast("int"))


def statement_rows(documents: DataFrame) -> DataFrame:
    """documents(run_id, filename, headers, rows, mapping) -> a row for each of their rows, with
    ``reason`` where it is set aside. A file is read month-first or day-first as a whole."""
    each = documents.select("run_id", "filename", "headers", "mapping", F.posexplode(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).alias("place", "row"))
    each = each.withColumns({f"_{f}": _cell(f) for f in FIELDS})
    fails = each.groupBy("run_id", "filename").agg((F.avg(parse_dates(F.col("_date"), F.lit(False)).isNull().cast("int")) > UNREAD).alias("_day_first"))
    each = each.join(fails, ["run_id", "filename"])
    t = squeeze(F.col("_description"))
    each = each.withColumns({
        "transaction_date": parse_dates(F.col("_date"), F.col("_day_first")), "amount": clean_amount(F.col("_amount")).cast("decimal(18,2)"),
        "description": F.when(t != "", t), "client_id": F.lit(None).cast("long"), "place": F.col("place").cast("long"),
    })
    reason = F.when(F.col("transaction_date").isNull(), "unreadable date").when(F.col("amount").isNull(), "unreadable amount")
    return each.select(*LINE, reason.alias("reason"))


def imported(documents: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending statements whose mapping(signature, mapping) is confirmed -> (documents with
    their outcome, all their rows). Others stay as they are."""
    d = documents.join(mappings.select("signature", "mapping"), "signature", "left")
    lacks = F.filter(F.array(*map(F.lit, FIELDS[:2])), lambda f: ~F.array_contains("headers", F.try_element_at("mapping", f)) | F.try_element_at("mapping", f).isNull())
    ready = d.filter("status = 'pending' AND mapping IS NOT NULL").withColumn("_lacks", F.concat_ws(", ", lacks))
    rows = cut(statement_rows(ready.filter("_lacks = ''")))
    n = rows.groupBy("run_id", "filename").agg(F.count_if(F.col("reason").isNull()).alias("n"))
    done = ready.join(n, ["run_id", "filename"], "left")
    error = F.when(F.col("_lacks") != "", F.concat(F.lit("map at least date and amount (missing: "), "_lacks", F.lit(")"))).when(F.coalesce("n", F.lit(0)) == 0, "no rows could be parsed with the confirmed mapping")
    told = F.concat(F.col("n"), F.lit(" transaction(s) parsed from columns: "), F.array_join(F.map_values("mapping"), ", "))
    done = done.withColumns({"status": F.when(error.isNotNull(), "failed").otherwise("complete"), "error": error, "n_lines": F.coalesce("n", F.lit(0)), "text": F.when(error.isNull(), told).otherwise(F.col("text"))})
    return done.select(*DOCUMENT), rows


def ingest(store: Store, files: DataFrame, mappings: DataFrame) -> DataFrame:
    """One batch. Returns the number of documents and lines inserted, changed and kept."""
    once = Window.partitionBy("run_id", "filename").orderBy(F.xxhash64("content"))
    fresh = files.select("run_id", "filename", "content").filter("run_id IS NOT NULL AND filename IS NOT NULL")
    fresh = fresh.withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_r")
    if "documents" in store.state():
        fresh = fresh.join(store.read("documents").select("run_id", "filename"), ["run_id", "filename"], "left_anti")
    read = cut(read_uploads(fresh).withColumn("n_lines", F.lit(0).cast("long")))
    done, rows = imported(read, mappings)
    documents = read.select(*DOCUMENT).join(done.select("run_id", "filename"), ["run_id", "filename"], "left_anti").unionByName(done)
    return _stored(store, documents, rows)


def confirm(store: Store, mappings: DataFrame) -> DataFrame:
    """Import the pending statements whose mapping has been confirmed since they came."""
    waiting = store.read("documents").filter("status = 'pending'").join(mappings.select("signature"), "signature", "left_semi")
    pending = cut(waiting.withColumn("rows", _csv_rows("text")))
    return _stored(store, *imported(pending, mappings))


def _stored(store: Store, documents: DataFrame, rows: DataFrame) -> DataFrame:
    aside = rows.filter("reason IS NOT NULL").select("run_id", "filename", "place", "reason")
    return store.merge({
        "documents": Change(documents, ("filename",), "upsert"), "lines": Change(rows.filter("reason IS NULL").select(*LINE), ("filename", "place"), "upsert"),
        "set_aside": Change(aside, ("filename", "place"), "upsert"),
    })


def ingest_stream(spark: SparkSession, folder: str, store: Store, mappings, run_id: int, checkpoint: str):
    """Files of a folder as they come, until none is new. ``mappings``: a function that gives the
    confirmed mappings of the moment. Returns the finished query."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", True).load(folder)
    files = files.select(F.lit(run_id).alias("run_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")
    query = files.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, mappings())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
