"""Removal of repeated passages with difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for two equal runs of ``LENGTH``
words at any places there is one offset below the period that is a cover place in
both. So hashing windows of LENGTH - PERIOD + 1 words at cover places alone finds an
aligned anchor in every match. Anchors seen in two documents extend to the LENGTH-word
windows around them; those are hashed (96 bits) and each is compared with the smallest
document id that holds it.

Every step sends one entry per distinct hash and batch, so a passage or a copy that a
third of all documents share is combined before any shuffle. Entries travel packed by
bucket; buckets follow the session's shuffle partitions. Copies of whole texts are
known from their md5: only the smallest id of each text goes through the windows.

Defined cases: a null text has no words; every row is a document of its own: rows with the
same id do not remove from each other, whatever their texts (where an id has several texts
or none is given, rows are told apart by the id and a 64-bit hash of the text together); a
null id is larger than all others, 2^63-1 included, and rows with null ids do not remove from
each other; very long texts are taken whole; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import wordhash as wh
from tallyloom.llm.store import materialize

LENGTH = 50
PERIOD = 31
#: Differences of these places give every residue modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
ENTRY = ["<u8", "<i8", "<i4", "<i4"]  # hash, document, place, home of the document
WINDOW = ["<u8", "<u4", "<i8", "<i4", "<i4"]  # hash, check, document, place, home
RANGE = ["<i8", "<i4", "<i4"]  # document, first word, end
#: in all of them, where ids do not tell rows apart, a hash of the text follows
KEY = ["<i8"]
#: The home is the bucket of a document, plus the number of buckets where its id is null (and
#: the document 0). An entry for all documents that a task has combined has no home:
NO_HOME = -1
#: anchors that a task combines before it sends them: bounds its memory
COMBINED = 1 << 20
RESULT = "doc_id long, nameless boolean, n_words long, n_removed long, kept_sha256 string"


def _docs_per(hashes: np.ndarray, docs: np.ndarray, home: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (hash, document): order, group starts, whether a group has two documents."""
    nameless = home >= buckets
    order = np.lexsort((docs, nameless, hashes))
    h, d, x = hashes[order], docs[order], nameless[order]
    first, ends = wh.groups(h)
    two = (d[first] != d[ends - 1]) | (x[first] != x[ends - 1])
    if len(h):
        two |= np.logical_or.reduceat(home[order] == NO_HOME, first)
    return order, first, two


def _later(docs: np.ndarray, nameless: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which entries of sorted groups are of another document than the group's first."""
    return (docs != np.repeat(docs[first], size)) | (nameless != np.repeat(nameless[first], size))


def anchors(docs: DataFrame, buckets: int, length: int, period: int, cover: tuple[int, ...], wide: bool) -> DataFrame:
    """Packed anchors: kind 0 to be compared, kind 1 known to be in two documents."""
    k = length - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def combined(got: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        h, d, p, b, r = (np.concatenate(c) for c in zip(*got, strict=True))
        if not len(h):
            return
        order, first, shared = _docs_per(h, d, b, buckets)
        h, d, p, b, r = (x[order] for x in (h, d, p, b, r))
        known = np.repeat(shared, np.diff(np.append(first, len(h))))
        if known.any():
            yield wh.packed(b[known] % buckets, [d[known], p[known], p[known] + 1] + [r[known]] * wide, 1)
        # of a shared hash one entry goes on, without a home, so that others meet it
        go = np.concatenate((np.flatnonzero(~known), first[shared]))
        sent = [h[go], d[go], p[go], np.where(known[go], NO_HOME, b[go]).astype(np.int32)] + [r[go]] * wide
        yield wh.packed((sent[0] % np.uint64(buckets)).astype(np.int64), sent)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, held = [], 0
            for some, raw in wh.chunks(pdf, "text"):
                words, ends = wh.hash_words(raw)
                text, place = wh.places(ends)
                n = np.diff(ends, prepend=0)[text]
                at = np.flatnonzero(chosen[place % period] & (place + k <= n) & (n >= length))
                h = wh.windows(words, k)
                ids, keys = some["doc_id"].to_numpy(np.int64), some["key"].to_numpy(np.int64)
                home = some["home"].to_numpy(np.int32)
                got.append([h[at] if len(at) else h[:0], ids[text[at]], place[at].astype(np.int32), home[text[at]], keys[text[at]]])
                held += len(at)
                if held >= COMBINED:
                    yield from combined(got)
                    got, held = [], 0
            if got:
                yield from combined(got)

    return docs.mapInPandas(find, wh.PACKED)


def _ranges(pdf: pd.DataFrame, kind: int, wide: bool) -> list[np.ndarray]:
    """The ranges of one bucket that are at home already, led by the bucket."""
    r = wh.unpacked(pdf.loc[pdf["kind"] == kind, "load"].tolist(), RANGE + KEY * wide)
    return [np.full(len(r[0]), pdf["bucket"].iat[0]), *r]


def _repeated(buckets: int, wide: bool):
    """Anchors in two documents, packed by the home of their document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[list[np.ndarray]]:
            for pdf in wh.by_bucket(batches):
                yield _ranges(pdf, 1, wide)
                h, d, p, b, *r = wh.unpacked(pdf.loc[pdf["kind"] == 0, "load"].tolist(), ENTRY + KEY * wide)
                order, first, shared = _docs_per(h, d, b, buckets)
                size = np.diff(np.append(first, len(h)))
                keep = order[np.repeat(shared, size)] if len(h) else order
                keep = keep[b[keep] != NO_HOME]
                yield [b[keep] % buckets, d[keep], p[keep], p[keep] + 1, *(x[keep] for x in r)]

        yield from wh.repacked(found(), 1)

    return find


Row = tuple[int, int]  # id and hash of the text: the same row of documents, or a copy of it


def _rows(pdf: pd.DataFrame) -> list[Row]:
    return list(zip(pdf["doc_id"].tolist(), pdf["key"].tolist(), strict=True))


def _copies(marks: pd.DataFrame, wide: bool) -> set[Row]:
    d, *r = wh.unpacked(marks.loc[marks["kind"] == 3, "load"].tolist(), ["<i8"] + KEY * wide)
    return set(zip(d.tolist(), (r or [np.zeros_like(d)])[0].tolist(), strict=True))


def _per_doc(loads: list[bytes], wide: bool) -> dict[Row, tuple[np.ndarray, np.ndarray]]:
    """Ranges of each document."""
    d, a, z, *r = wh.unpacked(loads, RANGE + KEY * wide)
    r = (r or [np.zeros_like(d)])[0]
    order = np.lexsort((r, d))
    d, a, z, r = (x[order] for x in (d, a, z, r))
    cut, ends = wh.groups(d, r)
    return {(int(d[i]), int(r[i])): (a[i:j], z[i:j]) for i, j in zip(cut, ends, strict=True)}


def _covered(n: int, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Which of n places the ranges [a, z) cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(a, 0, n), 1)
    np.add.at(step, np.clip(z, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def _runs(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Window starts -> document, ranges of covered words (neighbours joined) and key."""
    order = np.lexsort((starts, keys, docs))
    d, r, s = docs[order], keys[order], starts[order]
    if not len(d):
        return [d, s.astype(np.int32), s.astype(np.int32), r]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] - s[:-1] > length)))
    last = np.append(new[1:], len(d)) - 1
    return [d[new], s[new].astype(np.int32), (s[last] + length).astype(np.int32), r[new]]


def window_entries(length: int, period: int, buckets: int, wide: bool):
    """Texts and repeated anchors of one home bucket -> windows to be compared."""

    def find(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        hits = _per_doc(marks.loc[marks["kind"] == 1, "load"].tolist(), wide)
        look = hits.keys() - _copies(marks, wide)
        wanted = texts[[row in look for row in _rows(texts)]]
        got: list[list[np.ndarray]] = []
        for some, raw in wh.chunks(wanted, "text") if len(wanted) else ():
            words, ends = wh.hash_words(raw)
            begin = np.append(0, ends[:-1])
            h, c = wh.windows(words, length), wh.windows(words, length, 77).astype(np.uint32)
            home = some["home"].to_numpy(np.int32)
            for i, (d, r) in enumerate(_rows(some)):
                n = int(ends[i] - begin[i]) - length + 1
                if n <= 0:
                    continue
                a, z = hits[d, r]
                at = np.flatnonzero(_covered(n, a - period + 1, z))
                w, m = begin[i] + at, len(at)
                got.append([h[w], c[w], np.full(m, d, np.int64), at.astype(np.int32), np.full(m, home[i]), np.full(m, r, np.int64)])
        if not got:
            return wh.packed(np.zeros(0, np.int64), [])
        h, c, d, p, b, r = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((d, b >= buckets, c, h))
        h, c, d, p, b, r = (x[order] for x in (h, c, d, p, b, r))
        first, ends = wh.groups(h, c)
        later = _later(d, b >= buckets, first, ends - first)
        sent = [x[~later] for x in (h, c, d, p, b)] + [r[~later]] * wide
        out = [wh.packed((h[~later] % np.uint64(buckets)).astype(np.int64), sent)]
        if later.any():
            runs = _runs(d[later], r[later], p[later], length)
            out.append(wh.packed(np.full(len(runs[0]), int(b[0]) % buckets), runs if wide else runs[:3], 2))
        return pd.concat(out)

    return find


def _later_windows(length: int, buckets: int, wide: bool):
    """Windows whose smallest document is another one, packed by home as word ranges."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[list[np.ndarray]]:
            for pdf in wh.by_bucket(batches):
                yield _ranges(pdf, 2, wide)
                h, c, d, p, b, *r = wh.unpacked(pdf.loc[pdf["kind"] == 0, "load"].tolist(), WINDOW + KEY * wide)
                order = np.lexsort((d, b >= buckets, c, h))
                h, c, d, p, b, *r = (x[order] for x in (h, c, d, p, b, *r))
                first, ends = wh.groups(h, c)
                later = _later(d, b >= buckets, first, ends - first)
                yield [b[later] % buckets, d[later], p[later], p[later] + length, *(x[later] for x in r)]

        yield from wh.repacked(found(), 2)

    return find


def _finish(length: int, wide: bool):
    def cut(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        hits = _per_doc(marks.loc[marks["kind"] == 2, "load"].tolist(), wide)
        copies = _copies(marks, wide)
        rows = []
        for row, nameless, t in zip(_rows(texts), texts["nameless"].tolist(), texts["text"], strict=True):
            words = t.encode().split() if isinstance(t, str) else []
            n = len(words)
            if row in copies and n >= length:
                words = []
            elif row in hits:
                gone = _covered(n, *hits[row])
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            rows.append((row[0], nameless, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return pd.DataFrame(rows, columns=["doc_id", "nameless", "n_words", "n_removed", "kept_sha256", "kept"])

    return cut


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, period: int = PERIOD,
    cover: tuple[int, ...] = COVER, texts: bool = True,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``texts``) the kept words themselves."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or period > length:
        raise ValueError("cover must be a difference cover modulo period, and period at most length")
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, buckets // 2)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    ident = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("doc_id"), ident.isNull().alias("nameless"), F.col(text).alias("text"), digest.alias("h"))
    named = materialize(rows.drop("text"), "repeat-names")
    texts_an_id = named.groupBy("doc_id").agg((F.min("h") < F.max("h")).alias("many"), F.max("nameless").alias("nameless"))
    wide = not texts_an_id.filter("many OR nameless").isEmpty()
    key = F.xxhash64("h", "nameless") if wide else F.lit(0).cast("long")

    def homed(df: DataFrame) -> DataFrame:
        df = df.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
        return df.withColumn("home", F.col("bucket") + F.when(F.col("nameless"), buckets).otherwise(0))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    # copies of whole texts: all but the smallest id
    place = F.struct("nameless", "doc_id")
    least = materialize(named.groupBy("h").agg(F.min(place).alias("least")), "repeat-copies")
    copies = homed(named).join(least, "h").filter(place > F.col("least")).select("bucket", "doc_id", "key")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [pdf[c].to_numpy(np.int64) for c in ("doc_id", "key")]
            yield wh.packed(pdf["bucket"].to_numpy(np.int64), ids if wide else ids[:1], 3)

    copies = materialize(copies.mapInPandas(listed, wh.PACKED), "repeat-copy-ids")
    rows = homed(rows).drop("h")
    marks = dealt(anchors(rows, buckets, length, period, cover, wide)).mapInPandas(_repeated(buckets, wide), wh.PACKED)
    found = (
        rows.groupBy("bucket").cogroup(marks.unionByName(copies).groupBy("bucket"))
        .applyInPandas(window_entries(length, period, buckets, wide), wh.PACKED)
    )
    gone = dealt(found).mapInPandas(_later_windows(length, buckets, wide), wh.PACKED)
    finish, schema = _finish(length, wide), RESULT + ", kept string" if texts else RESULT
    out = rows.groupBy("bucket").cogroup(gone.unionByName(copies).groupBy("bucket")).applyInPandas(
        lambda a, b: finish(a, b)[[c.split()[0] for c in schema.split(", ")]], schema
    )
    return out.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, texts=False)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + {LENGTH}], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {LENGTH - 1})) AS i FROM d WHERE len(ws) >= {LENGTH})
), f AS (
  SELECT k, min(doc_id) AS least FROM w GROUP BY k
), gone AS (
  SELECT doc_id, list_distinct(list(p)) AS ps
  FROM (SELECT w.doc_id, unnest(range(w.i + 1, w.i + {LENGTH + 1})) AS p FROM w JOIN f USING (k) WHERE f.least < w.doc_id) GROUP BY doc_id
), u AS (
  SELECT d.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), left_over AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM u
  LEFT JOIN (SELECT doc_id, unnest(ps) AS p, true AS out FROM gone) g USING (doc_id, p) WHERE out IS NULL GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
