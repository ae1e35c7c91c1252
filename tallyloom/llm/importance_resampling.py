"""Target-distribution importance resampling with features counted once a distinct line.

Texts are cut at newlines. Distinct lines are counted first; their hashed features (runs
of 1 to ``longest`` words, by bucket) are worked out once and count as often as the line
occurs. Runs that cross a line's end are taken from the edges of the lines, document by
document, and added separately. From the bucket counts of all documents and of the target
comes a gain for every bucket; a distinct line's gains are summed once, too, and reach the
documents through a join by the line's 128-bit hash. Noise from the document's id turns
the weights into a draw without replacement (the highest scores).

Lines travel to the executors that count them with their occurrences added up beforehand;
the join broadcasts hot lines only (those with one in 1024 of all uses). The bucket counts
are as many rows as there are buckets.

Defined cases: a null text counts as empty: no features, weight 0, never drawn while
``least_words`` is above 0; very long texts are cut into lines like any, a long line is one
row; a null id has the noise of an empty one and ranks last among equal scores; rows of one
id are scored one by one; equal scores go to the smaller id; an empty table gives an empty
table, an empty target weighs all buckets by the documents alone; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.hot import lookup, ranked
from tallyloom.llm.license_scan import license_words
from tallyloom.llm.sql import crc32_sql
from tallyloom.llm.store import materialize

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
LINE_SUMS = "k1 long, k2 long, uses long, n_words long, n long, gain long"
ROW_SUMS = "_row long, n long, gain long"


def _bucket(run: Column, buckets: int) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def line_features(words: Column, longest: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` of ``words``."""
    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
        found = F.transform(starts, lambda i: _bucket(F.array_join(F.slice(words, i, F.lit(k)), " "), buckets))
        return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<int>"))

    single = F.transform(words, lambda w: _bucket(w, buckets))
    return F.concat(single, *[runs(k) for k in range(2, longest + 1)]) if longest > 1 else single


def crossing_features(lines: Column, longest: int, buckets: int) -> Column:
    """Buckets of the runs that begin in one line and end in another.

    Only ``longest - 1`` words at each end of a line can be in such a run; a null stands
    for what a longer line has between its ends.
    """
    m = longest - 1
    none = F.array().cast("array<int>")
    if not m:
        return none

    def edges(line: Column, at: Column) -> Column:
        def cut(w: Column) -> Column:
            return F.when(F.size(w) <= 2 * m, w).otherwise(F.concat(F.slice(w, 1, m), F.array(F.lit(None).cast("string")), F.slice(w, -m, m)))

        words = F.flatten(F.transform(F.array(license_words(line)), cut))
        return F.transform(words, lambda w: F.struct(w.alias("w"), at.alias("line")))

    row = F.flatten(F.transform(lines, edges))

    def crossing(row: Column, k: int) -> Column:
        def run(i: Column) -> Column:
            part = F.slice(row, i, F.lit(k))
            whole = ~F.exists(part, lambda x: x["w"].isNull())
            apart = F.get(part, F.lit(0))["line"] != F.get(part, F.lit(k - 1))["line"]
            return F.when(whole & apart, _bucket(F.array_join(F.transform(part, lambda x: x["w"]), " "), buckets))

        runs = F.transform(F.sequence(F.lit(1), F.size(row) - (k - 1)), run)
        return F.when(F.size(row) >= k, F.filter(runs, lambda b: b.isNotNull())).otherwise(none)

    # the row is bound once, so that it is not worked out anew for every run
    return F.flatten(F.transform(F.array(row), lambda r: F.concat(*[crossing(r, k) for k in range(2, longest + 1)])))


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")


def feature_tables(docs: DataFrame, text: str, longest: int, buckets: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: _row, key, lines as hash pairs, crossing features), (distinct lines: hash
    pair, uses, n_words, features), both written."""
    spot = lambda x: F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(F.lit("line"), x).alias("k2"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), (F.col(key) if key else F.lit(None).cast("long")).alias("_key"),
        F.transform(_lines(text), spot).alias("lines"), crossing_features(_lines(text), longest, buckets).alias("feats"),
    )
    counted = docs.select(F.explode(_lines(text)).alias("line")).groupBy("line").agg(F.count("*").alias("uses"))
    lines = counted.select(spot(F.col("line")).alias("k"), "uses", license_words(F.col("line")).alias("w"))
    lines = lines.select("k.*", "uses", F.size("w").cast("long").alias("n_words"), line_features(F.col("w"), longest, buckets).alias("feats"))
    return materialize(rows, "resample-rows"), materialize(lines, "resample-lines")


def bucket_counts(rows: DataFrame, lines: DataFrame) -> dict[int, int]:
    """Occurrences by bucket (as many rows as there are buckets): a distinct line's
    features times its uses, plus the features that cross lines."""
    inside = lines.select(F.explode("feats").alias("b"), "uses")
    across = rows.select(F.explode("feats").alias("b"), F.lit(1).cast("long").alias("uses"))
    both = inside.unionByName(across).groupBy("b").agg(F.sum("uses").alias("n"))
    return {r.b: r.n for r in both.collect()}


def bucket_gains(ours: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln of the target's share over ours) by bucket, one added to every bucket."""
    s_all, t_all = float(sum(ours.values()) + buckets), float(sum(target.values()) + buckets)
    gains = np.zeros(buckets, np.int64)
    for b in range(buckets):
        t, s = target.get(b, 0) + 1.0, ours.get(b, 0) + 1.0
        gains[b] = math.floor(1000 * math.log((t * s_all) / (s * t_all)))
    return gains


def summed(gains: np.ndarray, keep: tuple[str, ...]):
    """Arrow task: ``keep`` columns, number and summed gains of the features of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = b.column(b.schema.get_field_index("feats"))
            n = np.asarray(feats.value_lengths()).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(gains[np.asarray(feats.flatten())])))
            ends = np.cumsum(n)
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(total[ends] - total[ends - n])], names=[*keep, "n", "gain"])

    return run


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id",
          longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: _row, the key, n_words, n_features, weight."""
    rows, lines = feature_tables(docs, text, longest, buckets, key)
    gains = bucket_gains(bucket_counts(rows, lines), bucket_counts(*feature_tables(target, target_text, longest, buckets)), buckets)
    sums = materialize(lines.mapInArrow(summed(gains, ("k1", "k2", "uses", "n_words")), LINE_SUMS), "resample-sums")
    places = materialize(rows.select("_row", F.explode("lines").alias("k")).select("_row", "k.*"), "resample-places")
    parts = lookup(places, sums, ["k1", "k2"]).select("_row", "n_words", "n", "gain")
    if longest > 1:
        across = rows.select("_row", "feats").mapInArrow(summed(gains, ("_row",)), ROW_SUMS)
        parts = parts.unionByName(across.withColumn("n_words", F.lit(0).cast("long")))
    whole = parts.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_words", "n", "gain")])
    out = rows.select("_row", F.col("_key").alias(key)).join(whole, "_row", "left").na.fill(0, ["n_words", "n", "gain"])
    floored = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0).cast("long"))
    return out.select("_row", key, "n_words", F.col("n").alias("n_features"), floored.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id",
             longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: the key, n_words, n_features, weight, score and the rank of those drawn."""
    df = weigh(docs, target, text, target_text, key, longest, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    df = df.withColumn("score", F.col("weight") + noise).withColumn("_may", F.col("n_words") >= least_words)
    df = materialize(df, "resample-scores")
    n = df.filter("_may").count() * percent // 100
    out = ranked(df, F.desc("_may"), F.desc("score"), F.asc_nulls_last(key), F.asc("_row"))
    return out.withColumn("rank", F.when(F.col("_may") & (F.col("rank") <= n), F.col("rank")).cast("long")).drop("_may", "_row")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, unnest({_WORDS}) AS w FROM documents
), dw AS (
  SELECT doc_id, w, count(*) AS c FROM d GROUP BY doc_id, w
), bw AS (
  SELECT w, count(*) AS c FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w
), v AS (
  SELECT w, {crc32_sql("w")} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), s AS (
  SELECT b, sum(c) AS s FROM dw JOIN v USING (w) GROUP BY b
), t AS (
  SELECT b, sum(c) AS t FROM bw JOIN v USING (w) GROUP BY b
), g AS (
  SELECT b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT b FROM v) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), m AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS gain FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id
), w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight
  FROM documents LEFT JOIN m USING (doc_id)
), r AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w
), p AS (
  SELECT *, row_number() OVER (ORDER BY (n_features >= {LEAST_WORDS}) DESC, score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS k
  FROM r
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= k AND n_features >= {LEAST_WORDS} THEN CAST(place AS BIGINT) END AS rank
FROM p
"""
