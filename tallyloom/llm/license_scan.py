"""License scans by diagonal voting.

All rolling three-word hashes of a text meet the three-word hashes of the license
templates in one join with the (fixed, small) template table. A hit at text place p
and template place q lies on diagonal p - q. Hits are counted by diagonal,
neighbouring diagonals (words put in or left out) are merged, however far a run drifts from
its first one, and what remains is verified: every hit by its words, a span by the share of
template places that its hits cover. A base phrase counts only as a whole.

Words: runs of digits, letters a-z after A-Z are lower-cased, and non-ASCII characters.

Defined cases: a null text counts as empty: no words, no labels, score 0; very long texts
are taken whole, their words do not travel; null ids and repeated
rows are scanned one by one; a text shorter than three words has no hits; an empty
table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: words that may stand between two diagonals that count as one passage
GAP = 4
#: share of a template's words that a passage must hold, in order of the diagonal
MATCH = 0.8
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrase and label; base phrases count only as a whole.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Longer wordings of public licenses, found by share of words.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    # whole grants and notices
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
     "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
     "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
     "or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
     "the documentation and or other materials provided with the distribution", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies", "isc"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
     "binary for any purpose commercial or non commercial and by any means", "unlicense"),
)


def license_words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, NOT_WORD), lambda w: w != "")


def grams(words: Column) -> Column:
    """Hashes of ``K`` consecutive words, by place."""
    n = F.size(words)
    return F.when(
        n >= K,
        F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(K)])),
    ).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(h, t_id, t_label, t_base, t_words, q): a few hundred rows, whatever the input."""
    rows = [(i, p, x, i < len(base)) for i, (p, x) in enumerate([*base, *templates])]
    known = F.array(
        *[F.struct(F.lit(i).alias("t_id"), F.lit(p).alias("p"), F.lit(x).alias("t_label"), F.lit(b).alias("t_base")) for i, p, x, b in rows]
    )
    df = spark.range(1).select(F.explode(known).alias("r")).select("r.*")
    df = df.withColumn("t_words", license_words(F.col("p")))
    return df.select("t_id", "t_label", "t_base", "t_words", F.posexplode(grams(F.col("t_words"))).alias("q", "h"))


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep`` columns, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    none = F.lit(-1)
    w = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), license_words(F.col(text)).alias("_w"))
    # the last element is a mark that every text carries, so that texts without a hit stay
    mark = F.xxhash64(F.lit("end of text"), F.lit(0))
    w = w.withColumn("_g", F.concat(grams(F.col("_w")), F.array(mark)))
    hits = w.select(*keep, "_row", "_w", F.posexplode("_g").alias("p", "h"))
    ends = spark.range(1).select(
        none.alias("t_id"), F.lit("").alias("t_label"), F.lit(False).alias("t_base"),
        F.array().cast("array<string>").alias("t_words"), F.lit(0).alias("q"), mark.alias("h"),
    )
    table = template_grams(spark).unionByName(ends)
    hits = hits.join(F.broadcast(table), "h")
    hits = hits.withColumn("d", F.when(F.col("t_id") == none, F.lit(0)).otherwise(F.col("p") - F.col("q")))
    # hashes only propose: a hit counts if the words are the template's
    alike = F.slice("_w", F.col("p") + 1, K) == F.slice("t_words", F.col("q") + 1, K)
    hits = hits.filter((F.col("t_id") == none) | alike)
    hits = hits.select(*keep, "_row", "t_id", "t_label", "t_base", F.size("t_words").alias("t_n"), "p", "q", "d", F.size("_w").alias("n_words"))
    votes = hits.groupBy("_row", "t_id", "d").agg(
        *[F.first(c).alias(c) for c in (*keep, "n_words", "t_label", "t_base", "t_n")],
        F.count("*").alias("votes"), F.min("p").alias("p0"), (F.max("p") + K).alias("p1"),
        F.collect_list("q").alias("qs"),  # at most as many as the template has words
    )
    # merge: a diagonal within GAP of the one before, whose words follow it closely
    line = Window.partitionBy("_row", "t_id").orderBy("d")
    apart = (F.col("d") - F.lag("d").over(line) > GAP) | (F.abs(F.col("p0") - F.lag("p1").over(line)) > GAP + K)
    fresh = F.col("t_base") | F.coalesce(apart, F.lit(True))
    runs = votes.withColumn("_run", F.sum(fresh.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("_row", "t_id", "_run").agg(
        *[F.first(c).alias(c) for c in (*keep, "n_words", "t_label", "t_base", "t_n")],
        F.min("d").alias("d"), F.sum("votes").alias("votes"), F.flatten(F.collect_list("qs")).alias("qs"),
    )
    whole = F.col("votes") == F.col("t_n") - K + 1  # a base phrase's run is one diagonal
    covered = F.array_distinct(F.flatten(F.transform("qs", lambda q: F.array(*[q + k for k in range(K)]))))
    share = F.when(F.col("t_base"), whole.cast("double")).otherwise(F.size(covered) / F.col("t_n"))
    spans = spans.withColumn("share", F.when(F.col("t_id") == none, F.lit(0.0)).otherwise(share))
    found = F.col("share") >= F.when(F.col("t_base"), F.lit(1.0)).otherwise(F.lit(MATCH))
    base = found & F.col("t_base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("t_label")))), ",")
    return (
        spans.groupBy("_row")
        .agg(
            *[F.first(c).alias(c) for c in keep],
            F.first("n_words").cast("long").alias("n_words"),
            F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("d"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("d"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(found).alias("labels"),
            F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs)


_TEMPLATES = ", ".join(f"({i}, '{p}', '{x}', {i < len(BASE)})" for i, (p, x) in enumerate([*BASE, *TEMPLATES]))
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents
), t AS (
  SELECT id, label, is_base, string_split(phrase, ' ') AS ts FROM (VALUES {_TEMPLATES}) v(id, phrase, label, is_base)
), tg AS (
  SELECT id, label, is_base, ts, q, array_to_string(ts[q + 1:q + {K}], ' ') AS g FROM t, range(0, 200) r(q) WHERE q <= len(ts) - {K}
), dg AS (
  SELECT doc_id, p, array_to_string(ws[p + 1:p + {K}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {K - 1})) AS p FROM d WHERE len(ws) >= {K})
), hit AS (
  SELECT doc_id, id, label, is_base, ts, p - q AS dg, p, q FROM dg JOIN tg USING (g)
), vote AS (
  SELECT doc_id, id, any_value(label) AS label, any_value(is_base) AS is_base, any_value(ts) AS ts, dg, count(*) AS votes, min(p) AS p0, max(p) + {K} AS p1, list(q) AS qs
  FROM hit GROUP BY doc_id, id, dg
), fresh AS (
  SELECT *, CASE WHEN is_base OR coalesce(dg - lag(dg) OVER w > {GAP} OR abs(p0 - lag(p1) OVER w) > {GAP + K}, true) THEN 1 ELSE 0 END AS fresh
  FROM vote WINDOW w AS (PARTITION BY doc_id, id ORDER BY dg)
), run AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY dg ROWS UNBOUNDED PRECEDING) AS run FROM fresh
), span AS (
  SELECT doc_id, id, run, any_value(label) AS label, any_value(is_base) AS is_base, any_value(ts) AS ts, min(dg) AS dg, sum(votes) AS votes, flatten(list(qs)) AS qs
  FROM run GROUP BY doc_id, id, run
), judged AS (
  SELECT *, CASE WHEN is_base THEN CASE WHEN votes = len(ts) - {K - 1} THEN 1.0 ELSE 0.0 END
    ELSE len(list_distinct(flatten(list_transform(qs, lambda q: [q, q + 1, q + 2]))))::DOUBLE / len(ts) END::DOUBLE AS share
  FROM span
), found AS (
  SELECT *, share >= CASE WHEN is_base THEN 1.0 ELSE {MATCH} END AS ok FROM judged
)
SELECT d.doc_id, CAST(len(any_value(d.ws)) AS BIGINT) AS n_words, count(*) FILTER (ok AND is_base) AS n_base,
  min(f.dg) FILTER (ok AND is_base) AS first_word, max(f.dg) FILTER (ok AND is_base) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (ok AND is_base))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (ok))), ','), '') AS labels,
  coalesce(max(share) FILTER (ok), 0.0)::DOUBLE AS score
FROM d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id
"""
