"""Question parsing and grounding queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import questions as q
from tallyloom.operators import grounding
from tallyloom.plans.texts import FOLD, TERMS, terms
from tallyloom.sources.derived import table
from tallyloom.sources.lineage import written


def question_parse(spark: SparkSession, d: str) -> DataFrame:
    """Questions written from orders in six ways, read back to a monthly cost."""
    o = table(spark, d, "orders")
    v = F.format_number(F.floor("o_totalprice"), 0)
    k = F.col("o_orderkey") % 6
    some = (F.col("o_orderkey") % 90 + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Can we afford $"), v, F.lit(" per month from March 2026?")))
        .when(k == 1, F.concat(F.lit("A designer starting in 2026 at "), v, F.lit(" a year?")))
        .when(k == 2, F.concat(F.lit("Would "), some, F.lit("k monthly fit by May?")))
        .when(k == 3, F.concat(F.lit("Is $500 now or $"), some, F.lit("k later from 2026-0"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" on fine?")))
        .when(k == 4, "Can we hire someone after 2026, or before 2025?").otherwise(F.concat(F.lit("A tool for 2000 until 2027, or "), v, F.lit("?")))
    )
    p = o.select("o_orderkey", q.parsed(text).alias("_p"))
    return p.select("o_orderkey", "_p.cost", "_p.cadence", "_p.start_month", "_p.monthly_cost", "_p.source", F.array_join("_p.warnings", ",").alias("warnings"))


def ground_percentages(spark: SparkSession, d: str) -> DataFrame:
    """The first rate a document states, or one that it may not, held against its whole text."""
    docs = terms(spark, d)
    first = F.regexp_extract("text", r"(\d{1,2}(?:\.\d)?)%", 1)
    claimed = F.when((F.col("doc_id") % 2 == 0) & (first != ""), first.try_cast("double")).otherwise((F.col("doc_id") % 7).cast("double"))
    docs = docs.withColumn("claimed", claimed)
    return docs.select("doc_id", "claimed", q.percentage_stated(F.col("claimed").cast("decimal(9,6)"), F.col("text")).alias("stated"))


def clause_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text held against every document: where it, or its beginning, stands
    word for word on a line."""
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    clauses = bench.select(F.col("item_id").alias("clause_id"), F.col("text").alias("clause_text"))
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    found = written(grounding.exact_pages(clauses, pages), "exact")
    some = pages.join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return grounding.exact_places(found.join(clauses, "clause_id"), some)


def clause_locate(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text held against every document, placed on its lines as pages."""
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    clauses = bench.select(F.col("item_id").alias("clause_id"), F.col("text").alias("clause_text"))
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    found = grounding.locate_all(clauses, pages)

    def of(method: str):
        page = F.when(F.col("method") == method, F.col("page")).cast("long")
        return F.struct(F.lit(method).alias("method"), F.count(page).alias("n"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))

    placed = found.agg(of("exact").alias("_e"), of("fuzzy").alias("_z"))
    # all other pairs fail: locate_all() leaves out none that can be placed
    every = bench.agg(F.count("*").alias("_b")).crossJoin(docs.agg(F.count("*").alias("_d")))
    none = F.lit(None).cast("long")
    failed = F.struct(F.lit("failed").alias("method"), (F.col("_b") * F.col("_d") - F.col("_e.n") - F.col("_z.n")).alias("n"), none.alias("first_page"), none.alias("last_page"))
    return placed.crossJoin(every).select(F.inline(F.array("_e", "_z", failed))).filter("n > 0")


QUERIES = {f.__name__: f for f in (question_parse, ground_percentages, clause_exact, clause_locate)}
_BARE = "regexp_replace(CAST(CAST(claimed AS DECIMAL(9,4)) AS VARCHAR), '\\.?0+$', '')"
_WORD = "CASE " + _BARE + " " + " ".join(f"WHEN '{k}' THEN '|{v.replace('-', '[- ]')}'" for k, v in q.SPELT.items()) + " ELSE '' END"
SQL = {
    "question_parse": """WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 2 THEN (o_orderkey % 90 + 1) * 1000.0 WHEN 3 THEN (o_orderkey % 90 + 1) * 1000.0 WHEN 4 THEN NULL
          WHEN 5 THEN 2000.0 ELSE floor(o_totalprice) END::DOUBLE AS cost,
        CASE o_orderkey % 6 WHEN 1 THEN 'annual' WHEN 4 THEN NULL ELSE 'monthly' END AS cadence,
        CASE o_orderkey % 6 WHEN 0 THEN 'March' WHEN 2 THEN 'May' WHEN 3 THEN '2026-0' || (o_orderkey % 9 + 1) END AS start_month FROM orders)
      SELECT o_orderkey, cost, cadence, start_month, CASE WHEN cadence = 'annual' THEN round(cost / 12, 2) ELSE cost END AS monthly_cost, CASE WHEN k = 4 THEN 'none' ELSE 'pattern' END AS source,
        CASE k WHEN 1 THEN 'divided_by_12' WHEN 3 THEN 'read_as_monthly' WHEN 5 THEN 'read_as_monthly' WHEN 4 THEN 'no_amount' ELSE '' END AS warnings FROM x""",
    "ground_percentages": f"""WITH {TERMS}, c AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t,
        CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, '\\d{{1,2}}(?:\\.\\d)?%') THEN CAST(regexp_extract(text, '(\\d{{1,2}}(?:\\.\\d)?)%', 1) AS DOUBLE) ELSE CAST(doc_id % 7 AS DOUBLE) END AS claimed FROM terms),
      f AS (SELECT *, '(?:' || replace({_BARE}, '.', '\\.') || CASE WHEN contains({_BARE}, '.') THEN '' ELSE '(?:\\.0{{1,2}})?' END || {_WORD} || ')' AS form FROM c)
      SELECT doc_id, claimed, claimed > 0 AND regexp_matches(t, form || '\\s*(?:%|per\\s*cent|percent)|' || form || '\\s*\\(\\s*[\\d.]+\\s*\\)\\s*(?:%|per\\s*cent|percent)|\\(\\s*' || form || '\\s*%?\\s*\\)') AS stated FROM f""",
    "clause_exact": f"""WITH w AS (SELECT item_id AS clause_id, regexp_replace(trim(regexp_replace({FOLD}, '\\s+', ' ', 'g')), '^[\\s.·…"''‘’“”]+|[\\s.·…"''‘’“”]+$', '', 'g') AS w FROM benchmark),
      p AS (SELECT DISTINCT clause_id, o AS ladder, CASE o WHEN 0 THEN w ELSE trim(substr(w, 1, [240, 160, 80][o])) END AS probe FROM w, range(0, 4) r(o)),
      d AS (SELECT clause_id, probe, row_number() OVER (PARTITION BY clause_id ORDER BY ladder) - 1 AS ord FROM (SELECT clause_id, probe, min(ladder) AS ladder FROM p WHERE length(probe) >= 20 GROUP BY 1, 2)),
      l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents WHERE text IS NOT NULL),
      t AS (SELECT doc_id, page, trim(regexp_replace({FOLD}, '\\s+', ' ', 'g')) AS t FROM l),
      h AS (SELECT clause_id, doc_id, page, ord FROM d JOIN t ON contains(t, probe))
      SELECT clause_id, doc_id, CAST(arg_min(page, (ord, page)) AS INTEGER) AS page, CAST(min(ord) AS INTEGER) AS ord FROM h GROUP BY clause_id, doc_id""",
}
