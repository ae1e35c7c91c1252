"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: (metric, comparison, threshold, share of what). ``apply_rules``
turns it into one boolean expression over the metric columns; no user function
runs. Words are runs of anything but ASCII white space.

Defined cases: a null text counts as empty; an empty text has no words and fails;
repeated rows are judged one by one; extra columns stay, and metric columns that
clash with them replace them; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus' languages.
STOP_WORDS = tuple(
    "the of and to a in is that it on for was with as be this by are at an from "
    "de la le et les des en un du que une pour est qui dans par pas au sur avec ou "
    "der die und den von zu das mit sich für auf im ist nicht dem ein als eine "
    "el y se los del las por con no su para es al lo".split()
)
#: metric, numerator column, denominator column, comparison that rejects, threshold
RULES = (
    ("too_few_words", "n_words", None, "<", 20),
    ("repeated_windows", "n_repeat_words", "n_words", ">", 0.30),
    ("word_length_low", "word_chars", "n_words", "<", 1.5),
    ("word_length_high", "word_chars", "n_words", ">", 25.0),
    ("symbols", "n_symbols", "n_words", ">", 1.0),
    ("stop_words", "n_stop_words", "n_plain_words", "<", 0.005),
    ("duplicate_lines", "n_dup_lines", "n_lines", ">", 0.5),
)
WINDOW = 8


def words(text: Column) -> Column:
    """Array of the words of a text, none for null or empty."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the metric columns the rules use; the word arrays do not stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumn("__words", words(t)).withColumn("__lines", lines)
    n = F.size("__words")
    # hashes of one word, then of two, four and eight words side by side
    df = df.withColumn("__grams", F.transform("__words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        shifted = F.slice("__grams", step + 1, F.greatest(n, F.lit(1)))
        df = df.withColumn("__grams", F.zip_with("__grams", shifted, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__grams", F.slice("__grams", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    # only texts that repeat a window pay for the sort: (hash, place) pairs side by side
    order = F.array_sort(F.transform(F.col("__grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = df.withColumn("__order", F.when(repeated, order))
    twice = F.filter(
        F.transform(
            F.col("__order"),
            lambda x, k: F.when(
                (x["h"] == F.get("__order", k - 1)["h"]) | (x["h"] == F.get("__order", k + 1)["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__starts", F.array_sort(twice))
    covered = F.aggregate(
        F.transform(F.col("__starts"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - i, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    stops = [v for w in STOP_WORDS for v in (w, w.capitalize())]
    symbols = F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.aggregate("__words", F.lit(0), lambda a, w: a + F.length(w)).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: w.isin(*stops))).cast("long"),
            "n_plain_words": F.greatest(n - 4 * symbols, F.lit(0)).cast("long"),
        }
    ).drop("__words", "__lines", "__grams", "__order", "__starts")


def failed_rules(rules=RULES) -> Column:
    """The names of the rules a row breaks, compiled from the table."""
    def broken(num: str, den: str | None, op: str, limit: float) -> Column:
        bound = F.lit(limit) if den is None else F.lit(limit) * F.col(den)
        return F.col(num) < bound if op == "<" else F.col(num) > bound

    return F.filter(F.array(*[F.when(broken(*r[1:]), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES, measured: bool = False) -> DataFrame:
    """Documents with metrics, ``base_failed``, ``failed`` rule names and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        (docs if measured else with_metrics(docs, text))
        .withColumn("base_failed", base)
        .withColumn("failed", failed_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the columns of documents stay."""
    # the row number keeps the filter above the metrics: pushed below them, it would
    # evaluate whole arrays once for each of their elements
    rows = with_metrics(docs).withColumn("__row", F.monotonically_increasing_id())
    return apply_rules(rows, measured=True).filter("kept AND __row >= 0").select(*docs.columns)


_STOPS = ", ".join(f"'{v}'" for w in STOP_WORDS for v in (w, w.capitalize()))
_BROKEN = " OR ".join(f"{n} {op} {limit}" + (f" * {d}" if d else "") for _, n, d, op, limit in RULES)
ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    len(regexp_extract_all(coalesce(text, ''), '[{SYMBOLS}]')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), m AS (
  SELECT doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(list_filter(w, lambda x: list_contains([{_STOPS}], x))) AS n_stop_words, greatest(len(w) - 4 * n_symbols, 0) AS n_plain_words
  FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + {WINDOW - 1}]) AS c
  FROM m, unnest(range(1, n_words - {WINDOW - 2})) AS x(i)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, {WINDOW}) AS y(k) WHERE c > 1 GROUP BY doc_id
), a AS (
  SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  n_repeat_words, base_failed, NOT base_failed AND NOT ({_BROKEN}) AS kept
FROM b
"""
