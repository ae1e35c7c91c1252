"""Text, corpus and scoring queries, and their SQL."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import corpus, fill, near
from tallyloom.plans.leaks import BASE
from tallyloom.sources import derived as src
from tallyloom.sources.derived import table


#: what is planted before and after a document, and the clauses that are looked for
WITHHELD = (
    " of $[***] per month rises by [*]% within the first [***] months; [redacted] stays. ",
    " Storage costs $ [***] a unit per annum, hosting $[***] monthly; odd [***] stays.",
)
TARGETS = ("a FEE of $[***] per month rises", "rises by [*]% within the first [***] months")


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a contract clause planted by id."""
    k = F.col("doc_id") % 6
    clause = F.element_at(F.array(*map(F.lit, corpus.CLAUSES)), (k + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", "source", F.concat(clause, F.lit(" "), F.col("text")).alias("text"))


TERMS = "terms AS (SELECT doc_id, source, CASE doc_id % 6 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(corpus.CLAUSES)
) + " END || ' ' || text AS text FROM documents)"


def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clause_fingerprint(F.col("text")).alias("fingerprint"))


def text_blanks(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).select("doc_id", text.count_blanks(F.col("text")).cast("long").alias("blanks"))


def text_relevance(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).select("doc_id", text.relevance(F.col("text")).cast("long").alias("score"))


def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct numbers that a whole text states, their count and exact sum."""
    n = F.array_distinct(F.array_compact(text.amounts_in(F.col("text"), "decimal(38,6)")))
    total = F.aggregate(n, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)")).cast("double")
    return terms(spark, d).select("doc_id", F.size(n).cast("long").alias("n"), total.alias("total"))


def text_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_typography(F.col("text")).cast("binary")).alias("folded"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n"))


def text_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts that stand word for word in a document."""
    return corpus.verbatim_hits(table(spark, d, "benchmark"), table(spark, d, "documents"))


def text_near(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts that stand in a document nearly word for word: all against all."""
    return near.near_verbatim(table(spark, d, "benchmark"), table(spark, d, "documents"))


def text_near_altered(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with every thirtieth letter another one, against all documents: each
    document that holds the text itself, and whether it was found."""
    quotes = table(spark, d, "benchmark").select("item_id", F.regexp_replace(text.flatten(F.col("text")), "(.{29}).", "$1~").alias("text"))
    found = near.near_verbatim(quotes, table(spark, d, "documents")).select("item_id", "doc_id", F.lit(True).alias("found"))
    return text_verbatim(spark, d).join(found, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.coalesce("found", F.lit(False)).alias("found"))


def corpus_tiers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tiers(terms(spark, d)).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("redacted")).alias("redacted"))


def corpus_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Ready, filled, review or skipped by tier and blanks."""
    t = corpus.tiers(terms(spark, d)).withColumn("blanks", text.count_blanks(F.col("text")))
    bucket = (
        F.when(F.col("tier") == "gold", "ready").when(F.col("tier") == "reject", "skipped").when(F.col("blanks") == 0, "review")
        .when(F.col("blanks") <= 4, "filled").otherwise("skipped")
    )
    return t.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def corpus_question_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents fit for a question: they state one fee and are no rate card."""
    return corpus.usable_questions(terms(spark, d)).select("doc_id", "amounts")


def corpus_percentages(spark: SparkSession, d: str) -> DataFrame:
    """Gold and template shares of the corpus."""
    t = corpus.tiers(terms(spark, d))
    n = F.count("*")
    pct = lambda x: F.round(100.0 * F.count_if(F.col("tier") == x) / n, 1)
    return t.agg(n.alias("n"), pct("gold").alias("gold_pct"), pct("template").alias("template_pct"))


def clause_snippets(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the first fee or rise that a document states."""
    t = terms(spark, d).withColumn("_flat", text.flatten(F.col("text")))
    fee, rise = corpus.snippet(F.col("_flat"), corpus.CONCRETE_FEE), corpus.snippet(F.col("_flat"), corpus.CONCRETE_RISE)
    return t.select("doc_id", F.md5(fee.cast("binary")).alias("fee"), F.length(rise).cast("long").alias("rise_chars"))


def fees_stated(spark: SparkSession, d: str) -> DataFrame:
    """Recurring fees that documents state, allowances and penalties aside."""
    t = terms(spark, d)
    more = F.when(F.col("doc_id") % 3 == 0, " An allowance of $900 per month. A retainer follows: quarterly fee of $7,500.00 due.").otherwise("")
    fees = corpus.candidate_fees(F.concat("text", more))
    return t.select("doc_id", F.array_join(F.transform(fees, lambda x: x.cast("decimal(18,2)").cast("string")), ",").alias("fees"))


def clause_fill(spark: SparkSession, d: str) -> DataFrame:
    """Documents with withheld figures put in where their kind is plain."""
    more = F.concat(F.lit(" A fee of $[***] per month rises by [*]% within [***] months; [redacted] stays. "), F.col("text"))
    t = terms(spark, d).select("doc_id", corpus.filled(more, F.col("doc_id")).alias("x"))
    return t.select("doc_id", "x.n_filled", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


def _withheld(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents between planted clauses with withheld figures, and their two target clauses
    (the first one is not in documents with an odd id)."""
    lead = F.when(F.col("doc_id") % 2 == 0, F.lit("A fee")).otherwise(F.lit("One charge"))
    text = F.concat(lead, F.lit(WITHHELD[0]), F.coalesce("text", F.lit("")), F.lit(WITHHELD[1]))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    targets = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("clause")) for k, c in enumerate(TARGETS)])
    return docs, docs.select("doc_id", F.explode(targets).alias("c")).select("doc_id", "c.*")


def fill_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of figures put in: place, length, kind, value and pass of each."""
    return fill.fill_script(*_withheld(spark, d))


def fill_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Texts after the log is applied."""
    docs, clauses = _withheld(spark, d)
    done = fill.replayed(docs, fill.fill_script(docs, clauses))
    return done.select("doc_id", "n_filled", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a stretch of 60 letters of a benchmark text."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), "text")
    return corpus.containing(quotes, table(spark, d, "documents").select("doc_id", "text"))


def seal_check(spark: SparkSession, d: str) -> DataFrame:
    """Sealed documents against those there now: sealed ones missing or changed, others unsealed."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    sealed = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    sealed = sealed.withColumn("h", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.col("h")))
    now = docs.filter("doc_id % 5 <> 0").withColumnRenamed("h", "now")
    both = sealed.join(now, "doc_id", "full_outer")
    state = F.when(F.col("h").isNull(), "unsealed").when(F.col("now").isNull(), "missing").when(F.col("h") != F.col("now"), "changed").otherwise("whole")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def sealed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Filers and clause wordings of the sealed documents."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.agg(F.count("*").alias("n"), F.count_distinct("source").alias("filers"), F.count_distinct(text.clause_fingerprint(F.col("text"))).alias("clauses"))


def corpus_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """One document of a filer and of a clause, those with figures first."""
    t = corpus.tiers(terms(spark, d)).filter("tier <> 'reject'")
    order = F.when(F.col("tier") == "gold", 0).otherwise(1).cast("long") * (1 << 40) + F.col("doc_id")
    filer = F.concat_ws("_", "source", (F.col("doc_id") % 40).cast("string"))
    name = F.concat(filer, F.lit("_EX-10.1_"), F.col("doc_id").cast("string"))
    clause = text.clause_fingerprint(F.substring("text", 60, 90))
    return corpus.keep_first_of_each(t.select("doc_id", order.alias("ord"), text.filer_of(name).alias("filer"), clause.alias("clause"))).select("doc_id", "filer")


def seeded_pick(spark: SparkSession, d: str) -> DataFrame:
    """A draw of ten documents: the first of each filer, filers in seeded order, each clause
    wording once."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("_", "source", (F.col("doc_id") % 9).cast("string")).alias("filer"), text.clause_fingerprint(F.col("text")).alias("fp"))
    one = docs.groupBy("filer").agg(F.min(F.struct("doc_id", "fp")).alias("_d")).select("filer", "_d.doc_id", "_d.fp", F.md5(F.concat("filer", F.lit("|draw-1")).cast("binary")).alias("h"))
    once = one.groupBy("fp").agg(F.min(F.struct("h", "filer", "doc_id")).alias("_d")).select("_d.*")
    return once.orderBy("h", "filer").limit(10).select("filer", "doc_id")


def rewrite_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a rewrite kept all figures: thousands set apart keep them, a new figure does not."""
    t = terms(spark, d)
    new = F.concat(F.regexp_replace("text", r"\$(\d+),(\d{3})\b", r"\$$1$2"), F.when(F.col("doc_id") % 3 == 0, " by 77").otherwise(" as agreed"))
    return t.select("doc_id", (text.figures(F.col("text")) == text.figures(new)).alias("same"))


def extractions_merged(spark: SparkSession, d: str) -> DataFrame:
    """Extractions of three chunks of each contract folded into one."""
    c = src.contracts(spark, d).withColumn("chunk", F.explode(F.array(*map(F.lit, range(3)))))
    k, n = F.col("client_id"), F.col("chunk")
    off = lambda p, m: F.struct(F.lit(p).alias("percentage"), F.lit(m).alias("duration_months"))
    rows = c.select(
        k.alias("doc_id"), "chunk", F.when((k + n) % 3 == 0, "null").when((k + n) % 3 == 1, F.upper("client_name")).otherwise(F.col("client_name")).alias("client_name"),
        F.when((k + n) % 2 == 0, F.col("base_amount") + n).cast("double").alias("base_amount"), F.when(n == 2, "EUR").alias("currency"),
        F.when(n == k % 3, F.col("frequency")).otherwise("unknown").alias("frequency"), F.when(n > k % 2, F.col("esc_pct") + n).cast("double").alias("esc_pct"),
        F.when(n == 0, F.array(off(10.0, 3))).when(n == 1, F.array(off(5.0, 2), off(10.0, 3))).alias("discounts"),
    )
    m = corpus.merge_extractions(rows)
    listed = F.array_join(F.transform("discounts", lambda x: F.concat_ws("x", x["percentage"].cast("int").cast("string"), x["duration_months"].cast("string"))), ",")
    return m.select("doc_id", "client_name", "base_amount", "currency", "frequency", "esc_pct", listed.alias("discounts"))


def sealed_membership(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content hash is among those of the labelled documents."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    sealed = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("h").distinct()
    return docs.join(sealed, "h", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def first_clause_per_filer(spark: SparkSession, d: str) -> DataFrame:
    """First document of each source, then first of each clause fingerprint."""
    docs = table(spark, d, "documents").select("doc_id", "source", text.clause_fingerprint(F.col("text")).alias("fp"))
    one = docs.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("_r = 1")
    return one.withColumn("_c", F.row_number().over(Window.partitionBy("fp").orderBy("doc_id"))).filter("_c = 1").select("source", "doc_id")


def exam_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """A rule's verdict on quality against the labels: counts and per cent right."""
    m = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    said = (F.length(F.translate("text", "#*$%&|<>", "")) == F.length("text")).cast("int")
    right = (said == F.col("quality"))
    return m.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(right).alias("right"), F.round(100.0 * F.count_if(right) / F.count("*"), 1).alias("percent"),
        F.round(100.0 * F.greatest(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)) / F.count("*"), 1).alias("majority"),
    )


def exam_split(spark: SparkSession, d: str) -> DataFrame:
    """Seeded split of the whole set: the first 15% by hash (one at least) validate. Cells of
    the hash are counted; rows are ranked inside the one cell that the edge falls into."""
    m = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    m = m.withColumn("_h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|split-1")).cast("binary")))
    m = m.withColumn("_cell", F.substring("_h", 1, 3))
    cells = m.groupBy("_cell").agg(F.count("*").alias("_n"))  # at most 4096
    line = Window.orderBy("_cell")
    cells = cells.withColumns({"_upto": F.sum("_n").over(line), "_all": F.sum("_n").over(Window.partitionBy())})
    most = F.greatest(F.lit(1), F.floor(F.lit(0.15) * F.col("_all")))
    cells = cells.select("_cell", (most - F.col("_upto") + F.col("_n")).alias("_room"), "_n")
    m = m.join(F.broadcast(cells), "_cell")
    edge = m.filter("_room > 0 AND _room < _n").withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id")))
    part = F.when(F.col("_r") <= F.col("_room"), "val").otherwise("train")
    sure = m.filter("_room <= 0 OR _room >= _n").withColumn("part", F.when(F.col("_room") > 0, "val").otherwise("train"))
    return edge.withColumn("part", part).select("doc_id", "lang", "part").unionByName(sure.select("doc_id", "lang", "part"))


def turn_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal of each turn within its role, as evidence is numbered."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("ordinal"), text.safe_name(F.concat_ws("_", "role", F.col("turn").cast("string"))).alias("name"))


def chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph chunks with relevance: a document's first and its five best others."""
    return corpus.select_chunks(terms(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        text_fingerprint, text_blanks, text_relevance, text_numbers, text_fold, html_text, text_verbatim, corpus_tiers, corpus_buckets,
        corpus_question_filter, corpus_percentages, clause_snippets, fees_stated, clause_fill, fill_log, fill_replayed, leak_check, seal_check, sealed_counts, corpus_deduplicated, seeded_pick,
        rewrite_check, text_near, text_near_altered, extractions_merged, sealed_membership, first_clause_per_filer, exam_scorecard, exam_split, turn_ordinals, chunk_scores,
    )
}
_FP = "substr(md5(substr(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 150)), 1, 8)"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
FOLD = "regexp_replace(text, '-\\s*\\n\\s*', '', 'g')"
for _a, _b in text.TYPOGRAPHY:
    FOLD = "replace({}, '{}', '{}')".format(FOLD, _a, _b.replace("'", "''"))
_NAMED = "MAP {" + ", ".join(f"'&{k};': chr({c})" for k, c in name2codepoint.items()) + "}"
_UNREAD = "|".join(rf"<{t}\b.*?</{t}>" for t in text.UNREAD_TAGS)
_HTML = f"""array_to_string(list_transform(regexp_extract_all(html, '(?is){_UNREAD}|<[^>]+>|[^<]+|<'), lambda t: CASE WHEN NOT regexp_matches(t, '(?s)^<.+>$') THEN t
  WHEN regexp_matches(t, '(?i)^(?:</(?:{text.LINE_TAGS})>|<br\\s*/?>)$') THEN chr(10) ELSE ' ' END), '')"""
_HTML = f"array_to_string(list_transform(regexp_extract_all({_HTML}, '&#?[0-9a-zA-Z]+;|[^&]+|&'), lambda t: coalesce(list_extract(map_extract(named, t), 1), t)), '')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '[ \\t\\x{{00a0}}]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '^\\s+|\\s+$', '', 'g')"
_FLAT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_PICK = lambda values, i: f"{list(values)}[1 + CAST('0x' || substr(md5(doc_id || '|' || ({i} - 1)), 1, 6) AS BIGINT) % {len(values)}]"
_SNIP = lambda ps: "coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(f, '{p}') THEN trim(substr(f, greatest(instr(f, regexp_extract(f, '{p}')) - 110, 1), instr(f, regexp_extract(f, '{p}')) - greatest(instr(f, regexp_extract(f, '{p}')) - 110, 1) + length(regexp_extract(f, '{p}')) + 110)) END"
    for p in ps
) + ")"
_any = lambda ps: "(" + " OR ".join(f"regexp_matches(f, '{p}')" for p in ps) + ")"
_TIERS = TERMS + f""", flat AS (SELECT *, {_FLAT} AS f FROM terms), tiered AS (SELECT *, regexp_matches(f, '{corpus.REDACTION}') AS redacted,
  CASE WHEN {_any(corpus.CONCRETE_RISE)} AND {_any(corpus.CONCRETE_FEE)} THEN 'gold'
       WHEN ({_any(corpus.SHAPE_RISE)} OR {_any(corpus.CONCRETE_RISE)}) AND ({_any(corpus.SHAPE_FEE)} OR {_any(corpus.CONCRETE_FEE)}) THEN 'template'
       ELSE 'reject' END AS tier FROM flat)"""
_NUMBER = "\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?"
_FIGURES = lambda t: f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(replace(n, ',', ''), '\\.?0+$', '') ELSE replace(n, ',', '') END)))"
_FILL = f"""WITH x AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN 'A fee' ELSE 'One charge' END || '{WITHHELD[0]}' || coalesce(text, '') || '{WITHHELD[1]}', '\\s+', ' ', 'g') AS t FROM documents),
      p AS (SELECT doc_id, t, string_split_regex(t, '{text.BLANK}') AS g, regexp_extract_all(t, '{text.BLANK}') AS m FROM x),
      b AS (SELECT doc_id, t, k - 1 AS i, m[k] AS marker, CAST(list_sum(list_transform(g[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) AS BIGINT) AS a
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p)),
      c AS (SELECT * FROM (VALUES (0, '{TARGETS[0]}'), (1, '{TARGETS[1]}')) v(place, clause)),
      w AS (SELECT doc_id, place, instr(lower(t), lower(clause)) - 1 AS lo, instr(lower(t), lower(clause)) - 1 + length(clause) + {fill.BEYOND} AS hi FROM x, c WHERE contains(lower(t), lower(clause))),
      s AS (SELECT b.*, place, substr(t, greatest(lo, a - {fill.TAIL}) + 1, a - greatest(lo, a - {fill.TAIL})) AS before,
          substr(t, a + length(marker) + 1, least(hi - a - length(marker), {fill.SHOWN})) AS after
        FROM b JOIN w USING (doc_id) WHERE a >= lo AND a + length(marker) <= hi),
      k AS (SELECT *, CASE WHEN regexp_matches(lower(before), '\\$\\s*$') THEN 'money'
          WHEN regexp_matches(lower(left(after, {fill.HEAD})), '{fill.KINDS[1][2]}') THEN 'percent'
          WHEN regexp_matches(lower(before), '{fill.KINDS[2][1]}') AND regexp_matches(lower(left(after, {fill.HEAD})), '{fill.KINDS[2][2]}') THEN 'count' END AS kind FROM s),
      f AS (SELECT doc_id, i, a, length(marker) AS n, marker, kind, regexp_matches(lower(before || left(after, {fill.HEAD})), '{fill.YEARLY}') AS yearly, 'clause' AS pass,
          trim(right(before, {fill.SHOWN}) || marker || after) AS context
        FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY place) = 1),
      r AS (SELECT doc_id, i, a, marker, regexp_extract(left(t, a), '\\$\\s*$') AS lead, substr(t, a + length(marker) + 1, {fill.SHOWN}) AS after FROM b
        WHERE doc_id IN (SELECT doc_id FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id AND f.i = b.i)),
      e AS (SELECT * FROM f UNION ALL SELECT doc_id, i, a - length(lead) + 1, length(marker) + length(lead) - 1, marker, 'money', regexp_matches(lower(regexp_extract(after, '{fill.PERIOD}', 1)), '{fill.YEARLY_PERIOD}'),
          'periodic', lead || marker || regexp_extract(after, '{fill.PERIOD}') FROM r WHERE lead <> '' AND regexp_matches(after, '{fill.PERIOD}')),
      v AS (SELECT *, CASE WHEN kind = 'money' AND yearly THEN {_PICK(corpus.YEARLY_FEES, '(i + 1)')} WHEN kind = 'money' THEN {_PICK(corpus.MONTHLY_FEES, '(i + 1)')}
          WHEN kind = 'percent' THEN CAST({_PICK(corpus.RATES, '(i + 1)')} AS DOUBLE) ELSE {_PICK(corpus.COUNTS, '(i + 1)')} END::DOUBLE AS value FROM e),
      edits AS (SELECT *, CASE WHEN kind = 'money' THEN format('{{:,}}', CAST(value AS BIGINT)) WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS rendered FROM v)"""

SQL = {
    "fill_log": _FILL + """ SELECT doc_id, CAST(a AS INTEGER) AS "at", CAST(n AS INTEGER) AS n, marker, kind, value, rendered, pass, context FROM edits""",
    "fill_replayed": _FILL + """, z AS (SELECT *, coalesce(lag(a + n) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM edits),
      y AS (SELECT doc_id, count(*) AS n_filled, string_agg(substr(t, since + 1, a - since) || rendered, '' ORDER BY a) AS head, max(a + n) AS last FROM z JOIN x USING (doc_id) GROUP BY doc_id)
      SELECT doc_id, CAST(coalesce(n_filled, 0) AS BIGINT) AS n_filled, md5(coalesce(head, '') || substr(t, coalesce(last, 0) + 1)) AS text_md5 FROM x LEFT JOIN y USING (doc_id)""",
    "text_fingerprint": f"SELECT doc_id, {_FP.format('text')} AS fingerprint FROM documents",
    "text_blanks": f"WITH {TERMS} SELECT doc_id, CAST({_COUNT.format('text', text.BLANK)} AS BIGINT) AS blanks FROM terms",
    "text_relevance": f"WITH {TERMS} SELECT doc_id, CAST({' + '.join(_COUNT.format('text', '(?i)' + p) + f' * {w}' for p, w in text.RELEVANCE)} AS BIGINT) AS score FROM terms",
    "text_numbers": f"""WITH {TERMS}, n AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_NUMBER}'),
      lambda x: round(TRY_CAST(replace(x, ',', '') AS DECIMAL(38,6)), 2)), lambda x: x IS NOT NULL)) AS v FROM terms),
      u AS (SELECT doc_id, unnest(v) AS x FROM n), s AS (SELECT doc_id, CAST(sum(x) AS DOUBLE) AS total FROM u GROUP BY doc_id)
      SELECT doc_id, CAST(len(v) AS BIGINT) AS n, coalesce(total, 0) AS total FROM n LEFT JOIN s USING (doc_id)""",
    "text_fold": f"SELECT doc_id, md5(trim(regexp_replace({FOLD}, '\\s+', ' ', 'g'))) AS folded FROM documents",
    "html_text": f"WITH x AS (SELECT page_id, {_HTML} AS t FROM pages, (SELECT {_NAMED} AS named)) SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n FROM x",
    "text_near_altered": """SELECT *, true AS found FROM (WITH q AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark),
      t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
      SELECT item_id, doc_id FROM q JOIN t ON contains(t, q) WHERE length(q) >= 20)""",
    "text_verbatim": """WITH q AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark),
      t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
      SELECT item_id, doc_id FROM q JOIN t ON contains(t, q) WHERE length(q) >= 20""",
    "corpus_tiers": f"WITH {_TIERS} SELECT tier, count(*) AS n, count(*) FILTER (redacted) AS redacted FROM tiered GROUP BY tier",
    "corpus_deduplicated": f"""WITH {_TIERS}, d AS (SELECT doc_id, (tier <> 'gold')::INT AS o, source || '_' || doc_id % 40 AS f, {_FP.format('substring(text, 60, 90)')} AS c  FROM tiered WHERE tier <> 'reject'),
      l AS (SELECT list({{'k': doc_id, 'f': f, 'c': c}} ORDER BY o, doc_id) AS l FROM d),
      r AS (SELECT list_reduce(l, lambda s, d: CASE WHEN list_contains(s.f, d.f) OR list_contains(s.c, d.c) THEN s ELSE {{'k': list_append(s.k, d.k), 'f': list_append(s.f, d.f), 'c': list_append(s.c, d.c)}} END,
        {{'k': []::BIGINT[], 'f': []::VARCHAR[], 'c': []::VARCHAR[]}}) AS r FROM l)
      SELECT unnest(r.k) AS doc_id, unnest(r.f) AS filer FROM r""",
    "corpus_buckets": f"""WITH {_TIERS}, b AS (SELECT *, {_COUNT.format('text', text.BLANK)} AS blanks FROM tiered)
      SELECT CASE WHEN tier = 'gold' THEN 'ready' WHEN tier = 'reject' THEN 'skipped' WHEN blanks = 0 THEN 'review' WHEN blanks <= 4 THEN 'filled' ELSE 'skipped' END AS bucket,
      count(*) AS n FROM b GROUP BY 1""",
    "corpus_question_filter": f"""WITH {TERMS}, a AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM terms),
      n AS (SELECT *, len(list_distinct(regexp_extract_all(t, '{corpus.DOLLARS}'))) AS amounts FROM a)
      SELECT doc_id, CAST(amounts AS BIGINT) AS amounts FROM n WHERE regexp_matches(t, '{corpus.ONE_FEE}') AND len(regexp_extract_all(t, '{corpus.FUND_WORDS}')) <= 2 AND amounts <= 20""",
    "corpus_percentages": f"""WITH {_TIERS} SELECT count(*) AS n, round(100.0 * count(*) FILTER (tier = 'gold') / count(*), 1)::DOUBLE AS gold_pct,
      round(100.0 * count(*) FILTER (tier = 'template') / count(*), 1)::DOUBLE AS template_pct FROM tiered""",
    "clause_snippets": f"WITH {TERMS}, flat AS (SELECT doc_id, {_FLAT} AS f FROM terms) SELECT doc_id, md5({_SNIP(corpus.CONCRETE_FEE)}) AS fee, CAST(length({_SNIP(corpus.CONCRETE_RISE)}) AS BIGINT) AS rise_chars FROM flat",
    "fees_stated": f"""WITH {TERMS}, x AS (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN ' An allowance of $900 per month. A retainer follows: quarterly fee of $7,500.00 due.' ELSE '' END, '\\s+', ' ', 'g') AS t FROM terms),
      m AS (SELECT doc_id, string_split_regex(t, '{corpus.FEE_WORDS}') AS g, regexp_extract_all(t, '{corpus.FEE_WORDS}') AS m FROM x),
      w AS (SELECT doc_id, list_filter(range(1, len(m) + 1), lambda i: NOT regexp_matches(right(coalesce(CASE WHEN i > 1 THEN m[i - 1] END, '') || g[i], 150) || m[i] || left(g[i + 1] || coalesce(m[i + 1], ''), 150), '(?i){corpus.NO_FEE}')) AS ok, m FROM m)
      SELECT doc_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(ok, lambda i: CAST(replace(regexp_extract(m[i], '\\$\\s?([\\d,]+(?:\\.\\d{{2}})?)', 1), ',', '') AS DOUBLE)))), lambda v: CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR)), ','), '') AS fees FROM w""",
    "clause_fill": f"""WITH {TERMS}, x AS (SELECT doc_id, ' A fee of $[***] per month rises by [*]% within [***] months; [redacted] stays. ' || text AS t FROM terms),
      p AS (SELECT doc_id, string_split_regex(t, '{text.BLANK}') AS g, regexp_extract_all(t, '{text.BLANK}') AS m FROM x),
      v AS (SELECT doc_id, g, m, list_transform(range(1, len(m) + 1), lambda i: CASE
          WHEN regexp_matches(g[i], '\\$\\s*$') THEN format('{{:,}}', CASE WHEN regexp_matches(lower(right(g[i], 70)) || lower(left(g[i + 1], 40)), 'per annum|annually|per year|annual fee')
            THEN {_PICK(corpus.YEARLY_FEES, 'i')} ELSE {_PICK(corpus.MONTHLY_FEES, 'i')} END)
          WHEN regexp_matches(lower(left(g[i + 1], 40)), '^\\s*(?:%|percent\\b)') THEN {_PICK(corpus.RATES, 'i')}
          WHEN regexp_matches(lower(left(g[i + 1], 40)), '^\\s*(?:month|day|year)s?\\b') AND regexp_matches(lower(right(g[i], 70)), '(?:first|initial|any|each|every|within|period of|for)\\s*(?:the\\s*)?$')
            THEN CAST({_PICK(corpus.COUNTS, 'i')} AS VARCHAR) END) AS v FROM p)
      SELECT doc_id, CAST(len(list_filter(v, lambda x: x IS NOT NULL)) AS BIGINT) AS n_filled,
        md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(v[i], m[i], '')), '')) AS text_md5 FROM v""",
    "leak_check": """WITH p AS (SELECT item_id AS name, substr(text, CAST(i AS INTEGER) + 1, 60) AS probe FROM benchmark, range(0, 20000, 2000) r(i) WHERE i < greatest(length(text), 1))
      SELECT DISTINCT name, doc_id FROM p JOIN documents ON contains(text, probe) WHERE length(probe) = 60 AND trim(probe) <> ''""",
    "seal_check": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE sha256(text) END AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
      n AS (SELECT doc_id, sha256(text) AS now FROM documents WHERE doc_id % 5 <> 0)
      SELECT CASE WHEN h IS NULL THEN 'unsealed' WHEN now IS NULL THEN 'missing' WHEN h <> now THEN 'changed' ELSE 'whole' END AS state, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids
      FROM s FULL JOIN n USING (doc_id) GROUP BY 1""",
    "sealed_counts": f"SELECT count(*) AS n, count(DISTINCT source) AS filers, count(DISTINCT {_FP.format('text')}) AS clauses FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "seeded_pick": f"""WITH d AS (SELECT doc_id, source || '_' || (doc_id % 9) AS filer, {_FP.format('text')} AS fp FROM documents),
      o AS (SELECT *, row_number() OVER (PARTITION BY filer ORDER BY doc_id) AS r FROM d), c AS (SELECT filer, doc_id, fp, md5(filer || '|draw-1') AS h FROM o WHERE r = 1),
      u AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY h, filer) AS k FROM c) SELECT filer, doc_id FROM u WHERE k = 1 ORDER BY h, filer LIMIT 10""",
    "rewrite_check": f"""WITH {TERMS}, x AS (SELECT doc_id, text, regexp_replace(text, '\\$(\\d+),(\\d{{3}})\\b', '$\\1\\2', 'g') || CASE WHEN doc_id % 3 = 0 THEN ' by 77' ELSE ' as agreed' END AS new FROM terms)
      SELECT doc_id, {_FIGURES('text')} = {_FIGURES('new')} AS same FROM x""",
    "extractions_merged": BASE + """, r AS (SELECT client_id AS k, n, CASE (client_id + n) % 3 WHEN 0 THEN NULL WHEN 1 THEN upper(client_name) ELSE client_name END AS name,
        CASE WHEN (client_id + n) % 2 = 0 THEN CAST(base_amount + n AS DOUBLE) END AS base, CASE WHEN n = client_id % 3 AND frequency <> 'unknown' THEN frequency END AS freq,
        CASE WHEN n > client_id % 2 THEN CAST(esc_pct + n AS DOUBLE) END AS esc FROM contracts, range(0, 3) t(n)),
      c AS (SELECT k, name, count(*) AS c, min(n) AS f FROM r WHERE name IS NOT NULL GROUP BY k, name), b AS (SELECT k, arg_min(name, (-c, f)) AS name FROM c GROUP BY k)
      SELECT r.k AS doc_id, any_value(b.name) AS client_name, arg_min(base, n) FILTER (base IS NOT NULL) AS base_amount, 'EUR' AS currency, coalesce(arg_min(freq, n) FILTER (freq IS NOT NULL), 'unknown') AS frequency,
        arg_min(esc, n) FILTER (esc IS NOT NULL) AS esc_pct, '10x3,5x2' AS discounts FROM r LEFT JOIN b ON b.k = r.k GROUP BY r.k""",
    "chunk_scores": f"""WITH RECURSIVE {TERMS}, p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '')) AS t FROM terms),
      q AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id) AS i FROM p),
      w AS (SELECT doc_id, i, t, CAST(CASE WHEN length(t) > 12000 THEN 0 ELSE length(t) + 2 END AS BIGINT) AS size, CAST(0 AS BIGINT) AS pos,
          CAST(CASE WHEN length(t) > 12000 THEN (length(t) + 11999) // 12000 ELSE 0 END AS BIGINT) AS chunk, length(t) <= 12000 AS held, false AS carry, length(t) AS last FROM q WHERE i = 1
        UNION ALL
        SELECT q.doc_id, q.i, q.t,
          CAST(CASE WHEN length(q.t) > 12000 THEN 0 WHEN held AND size + length(q.t) > 12000 THEN last + length(q.t) + 2 WHEN held THEN size + length(q.t) + 2 ELSE length(q.t) + 2 END AS BIGINT),
          CAST(CASE WHEN length(q.t) > 12000 THEN chunk + held::INT WHEN held AND size + length(q.t) > 12000 THEN chunk + 1 ELSE chunk END AS BIGINT),
          CAST(CASE WHEN length(q.t) > 12000 THEN chunk + held::INT + (length(q.t) + 11999) // 12000 WHEN held AND size + length(q.t) > 12000 THEN chunk + 1 ELSE chunk END AS BIGINT),
          length(q.t) <= 12000, held AND length(q.t) <= 12000 AND size + length(q.t) > 12000, length(q.t) FROM w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i + 1),
      r AS (SELECT doc_id, pos AS chunk, i, t FROM w WHERE length(t) <= 12000
        UNION ALL SELECT w.doc_id, w.pos, q.i, q.t FROM w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i - 1 WHERE carry
        UNION ALL SELECT doc_id, pos + k, i, substr(t, CAST(k * 12000 + 1 AS INTEGER), 12000) FROM w, range(0, 1000) g(k) WHERE length(t) > 12000 AND k * 12000 < length(t)),
      c AS (SELECT doc_id, chunk, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, chunk),
      s AS (SELECT doc_id, chunk, length(text) AS n_chars, {' + '.join(_COUNT.format('text', '(?i)' + p) + f' * {w}' for p, w in text.RELEVANCE)} AS score FROM c),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk > 0, score DESC, chunk) AS k FROM s)
      SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(score AS INTEGER) AS score, CAST(n_chars AS INTEGER) AS n_chars FROM o WHERE k <= 6""",
    "sealed_membership": """WITH s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
      SELECT source, count(*) AS n FROM documents WHERE sha256(text) IN (SELECT h FROM s) GROUP BY source""",
    "first_clause_per_filer": f"""WITH o AS (SELECT source, doc_id, {_FP.format('text')} AS fp, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
      c AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS c FROM o WHERE r = 1) SELECT source, doc_id FROM c WHERE c = 1""",
    "exam_scorecard": """WITH m AS (SELECT d.lang, l.quality, CASE WHEN regexp_matches(d.text, '[#*$%&|<>]') THEN 0 ELSE 1 END AS said FROM labels l JOIN documents d USING (doc_id))
      SELECT lang, count(*) AS n, count(*) FILTER (said = quality) AS "right", round(100.0 * count(*) FILTER (said = quality) / count(*), 1)::DOUBLE AS percent,
        round(100.0 * greatest(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) / count(*), 1)::DOUBLE AS majority FROM m GROUP BY lang""",
    "exam_split": """WITH m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || '|split-1'), doc_id) AS r, count(*) OVER () AS n
      FROM labels JOIN documents USING (doc_id)) SELECT doc_id, lang, CASE WHEN r <= greatest(1, floor(0.15 * n)) THEN 'val' ELSE 'train' END AS part FROM m""",
    "turn_ordinals": """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal, lower(role || '_' || turn) AS name FROM conversations""",
}
