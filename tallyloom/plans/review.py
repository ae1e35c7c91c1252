"""Names, headers, terms of contracts, drafts and their review, and the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.money import shown
from tallyloom.operators import corpus, drafts, marks, names, pairs, reconcile, scan
from tallyloom.plans import runs
from tallyloom.plans.leaks import BASE
from tallyloom.plans.texts import TERMS, terms
from tallyloom.sources import derived as src
from tallyloom.sources import run_tables as tables

SYLLABLES = "bar cen dol fen gar hal jor kel lum mer nor pol ras sed tor vel".split()


def name_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ways in which contracts write their clients' names, grouped by run and called by the longest."""
    s = src.table(spark, d, "supplier").withColumn("h", F.sha2("s_name", 256))
    part = lambda i: F.get(F.array(*map(F.lit, SYLLABLES)), F.conv(F.substring("h", i, 2), 16, 10).cast("int") % 16)
    one, two = F.initcap(F.concat(part(1), part(3), part(5))), F.initcap(F.concat(part(7), part(9), part(11)))
    ways = F.array(F.concat(one, two), F.concat_ws(" ", one, two, F.lit("Inc.")), F.concat_ws(" ", F.substring(one, 1, 8), two, F.lit("Holdings")), F.upper(F.concat_ws(" ", two, one)))
    n = s.select(F.col("s_nationkey").cast("long").alias("run_id"), "s_suppkey", F.posexplode(ways).alias("k", "name"))
    return names.group_clients(n.select("run_id", (F.col("s_suppkey") * 4 + F.col("k")).alias("ord"), "name"))


def column_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Columns proposed for every header layout, those confirmed before in their place."""
    e = src.table(spark, d, "events").select("event_type", (F.col("user_id") % 7).alias("k")).distinct()
    headers = F.array(F.upper("event_type"), F.lit(" Trans. Date"), F.concat(F.lit("Amt "), F.col("k")), F.when(F.col("k") % 2 == 0, "Payee Name").otherwise("Zone"))
    e = e.withColumn("headers", headers).withColumn("signature", text.header_signature(F.col("headers")))
    known = e.filter("k = 3").select("signature", F.create_map(F.lit("description"), F.col("headers")[0]).alias("confirmed"))
    m = F.coalesce("confirmed", names.proposed(F.col("headers")))
    return e.join(known, "signature", "left").select("event_type", "k", *[F.try_element_at(m, F.lit(f)).alias(f) for f in names.FIELD_NAMES])


def contract_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of terms that contracts name; those with two at least."""
    s = scan.survivors(scan.categories(terms(spark, d)), 2)
    return s.select("doc_id", F.array_join("categories", ",").alias("categories"), "core_pair", "plain_filter", "dispute_only")


def contract_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the categories with their surroundings and pages."""
    return scan.hits(terms(spark, d))


def clause_windows(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts around one clause, whichever way it is broken and written."""
    w = drafts.window_around(F.col("text"), F.lit("THE  fee shall\nincrease BY 5% annually."))
    return terms(spark, d).select("doc_id", F.md5(w.cast("binary")).alias("window_md5"))


def contract_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Openings with the stretch around a clause at the end, asked for twice."""
    t = src.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" The fee shall\nincrease by 5% annually.")).alias("text"))
    asked = [F.lit("the fee shall increase by 5% annually."), F.lit("THE FEE shall increase BY 5% annually. And more words that are not there to be found at all")]
    return t.select("doc_id", F.md5(drafts.excerpt(F.col("text"), asked).cast("binary")).alias("excerpt_md5"))


def clause_marks(spark: SparkSession, d: str) -> DataFrame:
    """Planted clauses marked in the escaped text of their documents; the second quote stands nowhere."""
    k = (F.col("doc_id") % 6 + 1).cast("int")
    clause = F.element_at(F.array(*map(F.lit, corpus.CLAUSES)), k)
    m = terms(spark, d).select("doc_id", marks.marked(F.col("text"), F.array(clause, F.lit("no such words stand here"), F.lit(None))).alias("m"))
    return m.select("doc_id", F.size("m.marks").cast("long").alias("n_marks"), F.get("m.marks", 0)["end"].alias("until"), F.md5(F.col("m.html").cast("binary")).alias("html_md5"))


def pairs_checked(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs from contracts, templates dealt evenly; some are spoilt after writing."""
    c = src.contracts(spark, d).select("client_id", "client_name", "base_amount", "frequency", "esc_pct", F.lit(10).alias("off_pct"), F.lit(3).alias("off_months"), (F.col("client_id") + 900_000).alias("ms_amount"))
    p = pairs.written(pairs.dealt(c, "client_id", 7))
    k = F.col("client_id")
    p = p.withColumns({"base_amount": F.when(k % 11 == 0, F.col("base_amount") + 1).otherwise(F.col("base_amount")), "rise_clause": F.when(k % 13 == 0, F.upper("rise_clause")).otherwise(F.col("rise_clause"))})
    out = p.withColumn("problems", F.array_join(pairs.problems(p), "; "))
    return out.groupBy("template", "problems").agg(F.count("*").alias("n"))


def finding_queue(spark: SparkSession, d: str) -> DataFrame:
    """The fifty findings to be looked at next."""
    q = reconcile.review_queue(tables.run_findings(spark, d), 50)
    return q.select("entry_id", "run_id", shown(F.col("gap")).alias("gap"))


def billing_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where to look for the payments of each rhythm: its billings, fifteen days wider."""
    return reconcile.billing_span(src.entries(spark, d), ("frequency",), 15)


def draft_answers(spark: SparkSession, d: str) -> DataFrame:
    """The plain reader's answers as drafts over excerpts with other sums beside the fee."""
    k = F.col("client_id")
    extra = F.when(k % 4 == 0, "A retainer applies, with a quarterly fee of $7,500.00 due. ").when(k % 4 == 1, "Overdue sums bear interest. ").when(k % 4 == 2, "An allowance of $900 per month is paid. ").otherwise("")
    name, quote = F.concat(F.lit("Client "), k), "struct<clause_text:string>"
    a = runs.answers(spark, d).filter("model = 'plain'")
    one = lambda when, x: F.when(when, F.array(F.struct(x.alias("clause_text")).cast(quote)))
    return a.select(
        k.alias("name"), F.concat(F.when(k % 6 != 0, F.concat(F.lit("Between "), name, F.lit(": "))).otherwise(""), extra, F.when(k % 9 == 0, "[***] ").otherwise(""), F.col("document")).alias("excerpt"),
        name.alias("client_name"), "amount", "frequency", F.when(F.col("pct").isNotNull() | (k % 8 == 0), F.struct(F.col("pct").alias("percentage"), F.col("esc_quote").alias("clause_text"))).alias("escalation"),
        one(F.col("disc_quote").isNotNull(), F.when(k % 10 == 0, "A discount of 15% applies for ever.").otherwise(F.col("disc_quote"))).alias("discounts"),
        one(k % 12 == 0, F.lit("Payment on delivery.")).alias("milestones"), F.col("usable").alias("drafted"),
    )


def decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("name")
    a = draft_answers(spark, d).filter("name % 3 <> 2")
    return a.select("name", F.when(k % 5 == 0, "drop").otherwise("keep").alias("decision"), F.when(k % 6 == 1, F.coalesce("amount", F.lit(0.0)) + (k % 4 == 1).cast("double")).alias("corrected_amount"), F.when(k % 4 == 3, 1).otherwise(0).alias("n_fixes"))


def draft_checks(spark: SparkSession, d: str) -> DataFrame:
    c = drafts.checks(draft_answers(spark, d))
    failed = F.filter("checks", lambda x: ~x["passed"])
    return c.select("name", F.size("checks").alias("n_checks"), F.array_join(F.transform(failed, lambda x: x["label"]), "; ").alias("failed"), "verdict")


def draft_corrections(spark: SparkSession, d: str) -> DataFrame:
    c = drafts.corrected(draft_answers(spark, d))
    return c.select("name", "amount", "frequency", F.col("escalation").isNotNull().alias("has_rise"), (F.size("discounts") + F.size("milestones")).alias("n_items"), F.array_join("changes", "; ").alias("changes"), F.array_join("human", "; ").alias("human"))


def exam_progress(spark: SparkSession, d: str) -> DataFrame:
    return drafts.progress(drafts.checks(draft_answers(spark, d)), decisions(spark, d))


def exam_final(spark: SparkSession, d: str) -> DataFrame:
    return drafts.finalised(draft_answers(spark, d), decisions(spark, d)).select("name", "amount", "answer_source", "n_fixes")


def exam_scan(spark: SparkSession, d: str) -> DataFrame:
    """Answer keys read out of replies with prose and fences around them."""
    k = F.col("client_id")
    who = F.when(k % 7 != 0, F.concat(F.lit('"client_name": "C {'), k, F.lit('", '))).otherwise("")
    body = F.concat(F.lit("{"), who, F.lit('"base_amount": '), F.col("base_amount").cast("int"), F.lit(', "billing_frequency": "'), F.col("frequency"), F.lit('"'), F.when(k % 9 == 0, "").otherwise("}"))
    reply = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.when(k % 9 == 0, "").otherwise(" as you asked.")))
    rows = src.contracts(spark, d).select(k.alias("source"), drafts.json_object(reply).alias("output"))
    return drafts.exam(rows)


def order_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the text of a table."""
    n = F.col("l_linenumber").cast("string")
    row = F.when(F.col("l_linenumber") == 3, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(n, F.concat(F.lit(" "), F.col("l_returnflag"))))
    rows = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("x"))
    return rows.select("l_orderkey", drafts.table_text(F.transform("x", lambda x: x["r"])).alias("text"))


QUERIES = {f.__name__: f for f in (
    name_groups, column_proposals, contract_categories, contract_hits, clause_windows, contract_excerpts, clause_marks, pairs_checked, finding_queue, billing_windows, draft_checks, draft_corrections, exam_progress, exam_final, exam_scan, order_tables,
)}


def _escaped(x: str) -> str:
    """SQL of a text with its special characters escaped and its line ends as breaks."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{c if c != chr(39) * 2 else chr(39) * 2}', '{e}')"
    return f"replace({x}, chr(10), '<br>')"


def _ratio(a: str, b: str) -> str:
    """SQL of the ratio of two strings: rows of the table of common subsequences, folded."""
    zero = f"list_transform(range(len({b})), lambda z: 0)"
    match = f"list_transform(range(1, len({a}) + 1), lambda i: list_transform(range(1, len({b}) + 1), lambda j: ({a}[i] = {b}[j])::INT))"
    step = "list_transform(range(1, len(e) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(p[q], CASE WHEN q > 1 THEN p[q - 1] ELSE 0 END + e[q]))))"
    fold = f"list_reduce(list_prepend({zero}, {match}), lambda p, e: {step})"
    return f"round_even(200.0 * coalesce(list_max({fold}), 0) / (len({a}) + len({b})), 0)"


_WORDS = "array_to_string(list_sort(regexp_extract_all(lower({}), '[a-z0-9]+')), ' ')"
_FLAT = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"


def _said(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(flat, '" + "|".join(patterns) + "')"


_PART = lambda i: f"(['{"','".join(SYLLABLES)}'])[('0x' || substring(h, {i}, 2))::INT % 16 + 1]"
_CAP = lambda x: f"(upper({x}[1]) || {x}[2:])"
_DRAFTS = runs._ANSWERS + f""", dr AS (
  SELECT client_id AS name, CASE WHEN client_id % 6 <> 0 THEN 'Between Client ' || client_id || ': ' ELSE '' END || CASE client_id % 4 WHEN 0 THEN 'A retainer applies, with a quarterly fee of $7,500.00 due. '
      WHEN 1 THEN 'Overdue sums bear interest. ' WHEN 2 THEN 'An allowance of $900 per month is paid. ' ELSE '' END || CASE WHEN client_id % 9 = 0 THEN '[***] ' ELSE '' END || document AS excerpt,
    amount, frequency, pct, esc_quote AS q, pct IS NOT NULL OR client_id % 8 = 0 AS has_esc, q_disc IS NOT NULL AS has_disc, client_id % 10 = 0 AS bad_disc, client_id % 12 = 0 AS has_ms, usable
  FROM a WHERE model = 'plain'
), fl AS (
  SELECT *, regexp_replace(excerpt, '\\s+', ' ', 'g') AS flat, len(list_filter(regexp_extract_all(excerpt, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: abs(CAST(replace(x, ',', '') AS DOUBLE) - amount) < 0.01)) > 0 AS ok,
    coalesce(contains(lower(regexp_replace(excerpt, '\\s+', ' ', 'g')), lower(q)), false) AS quoted, contains(excerpt, 'Client ' || name) AS named FROM dr
), fee AS (
  SELECT name, amount, arg_min(frequency, o) AS frequency FROM (
    SELECT name, CAST(replace(m, ',', '') AS DOUBLE) AS amount, CASE lower(p) WHEN 'month' THEN 'monthly' WHEN 'quarter' THEN 'quarterly' WHEN 'year' THEN 'annual' WHEN 'annum' THEN 'annual' ELSE lower(p) END AS frequency, o FROM (
      SELECT name, unnest(regexp_extract_all(flat, '{drafts.FEE_THEN_PERIOD}', 1)) AS m, unnest(regexp_extract_all(flat, '{drafts.FEE_THEN_PERIOD}', 2)) AS p, 1 AS o FROM fl WHERE NOT regexp_matches(flat, '(?i){corpus.NO_FEE}')
      UNION ALL SELECT name, unnest(regexp_extract_all(flat, '{drafts.PERIOD_THEN_FEE}', 2)), unnest(regexp_extract_all(flat, '{drafts.PERIOD_THEN_FEE}', 1)), 2 FROM fl WHERE NOT regexp_matches(flat, '(?i){corpus.NO_FEE}')))
  WHERE amount >= 100 GROUP BY name, amount
), fees AS (
  SELECT name, count(*) AS n, any_value(amount) AS fee, any_value(frequency) AS rhythm FROM fee GROUP BY name
), fx AS (
  SELECT fl.*, coalesce(n, 0) AS n, fee, rhythm, NOT coalesce(ok, false) AND coalesce(n, 0) = 1 AS mend, has_esc AND pct IS NULL AS lost, has_esc AND pct IS NOT NULL AND NOT quoted AS unquoted,
    contains(regexp_replace(q, '[^\\d.]', ' ', 'g'), CAST(CAST(pct AS INTEGER) AS VARCHAR)) AS fig FROM fl LEFT JOIN fees USING (name)
), ck AS (
  SELECT *, [CASE WHEN NOT coalesce(ok, false) THEN '! the fee amount appears in the text' END, CASE WHEN NOT named THEN 'the client name appears in the text' END,
      CASE WHEN has_esc AND NOT quoted THEN '! the quoted increase clause is verbatim' END,
      CASE WHEN has_esc AND NOT coalesce(list_contains(regexp_extract_all(q, '\\d+'), CAST(CAST(pct AS INTEGER) AS VARCHAR)), false) THEN '! the percentage matches its own quote' END,
      CASE WHEN has_esc AND regexp_matches(q, '{drafts.INTEREST}') THEN 'the quote is not a late-payment clause' END, CASE WHEN has_esc AND regexp_matches(q, '{drafts.DISPUTE}') THEN 'the quote is not a dispute-escalation clause' END,
      CASE WHEN has_disc AND bad_disc THEN '! discount 1 quote is verbatim' END, CASE WHEN has_ms THEN '! milestone 1 quote is verbatim' END,
      CASE WHEN contains(excerpt, '[***]') THEN 'no redacted figures in the excerpt' END] AS bad FROM fx
), ver AS (
  SELECT *, array_to_string(list_filter(bad, lambda x: x IS NOT NULL), '; ') AS failed,
    CASE WHEN NOT usable THEN 'unusable' WHEN len(list_filter(bad, lambda x: x LIKE '!%')) = 0 THEN 'clean' WHEN regexp_matches(flat, '{corpus.ONE_FEE}') THEN 'needs_fix' ELSE 'unusable' END AS verdict FROM ck
), dec AS (
  SELECT name, CASE WHEN name % 5 = 0 THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN name % 6 = 1 THEN coalesce(amount, 0) + CAST(name % 4 = 1 AS DOUBLE) END AS fixed, CASE WHEN name % 4 = 3 THEN 1 ELSE 0 END AS n_fixes FROM dr WHERE name % 3 <> 2
)"""
_KNOWN = ", ".join(f"('{f}', {i}, '{n}')" for i, f in enumerate(names.FIELD_NAMES) for n in names.FIELD_NAMES[f])
SQL = {
    "name_groups": f"""WITH RECURSIVE s AS (SELECT CAST(s_nationkey AS BIGINT) AS run_id, s_suppkey, sha256(s_name) AS h FROM supplier),
      w AS (SELECT run_id, s_suppkey, {_CAP(f"({_PART(1)} || {_PART(3)} || {_PART(5)})")} AS one, {_CAP(f"({_PART(7)} || {_PART(9)} || {_PART(11)})")} AS two FROM s),
      every AS (SELECT run_id, s_suppkey * 4 + k AS ord, CASE k WHEN 0 THEN one || two WHEN 1 THEN one || ' ' || two || ' Inc.' WHEN 2 THEN one[1:8] || ' ' || two || ' Holdings' ELSE upper(two || ' ' || one) END AS name FROM w, range(4) t(k)),
      n AS (SELECT run_id, name, min(ord) AS place, regexp_replace(regexp_replace(lower(name), '\\b(inc|holdings)\\b', ' ', 'g'), '[^a-z0-9]', '', 'g') AS key FROM every GROUP BY run_id, name),
      pair AS (SELECT a.run_id, a.place AS a, b.place AS b FROM n a JOIN n b ON a.run_id = b.run_id AND b.place < a.place WHERE {_ratio("a.key", "b.key")} >= 85),
      reach AS (SELECT run_id, place AS a, place AS b FROM n UNION SELECT r.run_id, r.a, p.b FROM reach r JOIN pair p ON p.run_id = r.run_id AND p.a = r.b),
      g AS (SELECT run_id, a AS place, min(b) AS first FROM reach GROUP BY run_id, a),
      m AS (SELECT n.*, first FROM n JOIN g USING (run_id, place))
      SELECT run_id, name, first_value(name) OVER (PARTITION BY run_id, first ORDER BY len(name) DESC, place) AS canonical FROM m""",
    "column_proposals": f"""WITH e AS (SELECT DISTINCT event_type, user_id % 7 AS k FROM events),
      c AS (SELECT *, [upper(event_type), ' Trans. Date', 'Amt ' || k, CASE WHEN k % 2 = 0 THEN 'Payee Name' ELSE 'Zone' END] AS hs FROM e),
      x AS (SELECT event_type, k, unnest(hs) AS h, unnest(range(4)) AS i FROM c),
      w AS (SELECT *, {_WORDS.format("h")} AS hw FROM x), kn AS (SELECT f, {_WORDS.format("name")} AS kw FROM (VALUES {_KNOWN}) v(f, o, name)),
      sc AS (SELECT event_type, k, h, i, f, max({_ratio("hw", "kw")}) AS score FROM w, kn GROUP BY ALL),
      best AS (SELECT event_type, k, f, arg_max(h, score * 10 - i) AS h, max(score) AS score FROM sc GROUP BY ALL)
      SELECT event_type, k, """ + ", ".join(f"CASE WHEN k = 3 THEN {'upper(event_type)' if f == 'description' else 'NULL'} ELSE max(h) FILTER (f = '{f}' AND score >= 55) END AS {f}" for f in names.FIELD_NAMES) + " FROM best GROUP BY event_type, k",
    "contract_categories": f"WITH {TERMS}, fl AS (SELECT doc_id, {_FLAT} AS flat FROM terms), x AS (SELECT doc_id, flat, list_filter([" + ", ".join(
        f"CASE WHEN {_said(p)} THEN '{c}' END" for c, p in scan.CATEGORIES.items()
    ) + f"""], lambda c: c IS NOT NULL) AS cs FROM fl) SELECT doc_id, array_to_string(cs, ',') AS categories, list_contains(cs, 'recurring_fee') AND list_contains(cs, 'escalation') AS core_pair, {_said(scan.PLAIN_WORDS)} AS plain_filter,
      list_contains(cs, 'escalation') AND NOT {_said(corpus.CONCRETE_RISE)} AND {_said(scan.DISPUTE)} AS dispute_only FROM x WHERE len(cs) >= 2""",
    "clause_windows": f"""WITH {TERMS}, x AS (SELECT doc_id, text, strpos(lower(text), 'the fee shall increase by 5% annually.') AS p FROM terms)
      SELECT doc_id, CASE WHEN p > 0 THEN md5(substring(text, greatest(p - 1 - 466, 0) + 1, 1400)) END AS window_md5 FROM x""",
    "attribute_lines": f"""WITH s AS (SELECT s_suppkey AS id, sha256(s_name) AS w FROM supplier), p AS (
        SELECT id, {", ".join(f"{SYLLABLES}[('0x' || substr(w, {i}, 2))::INT % 16 + 1] AS p{i}" for i in (1, 3, 5, 7, 9, 11))} FROM s
      ), n AS (SELECT id, p1 || p3 || p5 AS a, p7 || p9 || p11 AS b FROM p
      ), x AS (SELECT l.id AS line, n.id AS name, l.a[1:6] || l.b AS k, n.a || n.b AS m, [l.a[1:6], l.b] AS lw, [n.a, n.b, 'holdings', 'inc'] AS nw FROM n l, n WHERE l.id % 11 <> 0
      ), r AS (SELECT line, name, list_reduce([0, 1, 2], lambda q, i: CASE WHEN q < 0 THEN -1 ELSE coalesce(list_min(list_filter(range(q + 1, 5), lambda j: starts_with(nw[j], lw[i]) OR starts_with(lw[i], nw[j]))), -1) END) > 0 AS abbr,
          CASE WHEN levenshtein(k, m) <= 0.205 * (len(k) + len(m)) THEN {_ratio("k", "m")} ELSE 0 END AS ratio FROM x
      ), y AS (SELECT line, name, greatest(CASE WHEN abbr THEN 90 ELSE 0 END, CASE WHEN ratio >= 80 THEN ratio ELSE 0 END) AS s FROM r
      ), t AS (SELECT line, name, s, row_number() OVER (PARTITION BY line ORDER BY s DESC, name) AS place, coalesce(lead(s) OVER (PARTITION BY line ORDER BY s DESC, name), 0) AS next FROM y)
      SELECT id AS txn_id, CASE WHEN id % 11 = 0 THEN id WHEN s >= 85 AND s - next >= 6 THEN name END AS client_id, CAST(CASE WHEN id % 11 = 0 THEN 100 ELSE s END AS BIGINT) AS score,
        CAST(CASE WHEN id % 11 = 0 THEN 0 ELSE next END AS BIGINT) AS runner_up FROM s1 LEFT JOIN t ON line = id AND place = 1""".replace("FROM s1 LEFT", "FROM s LEFT"),
    "contract_excerpts": """WITH x AS (SELECT doc_id, text || ' The fee shall' || chr(10) || 'increase by 5% annually.' AS t FROM documents),
      w AS (SELECT doc_id, t, substring(t, greatest(length(t) - 38 - 466, 0) + 1, 1400) AS w FROM x),
      e AS (SELECT doc_id, regexp_replace(substring(t, 1, 1200), '^\\s+|\\s+$', '', 'g') AS h, CASE WHEN NOT contains(substring(t, 1, 1200), substring(w, 1, 120)) THEN regexp_replace(w, '^\\s+|\\s+$', '', 'g') END AS w FROM w)
      SELECT doc_id, md5(regexp_replace(concat_ws(chr(10) || chr(10) || '[...]' || chr(10) || chr(10), CASE WHEN h <> '' THEN h END, w), '\\n{3,}', chr(10) || chr(10), 'g')) AS excerpt_md5 FROM e""",
    "clause_marks": f"""WITH {TERMS}, x AS (SELECT doc_id, t.text, length(t.text) - 1 - length(d.text) AS n FROM terms t JOIN documents d USING (doc_id)),
      e AS (SELECT doc_id, n, {_escaped("substring(text, 1, n)")} AS c, {_escaped("substring(text, n + 1)")} AS r FROM x)
      SELECT doc_id, CAST(1 AS BIGINT) AS n_marks, CAST(n AS INTEGER) AS until, md5('<mark class="exact">' || c || '</mark>' || r) AS html_md5 FROM e""",
    "pairs_checked": BASE + """, p AS (SELECT *, CAST((row_number() OVER (ORDER BY md5('7:' || client_id), client_id) - 1) % 6 AS INTEGER) AS template FROM contracts)
      SELECT template, concat_ws('; ', CASE WHEN client_id % 11 = 0 THEN 'fee is not in the text' END, CASE WHEN client_id % 13 = 0 AND template IN (1, 3, 5) THEN 'rise clause is not verbatim' END) AS problems, count(*) AS n
      FROM p GROUP BY 1, 2""",
    "finding_queue": runs._RUN + "SELECT entry_id, run_id, CAST(gap AS DOUBLE) AS gap FROM fr WHERE status = 'unverified' ORDER BY fr.gap DESC, entry_id LIMIT 50",
    "billing_windows": BASE + "SELECT frequency, CAST(min(billing_date) - 15 AS DATE) AS first_day, CAST(max(billing_date) + 15 AS DATE) AS last_day FROM keyed GROUP BY frequency",
    "draft_checks": _DRAFTS + "SELECT name, CASE WHEN usable THEN failed END AS failed, CASE WHEN usable THEN 3 + 4 * has_esc::INT + has_disc::INT + has_ms::INT END AS n_checks, verdict FROM ver",
    "draft_corrections": _DRAFTS + """SELECT name, CASE WHEN mend THEN fee ELSE amount END AS amount, CASE WHEN mend THEN rhythm ELSE frequency END AS frequency, has_esc AND NOT lost AND NOT unquoted AS has_rise,
      (has_disc AND NOT bad_disc)::INT AS n_items, concat_ws('; ', CASE WHEN mend THEN 'base amount: the only recurring fee in the text' END, CASE WHEN mend AND rhythm <> frequency THEN 'billing frequency: from the same sentence' END,
        CASE WHEN lost THEN 'escalation removed: no percentage' END, CASE WHEN unquoted THEN 'escalation removed: its quote is not in the document' END,
        CASE WHEN has_disc AND bad_disc THEN 'dropped one discount: its quote is not in the document' END, CASE WHEN has_ms THEN 'dropped one milestone: its quote is not in the document' END) AS changes,
      concat_ws('; ', CASE WHEN NOT coalesce(ok, false) AND n > 1 THEN n || ' competing fees' END, CASE WHEN NOT coalesce(ok, false) AND n = 0 THEN 'no recurring fee is stated' END,
        CASE WHEN has_esc AND pct IS NOT NULL AND NOT unquoted AND NOT fig THEN 'the percentage is not in its own quote' END) AS human FROM fx""",
    "exam_progress": _DRAFTS + """SELECT count(verdict) AS prepared, count(*) FILTER (verdict = 'unusable') AS unusable, count(*) FILTER (verdict <> 'unusable') AS reviewable, count(decision) AS reviewed,
      count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'drop') AS dropped, count(fixed) AS corrected FROM ver LEFT JOIN dec USING (name)""",
    "exam_final": _DRAFTS + """SELECT name, coalesce(fixed, amount) AS amount, n_fixes, CASE WHEN n_fixes > 0 THEN 'model_draft + rule_correction' WHEN fixed IS NOT NULL AND fixed IS DISTINCT FROM amount THEN 'human_edit'
      ELSE 'model_draft' END AS answer_source FROM dr JOIN dec USING (name) WHERE decision = 'keep'""",
    "exam_scan": runs.BASE + """SELECT client_id AS source, CASE WHEN client_id % 9 <> 0 AND client_id % 7 <> 0 THEN 'C {' || client_id END AS client_name, CASE WHEN client_id % 9 <> 0 THEN CAST(CAST(base_amount AS INTEGER) AS DOUBLE) END AS base_amount,
      CASE WHEN client_id % 9 <> 0 THEN frequency END AS billing_frequency, CASE WHEN client_id % 9 = 0 THEN 'answer key does not parse' WHEN client_id % 7 = 0 THEN 'answer key names no client' END AS reason FROM contracts""",
    "order_tables": "SELECT l_orderkey, coalesce(string_agg(l_linenumber || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber <> 3), '') AS text FROM lineitem GROUP BY l_orderkey",
}
