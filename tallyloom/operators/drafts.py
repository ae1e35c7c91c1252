"""Draft answers for an exam: checks, repairs by rule, review and the rows that stay.

A draft: name, excerpt, client_name, amount (double), frequency, escalation
struct(percentage double, clause_text), discounts and milestones array(struct(clause_text));
``drafted`` is false where the model gave no rules at all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.functions import text
from tallyloom.functions.money import percent_number
from tallyloom.operators.corpus import NO_FEE, ONE_FEE

#: Clauses that are taken for a rise and are none, and withheld figures.
INTEREST = "(?i)per annum|interest|late payment|overdue|past due"
DISPUTE = "(?i)dispute|senior management|arbitrat|good faith|executive sponsor"
WITHHELD = r"\[\s*\*+\s*\]|\*{3,}"
#: A fee by its period, before or after the amount, and the rhythm meant.
FEE_THEN_PERIOD = r"(?i)\$\s?([\d,]+(?:\.\d{2})?)\s*per\s+(month|quarter|year|annum)"
PERIOD_THEN_FEE = r"(?i)(monthly|quarterly|annual)\s+(?:base\s+)?(?:fee|retainer|compensation|charge)[^.$]{0,40}\$\s?([\d,]+(?:\.\d{2})?)"
RHYTHMS = {"month": "monthly", "monthly": "monthly", "quarter": "quarterly", "quarterly": "quarterly", "year": "annual", "annum": "annual", "annual": "annual"}
#: Letters of context that tell a fee from other sums, and the least fee believed.
CONTEXT, LEAST_FEE = 150, 100.0


def _number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double")


def amount_stated(amount: Column, excerpt: Column) -> Column:
    """Whether a text states an amount, by value."""
    found = F.transform(F.regexp_extract_all(excerpt, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), _number)
    return F.coalesce(F.exists(found, lambda x: F.abs(x - amount) < 0.01), F.lit(False))


def _fees(flat: Column, pattern: str, amount: int, period: int) -> Column:
    m, gaps = F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), F.split(flat, pattern, -1)
    after = F.slice(gaps, F.lit(2), F.size(gaps))
    around = F.arrays_zip(gaps.alias("g"), m.alias("m"), F.concat(F.array(F.lit("")), m).alias("p"), after.alias("n"), F.slice(m, F.lit(2), F.size(m)).alias("q"))
    near = lambda x: F.concat_ws("", F.right(F.concat_ws("", x["p"], x["g"]), F.lit(CONTEXT)), x["m"], F.left(F.concat_ws("", x["n"], x["q"]), F.lit(CONTEXT)))
    rhythm = F.create_map(*[F.lit(v) for kv in RHYTHMS.items() for v in kv])
    fair = F.filter(around, lambda x: x["m"].isNotNull() & ~near(x).rlike("(?i)" + NO_FEE))
    return F.transform(fair, lambda x: F.struct(
        _number(F.regexp_extract(x["m"], pattern, amount)).alias("amount"), F.try_element_at(rhythm, F.lower(F.regexp_extract(x["m"], pattern, period))).alias("frequency"),
    ))


def recurring_fees(excerpt: Column) -> Column:
    """Recurring fees of a text with their rhythm, one of each amount, the smallest first."""
    flat = F.regexp_replace(excerpt, r"\s+", " ")
    both = F.concat(_fees(flat, FEE_THEN_PERIOD, 1, 2), _fees(flat, PERIOD_THEN_FEE, 2, 1))
    both = F.filter(both, lambda x: x["amount"].isNotNull())
    amounts = F.array_sort(F.array_distinct(F.transform(both, lambda x: x["amount"])))
    return F.transform(amounts, lambda a: F.get(F.filter(both, lambda x: x["amount"] == a), 0))


def checks(d: DataFrame) -> DataFrame:
    """Adds checks (label, passed; an exclamation mark means that the draft fails with it) and verdict."""
    esc, quote = F.col("escalation"), F.coalesce("escalation.clause_text", F.lit(""))
    check = lambda label, passed: F.struct(F.lit(label).alias("label"), F.coalesce(passed, F.lit(False)).alias("passed"))
    quoted = lambda kind, items: F.transform(F.coalesce(items, F.array().cast("array<struct<clause_text:string>>")), lambda x, i: F.struct(
        F.concat(F.lit(f"! {kind} "), (i + 1).cast("string"), F.lit(" quote is verbatim")).alias("label"), text.stands_folded(x["clause_text"], F.col("excerpt")).alias("passed")))
    name = F.trim(F.coalesce("client_name", F.lit("")))
    of_rise = F.array(
        check("! the quoted increase clause is verbatim", text.stands_folded(quote, F.col("excerpt"))),
        check("! the percentage matches its own quote", F.array_contains(text.figures(quote), percent_number(F.col("escalation.percentage")))),
        check("the quote is not a late-payment clause", ~quote.rlike(INTEREST)),
        check("the quote is not a dispute-escalation clause", ~quote.rlike(DISPUTE)),
    )
    every = F.concat(
        F.array(
            check("! the fee amount appears in the text", amount_stated(F.col("amount"), F.col("excerpt"))),
            check("the client name appears in the text", (name != "") & F.contains("excerpt", F.left(name, F.lit(18)))),
        ),
        F.when(esc.isNotNull(), of_rise).otherwise(F.array().cast("array<struct<label:string,passed:boolean>>")),
        quoted("discount", F.col("discounts")), quoted("milestone", F.col("milestones")),
        F.array(check("no redacted figures in the excerpt", ~F.col("excerpt").rlike(WITHHELD))),
    )
    failed = F.exists("checks", lambda c: ~c["passed"] & c["label"].startswith("!"))
    mendable = F.regexp_replace("excerpt", r"\s+", " ").rlike(ONE_FEE)
    verdict = F.when(~F.col("drafted"), "unusable").when(~failed, "clean").when(mendable, "needs_fix").otherwise("unusable")
    return d.withColumn("checks", F.when(F.col("drafted"), every)).withColumn("verdict", verdict)


def corrected(d: DataFrame) -> DataFrame:
    """Drafts repaired where a rule can tell, with the changes made and what a person has to settle."""
    d = d.withColumns({"_fees": F.filter(recurring_fees(F.col("excerpt")), lambda x: x["amount"] >= LEAST_FEE), "_ok": amount_stated(F.col("amount"), F.col("excerpt"))})
    one, n = F.get("_fees", 0), F.size("_fees")
    mend = ~F.col("_ok") & (n == 1)
    other = mend & ~F.equal_null(F.col("frequency"), one["frequency"])
    esc, pct, quote = F.col("escalation"), F.col("escalation.percentage"), F.coalesce("escalation.clause_text", F.lit(""))
    lost = esc.isNotNull() & pct.isNull()
    unquoted = esc.isNotNull() & pct.isNotNull() & ~text.stands_folded(quote, F.col("excerpt"))
    figures = F.contains(F.regexp_replace(quote, r"[^\d.]", " "), percent_number(pct))
    kept, dropped = {}, []
    for kind in ("discounts", "milestones"):
        items = F.coalesce(F.col(kind), F.array().cast("array<struct<clause_text:string>>"))
        kept[kind] = F.filter(items, lambda x: text.stands_folded(x["clause_text"], F.col("excerpt")))
        dropped.append(F.array_repeat(F.lit(f"dropped one {kind[:-1]}: its quote is not in the document"), F.size(items) - F.size(kept[kind])))
    changes = F.array_compact(F.array(
        F.when(mend, "base amount: the only recurring fee in the text"), F.when(other, "billing frequency: from the same sentence"),
        F.when(lost, "escalation removed: no percentage"), F.when(unquoted, "escalation removed: its quote is not in the document"),
    ))
    human = F.array_compact(F.array(
        F.when(~F.col("_ok") & (n > 1), F.concat(n.cast("string"), F.lit(" competing fees"))), F.when(~F.col("_ok") & (n == 0), "no recurring fee is stated"),
        F.when(esc.isNotNull() & pct.isNotNull() & ~unquoted & ~figures, "the percentage is not in its own quote"),
    ))
    return d.withColumns({
        "changes": F.concat(changes, *dropped), "human": human, "amount": F.when(mend, one["amount"]).otherwise(F.col("amount")),
        "frequency": F.when(other, one["frequency"]).otherwise(F.col("frequency")), "escalation": F.when(~(lost | unquoted), esc), **kept,
    }).drop("_fees", "_ok")


def progress(checked: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: drafts made, never shown, reviewed of those shown, kept, dropped, changed by hand.

    decisions(name, decision, corrected_amount, n_fixes)."""
    every = checked.select("name", "verdict").join(decisions, "name", "full_outer")
    return every.agg(
        F.count("verdict").alias("prepared"), F.count_if(F.col("verdict") == "unusable").alias("unusable"), F.count_if(F.col("verdict") != "unusable").alias("reviewable"),
        F.count("decision").alias("reviewed"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"),
        F.count("corrected_amount").alias("corrected"),
    )


def finalised(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Kept drafts; a reviewed answer wins over the draft, and each row says how it came about."""
    rows = drafts.join(decisions.filter("decision = 'keep'"), "name")
    by_hand = F.col("corrected_amount").isNotNull() & ~F.equal_null(F.col("corrected_amount"), F.col("amount"))
    source = F.when(F.col("n_fixes") > 0, "model_draft + rule_correction").when(by_hand, "human_edit").otherwise("model_draft")
    return rows.withColumns({"answer_source": source, "amount": F.coalesce("corrected_amount", "amount")})


def _object(reply: str) -> str:
    bare = re.sub(r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "", reply.strip())
    start, depth = bare.find("{"), 0
    if start < 0:
        return bare
    # strings are skipped as a whole, an open one to the end
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', bare[start:], re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return bare[start : start + m.end()]
    return bare[start:]


@F.pandas_udf(StringType())
def json_object(replies: pd.Series) -> pd.Series:
    """The first whole JSON object of a reply, fences and prose around it gone."""
    return replies.map(_object, na_action="ignore")


#: the parts of an answer key that must parse
KEY = "client_name string, base_amount double, billing_frequency string"


def exam(rows: DataFrame) -> DataFrame:
    """rows(source, output) -> the answer key, or the reason why a row cannot be marked."""
    key = F.from_json("output", KEY + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_key", key)
    bad = F.col("_key").isNull() | F.col("_key._bad").isNotNull()
    reason = F.when(bad, "answer key does not parse").when(F.col("_key.client_name").isNull(), "answer key names no client")
    return rows.select("source", "_key.client_name", "_key.base_amount", "_key.billing_frequency", reason.alias("reason"))


def table_text(rows: Column) -> Column:
    """A table as text: cells of a row joined by bars, a line each, blank rows gone."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | "))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[ |]*$")), "\n")


def window_around(whole: Column, needle: Column, size: int = 1400) -> Column:
    """A stretch of a text around a scored snippet, found by its first ten words, else by its
    last ten, whatever the case and the white space between; null where neither stands there."""
    words = F.filter(F.split(needle, r"\s+"), lambda w: w != "")
    pattern = lambda some: F.concat(F.lit("(?i)"), F.array_join(F.transform(some, lambda w: F.regexp_replace(w, r"(\p{Punct})", r"\\$1")), r"\s+"))
    head, tail = F.slice(words, 1, 10), F.slice(words, F.greatest(F.size(words) - 9, F.lit(1)), 10)
    hit = F.when(F.size(words) >= 3, F.coalesce(F.regexp_substr(whole, pattern(head)), F.regexp_substr(whole, pattern(tail))))
    start = F.greatest(F.instr(whole, hit) - 1 - size // 3, F.lit(0))
    return F.when(hit.isNotNull(), F.substr(whole, start + 1, F.lit(size)))


def excerpt(whole: Column, snippets: list[Column], head: int = 1200, size: int = 1400) -> Column:
    """The opening of a text and the stretches around its scored snippets, those that are in an
    earlier part already left out; what is left between is told by [...]."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.array(F.substring(whole, 1, head))
    for s in snippets:
        w = window_around(whole, s, size)
        fresh = w.isNotNull() & ~F.coalesce(F.exists(parts, lambda p: F.contains(p, F.substring(w, 1, 120))), F.lit(True))  # noqa: B023
        parts = F.when(fresh, F.concat(parts, F.array(w))).otherwise(parts)
    told = F.filter(F.transform(parts, trimmed), lambda p: p != "")
    return F.regexp_replace(F.array_join(told, "\n\n[...]\n\n"), r"\n{3,}", "\n\n")
