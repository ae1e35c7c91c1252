"""Contract corpus: tiers by the wording of fees and rises, quotes, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import BLANK, flatten, relevance
from tallyloom.sources.lineage import cut, written

#: Clauses planted in documents by id, one for each way a contract can read.
CLAUSES = (
    "The monthly fee is $5,000.00 per month and the fee shall increase by 5% annually.",
    "A monthly retainer is due and the fee shall be increased each year by [***] percent.",
    "The annual fee of $12,000 is payable annually.",
    "The fee may be adjusted to the consumer price index as set out below.",
    "The monthly fee shall be [***] and prices will increase each year by [redacted] or ****.",
    "This letter has no terms of payment.",
)
#: Figures withheld from a filed contract.
REDACTION = r"\[\s*\*{2,}\s*\]|\[\*+\]|\[redacted\]|\*{5,}|\[\s*\.{3,}\s*\]"
#: A price rise with its figure.
CONCRETE_RISE = (
    r"(?:fee|fees|rate|rates|price|prices|payment|compensation)(?:.{0,120}?)(?:increase|escalat|adjust)(?:.{0,120}?)\d+(?:\.\d+)?\s?(?:%|percent)",
    r"(?:increase|escalat|adjust)(?:.{0,120}?)\d+(?:\.\d+)?\s?(?:%|percent)(?:.{0,120}?)(?:per year|annually|each year|per annum|anniversary)",
    r"\d+(?:\.\d+)?\s?(?:%|percent)(?:.{0,80}?)(?:increase|escalat)(?:.{0,80}?)(?:per year|annually|each year|per annum|anniversary)",
    r"(?:fee|price|rate)(?:.{0,120}?)(?:increase|adjust)(?:.{0,120}?)consumer price index",
)
#: A recurring fee with its figure.
CONCRETE_FEE = (
    r"\$\s?[\d,]{3,}(?:\.\d{2})?\s*(?:per|/|each)\s*(?:month|year|annum|quarter)",
    r"(?:monthly|annual|quarterly)\s+(?:fee|retainer|payment|charge|rate)[^.]{0,80}?\$\s?[\d,]{3,}",
    r"\$\s?[\d,]{3,}(?:\.\d{2})?[^.]{0,60}?(?:per month|monthly|per annum|annually|per year)",
    r"retainer[^.]{0,100}?\$\s?[\d,]{3,}",
)
#: The wording of a recurring fee without its figure.
SHAPE_FEE = (
    r"(?:monthly|annual|quarterly)\s+(?:fee|fees|retainer|payment|charge|rate)",
    r"\bretainer\b",
    r"payable (?:monthly|quarterly|annually)",
    r"(?:fee|fees)(?:.{0,60}?)(?:per month|per annum|per year|each month)",
    r"(?:fees|compensation|amounts)(?:.{0,60}?)set forth in (?:exhibit|schedule|appendix|annex)",
)
#: The wording of a price rise without its figure.
SHAPE_RISE = (
    r"(?:fee|fees|rate|rates|price|prices|compensation)(?:.{0,120}?)(?:shall|will|may) (?:be )?(?:increase|escalat|adjust)",
    r"(?:increase|escalat|adjust)(?:.{0,100}?)(?:annually|each year|per annum|anniversary|calendar year)",
    r"(?:annual|yearly)(?:.{0,40}?)(?:price|fee|rate)(?:.{0,40}?)(?:increase|adjustment|escalation)",
    r"consumer price index|\bcpi\b",
    r"price (?:increase|escalation|adjustment)",
)
#: inner words of a quote that are looked up, by its length
QUOTE_WORDS = (8, 4, 2)
#: Figures that stand in for withheld ones.
RATES = ("3", "3.5", "4", "5", "5", "6", "7.5", "8")
MONTHLY_FEES = (2500, 3500, 4000, 5000, 6000, 7500, 8500, 12000)
YEARLY_FEES = (30000, 42000, 48000, 60000, 75000, 90000, 120000)
COUNTS = (2, 3, 5, 10, 12)
#: How a recurring fee is written, and words that say that it is none.
FEE_WORDS = (
    r"(?i)\$\s?[\d,]+(?:\.\d{2})?\s*per\s+(?:month|quarter|year|annum)"
    r"|(?:monthly|quarterly|annual)\s+(?:base\s+)?(?:fee|retainer|compensation|charge)[^.$]{0,40}\$\s?[\d,]+(?:\.\d{2})?"
)
NO_FEE = (
    "insurance|liabilit|coverage|per occurrence|aggregate limit|indemnif|allowance|reimburs|expense|deposit|security"
    "|penalt|liquidated damages|late|overdue|interest|salary|bonus|severance|vacation|renewal fee|renewabl|nominal"
)
LEAST_QUOTE = 20


#: One recurring fee, wording of fund administration, and dollar amounts.
ONE_FEE = (
    r"(?i)(?:a\s+)?(?:monthly|quarterly|annual)\s+(?:base\s+)?(?:fee|retainer|compensation|salary)[^.$]{0,60}\$\s?[\d,]+(?:\.\d{2})?"
    r"|\$\s?[\d,]+(?:\.\d{2})?\s*(?:per|each)\s+(?:month|quarter|year)"
)
FUND_WORDS = (
    r"(?i)fund accounting|transfer agen|sub-administration|net asset value|basis points|bps\b|per\s+(?:fund|portfolio|series|account)\b"
)
DOLLARS = r"\$\s?[\d,]+(?:\.\d{2})?"
FUND_MOST, AMOUNTS_MOST = 2, 20
#: one of these stands in any text that a family of patterns can match: a cheap first look
GATES = {
    "rise": r"increase|escalat|adjust|consumer price index|\bcpi\b",
    "fee": r"\$\s?[\d,]{3}|monthly|annual|quarterly|retainer|payable|fee|compensation|amounts",
}


def _says(text: Column, patterns: tuple[str, ...], gate: str) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return text.rlike(GATES[gate]) & hit


def once(docs: DataFrame, **found: Column) -> DataFrame:
    """Add columns that are worked out once, whatever is filtered on them later: out of an array
    of one, as a filter moved below a projection would evaluate them again."""
    return docs.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def tiers(docs: DataFrame) -> DataFrame:
    """Add redacted and tier: gold (both with figures), template (both by wording), reject.
    Patterns look at the squeezed, lower-cased text."""
    t, rise, fee = F.col("_flat"), F.col("_rise"), F.col("_fee")
    out = once(docs, _flat=flatten(F.coalesce("text", F.lit(""))))
    out = once(out, _rise=_says(t, CONCRETE_RISE, "rise"), _fee=_says(t, CONCRETE_FEE, "fee"))
    tier = F.when(rise & fee, "gold").when((rise | _says(t, SHAPE_RISE, "rise")) & (fee | _says(t, SHAPE_FEE, "fee")), "template").otherwise("reject")
    return once(out, redacted=t.rlike(REDACTION), tier=tier).drop("_flat", "_rise", "_fee")


def usable_questions(docs: DataFrame) -> DataFrame:
    """Documents that state one recurring fee: no rate card, no fund administration."""
    flat = docs.withColumn("_flat", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    amounts = F.size(F.array_distinct(F.regexp_extract_all("_flat", F.lit(DOLLARS), F.lit(0))))
    flat = flat.filter(F.col("_flat").rlike(ONE_FEE)).withColumn("amounts", amounts.cast("long"))
    return flat.filter((F.regexp_count("_flat", F.lit(FUND_WORDS)) <= FUND_MOST) & (F.col("amounts") <= AMOUNTS_MOST)).drop("_flat")


def snippet(text: Column, patterns: tuple[str, ...], pad: int = 110) -> Column:
    """The first hit of the first pattern that hits, with what stands around it."""
    def one(p: str) -> Column:
        at, hit = F.regexp_instr(text, F.lit(p)), F.regexp_substr(text, F.lit(p))
        first = F.greatest(at - pad, F.lit(1))
        return F.when(at > 0, F.trim(F.substr(text, first, at - first + F.length(hit) + pad)))

    return F.coalesce(*[one(p) for p in patterns])


def verbatim_hits(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the squeezed, lower-cased quote stands in the document.

    A quote's inner words are whole words of any text that holds it, so eight of them (of
    shorter quotes four or two) hash to a key that the text's windows of as many words are
    joined on; ``contains`` decides. Quotes of fewer than four words are compared one by one
    with every text.
    """
    q = quotes.select("item_id", flatten(F.col("text")).alias("q")).filter(F.length("q") >= LEAST_QUOTE)
    q = q.withColumn("_w", F.split("q", " "))
    k = F.coalesce(*[F.when(F.size("_w") >= n + 2, n) for n in QUOTE_WORDS], F.lit(0))
    q = q.withColumn("_k", k)
    hashed = lambda n, first: F.xxhash64(F.lit(n), *[F.get("_w", first + j) for j in range(n)])
    inner = F.coalesce(*[F.when(F.col("_k") == n, hashed(n, F.lit(1))) for n in QUOTE_WORDS])
    long = q.filter("_k > 0").select("item_id", "q", inner.alias("_h"))
    asked = [r["_k"] for r in q.select("_k").distinct().collect()]  # at most one for each width
    t = docs.select("doc_id", flatten(F.col("text")).alias("t"))
    words = t.withColumn("_w", F.split("t", " "))

    def windows(n: int) -> Column:
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: hashed(n, i))).otherwise(F.array().cast("array<bigint>"))

    # outer: the filter that a plain explode infers would split the text for every window
    every = F.array_distinct(F.flatten(F.array(*[windows(n) for n in QUOTE_WORDS if n in asked], F.array().cast("array<bigint>"))))
    placed = words.select("doc_id", F.explode_outer(every).alias("_h"))
    # written: their size is known, few of them are sent to the texts and not all texts to them
    pairs = written(placed.join(long, "_h").select("item_id", "doc_id", "q").distinct(), "pairs")
    sure = pairs.join(t, "doc_id").filter(F.contains("t", "q")).select("item_id", "doc_id")
    if 0 not in asked:
        return sure
    short = q.filter("_k = 0").select("item_id", "q")
    return sure.unionByName(t.join(short, F.contains("t", "q")).select("item_id", "doc_id"))


def chunks(docs: DataFrame, limit: int = 12_000) -> DataFrame:
    """Paragraphs packed into chunks of about ``limit`` characters: a full chunk's last
    paragraph opens the next one; a paragraph over the limit is cut hard, into chunks of its
    own. A text without paragraphs has no chunk."""

    def packed(text: str) -> Iterator[str]:
        held: list[str] = []
        size = 0
        for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
            if len(p) > limit:
                if held:
                    yield "\n\n".join(held)
                held, size = [], 0
                yield from (p[i : i + limit] for i in range(0, len(p), limit))
                continue
            if held and size + len(p) > limit:
                yield "\n\n".join(held)
                held, size = held[-1:], len(held[-1])
            held.append(p)
            size += len(p) + 2
        if held:
            yield "\n\n".join(held)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, c in enumerate(packed(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInPandas(split, "doc_id long, chunk int, text string")


def select_chunks(docs: DataFrame, most: int = 6) -> DataFrame:
    """A document's first chunk and its best others by relevance (the earlier wins ties)."""
    c = chunks(docs).withColumn("score", relevance(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy(F.col("chunk") > 0, F.desc("score"), "chunk")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("doc_id", "chunk", "score", F.length("text").alias("n_chars"))


def merge_extractions(rows: DataFrame) -> DataFrame:
    """Extractions of a document's chunks (doc_id, chunk, client_name, base_amount, currency,
    frequency, esc_pct, discounts array<struct<percentage, duration_months>>) folded into one:
    the commonest name (the first seen of equals), of other fields the first that is stated,
    and each discount once, in order of appearance."""
    def first(c: str, stated: Column) -> Column:
        return F.min(F.when(stated, F.struct("chunk", F.col(c).alias("v"))))["v"].alias(c)

    named = rows.filter(F.coalesce(F.lower("client_name"), F.lit("null")).isin("null", "") == F.lit(False))
    names = named.groupBy("doc_id", "client_name").agg(F.count("*").alias("n"), F.min("chunk").alias("at"))
    names = names.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), F.col("at"), F.col("client_name").alias("v")))["v"].alias("client_name"))
    some = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    fields = rows.groupBy("doc_id").agg(
        first("base_amount", some("base_amount")), first("currency", some("currency")), first("frequency", some("frequency") & (F.col("frequency") != "unknown")),
        first("esc_pct", some("esc_pct")),
    )
    off = rows.select("doc_id", "chunk", F.posexplode("discounts").alias("_p", "_d"))
    off = off.groupBy("doc_id", "_d").agg(F.min(F.struct("chunk", "_p")).alias("_at"))
    off = off.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]).alias("discounts"))
    out = fields.join(names, "doc_id", "left").join(off, "doc_id", "left")
    return out.withColumns({"currency": F.coalesce("currency", F.lit("USD")), "frequency": F.coalesce("frequency", F.lit("unknown"))})


def containing(quotes: DataFrame, texts: DataFrame, size: int = 60, step: int = 2000, most: int = 20_000) -> DataFrame:
    """(name, doc_id) of texts that hold a stretch of ``size`` characters of another body,
    taken every ``step`` characters of its first ``most``: a leak of one set into another.

    quotes: name, text; texts: doc_id, text. Stretches are looked up like quotes, then
    compared letter by letter."""
    n = F.least(F.length("text"), F.lit(most))
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))
    probes = quotes.select("name", F.explode(F.transform(at, lambda i: F.substr("text", i, F.lit(size)))).alias("text"))
    probes = probes.filter((F.length("text") == size) & (F.trim("text") != "")).select(F.struct("name", "text").alias("item_id"), "text")
    hits = verbatim_hits(probes, texts).join(texts.select("doc_id", "text"), "doc_id")
    return hits.filter(F.contains("text", "item_id.text")).select("item_id.name", "doc_id").distinct()


def _two_first(left: DataFrame, by: str) -> DataFrame:
    """``by``, and the two smallest ords of each: a smallest, then a smallest of the others."""
    one = left.groupBy(by).agg(F.min("ord").alias(f"{by}_1"))
    rest = left.join(one, by).filter(F.col("ord") > F.col(f"{by}_1")).groupBy(by).agg(F.min("ord").alias(f"{by}_2"))
    return one.join(rest, by, "left")


def _chains(links: DataFrame) -> DataFrame:
    """links(ord, before, odd): ``before`` leads on until it has no link; each round doubles the
    steps, ``odd`` tells whether their number is."""
    while True:
        on = links.select(F.col("ord").alias("before"), F.col("before").alias("_b"), F.col("odd").alias("_o"))
        longer = links.join(on, "before", "left")
        longer = cut(longer.select("ord", F.coalesce("_b", "before").alias("before"), F.when(F.col("_o"), ~F.col("odd")).otherwise(F.col("odd")).alias("odd"), F.col("_b").isNotNull().alias("_on")))
        links = longer.drop("_on")
        if longer.filter("_on").isEmpty():
            return links


def keep_first_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, ord, filer, clause): one document of a filer AND of a clause, in order.

    Greedy by nature: whether a document stays depends on those before it of its filer and its
    clause. One without any is sure. One with a single one before it stays if that one goes: such
    documents form chains, which are walked by doubling, so a chain of n is decided in log n
    joins. What shares a filer or clause with one that stays goes; documents with several before
    them wait for the next round. Rounds: the depth of such waiting, not the length of chains."""
    kept, left = None, cut(docs.select("doc_id", "ord", "filer", "clause"))
    while True:
        x = left.join(_two_first(left, "filer"), "filer").join(_two_first(left, "clause"), "clause")
        ahead = lambda by: F.when(F.col("ord") == F.col(f"{by}_1"), F.lit(None)).otherwise(F.col(f"{by}_1"))
        few = lambda by: (F.col("ord") == F.col(f"{by}_1")) | F.coalesce(F.col("ord") == F.col(f"{by}_2"), F.lit(False))
        x = x.withColumns({"_f": ahead("filer"), "_c": ahead("clause")})
        single = few("filer") & few("clause") & (F.col("_f").isNull() | F.col("_c").isNull() | (F.col("_f") == F.col("_c")))
        x = cut(x.select("ord", F.coalesce("_f", "_c").alias("before"), (F.col("_f").isNull() & F.col("_c").isNull()).alias("sure"), single.alias("single")))
        sure = x.filter("sure").select("ord")
        ends = _chains(cut(x.filter("single AND NOT sure").select("ord", "before", F.lit(True).alias("odd"))))
        # a chain that ends at a document that is not sure yet is left for later
        known = ends.join(sure.withColumnRenamed("ord", "before"), "before", "left_semi")
        stay = cut(sure.unionByName(known.filter("NOT odd").select("ord")))
        if stay.isEmpty():
            return kept if kept is not None else left
        mine = cut(left.join(stay, "ord", "left_semi"))
        kept = mine if kept is None else kept.unionByName(mine)
        left = left.join(mine.select("filer"), "filer", "left_anti").join(mine.select("clause"), "clause", "left_anti")
        left = cut(left.select("doc_id", "ord", "filer", "clause"))


def filled(text: Column, seed: Column) -> Column:
    """A contract with its withheld figures put in where their kind is plain: an amount after
    a dollar sign, a rate before a per cent sign, a count before a word of time after a word
    of duration. All others stay withheld. struct(text, n_filled); the choice follows seed."""
    marks = F.regexp_extract_all(text, F.lit(BLANK), F.lit(0))
    gaps = F.split(text, BLANK, -1)

    def pick(values: tuple, i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string")).cast("binary"))
        at = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % len(values)
        return F.get(F.array(*map(F.lit, values)), at)

    def value(g: Column, i: Column, after: Column) -> Column:
        before, head = F.lower(F.right(g, F.lit(70))), F.lower(F.left(F.coalesce(after, F.lit("")), F.lit(40)))
        yearly = F.concat(before, head).rlike("per annum|annually|per year|annual fee")
        amount = F.when(yearly, pick(YEARLY_FEES, i)).otherwise(pick(MONTHLY_FEES, i))
        count = head.rlike(r"^\s*(?:month|day|year)s?\b") & before.rlike(r"(?:first|initial|any|each|every|within|period of|for)\s*(?:the\s*)?$")
        return (
            F.when(g.rlike(r"\$\s*$"), F.format_number(amount, 0)).when(head.rlike(r"^\s*(?:%|percent\b)"), pick(RATES, i))
            .when(count, pick(COUNTS, i).cast("string"))
        )

    parts = F.arrays_zip(gaps.alias("g"), marks.alias("m"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("n"))
    put = F.transform(parts, lambda p, i: F.struct(p["g"].alias("g"), p["m"].alias("m"), F.when(p["m"].isNotNull(), value(p["g"], i, p["n"])).alias("v")))
    return F.struct(
        F.array_join(F.transform(put, lambda p: F.concat_ws("", p["g"], F.coalesce(p["v"], p["m"]))), "").alias("text"),
        F.size(F.filter(put, lambda p: p["v"].isNotNull())).cast("long").alias("n_filled"),
    )


def candidate_fees(text: Column) -> Column:
    """Sorted distinct amounts that stand as a recurring service fee, judged by 150 characters
    around (no further than the fees beside it): no insurance, allowance, penalty, salary or
    peppercorn."""
    flat = F.regexp_replace(text, r"\s+", " ")
    m, g = F.regexp_extract_all(flat, F.lit(FEE_WORDS), F.lit(0)), F.split(flat, FEE_WORDS, -1)
    around = F.arrays_zip(g.alias("g"), m.alias("m"), F.concat(F.array(F.lit("")), m).alias("p"), F.slice(g, F.lit(2), F.size(g)).alias("n"), F.slice(m, F.lit(2), F.size(g)).alias("q"))
    said = lambda x: F.concat_ws("", F.right(F.concat_ws("", x["p"], x["g"]), F.lit(150)), x["m"], F.left(F.concat_ws("", x["n"], x["q"]), F.lit(150)))
    fair = F.filter(around, lambda x: x["m"].isNotNull() & ~said(x).rlike("(?i)" + NO_FEE))
    amounts = F.transform(fair, lambda x: F.regexp_replace(F.regexp_extract(x["m"], r"\$\s?([\d,]+(?:\.\d{2})?)", 1), ",", "").try_cast("double"))
    return F.when(flat.rlike(FEE_WORDS), F.array_sort(F.array_distinct(F.array_compact(amounts)))).otherwise(F.array().cast("array<double>"))
