"""Scan of contract texts by five categories of terms."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tallyloom.functions.batches import pieces
from tallyloom.functions.text import flatten
from tallyloom.operators.corpus import CONCRETE_RISE
from tallyloom.sources.lineage import cut

#: The wording of each category of terms.
CATEGORIES = {
    "recurring_fee": (
        r"\bretainer\b",
        r"monthly (?:fee|fees|rate|charge|payment|installment|instalment|amount|sum)",
        r"(?:fee|amount|sum|payment)s? of \$[\d,]+(?:\.\d+)? per month",
        r"\$[\d,]+(?:\.\d+)?\s*(?:per|each|/)\s*month",
        r"payable monthly",
        r"per month(?:ly)? in advance",
        r"annual (?:fee|fees|subscription)",
        r"\brecurring\s+(?:fee|charge|payment|revenue)",
        r"quarterly (?:fee|fees|payment|installment)",
    ),
    "escalation": (
        r"(?:shall|will|may) (?:be )?increase[sd]?(?:.{0,80}?)\d+(?:\.\d+)?\s?%",
        r"\d+(?:\.\d+)?\s?%(?:.{0,60}?)(?:increase|escalation|uplift|adjustment)",
        r"\bescalat(?:e|es|ed|ion|or)\b",
        r"annual(?:ly)? (?:increase|adjust|escalat|uplift)",
        r"(?:increase|adjust)(?:.{0,60}?)(?:consumer price index|\bcpi\b)",
        r"(?:on|upon) each anniversary(?:.{0,80}?)(?:increase|adjust)",
        r"price (?:increase|escalation|adjustment)",
    ),
    "discount": (
        r"\d+(?:\.\d+)?\s?%\s*discount",
        r"discount of \d+(?:\.\d+)?\s?%",
        r"discount(?:ed)? (?:rate|price|fee|amount)",
        r"(?:introductory|promotional|initial|trial) (?:rate|price|period|discount)",
        r"\brebate\b",
        r"fees? (?:shall be |will be |are )?waived",
    ),
    "milestone": (
        r"\bmilestone\b",
        r"upon (?:completion|delivery|acceptance|launch|execution)(?:.{0,60}?)(?:pay|payment|\$)",
        r"(?:pay|payment|\$)(?:.{0,60}?)upon (?:completion|delivery|acceptance|launch)",
        r"payment schedule",
        r"lump[- ]sum",
        r"one[- ]time (?:fee|payment|charge)",
    ),
    "payment_terms": (
        r"\bnet (?:thirty|30|forty[- ]five|45|sixty|60|fifteen|15)\b",
        r"within (?:thirty|30|forty[- ]five|45|sixty|60|fifteen|15) \(?\d*\)? ?days? (?:of|after|from|following)",
        r"due (?:and payable )?within \d+ days",
        r"payment terms",
    ),
}
#: Words of which each match of a category has one: a cheap first look.
GATES = {
    "recurring_fee": ("retainer", "month", "annual", "recurring", "quarterly"),
    "escalation": ("increase", "escalat", "uplift", "adjust"),
    "discount": ("discount", "introductory", "promotional", "initial", "trial", "rebate", "waived"),
    "milestone": ("milestone", "upon ", "payment schedule", "lump", "one-time", "one time"),
    "payment_terms": ("net ", "within ", "payment terms"),
}
#: Rises that mean a dispute handed upwards.
DISPUTE = (
    r"escalat(?:e|ed|ion)(?:.{0,60}?)(?:dispute|senior|executive|management|committee|level \d)",
    r"(?:dispute|disagreement)(?:.{0,60}?)escalat",
    r"escalation procedure",
)
#: Words of the plain filter.
PLAIN_WORDS = (
    "monthly fee", "retainer", "shall increase", "escalat", "annual increase", "discount", "net 30", "net 45", "milestone", "recurring", "per month", "monthly payment",
)
#: hits of one category that are listed, and letters shown around each
HITS, AROUND = 4, 160
FOUND = "doc_id long, category string, snippet string, page int"


def _any(flat: Column, patterns: tuple[str, ...]) -> Column:
    return flat.rlike("|".join(patterns))


def _named(flat: Column, category: str) -> Column:
    gate = F.lit(False)
    for word in GATES[category]:
        gate = gate | F.contains(flat, F.lit(word))
    return gate & _any(flat, CATEGORIES[category])


def categories(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> categories named, their number, and what follows from them."""
    flat = F.col("_flat")
    d = docs.select("doc_id", F.length("text").alias("n_chars"), flatten(F.coalesce("text", F.lit(""))).alias("_flat"))
    # out of an array of one: what is filtered on later is not worked out a second time
    named = F.struct(*[_named(flat, c).alias(c) for c in CATEGORIES])
    d = d.select("*", F.inline_outer(F.array(named)))
    d = d.withColumn("categories", F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CATEGORIES])))
    return d.select(
        "doc_id", "n_chars", "categories", F.size("categories").alias("score"), (F.col("recurring_fee") & F.col("escalation")).alias("core_pair"),
        _any(flat, PLAIN_WORDS).alias("plain_filter"), (F.col("escalation") & _any(flat, DISPUTE) & ~_any(flat, CONCRETE_RISE)).alias("dispute_only"),
    )


def survivors(scored: DataFrame, least: int = 3) -> DataFrame:
    """Documents with enough categories, the best first: those of the gold tier, if it is told,
    then those with both core categories, more categories, longer ones. They are written once:
    a sort looks at its rows twice."""
    gold = [F.desc("gold")] if "gold" in scored.columns else []
    return cut(scored.filter(F.col("score") >= least)).orderBy(*gold, F.desc("core_pair"), F.desc("score"), F.desc("n_chars"), "doc_id")


def _spans(flat: str, patterns: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Matches in order of the patterns, none beginning inside an earlier one."""
    taken: list[tuple[int, int]] = []
    for m in itertools.chain.from_iterable(re.finditer(p, flat) for p in patterns):
        if not any(lo <= m.start() < hi for lo, hi in taken):
            taken.append(m.span())
            yield m.span()


def hits(docs: DataFrame) -> DataFrame:
    """The first four hits of each category with their surroundings and page; form feeds part pages."""

    kind = to_arrow_type(StructType.fromDDL(FOUND))

    def of_one(doc: int, raw: str) -> Iterator[tuple[int, dict]]:
        flat = " ".join(raw.lower().split())
        ends = np.cumsum([len(" ".join(p.split())) + 1 for p in raw.split("\f")])
        for name, patterns in CATEGORIES.items():
            for lo, hi in itertools.islice(_spans(flat, patterns), HITS):
                page = min(int(np.searchsorted(ends, lo, "right")), len(ends) - 1) + 1
                snippet = flat[max(0, lo - AROUND) : hi + AROUND].strip()
                yield len(snippet), {"doc_id": doc, "category": name, "snippet": snippet, "page": page}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id"), batch.column("text"), strict=True)
            found = itertools.chain.from_iterable(of_one(doc.as_py(), raw.as_py()) for doc, raw in rows)
            yield from map(pa.RecordBatch.from_struct_array, pieces(found, kind))

    some = F.lit(False)
    for name in CATEGORIES:
        some = some | _named(F.col("_flat"), name)
    named = docs.select("doc_id", "text", F.inline_outer(F.array(F.struct(flatten(F.col("text")).alias("_flat"))))).filter(some).drop("_flat")
    return named.mapInArrow(find, FOUND)
