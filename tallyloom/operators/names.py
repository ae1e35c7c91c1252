"""Variants of one company name, and columns of a statement by their headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import normalise_name
from tallyloom.operators.attribution import THRESHOLD, indel_ratio, near_names
from tallyloom.sources.lineage import cut

#: The fields that a statement must have, and how banks call their columns.
FIELD_NAMES = {
    "date": ("date", "txn date", "transaction date", "posted date", "trans date", "value date", "posting date"),
    "amount": ("amount", "amt", "value", "transaction amount", "net amount", "debit", "credit"),
    "description": ("description", "desc", "memo", "narrative", "details", "payee", "reference", "particulars"),
}
#: Fixed value: a header less like every known one stays unmapped.
HEADER_LIKENESS = 55


def similar_names(names: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """names(run_id, place, key) -> (run_id, a, b): the name at place a is like the earlier one
    at b. The names of a run go down the tree of their own keys, in blocks."""
    n = names.filter("key <> ''").withColumn("_scope", F.col("run_id").cast("string"))
    lines = n.select("_scope", F.col("place").cast("string").alias("_line"), F.col("key").alias("_ka"))
    met = near_names(lines, n.select("_scope", F.col("place").alias("_cid"), F.col("key").alias("_kb")), threshold).filter("_line IS NOT NULL")
    met = met.select(F.col("_scope").cast("long").alias("run_id"), F.col("_line").cast("long").alias("a"), F.col("_cid").cast("long").alias("b"))
    return met.filter("b < a")


def group_clients(names: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """names(run_id, ord, name) -> run_id, name, canonical: a name joins the oldest group that
    has a member like it, else founds one; a group is called by its longest name, the first of
    those. Names are trimmed, blank ones go, one that repeats counts where it is first seen.

    The group of a name is the smallest place that can be reached from it over ever earlier
    similar names, so groups come from joins that halve the way each time."""
    n = names.withColumn("name", F.trim("name")).filter("name <> ''").groupBy("run_id", "name").agg(F.min("ord").alias("place"))
    n = cut(n.withColumn("key", normalise_name(F.col("name"))))
    pairs = cut(similar_names(n, threshold))
    label = cut(n.select("run_id", "place", F.col("place").alias("first")))
    while True:
        of_b = label.select("run_id", F.col("place").alias("b"), F.col("first").alias("seen"))
        best = pairs.join(of_b, ["run_id", "b"]).groupBy("run_id", F.col("a").alias("place")).agg(F.min("seen").alias("seen"))
        step = label.join(best, ["run_id", "place"], "left").withColumn("next", F.least("first", F.coalesce("seen", "first")))
        jump = label.select("run_id", F.col("place").alias("next"), F.col("first").alias("far"))
        step = cut(step.join(jump, ["run_id", "next"], "left").select("run_id", "place", F.least("next", "far").alias("next"), "first"))
        label = step.select("run_id", "place", F.col("next").alias("first"))
        if step.filter("next <> first").isEmpty():
            break
    out = n.join(label, ["run_id", "place"])
    called = out.groupBy("run_id", "first").agg(F.min_by("name", F.struct(-F.length("name"), F.col("place"))).alias("canonical"))
    return out.join(called, ["run_id", "first"]).select("run_id", "name", "canonical")


def _sorted_words(x: str) -> str:
    return " ".join(sorted("".join(c if c.isalnum() else " " for c in x.lower()).split()))


def propose(headers: list[str]) -> dict[str, str]:
    """The column most like the names of each field; fields without one are left out."""
    known = {f: [_sorted_words(n) for n in names] for f, names in FIELD_NAMES.items()}
    found = {}
    for field, names in known.items():
        likeness = [max(indel_ratio(_sorted_words(h), n) for n in names) for h in headers]
        if likeness and max(likeness) >= HEADER_LIKENESS:
            found[field] = headers[likeness.index(max(likeness))]
    return found


def proposed(headers: Column) -> Column:
    """map of field to column for an array of header names."""

    @F.pandas_udf("map<string,string>")
    def by_name(some: pd.Series) -> pd.Series:
        return some.map(lambda h: propose(list(h)) if h is not None else {})

    return by_name(headers)
