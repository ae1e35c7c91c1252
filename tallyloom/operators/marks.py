"""Quotes marked in the escaped text they were taken from.

A quote is looked up as it stands; failing that by its first fourteen words (four at least)
whatever the white space between. Spans are chosen on the text as it is, quotes in order: each
takes its first place that touches no span taken before. The looser search runs on the squeezed
text; a map of runs leads each of its letters back to the text. Escapes, marks and breaks are
put in once, in one pass over the pieces between the spans.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tallyloom.functions.batches import by_row

#: Words that the looser search takes at most and at least.
MOST, FEWEST = 14, 4
OPEN = {"exact": '<mark class="exact">', "loose": '<mark class="loose">'}
MARKED = "struct<html:string,marks:array<struct<place:int,start:int,end:int,how:string>>>"


class Squeezed:
    """A text with each run of white space as one space, and where its letters stand in the text."""

    def __init__(self, text: str):
        words = list(re.finditer(r"\S+", text))
        self.text = " ".join(m.group() for m in words)
        size = np.array([m.end() - m.start() for m in words], np.int64)
        #: where each word begins in the squeezed text and in the text
        self.flat = np.cumsum(size + 1) - size - 1
        self.raw = np.array([m.start() for m in words], np.int64)

    def back(self, at: int) -> int:
        """Place in the text of a letter of the squeezed text."""
        k = int(np.searchsorted(self.flat, at, "right")) - 1
        return int(self.raw[k] + at - self.flat[k])


def _first(text: str, needle: str, free) -> tuple[int, int] | None:
    at = text.find(needle)
    while at >= 0:
        if free(at, at + len(needle)):
            return at, at + len(needle)
        at = text.find(needle, at + 1)
    return None


def spans(text: str, quotes: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(number of the quote, start, end, how), in order of place."""
    taken: list[tuple[int, int, int, str]] = []
    squeezed = None

    def free(a: int, b: int) -> bool:
        return all(b <= lo or hi <= a for _, lo, hi, _ in taken)

    for k, quote in enumerate(quotes):
        if not quote or not quote.strip():
            continue
        hit, how = _first(text, quote, free), "exact"
        words = quote.split()[:MOST]
        if hit is None and len(words) >= FEWEST:
            squeezed = squeezed or Squeezed(text)
            real = lambda a, b: (squeezed.back(a), squeezed.back(b - 1) + 1)
            hit, how = _first(squeezed.text, " ".join(words), lambda a, b: free(*real(a, b))), "loose"
            hit = real(*hit) if hit else None
        if hit:
            taken.append((k, *hit, how))
    return sorted(taken, key=lambda s: s[1])


def render(text: str, found: list[tuple[int, int, int, str]]) -> str:
    out, at = [], 0
    for _, a, b, how in found:
        out += [html.escape(text[at:a]), OPEN[how], html.escape(text[a:b]), "</mark>"]
        at = b
    return "".join([*out, html.escape(text[at:])]).replace("\n", "<br>")


def marked(text: Column, quotes: Column) -> Column:
    """struct(html, marks) of a text and the array of its quotes; a null text is none."""

    kind = StructType.fromDDL(f"x {MARKED}")["x"].dataType
    arrow = to_arrow_type(kind)

    def one(t: str | None, q: list[str | None] | None) -> dict:
        found = spans(t, q or []) if t is not None else []
        return {"html": None if t is None else render(t, found), "marks": [{"place": k, "start": a, "end": b, "how": how} for k, a, b, how in found]}

    @F.arrow_udf(kind)
    def rows(text: pa.Array, quotes: pa.Array) -> pa.Array:
        return by_row(one, arrow, text, quotes)

    return rows(text, quotes)


def unmarked(texts: DataFrame) -> DataFrame:
    """texts(doc_id, quotes, marked) -> doc_id, place, quote of the quotes that stand nowhere."""
    q = texts.select("doc_id", F.transform("marked.marks", lambda m: m["place"]).alias("_at"), F.posexplode("quotes").alias("place", "quote"))
    return q.filter(~F.array_contains("_at", F.col("place"))).drop("_at")
