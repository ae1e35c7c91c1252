"""Where a quoted clause stands on the pages of a document."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from tallyloom.functions.questions import percentage_stated
from tallyloom.functions.text import absent_quote, flatten, fold_typography
from tallyloom.operators.corpus import verbatim_hits
from tallyloom.operators.near import LEAST, NEAR, partial_ratio
from tallyloom.sources.lineage import written

#: Lengths of the stretches of a quote that are searched, longest first.
LADDER = (None, 240, 160, 80)
#: Hundredths that a window must resemble a quote, and share of its words that a page must use.
RATIO = 75
OVERLAP = 35
WORD = "[a-z0-9][a-z0-9,.$%-]*"
#: letters that a block of quotes and of pages holds, about
QUOTE_BLOCK, PAGE_BLOCK = 1_000_000, 2_000_000
STOPWORDS = frozenset("the of and or to in for a an by on at as is be shall will with from that this such any all each per its it not".split())


def probes(clause):
    """Array of (order, stretch) of a quote; stretches under 20 characters are left out."""
    whole = F.regexp_replace(fold_typography(clause), "^[\\s.·…\"'‘’“”]+|[\\s.·…\"'‘’“”]+$", "")
    parts = F.array(*[whole if n is None else F.trim(F.substring(whole, 1, n)) for n in LADDER])
    return F.transform(F.filter(F.array_distinct(parts), lambda p: F.length(p) >= LEAST), lambda p, i: F.struct(i.alias("ord"), p.alias("probe")))


def vocabulary(text: str) -> set[str]:
    """Words worth matching on, of a lower-cased text: four characters, or with a digit."""
    return {w for w in re.findall(WORD, text) if w not in STOPWORDS and (len(w) >= 4 or any(c.isdigit() for c in w))}


def _vocabulary(x: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOPWORDS)) & ((F.length(w) >= 4) | w.rlike("[0-9]")))


def letter_masks(needle: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(needle):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def window_ratio(needle: str, page: str, masks: dict[str, int] | None = None, least: int = 0) -> int:
    """Best Indel ratio of a quote with the windows of its length, a quarter of it apart; what is
    below ``least`` may be told as 0. ``masks``: as from ``letter_masks``, if they are at hand."""
    size = len(needle)
    masks = letter_masks(needle) if masks is None else masks
    full = (1 << size) - 1

    def ratio(window: str, target: int) -> int:
        row, n = full, len(window)
        need = (target - 0.5) * (size + n) / 200
        for at in range(0, n, 32):
            for ch in window[at : at + 32]:
                u = row & masks.get(ch, 0)
                row = ((row + u) | (row - u)) & full
            # too little even if all letters that are left are in common
            if size - row.bit_count() + max(n - at - 32, 0) < need:
                return 0
        return round(200 * (size - row.bit_count()) / (size + n))

    if len(page) <= size * 1.2:
        return ratio(page, least)
    best = 0
    for at in range(0, len(page) - size + 1, max(size // 4, 8)):
        best = max(best, ratio(page[at : at + size], max(best + 1, least)))
        if best >= 97:
            break
    return best


@F.pandas_udf(IntegerType())
def _likeness(needle: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([window_ratio(q, t) for q, t in zip(needle, page, strict=True)], dtype="int32")


def _alike(met: DataFrame, needles: DataFrame, pages: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of _sharing() whose page uses enough of the quote's words, with ``_s``, their likeness,
    from a ratio of 75."""
    words = pages.select("doc_id", "page", "_t", _vocabulary(F.col("_t")).alias("_pv"))
    both = met.join(needles.select("clause_id", *within, "_n", "_v"), ["clause_id", *within]).join(words, ["doc_id", "page"])
    both = both.filter(100 * F.size(F.array_intersect("_v", "_pv")) >= OVERLAP * F.size("_v"))
    return both.select("clause_id", "doc_id", "page", _likeness("_n", "_t").alias("_s")).filter(F.col("_s") >= RATIO)


def _alike_in(quotes: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
    """A block of quotes against a block of pages: the words in common are counted from lists of
    the quotes that have a word; only where they are enough is a page compared."""
    out = []
    if len(quotes) and len(pages):
        ids, needles = quotes["clause_id"].tolist(), quotes["_n"].tolist()
        masks = [letter_masks(q) for q in needles]
        asked: dict[str, list[int]] = {}
        size = np.zeros(len(needles), np.int64)
        for k, q in enumerate(needles):
            words = vocabulary(q)
            size[k] = len(words)
            for w in words:
                asked.setdefault(w, []).append(k)
        holders = {w: np.array(k) for w, k in asked.items()}
        for doc, page, text in zip(pages["doc_id"], pages["page"], pages["_t"], strict=True):
            met = [holders[w] for w in vocabulary(text) if w in holders]
            shared = np.bincount(np.concatenate(met), minlength=len(size)) if met else np.zeros(len(size), np.int64)
            for k in np.flatnonzero(100 * shared >= OVERLAP * size).tolist():
                s = window_ratio(needles[k], text, masks[k], RATIO)
                if s >= RATIO:
                    out.append((ids[k], doc, page, s))
    return pd.DataFrame(out, columns=["clause_id", "doc_id", "page", "_s"])


def alike_pages(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """clause_id, doc_id, page, _s of all quotes and pages that use enough of the quote's words and
    are like it from a ratio of 75. Blocks of quotes meet blocks of pages in pairs: pages travel
    once for each block of quotes, pairs of a quote and a page never do."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    needles = _needles(clauses).filter("clause_id IS NOT NULL").select("clause_id", "_n")
    folded = _folded(pages).filter("doc_id IS NOT NULL AND page IS NOT NULL")
    letters = lambda df, c: df.agg(F.sum(F.length(c).cast("long"))).first()[0] or 0
    n, m = -(-letters(needles, "_n") // QUOTE_BLOCK) or 1, -(-letters(pages, "text") // PAGE_BLOCK) or 1
    own = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    a = needles.select(own(n, "clause_id", "_n").alias("_i"), every(m).alias("_j"), "clause_id", "_n")
    b = folded.select(every(n).alias("_i"), own(m, "doc_id", "page").alias("_j"), "doc_id", "page", "_t")
    shape = f"clause_id {kind(clauses, 'clause_id')}, doc_id {kind(pages, 'doc_id')}, page {kind(pages, 'page')}, _s int"
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(_alike_in, shape)


def _needles(clauses: DataFrame) -> DataFrame:
    """clause_id, needle and words of the quotes that are long enough to be searched."""
    c = clauses.withColumn("_n", F.lower(F.get(probes(F.col("clause_text")), 0)["probe"])).filter("_n IS NOT NULL")
    return c.drop("clause_text").withColumn("_v", _vocabulary(F.col("_n")))


def _sharing(needles: DataFrame, pages: DataFrame, within: list[str]) -> DataFrame:
    """clause_id, doc_id, page of all pairs that can share enough words.

    A page with 35 of 100 words of a quote has one of any 66 of them, so the rarest such
    part is joined on. A quote without such words meets every page. ``within``: columns
    that both sides have in common.
    """
    words = pages.select("doc_id", "page", F.explode(_vocabulary(F.col("_t"))).alias("_w"))
    asked = needles.select("clause_id", *within, F.size("_v").alias("_k"), F.explode("_v").alias("_w"))
    often = words.join(F.broadcast(asked.select("_w").distinct()), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_f"))
    rank = F.row_number().over(Window.partitionBy("clause_id", *within).orderBy(F.coalesce("_f", F.lit(0)), "_w"))
    rare = asked.join(often, "_w", "left").withColumn("_r", rank)
    rare = rare.filter(F.col("_r") <= F.col("_k") - F.floor((F.col("_k") * OVERLAP + 99) / 100) + 1).select("clause_id", *within, "_w")
    met = words.join(rare, ["_w", *within]).select("clause_id", "doc_id", "page")
    plain = needles.filter(F.size("_v") == 0).select("clause_id", *within)
    every = pages.select("doc_id", "page")
    every = every.join(plain, within) if within else every.crossJoin(plain)
    return met.unionByName(every.select("clause_id", "doc_id", "page")).distinct()


def _folded(pages: DataFrame) -> DataFrame:
    # out of an array of one: the filter does not fold a second time
    text = F.inline_outer(F.array(F.struct(F.lower(fold_typography(F.col("text"))).alias("_t"))))
    return pages.select("doc_id", "page", text).filter(F.length("_t") >= LEAST)


def exact_pages(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """(clause_id, doc_id, page) of pages that hold the quote's shortest stretch, case aside."""
    p = _folded(pages)
    least = clauses.select(F.col("clause_id").alias("item_id"), F.get(F.reverse(probes(F.col("clause_text"))), 0)["probe"].alias("text")).filter("text IS NOT NULL")
    exact = verbatim_hits(least, p.select(F.struct("doc_id", "page").alias("doc_id"), F.col("_t").alias("text")))
    return exact.select(F.col("item_id").alias("clause_id"), "doc_id.doc_id", "doc_id.page")


def candidates(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """clauses(clause_id, clause_text), pages(doc_id, page, text) -> all (clause_id, doc_id)
    that locate() can place: pages that hold the shortest stretch or share enough words."""
    exact = exact_pages(clauses, pages).select("clause_id", "doc_id")
    return exact.unionByName(alike_pages(clauses, pages).select("clause_id", "doc_id")).distinct()


def exact_places(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """clause_id, doc_id, page and ord of the longest stretch found, then the first page.
    Where ``clauses`` tells the pages that can hold a quote, as exact_pages() does, no others are looked at."""
    on = [c for c in ("doc_id", "page") if c in clauses.columns]
    p = pages.select("doc_id", "page", fold_typography(F.col("text")).alias("_t"))
    c = clauses.withColumn("_p", F.explode(probes(F.col("clause_text")))).select("clause_id", *on, "_p.ord", "_p.probe")
    hits = c.join(p, on).filter(F.contains("_t", "probe"))
    return hits.groupBy("clause_id", "doc_id").agg(F.min(F.struct("ord", "page")).alias("_b")).select("clause_id", "doc_id", "_b.page", "_b.ord")


def locate(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """clauses(clause_id, doc_id, clause_text), pages(doc_id, page, text) -> page and
    method: the longest stretch found wins, then the first page ('exact'); else the page with
    the window most like the quote, from a ratio of 75, then the first ('fuzzy'); else 'failed'."""
    one = exact_places(clauses, pages)
    left = _needles(clauses.join(one, ["clause_id", "doc_id"], "left_anti").select("clause_id", "doc_id", "clause_text"))
    t = _folded(pages)
    like = _alike(_sharing(left, t, ["doc_id"]), left, t, ["doc_id"])
    near = Window.partitionBy("clause_id", "doc_id").orderBy(F.desc("_s"), "page")
    like = like.withColumn("_r", F.row_number().over(near)).filter("_r = 1").select("clause_id", "doc_id", F.col("page").alias("_near"))
    out = clauses.select("clause_id", "doc_id").join(one, ["clause_id", "doc_id"], "left").join(like, ["clause_id", "doc_id"], "left")
    method = F.when(F.col("page").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy").otherwise("failed")
    return out.select("clause_id", "doc_id", F.coalesce("page", "_near").alias("page"), "ord", method.alias("method"))


def locate_all(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """locate() for all clauses(clause_id, clause_text) and all documents of pages(doc_id, page, text):
    clause_id, doc_id, page, method of those that are placed. Each page is compared once."""
    on = ["clause_id", "doc_id"]
    found = written(exact_pages(clauses, pages), "exact")
    some = pages.join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    one = exact_places(found.join(clauses, "clause_id"), some).select(*on, "page", F.lit("exact").alias("method"))
    like = alike_pages(clauses, pages).groupBy(*on).agg(F.min(F.struct((-F.col("_s")).alias("_s"), "page"))["page"].alias("page"))
    return one.unionByName(like.join(one.select(*on), on, "left_anti").withColumn("method", F.lit("fuzzy")))


@F.pandas_udf(DoubleType())
def _partial(quote: pd.Series, document: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(q, d) if q and d else 0.0 for q, d in zip(quote, document, strict=True)], dtype="float64")


def is_verbatim(quotes: DataFrame, quote: str = "quote", document: str = "document") -> DataFrame:
    """Add ``verbatim``: the quote has 20 letters at least and stands in the document, white
    space and case aside, or nearly so, or a shorter document in it (``near``). Only what does not stand there is compared by ratio."""
    flat = quotes.withColumns({"_q": flatten(F.coalesce(quote, F.lit(""))), "_d": flatten(F.coalesce(document, F.lit("")))})
    flat = flat.withColumn("_s", F.contains("_d", "_q"))
    long = F.length("_q") >= LEAST
    ratio = _partial(F.when(long & ~F.col("_s"), F.col("_q")), F.when(long & ~F.col("_s"), F.col("_d")))
    return flat.withColumn("verbatim", long & (F.col("_s") | (ratio >= NEAR))).drop("_q", "_d", "_s")


def ground(quotes: DataFrame) -> DataFrame:
    """quotes(..., kind, quote, percentage, document) with status: blank (no quote is given),
    dropped (not in the document), bad_figure (the rate is not in the quote; milestones have
    none) or kept. ``grounded``: the quote stands, whatever becomes of its rate."""
    q = is_verbatim(quotes)
    blank = absent_quote(F.col("quote"))
    rated = (F.col("kind") != "milestone") & F.col("percentage").isNotNull()
    bad = rated & ~percentage_stated(F.col("percentage"), F.col("quote"))
    status = F.when(blank, "blank").when(~F.col("verbatim"), "dropped").when(bad, "bad_figure").otherwise("kept")
    return q.withColumns({"status": status, "grounded": ~blank & F.col("verbatim")}).drop("verbatim")


def overlap(quote: Column, page: Column) -> Column:
    """Share of a quote's distinctive words that a page uses; null where it has none."""
    mine = _vocabulary(F.lower(quote))
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, _vocabulary(F.lower(page)))) / F.size(mine))


def rates(located: DataFrame) -> DataFrame:
    """Counts and percentages of quotes placed exactly, by likeness, and not at all."""
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.round(100.0 * F.count_if(c) / n, 1)).otherwise(0.0)
    m = F.col("method")
    return located.agg(
        n.alias("n"), share(m == "exact").alias("exact_pct"), share(m == "fuzzy").alias("fuzzy_pct"), share(m == "failed").alias("failed_pct"),
        share(m != "failed").alias("grounded_pct"),
    )
