"""Quotes that stand nearly word for word in documents: all quotes against all documents.

A quote is near a document if the shorter of the two is like a stretch of the longer: twice
the letters in common over both lengths reach 92 of 100. Stretches have the shorter's length,
or less where they are cut off by an end of the longer.

With n letters at most 16 of 100 n letters are missing or put in, and each breaks one of the
shorter's pieces at most. So of its n // 5 pieces of five letters a known number stands
unchanged, and their diagonals (place in the longer less place in the shorter) lie no further
apart than the letters that differ. Shorter and longer texts are dealt into blocks of bounded
size that meet in pairs; inside such a pair, pieces are looked up at all places of the longer
texts (those that a bitmap of the pieces lets through), hits are counted by overlapping bands
of diagonals, and only where enough different pieces fall into a band is the stretch compared,
with bit rows, at the starts that the band allows. Hits never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import flatten
from tallyloom.sources.lineage import cut

#: hundredths of likeness; shortest quote that counts as evidence
NEAR, LEAST = 92, 20
PIECE = 5
#: bits of a block's bitmap of pieces; letters that a block of shorter and of longer texts holds, about
BITS = 1 << 20
SHORT_BLOCK, LONG_BLOCK = 1_000_000, 4_000_000


def edits(n: int) -> int:
    """Letters missing and put in at most where n letters are near a stretch."""
    return 2 * (100 - NEAR) * n // 100


def piece_length(n: int) -> int:
    return PIECE if n >= LEAST else n // (edits(n) + 1)


def _common(masks: dict[str, int], size: int, text: Iterable[str]) -> Iterator[int]:
    """Letters in common with the first 1, 2, 3 ... letters of ``text``."""
    row = full = (1 << size) - 1
    for ch in text:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
        yield size - row.bit_count()


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def best_stretch(short: str, long: str, starts: Iterable[int]) -> float:
    """Best ratio of ``short`` with the stretches of ``long`` that begin at ``starts``; those
    that begin before the text or run over its end are cut off there."""
    n, size = len(short), len(long)
    masks = _masks(short)
    best, over = 0.0, [False, False]
    for at in starts:
        if at < 0:
            over[0] = True
        elif at + n > size:
            over[1] = True
        else:
            common = 0
            for common in _common(masks, n, long[at : at + n]):
                pass
            best = max(best, 100 * common / n)
    for cut_off, key, text in ((over[0], masks, long[: n - 1]), (over[1], _masks(short[::-1]), long[: -n : -1] if n > 1 else "")):
        if cut_off:
            for m, common in enumerate(_common(key, n, text), 1):
                best = max(best, 200 * common / (n + m))
    return best


def partial_ratio(quote: str, document: str) -> float:
    """Best ratio of the shorter with a stretch of the longer if it reaches ``NEAR``, else less."""
    best = 0.0
    for short, long in ((quote, document), (document, quote)):
        if not short or len(short) > len(long):
            continue
        n, e, size = len(short), edits(len(short)), piece_length(len(short))
        starts: set[int] = set()
        for at in range(0, n - size + 1, size):
            hit = -1
            while (hit := long.find(short[at : at + size], hit + 1)) >= 0:
                starts.update(range(hit - at - e, hit - at + e + 1))
        best = max(best, best_stretch(short, long, starts))
    return best


def _rolled(text: str, size: int) -> np.ndarray:
    """Hash of every run of ``size`` letters."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for j in range(size if n > 0 else 0):
        h = (h + c[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Pieces:
    """The disjoint pieces of the shorter texts of a block, by length and hash."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        n = np.array([len(t) for t in texts], np.int64)
        self.n, self.e = n, 2 * (100 - NEAR) * n // 100
        size = np.array([piece_length(len(t)) for t in texts], np.int64)
        self.stand = n // size - self.e
        self.by_size = {}
        for k in np.unique(size):
            some = np.flatnonzero(size == k)
            hashes = [_rolled(texts[i], int(k))[::k] for i in some]
            h, owner = np.concatenate(hashes), np.repeat(some, [len(x) for x in hashes])
            place = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            known = np.zeros(BITS, bool)
            known[(h & np.uint64(BITS - 1)).astype(np.int64)] = True
            self.by_size[int(k)] = (h[order], owner[order], place[order], known)

    def bands(self, text: str) -> Iterator[tuple[int, int]]:
        """(short text, band of diagonals) with as many different pieces as have to stand."""
        for size, (hashes, owner, place, known) in self.by_size.items():
            h = _rolled(text, size)
            at = np.flatnonzero(known[(h & np.uint64(BITS - 1)).astype(np.int64)])
            low, high = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            count = high - low
            hit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            q, o, p = owner[hit], place[hit], np.repeat(at, count)
            fits = self.n[q] <= len(text)
            q, o, p = q[fits], o[fits], p[fits]
            if not len(q):
                continue
            # bands twice as wide as the letters that may differ, half over each other
            band = (p - o * size) // (self.e[q] + 1)
            q, o, band = np.tile(q, 2), np.tile(o, 2), np.concatenate([band, band - 1])
            first, kinds = band.min(), o.max() + 1
            bands = band.max() - first + 1
            each, n = np.unique(np.unique((q * bands + band - first) * kinds + o) // kinds, return_counts=True)
            q, band = each // bands, each % bands + first
            good = n >= self.stand[q]
            yield from zip(q[good].tolist(), band[good].tolist())


def _near_in(shorts: pd.DataFrame, longs: pd.DataFrame) -> pd.DataFrame:
    """A block of shorter texts against one of longer texts: the pairs that are near."""
    best: dict[tuple, float] = {}
    if len(shorts) and len(longs):
        pieces, ids = Pieces(shorts["text"].tolist()), shorts["id"].tolist()
        for long_id, text in zip(longs["id"].tolist(), longs["text"], strict=True):
            for q, band in pieces.bands(text):
                e = int(pieces.e[q])
                ratio = best_stretch(pieces.texts[q], text, range(band * (e + 1) - e, (band + 2) * (e + 1) + e))
                if ratio >= NEAR:
                    best[ids[q], long_id] = max(ratio, best.get((ids[q], long_id), 0.0))
    return pd.DataFrame([(*k, r) for k, r in best.items()], columns=["short_id", "long_id", "ratio"])


def near_stretches(short: DataFrame, long: DataFrame) -> DataFrame:
    """short(id, text) and long(id, text) -> short_id, long_id, ratio of all pairs where the
    short text is near a stretch of the long one; texts are compared as they are."""
    ids = lambda df: df.schema["id"].dataType.simpleString()
    letters = lambda df: df.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n, m = (-(-letters(df) // most) or 1 for df, most in ((short, SHORT_BLOCK), (long, LONG_BLOCK)))
    own = lambda k: F.pmod(F.xxhash64("id", "text"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    a = short.filter("text <> '' AND id IS NOT NULL").select(own(n).alias("i"), every(m).alias("j"), "id", "text").toDF("i", "j", "id", "text")
    b = long.filter("text <> '' AND id IS NOT NULL").select(every(n).alias("i"), own(m).alias("j"), "id", "text").toDF("i", "j", "id", "text")
    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(_near_in, f"short_id {ids(short)}, long_id {ids(long)}, ratio double")
    return found.groupBy("short_id", "long_id").agg(F.max("ratio").alias("ratio"))


def near_verbatim(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quotes(item_id, text) and documents(doc_id, text) -> item_id, doc_id, ratio of all quotes
    of 20 letters or more that stand in a document or nearly so, or the document in them; white
    space and case aside. Null and empty texts have no partner."""
    q = cut(quotes.select(F.col("item_id").alias("id"), flatten(F.col("text")).alias("text")).filter(F.length("text") >= LEAST))
    d = documents.select(F.col("doc_id").alias("id"), flatten(F.col("text")).alias("text"))
    longest = q.agg(F.max(F.length("text"))).first()[0] or 0
    one = near_stretches(q, d).select(F.col("short_id").alias("item_id"), F.col("long_id").alias("doc_id"), "ratio")
    # documents that are no longer than some quote
    few = cut(d.filter(F.length("text").between(1, longest)))
    other = near_stretches(few, q).select(F.col("long_id").alias("item_id"), F.col("short_id").alias("doc_id"), "ratio")
    return one.unionByName(other).groupBy("item_id", "doc_id").agg(F.max("ratio").alias("ratio"))
