"""Best-fit packing with exact-complement hashing over a histogram of lengths.

Whole documents are encoded once in Arrow-fed tasks that return narrow piece rows
(no ids travel). Piece lengths are at most ``CAPACITY``, so their histogram has at
most that many rows, whatever the input: on it the plan is made. For each length,
longest first, the gap to the capacity is looked up among single lengths, then sums
of two, then sums of three, and combinations that fill it exactly are consumed as
often as the counts allow; what is left is placed best-fit, longest first. The plan
says which ranks of a length go to which run of sequences; a join by length and rank
gives every piece its sequence and offset.

Ranks within a length are taken in cells by a hash of the id, as many as its pieces need,
so a length that a third of all pieces share is not ranked in one task.

Defined cases: a null text counts as empty and is the closing id alone; a very long text
is cut into full pieces and a rest; rows with the same id, null ids too, are packed one by
one; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

CAPACITY = 2048
END_ID = 0
#: pieces of one length that are ranked in one task; from ``SPREAD`` on a length is cut into up to RANK_CELLS cells
RANK_CELL, RANK_CELLS, SPREAD = 50_000, 32, 256
#: bytes of stretches kept with their ids in a worker before the table is emptied (memory only)
KNOWN_BYTES = 32 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of stretches between plain spaces, as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are
    its stretches' ids in a row; stretches repeat, texts hardly do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # how a Latin letter reaches the merges: normalized alone (letters below U+0250
        # do not combine with each other), then spelt in the byte alphabet
        spell, fold = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
        self.letters = {i: "".join(x for x, _ in spell(fold(chr(i)))) for i in range(0x250) if fold(chr(i)).isalpha()}
        self.latin = re.compile("[" + "".join(map(chr, self.letters)) + "]+").fullmatch
        self.marks = {m: self._ids(m) for m in ".,"}
        self.held = 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def _ids(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, stretches: set[str]) -> None:
        if self.held > KNOWN_BYTES:
            self.clear()
        before = len(self)
        merge, new = self.tokenizer.model.tokenize, []
        for s in stretches:
            if s in self:
                continue
            mark = s[-1:] if s[-1:] in self.marks else ""
            word = s[:-1] if mark else s
            if not self.latin(word):
                new.append(s)
                continue
            ids = self.get(word)
            if ids is None:
                ids = array("I", [t.id for t in merge(word.translate(self.letters))]).tobytes()
            self[s] = ids + self.marks[mark] if mark else ids
        for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[s] = np.array(e.ids, "<u4").tobytes()
        # two objects and a slot, besides what they hold (mostly one byte a letter, four an id)
        self.held += 180 * (len(self) - before) + sum(map(len, new)) * 5

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*parts))
        return [b"".join(map(self.__getitem__, p)) for p in parts]


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table a worker process, kept over its tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it starts in its document, its length, crc of its ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(path)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256]
                rows = []
                for d, ids in zip(some[doc_id], known.encode([t or "" for t in some[text]]), strict=True):
                    ids = ids + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        known.clear()  # the worker may go on to other work

    return docs.select(doc_id, text).mapInPandas(cut, PIECE)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Histogram -> (times, length, length, ...): how often each combination is used."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan: list[tuple[int, ...]] = []

    def use(combo: tuple[int, ...]) -> bool:
        need = Counter(combo)
        times = min(left[n] // k for n, k in need.items())
        if times <= 0:
            return False
        for n, k in need.items():
            left[n] -= k * times
        plan.append((int(times), *sorted(combo, reverse=True)))
        return True

    if left[capacity]:
        use((capacity,))
    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        if not left[n]:
            continue
        if gap <= n:
            use((n, gap))
        a = np.arange(1, gap // 2 + 1)
        for x in a[(left[a] > 0) & (left[gap - a] > 0)][::-1] if left[n] else ():
            if not left[n]:
                break
            if gap - x <= n:
                use((n, int(x), int(gap - x)))
        for x in range(gap // 3, 0, -1) if left[n] else ():
            if not left[n]:
                break
            if not left[x]:
                continue
            b = np.arange(x, (gap - x) // 2 + 1)
            for y in b[(left[b] > 0) & (left[gap - x - b] > 0)][::-1]:
                if not left[n] or not left[x]:
                    break
                use((n, int(x), int(y), int(gap - x - y)))
    # residuals: best fit, longest first, on bins of equal content at once
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    by_gap: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            fit = next((g for g in range(n, capacity) if by_gap.get(g)), None)
            if fit is None:
                each = capacity // n
                full, rest = divmod(int(left[n]), each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        combo = (n,) * k
                        if not bins[combo]:
                            by_gap[capacity - n * k].append(combo)
                        bins[combo] += times
                left[n] = 0
                continue
            combo = by_gap[fit][-1]
            times = int(min(bins[combo], left[n]))
            bins[combo] -= times
            if not bins[combo]:
                by_gap[fit].pop()
            grown = (*combo, n)
            if not bins[grown]:
                by_gap[fit - n].append(grown)
            bins[grown] += times
            left[n] -= times
    return plan + [(times, *combo) for combo, times in bins.items() if times]


def places(plan: list[tuple[int, ...]]) -> list[tuple[int, int, int, int, int]]:
    """Plan -> (length, first rank, end rank, first sequence, offset)."""
    used: Counter = Counter()
    rows, first = [], 0
    for times, *lengths in plan:
        at = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, first, at))
            used[n] += times
            at += n
        first += times
    return rows


def pack(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path or tokenizer_path(), doc_id, text, capacity), "pieces")
    # at most ``capacity`` rows, whatever the input
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = [(n, max(-(-c // RANK_CELL), min(RANK_CELLS, -(-c // SPREAD)))) for n, c in by_length.items()]
    parts = F.broadcast(spark.createDataFrame(parts, "length long, _cells long"))
    cut = cut.join(parts, "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_cells").cast("int")).drop("_cells")
    cells = cut.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    found = cells.collect()  # a row for RANK_CELL pieces, RANK_CELLS at most for a rarer length
    counts: Counter = Counter()
    starts = []
    for r in sorted(found):
        starts.append((r["length"], r["_cell"], counts[r["length"]]))
        counts[r["length"]] += r["n"]
    bases = spark.createDataFrame(starts, "length long, _cell int, _base long")
    spots = spark.createDataFrame(
        places(plan_sequences(counts, capacity)), "length long, _lo long, _hi long, _first long, _at long"
    )
    k = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    # both tables are bounded by the capacity, not by the input
    ranked = cut.withColumn("_k", k).join(F.broadcast(bases), ["length", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_k"))
    spots = F.broadcast(spots.withColumnRenamed("length", "_length"))
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return ranked.join(spots, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_at").alias("offset"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return pack(docs)
