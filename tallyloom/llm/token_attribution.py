"""Token counts by section from offsets of whole-document encodings.

A document (its fields, joined by a newline) is encoded once. Byte-level tokens tile
the UTF-8 bytes, so running sums of token lengths are their spans. Sections - fields,
cut after every newline - tile the same bytes; both are sorted, and one merge
(``searchsorted``) joins the two interval lists inside the task that read the row.

A token that crosses a boundary is given to one section by ``rule``:
``start`` the section with its first byte, ``end`` the one with its last byte,
``majority`` the one with most of its bytes (the earliest of equals). So sections
add up to the document's tokens exactly.

Defined cases: a null field is empty and has one section of no characters; an empty
section counts 0; a very long text is encoded whole; rows with the same id, null ids too,
are counted one by one; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "doc_id long, field string, section int, start_char long, end_char long, n_tokens long, n_crossing long"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token byte lengths of a text, from a tiktoken vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(k) for k in ranks]

    def ends(self, text: str) -> np.ndarray:
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def section_starts(fields: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all sections and the field each belongs to; fields end in a newline."""
    starts, owner, at = [], [], 0
    for k, b in enumerate(fields):
        cuts = np.flatnonzero(np.frombuffer(b, np.uint8) == 10) + 1
        own = np.concatenate(([0], cuts[cuts < len(b)])) + at
        starts.append(own)
        owner.append(np.full(len(own), k))
        at += len(b) + 1
    return np.concatenate(starts), np.concatenate(owner)


def assign(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses a boundary."""
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    section = first.copy()
    bounds = np.concatenate((starts, [ends[-1] if len(ends) else 0]))
    for i in np.flatnonzero(crossing):
        k = np.arange(first[i], last[i] + 1)
        held = np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], begins[i])
        section[i] = k[np.argmax(held)]
    return section, crossing


def attribute_tokens(
    docs: DataFrame, fields: tuple[str, ...] = ("text",), doc_id: str = "doc_id", rule: str = "start", path: str | None = None
) -> DataFrame:
    """One row per document, field and section with its token count."""
    if rule not in ("start", "end", "majority"):
        raise ValueError(f"unknown rule {rule}")
    path = path or tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                some = pdf.iloc[lo : lo + 512]
                cols: list[list] = [[] for _ in range(7)]
                for d, *values in some.itertuples(index=False):
                    texts = [v if isinstance(v, str) else "" for v in values]
                    raw = [t.encode() for t in texts]
                    joined = b"\n".join(raw)
                    ends = encoder.ends("\n".join(texts))
                    starts, owner = section_starts(raw)
                    section, crossing = assign(ends, starts, rule)
                    n = len(starts)
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)))
                    stops = np.append(starts[1:], len(joined))
                    for out, v in zip(
                        cols,
                        (
                            np.full(n, d),
                            [fields[k] for k in owner],
                            np.arange(n) - np.searchsorted(owner, owner),
                            chars[starts],
                            chars[stops],
                            np.bincount(section, minlength=n),
                            np.bincount(section[crossing], minlength=n),
                        ),
                        strict=True,
                    ):
                        out.extend(v)
                yield pd.DataFrame(dict(zip([c.split()[0] for c in COLUMNS.split(", ")], cols, strict=True)))

    return docs.select(doc_id, *fields).mapInPandas(count, COLUMNS)


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's source and of each line of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return attribute_tokens(docs, ("source", "text"))
