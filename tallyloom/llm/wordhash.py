"""Word hashes of many texts at once with numpy, and rows packed for a shuffle.

Words are runs of anything but the ASCII white space \\x20 and \\x09-\\x0D; the cut is
made on UTF-8 bytes, which is the same. A word's hash is a polynomial over random
64-bit byte values, modulo 2^64, read off running sums and mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer: spreads every bit of a 64-bit value."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.ones(size, U)
            up, down = ones.copy(), ones.copy()
            up[1:] = U(_BASE)
            down[1:] = U(pow(_BASE, -1, 1 << 64))
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _segments(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space, so that no word is divided and memory stays bounded."""
    at = 0
    while at < len(buf):
        end = min(at + _SEGMENT, len(buf))
        while end < len(buf):
            gap = np.flatnonzero(_SPACE[buf[end : end + _SEGMENT]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + _SEGMENT, len(buf))
        yield at, end
        at = end


def hash_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, end of each text in that order)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    table = _FOLDED if fold else _BYTES
    hashes, starts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for lo, hi in _segments(buf):
        part = buf[lo:hi]
        edge = np.diff(np.concatenate(([False], ~_SPACE[part], [False])).astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers.get(len(part) + 1)
        run = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * up[:-1], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)))
        starts.append(s + lo)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.cumsum(lengths))


def windows(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k words side by side (also across texts: the caller drops those)."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    w = mix(words + U(salt)) if salt else words
    up, down = _powers.get(n + 1)
    run = np.zeros(n + 1, U)
    np.cumsum(w * up[:n], out=run[1:])
    return mix((run[k:] - run[:-k]) * down[: n - k + 1])


def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word: the number of its text, and its place in it."""
    n = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), n)
    return text, np.arange(len(text)) - np.repeat(ends - n, n)


def chunks(pdf: pd.DataFrame, text: str, size: int = 4 << 20) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows in runs of about ``size`` bytes of text, encoded as they come; null counts as empty."""
    raw: list[bytes] = []
    at, total, last = 0, 0, len(pdf) - 1
    for k, t in enumerate(pdf[text]):
        raw.append(t.encode() if isinstance(t, str) else b"")
        total += len(raw[-1])
        if total >= size or k == last:
            yield pdf.iloc[at : k + 1], raw
            at, total, raw = k + 1, 0, []


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


def packed(bucket: np.ndarray, columns: list[np.ndarray], kind: int = 0) -> pd.DataFrame:
    """Entries as one row per bucket: (bucket, kind, the columns' bytes one after another)."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut, ends = groups(bucket)
    load = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cut, ends, strict=True)]
    return pd.DataFrame({"bucket": bucket[cut].astype(np.int32), "kind": np.int32(kind), "load": load})


def unpacked(loads: list[bytes], types: list[str]) -> list[np.ndarray]:
    """The columns of several packed rows, one after another."""
    width = sum(np.dtype(t).itemsize for t in types)
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for x in loads:
        n, at = len(x) // width, 0
        for p, t in zip(parts, types, strict=True):
            p.append(np.frombuffer(x, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def repacked(parts: Iterator[list[np.ndarray]], kind: int, limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Entries of many parts, each led by its home bucket, packed when ``limit`` are held: a
    task sends one row a bucket, not one for every bucket that it has read."""
    held: list[list[np.ndarray]] = []
    n = 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= limit:
            b, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            yield packed(b.astype(np.int64), columns, kind)
            held, n = [], 0
    if held:
        b, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        yield packed(b.astype(np.int64), columns, kind)


PACKED = "bucket int, kind int, load binary"


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of one bucket at a time, from input sorted by bucket."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for b, part in pdf.groupby("bucket", sort=False):
            if held and held[0]["bucket"].iat[0] != b:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)
