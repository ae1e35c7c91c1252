"""Ids at the ends of their range, null ids, and one repeated id among many, against brute force."""

import collections
import hashlib
import random

import pytest

from tallyloom.llm import jaccard_join, substring_dedup

LEAST, MOST = -(2**63), 2**63 - 1
rnd = random.Random(17)
WORDS = [f"w{k}" for k in range(4000)]


def text(n):
    return " ".join(rnd.choices(WORDS, k=n))


def rows_with(extra):
    """Copies, near copies and shared passages over ordinary ids, and the rows of ``extra``."""
    whole, passage = text(90), text(70)
    texts = [whole, whole, whole + " end", f"{text(9)} {passage} {text(12)}", f"{passage} {text(30)}", text(80), "", None, text(3)]
    rows = [(10 + k, t) for k, t in enumerate(texts)]
    return rows + [(i, [whole, whole + " more", f"{text(5)} {passage}", text(60), whole][k % 5]) for k, i in enumerate(extra)]


CASES = {
    "ends": [LEAST, MOST, LEAST + 1, MOST - 1, 0, -1],
    "ends with nulls": [LEAST, None, None, MOST, None, MOST, None],
    "one repeated id": [LEAST, 12, 12, 12, MOST, 0],
    "only the largest": [MOST],
    "only the smallest": [LEAST, LEAST],
}


def cut_brute(rows, length=50):
    """Row by row; null ids come after all others and are one id."""
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min(first.get(x, place(i)), place(i))
    out = collections.Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < place(i):
                gone |= set(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def class_brute(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            named = rows[a][0] is not None and rows[b][0] is not None
            if named and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
    small = {}
    for (i, _), r in zip(rows, root, strict=True):
        small[r] = i if small.get(r) is None or i is None else min(i, small[r])
    return collections.Counter((i, len(s), small[r]) for (i, _), s, r in zip(rows, sets, root, strict=True))


@pytest.mark.parametrize("case", sorted(CASES))
def test_substring_dedup_keeps_every_id(spark, case):
    rows = rows_with(CASES[case])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(tuple(r[:4]) for r in substring_dedup.remove_repeats(df).collect()) == cut_brute(rows)


@pytest.mark.parametrize("case", sorted(CASES))
def test_jaccard_join_keeps_every_id(spark, case):
    rows = rows_with(CASES[case])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert got == class_brute(rows)


def test_ids_beyond_float_precision_beside_nulls(spark):
    rows = [(2**53 + 1, text(40)), (None, text(40)), (2**53 + 3, text(40)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = jaccard_join.near_duplicates(df).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter((i, i) for i, _ in rows)
