"""Who sent a payment: fuzzy match of bank lines to clients with a margin.

A line is a client's from a score of ``threshold`` on if no other client comes within
``margin``. So only scores above threshold less margin matter, and all of those are found
without comparing all pairs:

* a ratio that high leaves few letters unmatched: lines go down a tree of the names' beginnings
  together and leave it where too many letters are lost or new, so a line meets the names that
  begin like it, not all of them (lines of more than 64 letters are held against all names by
  lengths and 256-bit signatures of letter pairs);
* an abbreviation needs every word of the line to start a word of the name or the reverse,
  so the line's rarest word is looked up by as many of its letters as it has.

Lines and names are dealt into blocks of bounded size; each pair of blocks is one call. Scores of threshold less margin and
below are reported as 0. Where only the sender is asked for (``decide``), scores of ``SURE`` and
above come first, from a join on what is left of both keys without a letter or two; lines that
those decide are not compared any further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyloom.functions.text import clean_description, normalise_name
from tallyloom.sources.lineage import cut, written

THRESHOLD = 85
MARGIN = 6
#: 64-bit words of a signature; lines and names of a block, more or less
WORDS, BLOCK_LINES, BLOCK_NAMES = 4, 4_096, 100_000
#: scores found by the join on shortened keys, and letters that are left out at most
SURE, LEFT_OUT = 92, 2
#: letters of a word's beginning by which it is looked up
LEVELS = (2, 3, 4, 6, 9, 13, 20)


def indel_ratio(a: str, b: str) -> int:
    """0-100: 200 * longest common subsequence / sum of lengths, by bit rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return round(200 * common / (len(a) + len(b)))


def abbreviation(line: list[str], name: list[str]) -> int:
    """Every word of the line starts a word of the name (or the reverse), in order."""
    if not line or not name or len(line) > len(name) or len(line) == 1 < len(name):
        return 0
    rest = iter(name)
    # any() leaves the iterator behind the word that it stopped at: the next word goes on there
    if not all(any(n.startswith(w) or w.startswith(n) for n in rest) for w in line):
        return 0
    return round(80 + 20 * len(line) / len(name))


def signatures(keys: list[str]) -> np.ndarray:
    """Bits of the letter pairs of each key, its ends marked: ``WORDS`` 64-bit words a key."""
    size = np.array([len(k) + 2 for k in keys], np.int64)
    flat = np.frombuffer("".join(f"^{k}$" for k in keys).encode(), np.uint8).astype(np.uint64)
    pair = np.ones(max(len(flat) - 1, 0), bool)
    pair[np.cumsum(size)[:-1] - 1] = False  # not from one key to the next
    owner = np.repeat(np.arange(len(keys)), size)[:-1][pair]
    bit = ((flat[:-1] * np.uint64(257) + flat[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))[pair] % np.uint64(64 * WORDS)
    out = np.zeros((len(keys), WORDS), np.uint64)
    np.bitwise_or.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Names:
    """Keys of a block: letters in a table, lengths, signatures, and by length a tree of their
    beginnings: ``trees[m]`` lists for each depth the first child of every node (and the end),
    the letters of the nodes, and last the keys in the order of the leaves."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.size = np.array([len(k) for k in keys], np.int64)
        self.letters = np.zeros((len(keys), int(self.size.max(initial=0))), np.uint8)
        self.letters[np.arange(self.letters.shape[1]) < self.size[:, None]] = np.frombuffer("".join(keys).encode(), np.uint8)
        self.signs = signatures(keys)
        self.trees = {int(m): self._tree(np.flatnonzero(self.size == m), int(m)) for m in np.unique(self.size) if m}

    def _tree(self, which: np.ndarray, m: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        table = np.ascontiguousarray(self.letters[which, :m])
        order = np.argsort(table.view(f"S{m}").ravel(), kind="stable")
        table, which = table[order], which[order]
        fresh = np.zeros(len(which), bool)
        fresh[0] = True
        node, first, letter = np.zeros(len(which), np.int64), [], []
        for d in range(m):
            # a node begins where its parent does, or where its letter differs from the one before
            fresh[1:] |= table[1:, d] != table[:-1, d]
            starts = np.flatnonzero(fresh)
            first.append(np.searchsorted(node[starts], np.arange(node[-1] + 2)))
            letter.append(table[starts, d])
            node = np.cumsum(fresh) - 1
        return first, letter, np.searchsorted(node, np.arange(node[-1] + 2)), which

    def possible(self, signs: np.ndarray, n: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, name) that lengths and letter pairs do not rule out.

        With ``both`` letters in common, a line of n letters loses n - both and gains
        m - both: a letter lost breaks two of its pairs, a letter gained one."""
        kinds, kind = np.unique(n, return_inverse=True)
        both = -(-(2 * floor - 1) * (kinds[:, None] + self.size) // 400)
        gone, new = kinds[:, None] - both, self.size - both
        lost = np.where((gone >= 0) & (new >= 0), 2 * gone + new, -1).astype(np.int16)
        missing = np.zeros((len(n), len(self.size)), np.int16)
        for w in range(WORDS):
            missing += np.bitwise_count(signs[:, w, None] & ~self.signs[:, w])
        a, b = np.nonzero(missing <= lost[kind])
        back = np.bitwise_count(self.signs[b] & ~signs[a]).sum(axis=1, dtype=np.int64)
        keep = back <= 2 * new[kind[a], b] + gone[kind[a], b]
        return a[keep], b[keep]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) of all x from start[k] to end[k] - 1."""
    size = end - start
    k = np.repeat(np.arange(len(size)), size)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + start[k]


def walked(masks: np.ndarray, n: np.ndarray, names: Names, m: int, floor: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, names, letters in common) of all names of m letters that reach ``floor``, down
    their tree, at most about ``most`` pairs of line and node at a time.

    With c letters in common needed, a line of n letters may lose n - c and gain m - c. After d
    letters of a name the pair lives on if the line's first d - (m - c) + (n - c) letters have
    d - (m - c) in common with them: no other way leads to c."""
    first, letter, leaf, which = names.trees[m]
    need = np.maximum(-(-(2 * floor - 1) * (n + m) // 400), 1)
    lines = np.flatnonzero((need <= n) & (need <= m))
    todo = [(0, lines, np.zeros(len(lines), np.int64), np.where(n[lines] == 64, ~np.uint64(0), (np.uint64(1) << n[lines].astype(np.uint64)) - np.uint64(1)))]
    while todo:
        d, line, node, row = todo.pop()
        if not len(line):
            continue
        if d == m:
            k, at = _ranges(leaf[node], leaf[node + 1])
            yield line[k], which[at], n[line[k]] - np.bitwise_count(row[k]).astype(np.int64)
            continue
        size = first[d][node + 1] - first[d][node]
        if len(line) > 1 and size.sum() > most:
            half = len(line) // 2
            todo += [(d, line[half:], node[half:], row[half:]), (d, line[:half], node[:half], row[:half])]
            continue
        k, node = _ranges(first[d][node], first[d][node + 1])
        line, row = line[k], row[k]
        mask = masks[line, letter[d][node]]
        u = row & mask
        row = (row + u) | (row - u)
        gained = d + 1 - (m - need[line])
        reach = (gained + n[line] - need[line]).clip(0, 64).astype(np.uint64)
        seen = np.where(reach == 64, ~np.uint64(0), (np.uint64(1) << (reach & np.uint64(63))) - np.uint64(1))
        full = np.where(n[line] == 64, ~np.uint64(0), (np.uint64(1) << (n[line].astype(np.uint64) & np.uint64(63))) - np.uint64(1))
        row &= full
        keep = np.bitwise_count(~row & seen) >= gained
        todo.append((d + 1, line[keep], node[keep], row[keep]))


def near_pairs(lines: list[str], names: Names, floor: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(lines, names, ratios) of the keys that reach ``floor``, and how many pairs were compared
    to their last letter. Lines of up to 64 letters go down the trees of the names, longer ones
    are held against all names by signatures."""
    n = np.array([len(k) for k in lines], np.int64)
    short = np.flatnonzero((n > 0) & (n <= 64))
    masks = np.zeros((len(short), 256), np.uint64)
    for k, at in enumerate(short):
        for p, ch in enumerate(lines[at].encode()):
            masks[k, ch] |= np.uint64(1 << p)
    for m in names.trees:
        for a, b, common in walked(masks, n[short], names, m, floor, most):
            yield short[a], b, np.rint(200 * common / (n[short[a]] + m)).astype(np.int64), len(a)
    long = np.flatnonzero(n > 64)
    step = max(1, most // max(len(names.keys), 1))
    for at in range(0, len(long), step):
        part = long[at : at + step]
        a, b = names.possible(signatures([lines[k] for k in part]), n[part], floor)
        ratio = np.array([indel_ratio(lines[part[x]], names.keys[y]) for x, y in zip(a, b, strict=True)], np.int64)
        good = ratio >= floor
        yield part[a[good]], b[good], ratio[good], len(a)


def _scored(floor: int) -> Callable:
    """Task: a block of lines against a block of names; a row with no line tells the pairs compared."""
    def run(lines: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out, compared = [], 0
        if len(lines) and len(names):
            block, ids = Names(names["_kb"].tolist()), names["_cid"].to_numpy()
            line, scope = lines["_line"].to_numpy(), lines["_scope"].iat[0]
            for a, b, ratio, n in near_pairs(lines["_ka"].tolist(), block, floor):
                out += [(scope, x, y, int(s)) for x, y, s in zip(line[a], ids[b], ratio)]
                compared += n
        return pd.DataFrame([*out, (None, None, None, compared)], columns=["_scope", "_line", "_cid", "_s"], dtype=object)

    return run


def near_names(lines: DataFrame, names: DataFrame, floor: int) -> DataFrame:
    """_scope, _line, _cid, _s of all lines and names with a ratio of ``floor`` or more, and
    rows without a line whose _s is how many pairs were compared letter by letter."""
    a, b = lines.filter("_ka <> ''"), names.filter("_kb <> ''")
    n = a.groupBy("_scope").agg(F.count("*").alias("_l")).join(b.groupBy("_scope").agg(F.count("*").alias("_m")), "_scope")
    blocks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    n = n.select("_scope", blocks("_l", BLOCK_LINES).alias("_nl"), blocks("_m", BLOCK_NAMES).alias("_nn"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    a = a.join(n, "_scope").withColumns({"_bl": mine("_line", "_nl"), "_bn": every("_nn")}).select("_scope", "_bl", "_bn", "_line", "_ka")
    b = b.join(n, "_scope").withColumns({"_bn": mine("_kb", "_nn"), "_bl": every("_nl")}).select("_scope", "_bl", "_bn", "_cid", "_kb").toDF("_scope", "_bl", "_bn", "_cid", "_kb")
    by = ["_scope", "_bl", "_bn"]
    kind = names.schema["_cid"].dataType.simpleString()
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(_scored(floor), f"_scope string, _line string, _cid {kind}, _s long")


@F.pandas_udf(IntegerType())
def _abbreviation(line: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([abbreviation(list(a), list(b)) for a, b in zip(line, name, strict=True)], dtype="int32")


def abbreviated_names(lines: DataFrame, names: DataFrame) -> DataFrame:
    """_scope, _line, _cid, _s of all lines whose words start the words of a name, in order."""
    heads = lambda w: F.transform(F.filter(F.array(*map(F.lit, LEVELS)), lambda k: k <= F.length(w)), lambda k: F.substr(w, F.lit(1), k))
    star, bare = lambda h: F.concat(h, F.lit("*")), lambda h: F.concat(h, F.lit("="))
    # the shorter of two words is looked up by its longest head: a line's among all heads of the
    # names' words, a name's among all heads of the line's words
    told = F.flatten(F.transform("_wb", lambda w: F.concat(F.transform(heads(w), star), F.array(bare(F.element_at(heads(w), -1))))))
    there = names.select("_scope", "_cid", "_wb", F.explode(F.array_distinct(told)).alias("_at"))
    asked = lambda w: F.concat(F.array(star(F.element_at(heads(w), -1))), F.transform(heads(w), bare))
    ways = lines.filter(F.size("_wa") > 0).select("_scope", "_line", F.posexplode("_wa").alias("_k", "_w"))
    ways = ways.select("_scope", "_line", "_k", F.explode(asked(F.col("_w"))).alias("_at"))
    often = there.groupBy("_scope", "_at").agg(F.count("*").alias("_n"))
    # both sums of a line in one place
    each = ways.join(often, ["_scope", "_at"]).repartition("_scope", "_line").groupBy("_scope", "_line", "_k").agg(F.sum("_n").alias("_n"))
    told_of = each.groupBy("_scope", "_line").agg(F.min_by("_k", F.struct("_n", "_k")).alias("_k"), F.count("*").alias("_m"))
    rarest = lines.join(told_of, ["_scope", "_line"]).filter(F.col("_m") == F.size("_wa"))  # each word starts some name's
    rarest = rarest.select("_scope", "_line", "_wa", F.explode(asked(F.get("_wa", F.col("_k")))).alias("_at"))
    met = rarest.join(there, ["_scope", "_at"]).filter((F.size("_wa") <= F.size("_wb")) & ((F.size("_wa") > 1) | (F.size("_wb") == 1)))
    starts = lambda c: F.transform(c, lambda w: F.substring(w, 1, 2))
    met = met.filter(F.size(F.array_except(starts("_wa"), starts("_wb"))) == 0)
    return met.withColumn("_s", _abbreviation("_wa", "_wb")).filter("_s > 0").select("_scope", "_line", "_cid", "_s")


@F.pandas_udf(IntegerType())
def _ratio(line: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([100 if a == b else indel_ratio(a, b) for a, b in zip(line, name, strict=True)], dtype="int32")


def _shortened(key: Column, n: int) -> Column:
    """What is left of a key without ``n`` letters, each once."""
    out = F.array(key)
    for _ in range(n):
        less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
        out = F.array_distinct(F.flatten(F.transform(out, less)))
    return out


def sure_names(lines: DataFrame, names: DataFrame, floor: int = SURE) -> tuple[DataFrame, list[int]]:
    """(_scope, _line, _cid, _s of all ratios of ``floor`` or more, lengths of the lines' keys for
    which that is so). Two keys with c letters in common are equal once each has lost the others:
    keys are joined on what is left without them, for the lengths where that is few."""
    a, b = (x.filter(F.col(k) != "").withColumn("_n", F.length(k)) for x, k in ((lines, "_ka"), (names, "_kb")))
    n, m = ([r["_n"] for r in x.select("_n").distinct().collect()] for x in (a, b))  # one row a length
    need = {(i, j): max(1, -(-(2 * floor - 1) * (i + j) // 400)) for i in n for j in m}
    need = {p: c for p, c in need.items() if c <= min(p)}
    wide = {i for (i, j), c in need.items() if max(i, j) - c > LEFT_OUT}
    need = {p: c for p, c in need.items() if p[0] not in wide}

    def without(x: DataFrame, key: str, side: int) -> DataFrame:
        less = {k: sorted({p[side] - c for p, c in need.items() if p[side] == k}) for k in {p[side] for p in need}}
        ways = F.array().cast("array<string>")
        for k, gone in less.items():
            ways = F.when(F.col("_n") == k, F.concat(*[_shortened(F.col(key), g) for g in gone])).otherwise(ways)
        return x.select("_scope", *[c for c in x.columns if c in ("_line", "_cid", key)], F.explode(ways).alias("_x"))

    met = without(a, "_ka", 0).join(without(b, "_kb", 1), ["_scope", "_x"]).drop("_x").distinct()
    scored = met.withColumn("_s", _ratio("_ka", "_kb").cast("long")).filter(F.col("_s") >= floor)
    return scored.select("_scope", "_line", "_cid", "_s"), sorted(set(n) - wide)


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def _best(scored: DataFrame) -> DataFrame:
    """The best and the next score of each line."""
    scored = scored.groupBy("_scope", "_line", "_cid").agg(F.max("_s").alias("_s"))
    order = Window.partitionBy("_scope", "_line").orderBy(F.desc("_s"), "_cid")
    return scored.withColumns({"_r": F.row_number().over(order), "_next": F.coalesce(F.lead("_s").over(order), F.lit(0))}).filter("_r = 1")


def attribute(
    payments: DataFrame, clients: DataFrame, threshold: int = THRESHOLD, margin: int = MARGIN, within: tuple[str, ...] = (), decide: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """payments(txn_id, client_id, description), clients(client_id, name) -> ``within``, txn_id,
    client_id (null: nobody surely), score, runner_up. A known client_id stays at 100.

    ``within``: columns of both sides (the run) inside which lines meet clients. ``decide``: the
    clients and scores are asked for; a runner-up that is too far off to matter may be told as 0.
    ``keep``: columns of the payments that ride along."""
    floor = threshold - margin + 1
    scope = F.to_json(F.struct(*within)) if within else F.lit("")
    # lines without a client are dealt by themselves, not into one task
    deal = F.when(F.col("client_id").isNull(), 1 + F.pmod(F.xxhash64("txn_id"), F.lit(1 << 20))).otherwise(0)
    p = payments.withColumns({"_scope": scope, "_deal": deal})
    names = clients.filter("client_id IS NOT NULL").select(scope.alias("_scope"), F.col("client_id").alias("_cid"), F.coalesce("name", F.lit("")).alias("_name"))
    known = names.select("_scope", F.col("_cid").alias("client_id"), F.col("_cid").alias("_known"), F.lit(0).cast("long").alias("_deal")).distinct()
    p = p.join(known, ["_scope", "client_id", "_deal"], "left")
    p = p.withColumn("_line", F.when(F.col("_known").isNull(), clean_description(F.col("description")))).select(*within, "txn_id", *keep, "_scope", "_known", "_line")
    names = names.withColumns({"_kb": normalise_name(F.col("_name")), "_wb": _words(F.col("_name"))})
    if decide:
        p, names = written(p, "payments"), cut(names)
    lines = p.filter("_known IS NULL AND _line <> ''").select("_scope", "_line").distinct()
    lines = lines.withColumns({"_ka": normalise_name(F.col("_line")), "_wa": _words(F.col("_line"))})
    if decide:
        lines = cut(lines)
    open_, keys, scored = lines.drop("_wa"), names.select("_scope", "_cid", "_kb").distinct(), abbreviated_names(lines, names).filter(F.col("_s") >= floor)
    if decide and floor < SURE:
        alike, lengths = sure_names(open_, keys)
        scored = cut(scored.unionByName(alike))
        # what is not known is below SURE: too far from the best, or the next is too close already
        told = _best(scored).filter((F.col("_s") >= SURE) & ((F.col("_s") >= SURE + margin - 1) | (F.col("_s") - F.col("_next") < margin)))
        told = told.select("_scope", "_line", F.lit(True).alias("_told"))
        open_ = open_.join(told, ["_scope", "_line"], "left").filter(F.col("_told").isNull() | ~F.length("_ka").isin(*lengths, 0)).drop("_told")
    scored = scored.unionByName(near_names(open_, keys, floor).filter("_line IS NOT NULL"))
    top = _best(scored)
    sure = (F.col("_s") >= threshold) & (F.col("_s") - F.col("_next") >= margin)
    top = top.select("_scope", "_line", F.when(sure, F.col("_cid")).alias("_who"), F.col("_s").alias("_score"), F.col("_next").alias("_runner"))
    fixed = F.col("_known").isNotNull()
    if decide:  # p is written: known lines need not meet the scores
        out = p.filter(~fixed).join(top, ["_scope", "_line"], "left").unionByName(p.filter(fixed), allowMissingColumns=True)
    else:
        out = p.join(top, ["_scope", "_line"], "left")
    return out.select(
        *within, "txn_id", *keep, F.when(fixed, F.col("_known")).otherwise(F.col("_who")).alias("client_id"),
        F.when(fixed, 100).otherwise(F.coalesce("_score", F.lit(0))).alias("score"),
        F.when(fixed, 0).otherwise(F.coalesce("_runner", F.lit(0))).alias("runner_up"),
    )
