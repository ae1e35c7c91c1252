"""Conversation prefix trie from composable fingerprints.

A conversation is rebuilt as the head of its group's first conversation followed by its
own turns after as many. Rebuilt texts are never written: a turn is a reference (128 bits
of its role and text), a run of turns is an element (hash, power of the base by its
length) of a monoid, and the fingerprint of a rebuilt prefix is the product of the base's
head and of a stretch of the conversation's own turns, both known from prefix products of
the turns as they stand. Two lanes of 64 bits are held side by side.

Prefixes with one fingerprint and depth form a node. Nodes are verified through the turn
references: the last turn of all members has to be one reference (with equal fingerprints
the prefixes before it are then equal in fingerprint, too, down to the root), and each
reference has to stand for one role and text in the whole table. Where either fails, the
trie is built anew with other references.

Nothing walks the tree level by level, so depth costs no rounds:

* a leaf counts for the nodes of one of its members, the smallest;
* a node's tokens are kept with its smallest member. The nodes kept with one conversation
  are the lower end of its path, so a subtree's sum is the sum over its members of all
  that is kept with them, less what the smallest member keeps above the node.

Prefix products are taken in ranges of (conversation, turn) side by side; what a range
hands to the next is one element, so a conversation of any length is no task of its own.
Joins broadcast hot keys with a bound (``hot.lookup``), the members that end at a node are
joined to pieces in ranges before the digest reads them in order.

Defined cases: rows without a conv_id belong to no conversation and are left out; null
turns come first, equal turns of a conversation are ordered by their reference, repeated
rows are turns of their own; null role and text count as empty; very long texts are read
once for their reference; an empty table has no node; extra columns are not read. A
conversation whose group has no first conversation has no head; ids below zero are grouped
by the remainder's sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.hot import lookup
from tallyloom.llm.sql import crc32_sql
from tallyloom.llm.store import materialize

U = np.uint64
MASK = (1 << 64) - 1
#: odd, so that powers have inverses modulo 2^64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASES)
HEADS, GROUP = 6, 100
#: nodes of one conversation whose tokens are summed in one step
STRETCH = 4096
NODE = ["depth", "f1", "f2"]
PREFIX = "_part int, conv_id long, n long, f1 long, f2 long, r1 long, r2 long, chars long"


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2^64, bit by bit of the exponents."""
    out, square, n = np.ones(len(n), U), base, n.astype(U)
    while n.any():
        out = np.where(n & U(1), out * U(square), out)
        square, n = square * square & MASK, n >> U(1)
    return out


def run_products(values: np.ndarray, base: int) -> np.ndarray:
    """Product of each prefix of ``values``: values[0] * base^i + ... + values[i]."""
    at = np.arange(len(values))
    return np.cumsum(values * powers(INVERSE[BASES.index(base)], at), dtype=U) * powers(base, at)


def turn_references(turns: DataFrame, salt: int) -> DataFrame:
    """conv_id, turn, ref (16 bytes of role and text), chars of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.lit(f"{salt}:"), F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(told.cast("binary"))).alias("ref"), F.length(text).cast("long").alias("chars"),
        role.alias("role"), text.alias("text"),
    )


def references_hold(turns: DataFrame) -> bool:
    """No reference stands for two different turns."""
    told = F.struct("role", "text")
    found = turns.groupBy("ref").agg(F.min(told).alias("a"), F.max(told).alias("b"))
    return found.filter("a <> b").isEmpty()


def _local_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix products of each conversation inside one range, in the order of its rows."""
    part = TaskContext.get().partitionId()
    last, count, carry = None, 0, [U(0), U(0)]
    for pdf in batches:
        if not len(pdf):
            continue
        conv = pdf["conv_id"].to_numpy(np.int64)
        refs = np.frombuffer(b"".join(pdf["ref"]), ">u8").astype(U).reshape(-1, 2)
        new = np.concatenate(([True], conv[1:] != conv[:-1]))
        if last is not None and conv[0] == last:
            new[0] = False
        start = np.flatnonzero(new | (np.arange(len(conv)) == 0))
        run = np.repeat(start, np.diff(np.append(start, len(conv))))
        n = np.arange(len(conv)) - run + 1
        going_on = (run == 0) & ~new[0]
        whole = n + np.where(going_on, count, 0)
        out = {"_part": np.int32(part), "conv_id": conv, "n": whole}
        for lane, base in enumerate(BASES):
            h = run_products(refs[:, lane], base)
            before = np.where(run > 0, h[run - 1], U(0))
            h = h - before * powers(base, n)
            h = h + np.where(going_on, carry[lane] * powers(base, n), U(0))
            out[f"f{lane + 1}"] = h.view(np.int64)
            carry[lane] = h[-1]
        out["r1"], out["r2"], out["chars"] = refs[:, 0].copy().view(np.int64), refs[:, 1].copy().view(np.int64), pdf["chars"].to_numpy(np.int64)
        last, count = conv[-1], int(whole[-1])
        yield pd.DataFrame(out)


def prefix_products(refs: DataFrame) -> DataFrame:
    """conv_id, n (from 1), f1, f2 (product of the first n turns), r1, r2, chars."""
    order = ("conv_id", F.asc_nulls_first("turn"), "ref")
    ranges = refs.select("conv_id", "turn", "ref", "chars").repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ranges.mapInPandas(_local_products, PREFIX), "trie-products")
    # conversations that go over the edge of a range: at most one an edge
    ends = sorted(map(tuple, local.groupBy("_part").agg(F.min("conv_id"), F.max("conv_id")).collect()))
    over = sorted({b[1] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not over:
        return local.drop("_part")
    wanted = F.broadcast(refs.sparkSession.createDataFrame([(c,) for c in over], "conv_id long"))
    tails = local.join(wanted, "conv_id").groupBy("conv_id", "_part").agg(F.max("n"), F.max_by("f1", "n"), F.max_by("f2", "n")).collect()
    carries, at = {}, {}
    for conv, part, n, *f in sorted(map(tuple, tails)):
        before, g = at.get(conv, (0, (0, 0)))
        carries[part, conv] = (before, *g)
        at[conv] = (before + n, tuple((x * pow(b, n, 1 << 64) + y) & MASK for x, y, b in zip(g, f, BASES)))

    def lift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = list(zip(pdf["_part"], pdf["conv_id"]))
            found = [carries.get(k, (0, 0, 0)) for k in keys]
            n = pdf["n"].to_numpy(np.int64)
            for lane, base in enumerate(BASES):
                head = np.array([c[lane + 1] for c in found], U)
                f = pdf[f"f{lane + 1}"].to_numpy(np.int64).view(U) + head * powers(base, n)
                pdf[f"f{lane + 1}"] = f.view(np.int64)
            pdf["n"] = n + np.array([c[0] for c in found], np.int64)
            yield pdf.drop(columns="_part")

    schema = PREFIX.split(", ", 1)[1]
    return materialize(local.mapInPandas(lift, schema), "trie-products")


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Own turns behind a head: product = own prefix + base^(turns behind the head) * (head - own head)."""
    for pdf in batches:
        past = (pdf["n"] - pdf["h"]).to_numpy(np.int64)
        out = {"conv_id": pdf["conv_id"], "depth": past + pdf["head_n"].to_numpy(np.int64)}
        for lane, base in enumerate(BASES):
            col = lambda c: pdf[f"{c}{lane + 1}"].to_numpy(np.int64).view(U)  # noqa: B023, E731
            out[f"f{lane + 1}"] = (col("f") + powers(base, past) * (col("head_f") - col("own_f"))).view(np.int64)
        out |= {c: pdf[c] for c in ("r1", "r2", "chars")}
        out["ends"] = pdf["n"] == pdf["n_own"]
        yield pd.DataFrame(out)


def rebuilt(products: DataFrame, heads: int = HEADS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(a row for each turn of each rebuilt conversation: conv_id, depth, fingerprint,
    reference, chars, whether it is the last), (one row a conversation), both written."""
    mine = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    at_head = [F.coalesce(F.max(F.when(F.col("n") == mine, F.col(f))), F.lit(0).cast("long")) for f in ("f1", "f2")]
    own = products.groupBy("conv_id").agg(F.max("n").alias("n_own"), at_head[0].alias("own_f1"), at_head[1].alias("own_f2"))
    own = own.withColumns({"h": mine, "base": F.col("conv_id") - F.col("conv_id") % group})
    first = products.filter((F.col("conv_id") % group == 0) & (F.col("n") < heads))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("n", "f1", "f2", "r1", "r2", "chars"))).alias("head"))
    convs = own.join(first, "base", "left")
    kept = F.slice("head", F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("head", F.coalesce(kept, F.array().cast(first.schema["head"].dataType))).withColumn("head_n", F.size("head").cast("long"))
    last = F.get("head", F.col("head_n").cast("int") - 1)
    zero = F.lit(0).cast("long")
    convs = materialize(convs.withColumns({"head_f1": F.coalesce(last["f1"], zero), "head_f2": F.coalesce(last["f2"], zero)}), "trie-convs")
    heads_in = convs.select("conv_id", "h", "n_own", "head_n", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.n").alias("depth"), "t.f1", "t.f2", "t.r1", "t.r2", "t.chars",
        ((F.col("t.n") == F.col("head_n")) & (F.col("n_own") <= F.col("h"))).alias("ends"),
    )
    needed = convs.select("conv_id", "h", "n_own", "own_f1", "own_f2", "head_n", "head_f1", "head_f2", F.col("n_own").alias("uses"))
    behind = lookup(products, needed, ["conv_id"]).filter("n > h")
    rows = heads_in.unionByName(behind.mapInPandas(_composed, heads_in.schema))
    return materialize(rows, "trie-rows"), convs


def _with_parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parent's fingerprint: the last turn taken off again."""
    for pdf in batches:
        for lane in (0, 1):
            f, r = (pdf[f"{c}{lane + 1}"].to_numpy(np.int64).view(U) for c in "fr")
            pdf[f"p{lane + 1}"] = ((f - r) * U(INVERSE[lane])).view(np.int64)
        yield pdf


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted members as pieces of joined decimals: one a node and batch."""
    for pdf in batches:
        runs = (pdf[NODE] != pdf[NODE].shift()).any(axis=1).cumsum()
        told = pdf["conv_id"].astype(str).groupby(runs).agg(",".join)
        at = ~runs.duplicated()
        out = pdf.loc[at, NODE].copy()
        out["first"], out["piece"] = pdf.loc[at, "conv_id"], told.to_numpy()
        yield out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each node in order, as they come by."""
    key, digest = None, None
    for pdf in batches:
        done = []
        for *node, piece in zip(*(pdf[c] for c in NODE), pdf["piece"]):
            if node != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) rows -> node, ends_sha256. Digests read pieces, not members."""
    order = [*NODE, "conv_id"]
    schema = "depth long, f1 long, f2 long, first long, piece string"
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_pieces, schema)
    there = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return there.mapInPandas(_digests, "depth long, f1 long, f2 long, ends_sha256 string")


def build(conversations: DataFrame, heads: int = HEADS, group: int = GROUP, salt: int = 0) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the reference (r1, r2) of its last turn."""
    turns = turn_references(conversations, salt)
    products = prefix_products(materialize(turns.drop("role", "text"), "trie-turns"))
    rows, convs = rebuilt(products, heads, group)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("r1", "r2") for n, f in (("low", F.min), ("high", F.max))]
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), *bounds)
    found = materialize(found, "trie-groups")
    if not found.filter("low_r1 <> high_r1 OR low_r2 <> high_r2").isEmpty() or not references_hold(turns):
        return build(conversations, heads, group, salt + 1)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*NODE, "r1", "r2")], "conv_id", "n_convs", zero.alias("kept"))
    nodes = found.select(*NODE, F.col("low_r1").alias("r1"), F.col("low_r2").alias("r2"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("kept"))
    nodes = nodes.unionByName(root)
    told = ", ".join(f"{c} long" for c in (*nodes.columns, "p1", "p2"))
    nodes = nodes.mapInPandas(_with_parents, told)
    above = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    nodes = nodes.join(above.agg(F.count("*").alias("n_children")), NODE, "left").na.fill(0, ["n_children"])
    # what the smallest member keeps above a node, in two steps: whole stretches, then inside one
    nodes = nodes.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    nodes = materialize(nodes, "trie-nodes")
    whole = nodes.groupBy("conv_id", "stretch").agg(F.sum("kept").alias("kept"))
    up = Window.orderBy("stretch").partitionBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "stretch", F.coalesce(F.sum("kept").over(up), zero).alias("far"))
    near = Window.orderBy("depth").partitionBy("conv_id", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    over = nodes.withColumn("near", F.coalesce(F.sum("kept").over(near), zero)).join(whole, ["conv_id", "stretch"])
    # what each conversation keeps, and whether it speaks for a leaf; its path ends at its last node
    leaf = (F.col("n_children") == 0).cast("long")
    keeps = materialize(nodes.groupBy("conv_id").agg(F.sum("kept").alias("all_kept"), F.max(leaf).alias("leaf"), F.max("depth").alias("uses")), "trie-keeps")
    members = lookup(rows.select("conv_id", *NODE), keeps, ["conv_id"])
    sums = members.groupBy(*NODE).agg(F.sum("all_kept").alias("all_kept"), F.sum("leaf").alias("n_leaves"))
    sums = sums.unionByName(keeps.agg(*[zero.alias(c) for c in NODE], F.sum("all_kept").alias("all_kept"), F.sum("leaf").alias("n_leaves")))
    turnless = convs.filter("head_n = 0 AND n_own <= h").select(*[zero.alias(c) for c in NODE], "conv_id")
    ends = end_digests(rows.filter("ends").select(*NODE, "conv_id").unionByName(turnless))
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses")
    )
    known = lookup(nodes.filter("depth > 0").select(*NODE, "p1", "p2"), materialize(parents, "trie-parents"), ["depth", "p1", "p2"])
    out = over.join(sums, NODE).join(ends, NODE, "left").join(known.drop("p1", "p2"), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_kept") - F.col("near") - F.col("far")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "r1", "r2",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return build(conversations).drop("r1", "r2")


_REF = "md5('0:' || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, {_REF}) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
  SELECT conv_id, ts, {crc32_sql("conv_id::VARCHAR")} % {HEADS} AS h, conv_id - conv_id % {GROUP} AS base FROM t
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN t b ON b.conv_id = c.base
), m AS (
  SELECT conv_id, d, ts[1:d] AS path, ts[d].text AS last, len(ts) = d AS here FROM r, range(0, 100000) x(d) WHERE d <= len(ts)
), n AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256
  FROM m GROUP BY d, path
), k AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(z.c, 0) AS n_children FROM n
  LEFT JOIN n p ON n.d = p.d + 1 AND n.path[1:n.d - 1] = p.path
  LEFT JOIN (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS c FROM n WHERE d > 0 GROUP BY 1, 2) z ON z.d = n.d AND z.path = n.path
), s AS (
  SELECT v.d, v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * coalesce(length(u.last), 0)) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS at FROM k) u JOIN k v ON v.d = u.at AND v.path = u.path[1:u.at] GROUP BY v.d, v.path
)
SELECT k.conv_id, k.d AS depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (d, path)
"""
