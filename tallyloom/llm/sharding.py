"""Sharding by balanced label propagation over links between equal texts.

Every document starts in a shard by the hash of its id. In each round a group of
linked documents (equal texts) votes: its members want to be where most of them are,
among shards that still have room.
Joins carry the votes to the documents; a table of at most shards x shards flows
tells how many of them each shard can take, and whole groups (or, for a group too
large for one shard, single documents) are let through by a hash. Afterwards an
exact repair moves the documents over a shard's quota, those without links first, to
shards below it. Law ``rows``: counts are at most one apart.

Ranks inside a shard are taken in cells (shard, linked or not, hash of the group,
hash of the id), so that neither a shard nor a huge group is sorted in one task.

Defined cases: a null text is an empty one of size 8 and crc 0; a very long text counts
like any other, by its digest; rows with the same id, null ids too, are rows of their own
(equal rows fall to the same hashes and are told apart by rank alone); an empty table
gives an empty table; extra columns stay out of the moves and are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

SHARDS = 24
ROUNDS = 4
#: room over the even share that a shard may take during the rounds
SLACK = 0.02
GROUP_CELLS = 64
ROW_CELLS = 8


def nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp): the narrow rows that take part in the moves."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(t.cast("binary"))).alias("grp"),
    )


def _unit(*cols) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _admitted(flows: list, sizes: dict[int, int], room: float, shards: int) -> list[tuple[int, float]]:
    """For each shard the share of its would-be arrivals that fits (at most shards rows)."""
    arrive = {b: sum(r["n"] for r in flows if r["to"] == b) for b in range(shards)}
    leave = {a: sum(r["n"] for r in flows if r["shard"] == a) for a in range(shards)}
    return [
        (b, min(1.0, max(0.0, (room - sizes.get(b, 0) + leave[b]) / arrive[b])))
        for b in range(shards)
        if arrive[b]
    ]


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, grp) -> with shard and members (rows of its group)."""
    spark = rows.sparkSession
    start = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int")
    state = materialize(rows.withColumn("shard", start), "shard-0")
    total = state.count()
    room = total / shards * (1 + SLACK)
    for k in range(rounds):
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        full = [s for s, n in held.items() if n >= room]
        space = ~F.col("shard").isin(full) if full else F.lit(True)
        tallies = state.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        votes = tallies.groupBy("grp").agg(
            F.max_by("shard", F.struct(space, "n", F.xxhash64("grp", "shard"))).alias("to"), F.sum("n").alias("members")
        )
        # a written table: the join below is then one that Spark can split at a huge group
        votes = materialize(votes.filter("members > 1"), f"shard-votes-{k}")
        wish = state.select("doc_id", "size", "text_crc32", "grp", "shard").join(votes, "grp", "left")
        wish = wish.withColumn("to", F.coalesce("to", "shard"))
        wish = materialize(wish, f"shard-wish-{k}")
        flows = wish.filter("to <> shard").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()
        if not flows:
            return wish.drop("to")
        share = spark.createDataFrame(_admitted(flows, held, room, shards), "to int, share double")
        own = F.when(F.col("members") > room / 4, F.xxhash64("doc_id")).otherwise(F.lit(0))
        go = _unit("grp", own, F.lit(k)) < F.coalesce("share", F.lit(0.0))
        state = wish.join(F.broadcast(share), "to", "left").withColumn("shard", F.when(go, F.col("to")).otherwise(F.col("shard")))
        state = state.drop("to", "share")
    return materialize(state, "shard-last")


def settle(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Exact counts: what is over a shard's quota fills the shards below theirs; slots."""
    spark = state.sparkSession
    single = F.coalesce(F.col("members"), F.lit(1)) == 1
    rows = state.withColumns(
        {
            "_s": single.cast("int"),
            "_g": F.pmod(F.xxhash64("grp"), F.lit(GROUP_CELLS)).cast("int"),
            "_r": F.pmod(F.xxhash64("doc_id"), F.lit(ROW_CELLS)).cast("int"),
        }
    )
    cells = materialize(rows.groupBy("shard", "_s", "_g", "_r").agg(F.count("*").alias("_n")), "shard-cells")
    line = Window.partitionBy("shard").orderBy("_s", "_g", "_r").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_at", F.coalesce(F.sum("_n").over(line), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_s", "_g", "_r").orderBy("grp", "doc_id")
    rows = rows.withColumn("_k", F.row_number().over(inside)).join(cells, ["shard", "_s", "_g", "_r"])
    rows = rows.withColumn("_pos", F.col("_at") + F.col("_k") - 1)
    # a plan of at most 2 x shards rows: quota by shard, and who takes the rows over it
    have = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    order = sorted(range(shards), key=lambda s: (-have.get(s, 0), s))
    quota = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    plan, over, under = [], 0, []
    for s in range(shards):
        extra = have.get(s, 0) - quota[s]
        plan.append((s, quota[s], over))
        over += max(0, extra)
    at = 0
    for s in range(shards):
        lack = quota[s] - have.get(s, 0)
        if lack > 0:
            under.append((s, at, at + lack, have.get(s, 0)))
            at += lack
    quotas = spark.createDataFrame(plan, "shard int, quota long, over long")
    takers = spark.createDataFrame(under, "new_shard int, lo long, hi long, filled long")
    rows = rows.join(F.broadcast(quotas), "shard")
    rank = F.when(F.col("_pos") >= F.col("quota"), F.col("over") + F.col("_pos") - F.col("quota"))
    rows = rows.withColumn("_rank", rank)
    near = (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    rows = rows.join(F.broadcast(takers), near, "left")
    return rows.withColumn("slot", F.coalesce(F.col("filled") + F.col("_rank") - F.col("lo"), F.col("_pos"))).withColumn(
        "shard", F.coalesce("new_shard", "shard")
    )


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    return settle(propagate(nodes(docs, doc_id, text), shards, rounds), shards)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
