"""Stored tables that are merged by key, several of them in one step.

A store is a folder of plain Parquet: each table's rows lie in one folder a partition (an
integer column, the run), and ``versions/00000012.json`` says which folders make up the
tables. ``merge`` joins changes to the partitions that they touch, writes what differs, then
those partitions anew where something differs, all into new folders; last it publishes the
next version by one rename. A reader sees the last version published: a job that dies half-way
leaves folders that no version names, and a rerun finds the old tables. Partitions without a
difference keep their folders, so a second merge of the same rows writes nothing.

What is held on the driver is one folder name a partition.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("inserted", "changed", "deleted", "kept")
_PART = "_part"


@dataclass
class Change:
    """Rows for a table. ``replace``: the touched partitions hold these rows and no others;
    ``upsert``: rows of other keys stay; ``update``: keys that are not there are passed over,
    and only the columns given change. ``parts``: partitions to be touched even without rows.
    ``at_rest``: the rows are read from written tables, no copy is made to work them out once."""

    rows: DataFrame
    keys: tuple[str, ...]
    mode: str = "replace"
    parts: list[int] = field(default_factory=list)
    at_rest: bool = False


class Conflict(RuntimeError):
    """Another writer has published the version that this merge was about to."""


class Store:
    def __init__(self, spark: SparkSession, root: str, by: str = "run_id"):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        jvm = spark._jvm
        self._path = lambda *at: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *at)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last version, 0 before the first merge."""
        at = self._path("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """{table: {schema, parts: {partition: folder}}} of a version."""
        n = self.version() if version is None else version
        if not n:
            return {}
        stream = self._fs.open(self._path("versions", f"{n:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, parts: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table as of one version, whatever is published while it is read."""
        table = (self.state() if state is None else state)[name]
        schema = StructType.fromJson(table["schema"])
        folders = [f for p, f in table["parts"].items() if parts is None or int(p) in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def merge(self, changes: dict[str, Change]) -> DataFrame:
        """All changes or none. Returns (table, partition column, kind, n)."""
        version = self.version()
        state = self.state(version)
        mark = uuid.uuid4().hex
        counts: list[tuple[str, int, str, int]] = []
        for name, change in changes.items():
            counts += self._staged(state, name, change, mark)
        if any(n for _, _, kind, n in counts if kind != "kept") or set(state) != set(self.state(version)):
            self._publish(version + 1, state)
        self._fs.delete(self._path("staging", mark), True)
        return self.spark.createDataFrame(counts, f"name string, {self.by} long, kind string, n long")

    def _staged(self, state: dict, name: str, change: Change, mark: str) -> list[tuple[str, int, str, int]]:
        """New folders for the partitions of one table that differ, entered into ``state``."""
        by, key = self.by, [self.by, *change.keys]
        new = change.rows
        if not change.at_rest:  # the rows given are worked out once
            at = f"{self.root}/staging/{mark}/{name}-rows"
            new.write.parquet(at)
            new = self.spark.read.schema(new.schema).parquet(at)
        if name not in state:
            if change.mode == "update":
                raise KeyError(name)
            state[name] = {"schema": json.loads(new.schema.json()), "parts": {}}
        columns = [f["name"] for f in state[name]["schema"]["fields"]]
        whole = change.mode == "replace" and set(columns) <= set(new.columns) and "map<" not in new.schema.simpleString()
        if not whole and not new.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name}: two rows of one key {key}")
        touched = sorted({r[0] for r in new.select(by).distinct().collect()} | set(change.parts))
        old = self.read(name, touched, state)
        if change.mode == "replace" and change.parts and set(change.parts) != set(touched):
            raise ValueError(f"{name}: rows outside the partitions {change.parts}")
        if whole:
            return self._replaced(state, name, new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns]), old, key, touched, mark)
        given = [c for c in columns if c in new.columns and c not in key]
        rest = [c for c in columns if c not in key]
        told = old.select(F.struct(*key).alias("_a"), F.struct(*[F.col(c) for c in rest]).alias("_old"))
        asked = new.select(F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in key]).alias("_b"), F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in given]).alias("_new"))
        both = told.join(asked, F.col("_a").eqNullSafe(F.col("_b")), "inner" if change.mode == "update" else "full_outer")
        after = [F.when(F.col("_b").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}") if c in given else F.col(f"_old.{c}")).alias(c) for c in rest]
        both = both.select(F.coalesce("_a", "_b").alias("_k"), F.col("_a").isNull().alias("_fresh"), F.col("_b").isNull().alias("_gone"), "_old", F.struct(*after).alias("_now"))
        kind = F.when(F.col("_fresh"), "inserted").when(F.col("_gone"), "deleted").when(~F.col("_old").eqNullSafe(F.col("_now")), "changed").otherwise("kept")
        unheeded = {"replace": (), "upsert": ("deleted",), "update": ("deleted", "inserted")}[change.mode]
        delta = both.withColumn("_kind", kind).filter(~F.col("_kind").isin("kept", *unheeded)).select("_k.*", "_now.*", "_kind")
        at = f"{self.root}/staging/{mark}/{name}"
        delta.write.parquet(at)
        delta = self.spark.read.schema(delta.schema).parquet(at)
        found = {(r[by], r["_kind"]): r["count"] for r in delta.groupBy(by, "_kind").count().collect()}
        before = {r[by]: r["count"] for r in old.groupBy(by).count().collect()}
        dirty = sorted({p for p, _ in found})
        if dirty:
            stay = self.read(name, dirty, state)
            lost = delta.filter("_kind <> 'inserted'").select(*[F.col(c).alias(f"_{c}") for c in key])
            same = [stay[c].eqNullSafe(lost[f"_{c}"]) for c in key]
            stay = stay.join(lost, same, "left_anti")
            rows = stay.select(*columns).unionByName(delta.filter("_kind <> 'deleted'").select(*columns))
            self._write(rows, name, key, self._spread(before, found, dirty), mark)
        return self._entered(state, name, before, found, touched, mark)

    def _replaced(self, state: dict, name: str, new: DataFrame, old: DataFrame, key: list[str], touched: list[int], mark: str) -> list[tuple[str, int, str, int]]:
        """Partitions that hold the rows given and no others: equal rows meet as wholes, in one shuffle;
        where something differs, the rows given are what is written."""
        by = self.by
        if not any(str(p) in state[name]["parts"] for p in touched):
            each = new.groupBy(*key).agg(F.count("*").alias("_new")).withColumns({"_was": F.lit(0), "_same": F.lit(False)})
        else:
            sides = new.withColumns({"_new": F.lit(1), "_was": F.lit(0)}).unionByName(old.withColumns({"_new": F.lit(0), "_was": F.lit(1)}))
            # dealt by key: both sums find their rows in place
            each = sides.repartition(*key).groupBy(*new.columns).agg(F.sum("_new").alias("_new"), F.sum("_was").alias("_was"))
            each = each.groupBy(*key).agg(F.sum("_new").alias("_new"), F.sum("_was").alias("_was"), F.max((F.col("_new") > 0) & (F.col("_was") > 0)).alias("_same"))
        kind = F.when(F.col("_was") == 0, "inserted").when(F.col("_new") == 0, "deleted").when(F.col("_same"), "kept").otherwise("changed")
        told = each.groupBy(by, kind.alias("_kind")).agg(F.count("*").alias("_n"), F.max("_new").alias("_most")).collect()
        if any(r["_most"] > 1 for r in told):
            raise ValueError(f"{name}: two rows of one key {key}")
        found = {(r[by], r["_kind"]): r["_n"] for r in told if r["_kind"] != "kept"}
        before: dict = {}
        for r in told:
            before[r[by]] = before.get(r[by], 0) + (r["_n"] if r["_kind"] != "inserted" else 0)
        dirty = sorted({p for p, _ in found})
        if dirty:
            rows = new if dirty == touched else new.filter(F.col(by).isin(*dirty))
            self._write(rows, name, key, self._spread(before, found, dirty), mark)
        return self._entered(state, name, before, found, touched, mark)

    def _write(self, rows: DataFrame, name: str, key: list[str], spread: int, mark: str) -> None:
        rows.withColumn(_PART, F.col(self.by)).repartition(F.col(_PART), F.xxhash64(*key) % spread).write.partitionBy(_PART).parquet(f"{self.root}/{name}/{mark}")

    @staticmethod
    def _entered(state: dict, name: str, before: dict, found: dict, touched: list[int], mark: str) -> list[tuple[str, int, str, int]]:
        """The folders written, entered into ``state``; the counts of the partitions touched."""
        for p in sorted({p for p, _ in found}):
            left = before.get(p, 0) + found.get((p, "inserted"), 0) - found.get((p, "deleted"), 0)
            state[name]["parts"].pop(str(p), None)
            if left:
                state[name]["parts"][str(p)] = f"{name}/{mark}/{_PART}={p}"
        out = [(name, p, k, n) for (p, k), n in found.items()]
        return out + [(name, p, "kept", before.get(p, 0) - found.get((p, "changed"), 0) - found.get((p, "deleted"), 0)) for p in touched]

    @staticmethod
    def _spread(before: dict, found: dict, dirty: list, rows: int = 2_000_000) -> int:
        """Files a partition, so that a large one is not written by one task."""
        return max(1, max((before.get(p, 0) + found.get((p, "inserted"), 0)) // rows for p in dirty) + 1)

    def _publish(self, version: int, state: dict) -> None:
        """One rename; it fails where the version is there already."""
        temp, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{version:08d}.json")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(final):
            raise Conflict(f"version {version} of {self.root} is there already")
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._files.rename(temp, final, options)

    def tidy(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions names, and older versions.
        Not while another writer is at work. Returns how many went."""
        last = self.version()
        states = [self.state(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {f.split("/")[1] for s in states for t in s.values() for f in t["parts"].values()}
        gone = 0
        for name in {n for s in states for n in s}:
            at = self._path(name)
            for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f.getPath().getName() not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for v in range(1, max(1, last - keep + 1)):
            self._fs.delete(self._path("versions", f"{v:08d}.json"), False)
        self._fs.delete(self._path("staging"), True)
        return gone
