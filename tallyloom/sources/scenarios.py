"""Scenario folders as a data source: read side by side, written with commit and abort.

A scenario is a folder with ``actuals.csv`` (date, description, amount), ``ground_truth.json``
(what was planted, and the clients with their rules) and ``contracts/``. ``spark.read.format(
"scenarios")`` gives each folder to a few tasks: one has the lines, the others a share of the clients
each. Rows enter and leave Python as Arrow batches. Writing takes rows (scenario, file, place, line):
tasks write below ``_staging``, the commit moves whole folders into place and adds a
``manifest.json`` to each; a job that fails leaves no folder behind.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyloom.functions.text import normalise_name
from tallyloom.operators.run import contract_plans
from tallyloom.sources.lineage import written

NAME = "scenarios"
ROWS = "scenario string, kind string, place long, name string, body string, text string"
RULES = (
    "struct<contract_start_date:date,contract_end_date:date,base_amount:decimal(18,2),billing_frequency:string,base_clause:string,"
    "escalation:struct<percentage:decimal(9,6),after_months:int,clause_text:string>,discounts:array<struct<percentage:decimal(9,6),duration_months:int,clause_text:string>>>"
)
ARROW = pa.schema([(c, pa.int64() if c == "place" else pa.string()) for c in ("scenario", "kind", "place", "name", "body", "text")])
#: tasks that share the clients of a folder; rows of a batch
SHARES, BATCH = 4, 4096
TRUTH = "struct<n:long,gap:decimal(18,2)>"


@dataclass
class Folder(InputPartition):
    path: str
    share: int | None = None  # of the clients; None: the lines


@dataclass
class Written(WriterCommitMessage):
    files: dict


def _folders(path: str) -> list[str]:
    where, root = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Folder(f, k) for f in _folders(self.path) for k in (None, *range(SHARES))] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _rows(self, partition: Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        name = partition.path.rsplit("/", 1)[-1]

        def text(*at: str) -> str | None:
            try:
                with where.open_input_stream("/".join((partition.path, *at))) as f:
                    return f.read().decode("utf-8", "replace")
            except (FileNotFoundError, IsADirectoryError):
                return None

        if partition.share is None:
            file = f"{partition.path}/actuals.csv"
            if where.get_file_info(file).type == fs.FileType.File:
                with where.open_input_stream(file) as f, io.TextIOWrapper(f, "utf-8", "replace", newline="") as lines:
                    for k, r in enumerate(csv.DictReader(lines)):
                        yield name, "line", k, r["date"], r["amount"], r["description"]
            return
        truth = json.loads(text("ground_truth.json") or "{}")
        if partition.share == 0:
            yield name, "truth", 0, None, json.dumps(truth.get("planted", {})), None
        for k, c in enumerate(truth.get("clients", [])):
            if k % SHARES == partition.share:
                yield name, "client", k, c["name"], json.dumps(c["rules"]), text("contracts", c["source_contract"]) if c.get("source_contract") else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.mark = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows of a file follow each other, in order of their place."""
        where, root = fs.FileSystem.from_uri(self.path)
        files: dict[str, dict[str, int]] = {}
        out, open_, attempt, made = None, None, uuid.uuid4().hex, set()
        for batch in batches:
            keys = list(zip(batch.column("scenario").to_pylist(), batch.column("file").to_pylist(), strict=True))
            for key, some in groupby(zip(keys, batch.column("line").to_pylist(), strict=True), itemgetter(0)):
                scenario, file = key
                seen = files.setdefault(scenario, {})
                if key != open_:
                    if out:
                        out.close()
                    open_ = key
                    if file in seen:
                        raise ValueError(f"rows of {file} in {scenario} do not follow each other")
                    target = f"{root}/_staging/{self.mark}/{attempt}/{scenario}/{file}"
                    folder = target.rsplit("/", 1)[0]
                    if folder not in made:
                        where.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = where.open_output_stream(target)
                lines = [line + "\n" for _, line in some]
                out.write("".join(lines).encode())
                seen[file] = seen.get(file, 0) + len(lines)
        if out:
            out.close()
        return Written({s: {"at": f"{root}/_staging/{self.mark}/{attempt}/{s}", "files": f} for s, f in files.items()})

    def commit(self, messages: list) -> None:
        """Only now do folders appear, each whole, in place of an older one."""
        where, root = fs.FileSystem.from_uri(self.path)
        done: dict = {}
        for m in messages:
            for s, x in m.files.items():
                if s in done:
                    self.abort(messages)
                    raise ValueError(f"scenario {s} came from two tasks")
                done[s] = x
        for s, x in done.items():
            with where.open_output_stream(f"{x['at']}/manifest.json") as f:
                f.write(json.dumps({"name": s, "files": x["files"]}, indent=1, sort_keys=True).encode())
        for s, x in done.items():
            if where.get_file_info(f"{root}/{s}").type == fs.FileType.Directory:
                where.delete_dir(f"{root}/{s}")
            where.move(x["at"], f"{root}/{s}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{root}/_staging/{self.mark}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/_staging/{self.mark}")


class Scenarios(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def scenario_files(clients: DataFrame, lines: DataFrame, truth: DataFrame) -> DataFrame:
    """clients(scenario, name, rules as ``RULES``, contract), lines(scenario, transaction_date,
    description, amount), truth(scenario, n, gap) -> rows of the files: scenario, file, place, line."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.date_format("transaction_date", "yyyy-MM-dd"), quoted(F.coalesce("description", F.lit(""))), F.col("amount").cast("decimal(18,2)").cast("string"))
    order = Window.partitionBy("scenario").orderBy("transaction_date", "description", "amount")
    actuals = lines.select("scenario", F.lit("actuals.csv").alias("file"), F.row_number().over(order).cast("long").alias("place"), row.alias("line"))
    head = lines.select("scenario").distinct().select("scenario", F.lit("actuals.csv").alias("file"), F.lit(0).cast("long").alias("place"), F.lit("date,description,amount").alias("line"))
    file = F.concat(F.substring(F.sha2("name", 256), 1, 16), F.lit(".txt"))
    contracts = clients.filter("contract IS NOT NULL").select("scenario", F.concat(F.lit("contracts/"), file).alias("file"), F.lit(0).cast("long").alias("place"), F.col("contract").alias("line"))
    entry = F.struct("name", "rules", F.when(F.col("contract").isNotNull(), file).alias("source_contract"))
    # the clients of a scenario are one file that a reader takes whole
    listed = clients.groupBy("scenario").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("clients"))
    answer = listed.join(truth, "scenario", "left").select(
        "scenario", F.lit("ground_truth.json").alias("file"), F.lit(0).cast("long").alias("place"),
        F.to_json(F.struct(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gap", F.lit(0)).alias("gap")).alias("planted"), "clients")).alias("line"),
    )
    return actuals.unionByName(head).unionByName(contracts).unionByName(answer)


def write_scenarios(files: DataFrame, folder: str) -> None:
    spark = files.sparkSession
    spark.dataSource.register(Scenarios)
    whole = files.repartition("scenario").sortWithinPartitions("scenario", "file", "place")
    whole.select("scenario", "file", "place", "line").write.format(NAME).mode("append").save(folder)


def read_scenarios(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Run tables of all scenarios of a folder: clients, rules, escalations, discounts, clauses,
    documents, lines (without clients: those are for the run to find) and truth. Runs are
    numbered by the scenarios' names."""
    spark.dataSource.register(Scenarios)
    rows = spark.read.format(NAME).option("path", folder).load()
    names = sorted(f.rsplit("/", 1)[-1] for f in _folders(folder))  # one a folder
    runs = spark.createDataFrame(list(enumerate(names, 1)), "run_id int, scenario string")
    # written once: every table is taken from these rows, and each would read all folders again
    rows = written(rows.join(F.broadcast(runs), "scenario"), "scenario-rows")
    # ids follow from run and place: the same folder gives the same ids
    ident = F.shiftleft(F.col("run_id").cast("long"), 32) + F.col("place")
    c = rows.filter("kind = 'client'").withColumns({"id": ident, "r": F.from_json("body", RULES)})
    clauses = c.select("id", "run_id", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("k"), F.lit("base_fee").alias("kind"), F.col("r.base_clause").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("escalation").alias("kind"), F.col("r.escalation.clause_text").alias("text"))),
        F.coalesce(F.transform("r.discounts", lambda d, i: F.struct((i + 2).alias("k"), F.lit("discount").alias("kind"), d["clause_text"].alias("text"))), F.array().cast("array<struct<k:int,kind:string,text:string>>")),
    )).alias("c")).filter("c.text IS NOT NULL").select(F.concat_ws(":", "id", "c.k").alias("id"), F.col("id").alias("rule_id"), "run_id", "c.kind", "c.text")
    offs = c.select("id", F.posexplode("r.discounts").alias("i", "d"))
    return {
        "runs": runs, "clients": c.select(F.col("id").alias("client_id"), "run_id", "name", normalise_name(F.col("name")).alias("normalized_name")),
        "rules": c.select(F.col("id").alias("rule_id"), F.col("id").alias("client_id"), F.col("id").alias("document_id"), F.col("name").alias("client_name"), "r.base_amount",
            F.col("r.billing_frequency").alias("frequency"), F.col("r.contract_start_date").alias("start_date"), F.col("r.contract_end_date").alias("end_date")),
        "escalations": c.filter("r.escalation IS NOT NULL").select("id", F.col("id").alias("rule_id"), F.concat_ws(":", "id", F.lit(1)).alias("clause_id"), "r.escalation.percentage", "r.escalation.after_months"),
        "discounts": offs.select(F.concat_ws(":", "id", "i").alias("id"), F.col("id").alias("rule_id"), F.concat_ws(":", "id", F.col("i") + 2).alias("clause_id"), "d.percentage", "d.duration_months"),
        "clauses": clauses, "documents": c.select(F.col("id").alias("document_id"), "run_id", "text"),
        "lines": rows.filter("kind = 'line'").select(ident.alias("txn_id"), "run_id", F.lit(None).cast("long").alias("client_id"), F.col("name").cast("date").alias("transaction_date"),
            F.col("body").cast("decimal(18,2)").alias("amount"), F.col("text").alias("description")),
        "truth": rows.filter("kind = 'truth'").select("run_id", "scenario", F.from_json("body", TRUTH).alias("t")).select("run_id", "scenario", "t.n", "t.gap"),
    }


def plans_of(tables: dict[str, DataFrame]) -> DataFrame:
    return contract_plans(tables["rules"], tables["escalations"], tables["discounts"], tables["clauses"])
