"""Reading statements and documents, writing run-scoped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import parse_dates
from tallyloom.functions.text import clean_amount, squeeze

#: share of unreadable month-first dates above which a file is read day-first
UNREAD = 0.2


def file_kind(path: Column) -> Column:
    """csv, text, image or pdf by suffix; null for anything else."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext == "csv", "csv").when(ext.isin("txt", "md"), "text").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff"), "image").when(ext == "pdf", "pdf")
    )


def read_statement(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """CSV with a confirmed {field: column} map -> date, amount, description. Rows whose
    date or amount cannot be read go; without a date or amount column there are none."""
    raw = spark.read.option("header", True).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    schema = "transaction_date date, amount double, description string"
    if not {"date", "amount"} <= mapping.keys() or not set(mapping.values()) <= set(raw.columns):
        return spark.createDataFrame([], schema)
    picked = raw.select(
        "_file", F.col(mapping["date"]).alias("_d"), F.col(mapping["amount"]).alias("_a"),
        (F.col(mapping["description"]) if "description" in mapping else F.lit(None).cast("string")).alias("_t"),
    )
    month_first = parse_dates(F.col("_d"), F.lit(False))
    # each file is read month-first or day-first as a whole
    failing = picked.groupBy("_file").agg((F.avg(month_first.isNull().cast("int")) > UNREAD).alias("_day_first"))
    text = squeeze(F.col("_t"))
    out = picked.join(failing, "_file").select(
        parse_dates(F.col("_d"), F.col("_day_first")).alias("transaction_date"), clean_amount(F.col("_a")).alias("amount"),
        F.when(text != "", text).alias("description"),
    )
    return out.filter("transaction_date IS NOT NULL AND amount IS NOT NULL")


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a batch whose name is not in the run yet, the first of each name by position."""
    fresh = uploads.join(known.select("run_id", "filename"), ["run_id", "filename"], "left_anti")
    place = F.col("position") if "position" in fresh.columns else F.lit(0)
    first = Window.partitionBy("run_id", "filename").orderBy(place)
    fresh = fresh.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return fresh.withColumn("status", F.when(file_kind(F.col("filename")) == "csv", "pending").otherwise("complete"))


def object_key(run_id: Column, content: Column, name: Column) -> Column:
    """Content-addressed place of an upload: run / first 12 hex digits of sha256 _ name."""
    return F.concat_ws("/", run_id.cast("string"), F.concat_ws("_", F.substring(F.sha2(content, 256), 1, 12), name))


def replace_run(df: DataFrame, path: str) -> None:
    """Recompute of runs: only the partitions in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
