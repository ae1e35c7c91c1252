"""Statement lines as a stream (an addition; the batch operators do not need it).

Late lines within the watermark count once; a repeated upload is dropped by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_amount, clean_description


def clean_stream(lines: DataFrame, late: str = "15 days") -> DataFrame:
    """lines(line_id, ts, raw_amount, raw_description), each id once."""
    once = lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["line_id"])
    out = once.withColumns({"amount": clean_amount(F.col("raw_amount")), "description": clean_description(F.col("raw_description"))})
    return out.filter("amount IS NOT NULL").select("line_id", "ts", "amount", "description")


def received_by_month(lines: DataFrame, late: str = "15 days") -> DataFrame:
    """Sum and count by 30-day window, appended once the watermark has passed it."""
    return clean_stream(lines, late).groupBy(F.window("ts", "30 days")).agg(
        F.sum("amount").alias("received"), F.count("*").alias("n")
    ).select(F.col("window.start").alias("start"), "received", "n")
