"""Lookup joins whose left keys may be hot, and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

#: a key with at least one in SHARE of all uses is hot: there are at most SHARE of them in any input
SHARE = 1024


def lookup(rows: DataFrame, table: DataFrame, on: list[str], uses: str = "uses") -> DataFrame:
    """``rows`` with the columns of the one row that ``table`` holds for their key (inner).

    ``uses`` is how many of ``rows`` have the key. Hot keys are broadcast (at most
    ``SHARE`` rows), so no key of the shuffled join has more than a small share of all
    rows. Both sides are read twice: hand in written tables.
    """
    total = table.agg(F.sum(uses)).first()[0] or 0
    hot = table.filter(F.col(uses) * SHARE >= total).drop(uses)
    cold = table.filter(F.col(uses) * SHARE < total).drop(uses)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Places from 1 in ``order`` over the whole table, counted in ranges side by side.

    ``order`` has to tell all rows apart, so that ties split over ranges too. What goes
    to the driver is one number a range.
    """
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in cut.groupBy("_range").count().collect())
    at, starts = 0, [(-1, 0)]
    for part, n in sizes:
        starts.append((part, at))
        at += n
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    before = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    return cut.withColumn(name, place).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
