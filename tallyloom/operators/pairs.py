"""Training pairs of contract text and rules: templates dealt evenly, each pair checked.

Templates go round by each row's place in a seeded order. The order is never sorted as a
whole: rows are counted by the first two hex digits of their digest (256 cells), ranked inside
a cell, and a cell's ranks begin where the cells before it end. So the number of rows of any
two templates differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import figures

#: what each template says beside the fee
TEMPLATES = (("base",), ("base", "rise"), ("base", "discount"), ("base", "rise", "discount"), ("base", "milestone"), ("base", "rise", "discount", "milestone"))


def dealt(rows: DataFrame, key: str, seed: int, n: int = len(TEMPLATES), name: str = "template") -> DataFrame:
    """``rows`` with the template of each, by turns in the order of md5(seed:key)."""
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")))
    rows = rows.withColumn("_cell", F.substring("_order", 1, 2))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))  # 256 rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_order", key)) - 1
    out = rows.withColumn("_rank", rank).join(F.broadcast(sizes.select("_cell", before.alias("_before"))), "_cell")
    return out.withColumn(name, ((F.col("_before") + F.col("_rank")) % n).cast("int")).drop("_order", "_cell", "_rank", "_before")


def says(part: str) -> Column:
    """Whether the template of a row holds a part."""
    return F.col("template").isin(*[i for i, t in enumerate(TEMPLATES) if part in t])


def written(rows: DataFrame) -> DataFrame:
    """rows(template, client_name, base_amount, frequency, esc_pct, off_pct, off_months, ms_amount)
    -> the pair: text, and the rules it states with their clauses word for word."""
    whole = lambda c: F.format_string("%d", F.col(c).cast("long"))
    rate = lambda c: F.regexp_replace(F.col(c).cast("decimal(9,4)").cast("string"), r"\.?0+$", "")
    clause = {
        "base": F.concat(F.lit("The client pays a "), "frequency", F.lit(" fee of $"), whole("base_amount"), F.lit(".")),
        "rise": F.concat(F.lit("After twelve months the fee rises by "), rate("esc_pct"), F.lit("%.")),
        "discount": F.concat(F.lit("For the first "), whole("off_months"), F.lit(" months "), rate("off_pct"), F.lit("% is taken off the fee.")),
        "milestone": F.concat(F.lit("On acceptance a further $"), whole("ms_amount"), F.lit(" falls due.")),
    }
    rows = rows.withColumns({f"{p}_clause": F.when(says(p), c) for p, c in clause.items()})
    head = F.concat(F.lit("Agreement with "), "client_name", F.lit("."))
    return rows.withColumn("text", F.concat_ws("\n", head, *[f"{p}_clause" for p in clause]))


def problems(pairs: DataFrame) -> Column:
    """What a pair states that its text does not: none for a pair that is fit to train on."""
    numbers, text = figures(F.col("text")), F.col("text")
    rate = lambda c: F.regexp_replace(F.col(c).cast("decimal(9,4)").cast("string"), r"\.?0+$", "")
    whole = lambda c: F.col(c).cast("long").cast("string")
    checks = [
        F.when(F.col("base_amount").isNotNull() & ~F.array_contains(numbers, whole("base_amount")), "fee is not in the text"),
        F.when(~F.contains(text, F.col("client_name")), "client is not in the text"),
        *[F.when(F.col(f"{p}_clause").isNotNull() & ~F.contains(text, F.col(f"{p}_clause")), f"{p} clause is not verbatim") for p in ("rise", "discount", "milestone")],
        F.when(F.col("rise_clause").isNotNull() & ~F.contains(text, rate("esc_pct")), "rise is not in the text"),
        F.when(F.col("discount_clause").isNotNull() & ~F.contains(text, rate("off_pct")), "discount is not in the text"),
        F.when(F.col("milestone_clause").isNotNull() & ~F.array_contains(numbers, whole("ms_amount")), "milestone is not in the text"),
    ]
    return F.array_compact(F.array(*checks))
