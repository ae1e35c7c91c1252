"""Mixing sources to target weights by Efraimidis-Spirakis keys.

A source's target is its share by weight of ``total_share`` of all sizes, held to
``cap`` times its own size; what is over goes to the others by weight until none
is above its cap. A target is met by complete epochs first; the rest is taken in
the order of exponential keys (-ln(u) / quality weight), prefix-summed to what is
left of the target. u comes from md5(seed, id), so reruns agree.

Only sums by (source, key cell) are ever gathered. Cells are even in the logarithm of the
key, ``cells`` to every doubling: a quality weight only shifts that logarithm, so whatever the
weights, no cell is expected to hold more than ln(2) / (e * cells) of its source's rows (0.1
per cent with 256), and a source has at most some 16,000 cells.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; rows with the same id and text are rows of their own; equal keys go by
id, then size; null ids share one random number and are taken by their weight, then size;
a very long text is measured whole; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2
#: cells to every doubling of the key
CELLS = 256
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: str = "text", size: str = "size") -> Column:
    """Quality weight in (0, 1]: symbol-ridden texts come late."""
    symbols = F.coalesce(F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + 10.0 * symbols / (F.col(size) + 1))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", size_of(text)).withColumn("quality", quality_of(text))


def uniform(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in (0, 1) from md5 of the id: 52 bits, the same in every run."""
    h = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f"|{seed}")).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, cap=CAP) -> DataFrame:
    """(_null, _src, source_size) -> with target; closed form of the repeated resharing.

    Sources sorted by cap / weight: those that hit their cap come first, so running
    sums tell for each whether it is still above when all before it are capped.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("__null", "__src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sizes.withColumn("__w", w).withColumn("__cap", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__null", "__src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "__cap_before": F.coalesce(F.sum("__cap").over(before), F.lit(0)),
            "__w_before": F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
            "__w_all": F.sum("__w").over(everything),
            "__total": total_share * F.sum("source_size").over(everything),
        }
    )
    full = F.col("__w") * (F.col("__total") - F.col("__cap_before")) >= F.col("__cap") * (F.col("__w_all") - F.col("__w_before"))
    df = df.withColumn("__full", full)
    left = F.col("__total") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(everything)
    w_left = F.col("__w_all") - F.sum(F.when(F.col("__full"), F.col("__w")).otherwise(0.0)).over(everything)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__w") * left / w_left)
    return df.withColumn("target", target).select("__null", "__src", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    cap: int = CAP,
    seed: str = SEED,
    cells: int = CELLS,
    cut_boundary: bool = True,
    measured: bool = False,
) -> DataFrame:
    """Rows with size, source_size, target and taken (words the mix takes).

    ``cut_boundary``: the row at which a source's target is reached gives only the
    words still missing. Without it that row is taken whole if at least half of it
    is missing, else not at all. ``measured``: the columns size and quality are
    there already (see ``measure``) and no text is read.
    """
    rows = docs if measured else measure(docs, text)
    rows = rows.withColumn("__key", -F.log(uniform(doc_id, seed)) / F.col("quality"))
    rows = rows.withColumns(
        {
            "__null": F.col(source).isNull(),
            "__src": F.coalesce(F.col(source), F.lit("")),
            "__cell": F.floor(F.log2("__key") * cells).cast("int"),
        }
    )
    sums = materialize(rows.groupBy("__null", "__src", "__cell").agg(F.sum("size").alias("__size")), "mix-cells")
    targets = source_targets(
        sums.groupBy("__null", "__src").agg(F.sum("__size").alias("source_size")), weights, total_share, cap
    )
    earlier = Window.partitionBy("__null", "__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells_df = sums.withColumn("__offset", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    cells_df = cells_df.join(targets, ["__null", "__src"])
    inside = Window.partitionBy("__null", "__src", "__cell").orderBy("__key", doc_id, "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__upto", F.sum("size").over(inside)).join(cells_df, ["__null", "__src", "__cell"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("__epochs", epochs.cast("long"))
    rest = F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long")
    missing = rest - (F.col("__offset") + F.col("__upto") - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), missing))
    if not cut_boundary:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    out = out.withColumn("taken", (F.col("__epochs") * F.col("size") + part).cast("long"))
    return out.drop("__null", "__src", "__cell", "__key", "__upto", "__offset", "__epochs", "quality")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = materialize(measure(docs).drop("text"), "mix-sizes")
    return mix_sources(rows, measured=True).select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole ones only."""
    mixed = mix_sources(docs, cut_boundary=False)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    again = mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times)))
    return again.select(*docs.columns)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 13) AS BIGINT) AS h
  FROM documents
), k AS (
  SELECT *, -ln((CAST(h AS DOUBLE) + 0.5) / 4503599627370496.0)
            / (1.0 / (1.0 + 10.0 * symbols / (size + 1))) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt
  FROM s
), r AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
    sum(wt) OVER () AS w_all, 1.5 * sum(source_size) OVER () AS total
  FROM w
), f AS (
  SELECT *, wt * (total - cap_before) >= cap * (w_all - w_before) AS is_full FROM r
), t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(cap AS DOUBLE)
         ELSE wt * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
              / (w_all - sum(CASE WHEN is_full THEN wt ELSE 0 END) OVER ()) END::DOUBLE AS target
  FROM f
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - (upto - size))) AS BIGINT) AS taken
FROM p
"""
