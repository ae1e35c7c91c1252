"""Exact top-k search by a Voronoi kNN join under integer inner products.

Vectors become integers floor(scale * x). Pivots, chosen by hash, more of them the more
data there are, cut the space into cells, and cells into rings by distance from the
pivot. Each ring is summarised by its radius, its largest norm and its size: a score in
it is at most the smaller of q.pivot + |q| * radius and |q| * norm, and at least
q.pivot - |q| * radius. A query first gets a score that its k-th best cannot fall below -
from the summaries, then from solving its own cell - and needs only the rings whose upper
bound reaches it.

Queries whose cells lie side by side form blocks. The distinct (query block, slice of a
ring) pairs that some query needs are gathered first, and data are replicated to these
alone: once to the block of their own cell, and further only as the bounds ask. A ring that
holds a third of all rows is cut into slices. Equal vectors are joined beforehand into
one row with their smallest k + 1 ids, which decide all ties.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part; an empty vector scores 0; vectors whose length differs from the most common one
take no part (inner products need one length); a null id takes no part; fewer candidates
than k give fewer rows; rows that repeat an id with the same vector count once, rows that
repeat an id with another vector are candidates of their own; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

#: pivots: one for so many vectors, within these bounds
PIVOT_ROWS, PIVOTS, MOST_PIVOTS = 50_000, 48, 4096
#: a cell has a ring for so many vectors, and at most so many rings
RING_ROWS, RINGS = 4096, 8
#: bytes of vectors in a block of queries or a slice of a ring
BLOCK_BYTES = 16 << 20
#: queries and vectors whose products are held at once
TILE = (512, 8192)


def quantized(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.int64).reshape(len(values), -1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; floats only where they hold every partial sum."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _best(qids: np.ndarray, scores: np.ndarray, ids: list, k: int) -> list[tuple[int, int, int]]:
    """Per query the k best (score, id) of one tile; ids holds the ids of each vector."""
    out = []
    m = scores.shape[1]
    top = min(m, k + 1)
    for i, q in enumerate(qids):
        row = scores[i]
        floor = row[np.argpartition(row, m - top)[m - top]] if top < m else row.min()
        some = [(-int(row[j]), int(v)) for j in np.flatnonzero(row >= floor) for v in ids[j] if v != q]
        out += [(q, v, -s) for s, v in sorted(some)[:k]]
    return out


def _side_by_side(centre: np.ndarray) -> np.ndarray:
    """Pivots in order along the direction in which they spread most."""
    x = centre - centre.mean(0) if len(centre) else centre
    u = np.ones(x.shape[1])
    for _ in range(5):
        u = x.T @ (x @ u)
        u /= max(float(np.sqrt((u * u).sum())), 1.0)
    return np.argsort(x @ u, kind="stable")


def _query_blocks(asked: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first query block, and over how many its queries are spread."""
    first, parts = np.zeros(len(asked), np.int64), np.ones(len(asked), np.int64)
    at, held = 0, 0
    for c in order:
        if held and held + asked[c] > size:
            at, held = at + 1, 0
        first[c], parts[c] = at, max(1, -(-int(asked[c]) // size))
        at, held = at + int(parts[c]) - 1, held + int(asked[c])
    return first, parts


def replicated(slices: DataFrame, targets: DataFrame) -> DataFrame:
    """Data once for each query block that needs their slice."""
    needed = targets.select(*[F.col(c).alias(c) for c in ("qb", "cell", "ring", "slice")]).distinct()
    return slices.join(needed, ["cell", "ring", "slice"])


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 256, pivots: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score for each query; the query's own id is no candidate."""
    spark = data.sparkSession
    schema = "query_id long, vec_id long, score long"
    points = data.select(F.col(vec_id).alias("vec_id"), quantized(vector, scale).alias("v")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    asked = queries.select(F.col(vec_id).alias("query_id"), quantized(vector, scale).alias("v")).filter("v IS NOT NULL AND query_id IS NOT NULL").distinct()
    # equal vectors: smallest ids by salted partial lists, each of at most k + 1 ids
    salted = points.distinct().withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    rank = F.row_number().over(Window.partitionBy("v", "_s").orderBy("vec_id"))
    few = salted.withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    few = few.groupBy("v", "_s").agg(F.collect_list("vec_id").alias("ids"))
    short = few.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    size = F.size("v")
    common = points.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = common[0]["d"]
    block = max(1, BLOCK_BYTES // (8 * max(d, 1)))
    short = materialize(short.filter(size == d), "knn-points")
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, -(-short.count() // PIVOT_ROWS)))
    chosen = short.orderBy(F.xxhash64(F.to_json("v")), F.element_at("ids", 1)).limit(pivots).collect()
    centre = np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), d)
    half = (centre * centre).sum(1) / 2

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"]).astype(np.float64)
            cell = (half[None, :] - x @ centre.T).argmin(1)
            dist = np.sqrt(((x - centre[cell]) ** 2).sum(1))
            yield pdf.assign(cell=cell.astype(np.int32), dist=dist, norm=np.sqrt((x * x).sum(1)))

    placed = "v array<long>, ids array<long>, cell int, dist double, norm double"
    cells = materialize(short.mapInPandas(near, placed), "knn-cells")
    # from here on to the driver: at most pivots x RINGS rows
    cuts = [i / RINGS for i in range(1, RINGS)]
    by_cell = cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", cuts, 1000).alias("cuts")).collect()
    edges = np.full((len(centre), RINGS - 1), np.inf)
    for r in by_cell:
        every = RINGS // max(1, min(RINGS, r["n"] // RING_ROWS))  # fewer rings for small cells
        some = r["cuts"][every - 1 :: every]
        edges[r["cell"], : len(some)] = some

    def ringed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ring=(edges[pdf["cell"]] < pdf["dist"].to_numpy()[:, None]).sum(1).astype(np.int32))

    rings = materialize(cells.mapInPandas(ringed, placed + ", ring int"), "knn-rings")
    summary = rings.groupBy("cell", "ring").agg(F.max("dist").alias("r"), F.max("norm").alias("m"), F.count("*").alias("n"))
    shape = (len(centre), RINGS)
    radius, norm, count = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int64)
    for r in summary.collect():
        radius[r["cell"], r["ring"]], norm[r["cell"], r["ring"]], count[r["cell"], r["ring"]] = r["r"] + 1e-6, r["m"] + 1e-6, r["n"]
    cut = np.maximum(1, -(-count // block))
    parts = spark.createDataFrame([(int(c), int(g), int(cut[c, g])) for c, g in zip(*np.nonzero(count), strict=True)], "cell int, ring int, parts int")
    slices = rings.join(F.broadcast(parts), ["cell", "ring"])
    slices = slices.select("v", "ids", "cell", "ring", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("slice"))
    used = count.sum(1) > 0

    def own_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mid = _matrix(pdf["v"]).astype(np.float64) @ centre.T
            yield pdf.assign(home=np.where(used, mid, -np.inf).argmax(1).astype(np.int32))

    asked = materialize(asked.filter(size == d).mapInPandas(own_cell, "query_id long, v array<long>, home int"), "knn-queries")
    per_home = np.zeros(len(centre), np.int64)
    for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect():
        per_home[r["home"]] = r["n"]
    first_block, spread = _query_blocks(per_home, _side_by_side(centre), block)

    def aimed(pdf: pd.DataFrame, need: np.ndarray) -> pd.DataFrame:
        """A row for each query and slice of the rings it needs."""
        i, c, g = np.nonzero(need)
        times = cut[c, g]
        j = np.repeat(np.arange(len(i)), times)
        at = np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)
        home = pdf["home"].to_numpy()
        qb = first_block[home] + pdf["query_id"].to_numpy() % spread[home]
        return pd.DataFrame({
            "query_id": pdf["query_id"].to_numpy()[i[j]], "qb": qb[i[j]].astype(np.int32), "cell": c[j].astype(np.int32),
            "ring": g[j].astype(np.int32), "slice": at.astype(np.int32),
        })

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            need = np.zeros((len(pdf), *shape), bool)
            need[np.arange(len(pdf)), pdf["home"]] = count[pdf["home"]] > 0
            yield aimed(pdf, need)

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rings whose upper bound reaches the k-th score that is sure by now."""
        there = (count > 0).reshape(-1)
        for whole in batches:
            for at in range(0, len(whole), TILE[0]):
                pdf = whole.iloc[at : at + TILE[0]]
                q = _matrix(pdf["v"]).astype(np.float64)
                long = np.sqrt((q * q).sum(1))[:, None, None]
                mid = (q @ centre.T)[:, :, None]
                low = np.where(there, (mid - long * radius).reshape(len(pdf), -1), -np.inf)
                high = np.minimum(mid + long * radius, long * norm).reshape(len(pdf), -1)
                order = np.argsort(-low, axis=1)
                total = np.cumsum(count.reshape(-1)[order], axis=1)
                k_at = np.minimum((total <= k).sum(1), low.shape[1] - 1)[:, None]  # one more than k: the own id is left out
                sure = np.take_along_axis(low, np.take_along_axis(order, k_at, 1), 1)[:, 0]
                sure = np.where(total[:, -1] > k, sure, -np.inf)
                sure = np.maximum(sure, pdf["known"].astype("float64").fillna(-np.inf).to_numpy())[:, None]
                need = there & (high + 1e-3 * np.maximum(1, np.abs(high)) >= sure)
                need = need.reshape(len(pdf), *shape)
                need[np.arange(len(pdf)), pdf["home"]] = False
                yield aimed(pdf, need)

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            qv, qid, ids = _matrix(q["v"]), q["query_id"].to_numpy(), x["ids"].tolist()
            for lo in range(0, len(x), TILE[1]):
                xv = _matrix(x["v"].iloc[lo : lo + TILE[1]])
                for at in range(0, len(q), TILE[0]):
                    some = slice(at, at + TILE[0])
                    out += _best(qid[some], _scores(qv[some], xv), ids[lo : lo + TILE[1]], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def solved(targets: DataFrame) -> DataFrame:
        q = targets.join(asked.select("query_id", "v"), "query_id")
        keys = ("qb", "cell", "ring", "slice")
        return q.groupBy(*keys).cogroup(replicated(slices, targets).groupBy(*keys)).applyInPandas(lambda a, b: solve(a, b), schema)

    aims = "query_id long, qb int, cell int, ring int, slice int"
    first = materialize(solved(materialize(asked.mapInPandas(at_home, aims), "knn-home")), "knn-own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").alias("known"))
    more = asked.join(kth, "query_id", "left").select("query_id", "v", "home", "known").mapInPandas(elsewhere, aims)
    rest = solved(materialize(more, "knn-needs"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(data, data.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
