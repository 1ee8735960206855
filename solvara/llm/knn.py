"""Exact top-k by inner product: a Voronoi kNN join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.storage import staged

#: Rows of a block of one cell at most, about; pivots at most; queries scored at a time.
BLOCK_ROWS, PIVOTS, SCORED = 8192, 256, 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Null ids, null vectors and null or non-finite components take no part.

    A component that doesn't fit a long (2**62 or more in size after scaling) raises an error.
    """
    large = F.raise_error(F.lit("a scaled component doesn't fit a long")).cast("long")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.when(F.abs(scale * x.cast("double")) < 2.0**62, F.floor(scale * x.cast("double")).cast("long")).otherwise(large)).alias("v"))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point while sums stay below 2**53, else by integers; an error where one doesn't fit a long."""
    top = max(int(a.max(initial=0)), -int(a.min(initial=0))) * max(int(b.max(initial=0)), -int(b.min(initial=0))) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and (exact.max() >= 2**63 or exact.min() < -(2**63)):
        raise OverflowError("an inner product doesn't fit a long")
    return exact.astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest, ties to the first."""
    if len(scores) > k:
        line = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= line)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query (query_id, v) its ``k`` best of ``vectors`` (vec_id, v): query_id, rank, vec_id, score.

    Rows are grouped by their nearest pivot. From each cell's radius, and its k + 1 least distances from the pivot, come
    for each query a score that its k-th best surely reaches and the highest that any row of a cell could have; the query
    goes only to cells that can reach it. Queries are the smaller side, so they are what is copied; a large cell is cut
    into blocks. Repeated rows become one with their number, k at most. Of equal vectors only the k + 1 least ids can be in
    a result, as one may be the query's own; a window's group limit keeps no more, on the map side too, so a vector that
    a third of all rows share is no hot group. A query's own rows, however many, don't count for the score to reach.

    A query doesn't meet rows of its own id. Vectors of another length than the query's don't meet it. Ties go to the
    smaller vec_id; repeated rows of one id and vector can each be in a result. Too few rows give all there are; empty
    tables give no rows. A product of compared rows that doesn't fit a long raises an error.
    """
    spark = vectors.sparkSession
    alike = Window.partitionBy("v").orderBy("vec_id")
    single = vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    rows = staged(single.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).drop("r").withColumn("d", F.size("v")))
    n = rows.count()
    want = int(min(PIVOTS, max(1, n**0.5 / 8)))
    pivot_rows = rows.select("d", "v").distinct().withColumn("h", F.xxhash64("v")).orderBy("h", "v").limit(want).collect()
    met = [p.d for p in pivot_rows]
    pivot_rows += rows.where(~F.col("d").isin(met)).groupBy("d").agg(F.min("v").alias("v")).collect()  # a row for each length without a pivot
    if not pivot_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = {d: (np.array([i for i, p in enumerate(pivot_rows) if p.d == d]), np.array([p.v for p in pivot_rows if p.d == d], dtype=float)) for d in {p.d for p in pivot_rows}}

    def assign(batches):
        for batch in batches:
            for d in set(batch.column("d").to_pylist()):
                part = batch.filter(pa.array(np.asarray(batch.column("d")) == d))
                x, (ids, p) = matrix(part.column("v")).astype(float), pivots[d]
                far = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None], 0))
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[near], pa.int32()), pa.array(far[np.arange(len(x)), near]), part.column("vec_id"), part.column("v"), part.column("copies")], ["cell", "far", "vec_id", "v", "copies"])

    cells = staged(rows.mapInArrow(assign, "cell int, far double, vec_id long, v array<long>, copies long"))
    close = Window.partitionBy("cell").orderBy("far", "vec_id")
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    ids = cells.groupBy("cell", "vec_id").agg(F.min("far").alias("far"))
    least = ids.select("cell", "vec_id", "far", F.row_number().over(close).alias("r")).where(F.col("r") <= k + 1).collect()
    blocks = {s.cell: -(-s.n // BLOCK_ROWS) for s in summary}
    radius = {s.cell: s.radius for s in summary}
    nearest: dict[int, list[tuple[int, float]]] = {}
    for row in least:
        nearest.setdefault(row.cell, []).append((row.vec_id, row.far))

    def route(batches):
        for batch in batches:
            ids, at, vs = [], [], []
            for query, v in zip(batch.column("query_id").to_pylist(), batch.column("v").to_pylist()):
                if len(v) not in pivots:
                    continue
                own, p = pivots[len(v)]
                norm = float(np.linalg.norm(np.asarray(v, dtype=float)))
                own, to = zip(*[(c, s) for c, s in zip(own.tolist(), p @ np.asarray(v, dtype=float)) if c in radius])
                lower = sorted((s - norm * far for c, s in zip(own, to) for i, far in nearest[c] if i != query), reverse=True)
                reach = lower[k - 1] if len(lower) >= k else -np.inf  # k rows of other ids reach it
                slack = 1e-9 * (1 + abs(reach) + norm * max(radius.values()))
                for c, s in zip(own, to):
                    if s + norm * radius[c] >= reach - slack:
                        for b in range(blocks[c]):
                            ids.append(query)
                            at.append((c, b))
                            vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.int64()))], ["cell", "block", "query_id", "v"])

    sent = queries.select("query_id", "v").mapInArrow(route, "cell int, block int, query_id long, v array<long>")
    sizes = spark.createDataFrame([(c, b) for c, b in blocks.items()], "cell int, blocks int")  # a row a cell
    placed = cells.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v", "copies")

    def solve(asked: pa.Table, data: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and data.num_rows:
            data = data.sort_by("vec_id")
            ids, x, copies = data.column("vec_id").to_numpy(), matrix(data.column("v")), data.column("copies").to_numpy()
            names, q = asked.column("query_id").to_numpy(), matrix(asked.column("v"))
            for i in range(0, len(q), SCORED):
                for name, scores in zip(names[i : i + SCORED], products(q[i : i + SCORED], x)):
                    others = np.flatnonzero(ids != name)
                    top = others[best(scores[others], k)]
                    found += [(name, ids[o], scores[o]) for o in np.repeat(top, copies[top])[:k]]
        return pa.table({c: pa.array([f[j] for f in found], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    local = sent.groupBy("cell", "block").cogroup(placed.groupBy("cell", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_knn_join(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each whose id is divisible by 50; of rows with one such id, the least vector asks."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where("vec_id % 50 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return top_k(vectors, queries, 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
