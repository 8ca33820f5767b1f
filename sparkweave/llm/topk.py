"""Exact top-k search by inner product as a Voronoi kNN join.

Inner products become distances: with R the largest norm of the data, x is lifted to
(x, sqrt(R^2-|x|^2)) and a query to (q, 0); then |q-x|^2 = |q|^2 + R^2 - 2 q.x. Queries and data
are grouped by the nearest of a few pivots (a bounded sample of the data). From summaries per
group (the radius of the queries, the distances of the nearest k+1 different ids of the data) follows
for each query group a distance within which each of its queries has k others; a data row goes only to the
query groups in whose reach it lies. Each (block of queries, chunk of data) is solved locally,
and the best k of each query's chunks are its result. Blocks and chunks are bounded, so no group
lands in one task, however many vectors are alike.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; rows with a null id take no part. Equal rows count once, rows of one id with
different vectors are different candidates; a query never meets rows of its own id. Ties go to the
smaller id. Scores are exact up to 2^63, beyond which a ValueError is raised. An empty table gives an
empty one. Only the id and vector of a table are used, whatever other columns it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

BLOCK = 4096
CHUNK = 8192
#: Queries per pivot, and the bounds of the number of pivots.
PER_PIVOT, PIVOTS = 512, (8, 256)


def finite(column: str) -> Column:
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, padded with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    off = column.offsets.to_numpy()
    size = np.diff(off)
    flat = column.values.to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat[off[0] : off[-1]].reshape(-1, dim)
    for i in range(len(size)):
        out[i, : size[i]] = flat[off[i] : off[i + 1]]
    return out


def _lifted(x: np.ndarray, square: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties to the smaller id; the least value of the type is no candidate."""
    none = -np.inf if score.dtype.kind == "f" else np.iinfo(score.dtype).min
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        row, col = np.nonzero((score >= least[:, None]) & (score > none))
    else:
        row, col = np.nonzero(score > none)
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(score.shape[0]))
    first = np.arange(len(row)) - start[row] < k
    return row[first], col[first]


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "id", vector: str = "vector", is_query: Column | None = None) -> DataFrame:
    """(query_id, rank, id, score): ``vectors`` holds ids and arrays of integers; ``is_query`` picks the queries."""
    spark = vectors.sparkSession
    query = F.lit(True) if is_query is None else is_query
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"), query.alias("query"))
    own = stored(own.where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "v"]), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    top = own.agg(F.count("*"), F.sum(F.col("query").cast("long")), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n, queries, dim, most, widest = (x or 0 for x in top)
    count = int(min(max(queries // PER_PIVOT, PIVOTS[0]), PIVOTS[1]))
    sample = own.orderBy(F.xxhash64("v"), "id").limit(count).select("v").collect()
    pivots = np.zeros((len(sample), dim), np.int64)
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    lifted, kind = _lifted(pivots, most), np.int32 if widest < 2**31 else np.int64
    if dim * int(widest) ** 2 >= 2**63:
        raise ValueError("inner products of these vectors don't fit into 64 bits")
    exact = dim * int(widest) ** 2 < 2**53

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(1), dim)
            asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            d = _distances(_lifted(x, most), lifted)
            flat = np.column_stack((x.astype(np.float64), np.zeros(len(x))))
            dq = _distances(flat, lifted)
            group, qgroup = d.argmin(axis=1), dq.argmin(axis=1)
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(asks), pa.array(group, pa.int32()), pa.array(d[at, group]), pa.array(qgroup, pa.int32()), pa.array(dq[at, qgroup])], names=["id", "query", "g", "d", "qg", "dq"])

    dealt = stored(own.mapInArrow(tidy(assign), "id long, query boolean, g int, d double, qg int, dq double"), "groups")
    near = dealt.groupBy("g", "id").agg(F.min("d").alias("d"))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))).where(F.col("rn") <= k + 1)
    near = [(r["g"], r["d"], r["id"]) for r in near.select("g", "d", "id").collect()]
    radius = {r["qg"]: (r["n"], r["u"]) for r in dealt.where("query").groupBy("qg").agg(F.count("*").alias("n"), F.max("dq").alias("u")).collect()}
    between = _distances(lifted, lifted)
    reach, blocks = np.full(len(sample), -1.0), np.zeros(len(sample), np.int64)
    for i, (size, u) in radius.items():
        bound: dict[int, float] = {}
        for far, x in sorted((u + between[i, j] + d, x) for j, d, x in near):
            bound.setdefault(x, far)
        theta = list(bound.values())[k] if len(bound) > k else np.inf
        reach[i], blocks[i] = (u + theta) * (1 + 1e-9) + 1e-6, -(-size // BLOCK)
    chunks = max(1, -(-n // CHUNK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _rows(b.column(1), dim), b.column(0).to_numpy()
            near = _distances(_lifted(x, most), lifted) <= reach
            raw = [r.tobytes() for r in np.ascontiguousarray(x, kind)]
            for i in np.flatnonzero(blocks):
                rows = np.flatnonzero(near[:, i])
                for block in range(blocks[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i), pa.int32()), pa.array(np.full(len(rows), block), pa.int32()), pa.array((ids[rows] * 2654435761 >> 7) % chunks, pa.int32()), pa.array(ids[rows]), pa.array([raw[r] for r in rows], pa.binary())], names=["g", "block", "chunk", "id", "x"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _rows(b.column(1), dim), b.column(0).to_numpy()
            i = _distances(np.column_stack((x.astype(np.float64), np.zeros(len(x)))), lifted).argmin(axis=1)
            raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())
            block = (ids * 40503 >> 5) % np.maximum(blocks[i], 1)
            for c in range(chunks):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(x), c), pa.int32()), pa.array(ids), raw], names=["qg", "qblock", "qchunk", "qid", "q"])

    def solve(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(xs):
            use = np.float64 if exact else np.int64
            x = np.frombuffer(b"".join(xs["x"]), kind).reshape(len(xs), dim).astype(use)
            q = np.frombuffer(b"".join(qs["q"]), kind).reshape(len(qs), dim).astype(use)
            ids, asks = xs["id"].to_numpy(), qs["qid"].to_numpy()
            for at in range(0, len(q), 256):
                s = q[at : at + 256] @ x.T
                s[asks[at : at + 256, None] == ids] = -np.inf if exact else np.iinfo(np.int64).min
                row, col = best_of(s, ids, k)
                out.append(pd.DataFrame({"query_id": asks[at + row], "id": ids[col], "score": s[row, col].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")

    data = own.select("id", "v").mapInArrow(tidy(send), "g int, block int, chunk int, id long, x binary")
    asked = own.where("query").select("id", "v").mapInArrow(tidy(ask), "qg int, qblock int, qchunk int, qid long, q binary")
    found = asked.groupBy("qg", "qblock", "qchunk").cogroup(data.groupBy("g", "block", "chunk")).applyInPandas(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def integer_search(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """The 20 best of every 20th vector among all others, over floor(64 x)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    rows = embeddings.where(finite("embedding")).select(F.col("vec_id").alias("id"), whole.alias("vector"))
    found = top_k(rows, k, is_query=F.pmod("id", F.lit(20)) == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


INTEGER_SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.id AS query_id, d.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.id % 20 = 0 AND q.id <> d.id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
