"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are laid down once in blocks: of each dimension the values that occur in the block, and of
each vector the numbers of its values among them. In a round a task tabulates the squared difference
of every dimension, occurring value and centroid; a distance is then a sum of looked-up entries, with
no arithmetic on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, stored, tidy

#: Vectors of one block; a value's number among those of its dimension fits 16 bits.
BLOCK = 4096
#: Integers up to here have squared distances that fit a long.
GREATEST = 1 << 27


def _integers(vectors: DataFrame, dim: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors of ``dim`` finite components as integers floor(scale * x); greater ones than the arithmetic holds fail the job."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    great = F.raise_error(F.lit(f"clustering: a component is beyond {GREATEST} in integers, so its squared distances fit no long")).cast("long")
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) > GREATEST, great).otherwise(F.floor(c.cast("double") * scale))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & ~odd).select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` as blocks (ids, sizes, occurring, codes): per dimension how many values occur and which, and each vector's value numbers, dimension by dimension."""
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("occurring", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                values, codes = zip(*(np.unique(x[:, d], return_inverse=True) for d in range(dim)), strict=True)
                columns = [[part.column(0)], [[len(v) for v in values]], [np.concatenate(values)], [np.stack(codes).astype(np.uint16).tobytes()]]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), columns[0][0])
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.binary())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def _nearest(sizes: np.ndarray, occurring: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each vector of a block, ties to the smaller number."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for d in range(len(sizes)):
        values = occurring[start[d] : start[d + 1]]
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table.take(codes[d], axis=0)
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def _read(b: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes, occurring = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
    return sizes, occurring, np.frombuffer(b.column(3)[i].as_buffer(), np.uint16).reshape(dim, -1)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floor of its vectors' mean, an empty one as it was.

    A task sends on the sums of what it saw, one row per centroid; Spark adds them up, and the driver
    gets as many rows as there are centroids.
    """
    k, dim = centroids.shape
    schema = "cluster int, n long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                sizes, occurring, codes = _read(b, i, dim)
                best, _ = _nearest(sizes, occurring, codes, centroids)
                count += np.bincount(best, minlength=k)
                start = np.concatenate([[0], np.cumsum(sizes)])
                for d in range(dim):
                    # how often each value occurs in each cluster, times the value
                    seen = np.bincount(best * sizes[d] + codes[d], minlength=k * sizes[d]).reshape(k, sizes[d])
                    sums[:, d] += seen @ occurring[start[d] : start[d + 1]]
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(tidy(run), schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dim)))
    out = centroids.copy()
    for r in parts.collect():  # a row per centroid
        out[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((vec_id, cluster, distance), (cluster, centroid, n, inertia)): ``rounds`` of exact k-means over floor(scale * x), and one last assignment.

    Centroids start as the ``k`` vectors whose SHA-256 of "seed:vec_id" is least, in this order (fewer
    if there are fewer; equal hashes go by the vector). Only vectors with exactly ``dim`` components,
    none null or not finite, take part: others have no row. Repeated rows and ids are vectors of their
    own, a null id is hashed as empty text, an empty table gives two empty ones, and other columns
    are not read. Components beyond 2**27 in integers fail the job with a message, since their
    squared distances need not fit a long. Ties go to the smaller centroid number.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors, dim, scale, vec_id, vector)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k vectors
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    per = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("inertia", T.LongType())])
    if not first:
        return spark.createDataFrame([], schema), spark.createDataFrame([], per)
    centroids = np.array([r["v"] for r in first], np.int64)
    blocks = stored(_blocks(rows, dim), "blocks")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                best, distance = _nearest(*_read(b, i, dim), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(best, pa.int32()), pa.array(distance)], names=schema.names)

    assigned = stored(blocks.mapInArrow(tidy(run), schema), "assigned")
    dropped(blocks)
    totals = {r["cluster"]: (r["n"], r["s"]) for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()}  # a row per centroid
    return assigned, spark.createDataFrame([(c, v.tolist(), *totals.get(c, (0, 0))) for c, v in enumerate(centroids)], per)


def clusters(vectors: DataFrame) -> DataFrame:
    """Every vector's cluster, with the sums of distances over its cluster and over all, and the hash of its centroid."""
    assigned, centroids = cluster(vectors)
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    per = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(text, 256).alias("centroid_sha256"))
    total = centroids.agg(F.sum("inertia").alias("inertia"))
    return assigned.join(F.broadcast(per.crossJoin(total)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL, one common table per round, vectors as a row per component."""
    near = "SELECT v.vec_id, c.k AS cluster, sum((v.x - c.x) * (v.x - c.x)) AS s FROM v JOIN {c} c ON c.d = v.d GROUP BY v.vec_id, c.k"
    best = "SELECT vec_id, arg_min(cluster, s * 64 + cluster) AS cluster, min(s) AS s FROM ({near}) GROUP BY vec_id"
    parts = [
        "e AS (SELECT vec_id, embedding AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, CAST(floor(256 * CAST(unnest(x) AS DOUBLE)) AS BIGINT) AS x FROM e)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS k FROM e QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT f.k, v.d, v.x FROM f JOIN v USING (vec_id))",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({best.format(near=near.format(c=f'c{i}'))})")
        parts.append(f"m{i} AS (SELECT a.cluster, v.d, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id) GROUP BY a.cluster, v.d)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.d, CAST(CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.k AND m.d = c.d)")
    parts.append(f"z AS MATERIALIZED ({best.format(near=near.format(c=f'c{rounds}'))})")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY k)")
    return f"WITH {', '.join(parts)} SELECT z.vec_id, CAST(z.cluster AS INTEGER) AS cluster, CAST(z.s AS BIGINT) AS distance, CAST(sum(z.s) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(z.s) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256 FROM z JOIN h ON h.k = z.cluster"


CLUSTER_SQL = _sql()
