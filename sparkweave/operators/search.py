"""Vector search with filters: recall, alignment to anchors, reranking with back-fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import RECALL, RERANK, REUSABLE, THRESHOLD_WITH_CATEGORY, THRESHOLD_WITHOUT
from ..functions.text import casefold
from ..functions.vector import norm
from .shared import stored

#: Queries and points that one task compares with each other.
BLOCK, CHUNK = 1024, 8192
#: Components of the queries that points stream by, four times their results at most; copies of points for each row of a key that smaller blocks may
#: cost; points to start with and at once; results that wait to be ranked.
VALUES, COPIES, STEP, WAIT = 2**20, 3, (64, 2048), 2**20
#: Queries that cells are tried on, and cells a query may visit on average.
PROBES, VISITS = 256, 8
#: Points of a cell, and the most cells of all keys: their centres are sent to every task.
CELL, CELLS = 512, 4096
#: Slack of an angle worked out in double precision.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a key and a finite vector that isn't zero, and the vector's length as a further key."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col("key").isNotNull() & v.isNotNull() & finite & (F.coalesce(norm(v), F.lit(0.0)) > 0)).withColumn("dim", F.size(v))


def _compared(asked: DataFrame, there: DataFrame, k: int) -> DataFrame:
    """(qid, id, similarity): of each (key, dim, cell), blocks of queries meet chunks of points and keep k points a query."""
    by = ["key", "dim", "cell"]
    count = lambda size, name: F.ceil(F.count("*") / size).cast("int").alias(name)
    sizes = asked.groupBy(*by).agg(count(BLOCK, "blocks")).join(there.groupBy(*by).agg(count(CHUNK, "chunks")), by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, by).select(*by, F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("b"), every("chunks").alias("c"), "qid", "q")
    there = there.join(sizes, by).select(*by, every("blocks").alias("b"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("c"), "id", "vector")
    schema = T.StructType([asked.schema["qid"], there.schema["id"], T.StructField("similarity", T.DoubleType())])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            order = pa.compute.sort_indices(right["id"]).to_numpy().astype(np.int64)
            x = _matrix(right["vector"])[order]
            asks = _matrix(left["q"])
            for at in range(0, len(asks), 256):
                s = np.round(asks[at : at + 256] @ x.T, 6)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows.append(np.repeat(np.arange(at, at + len(s)), best.shape[1]))
                cols.append(order[best].ravel())
                values.append(np.take_along_axis(s, best, axis=1).ravel())
        take = lambda c, i: c.combine_chunks().take(pa.array(np.concatenate(i)))
        return pa.table({"qid": take(left["qid"], rows), "id": take(right["id"], cols), "similarity": pa.array(np.concatenate(values))})

    return asked.groupBy(*by, "b", "c").cogroup(there.groupBy(*by, "b", "c")).applyInArrow(solve, schema)


class Best:
    """The k most similar points of each query of a block, while points pass by in ascending order of their ids."""

    def __init__(self, asked: pa.Table, k: int):
        self.qids, self.asks, self.k = asked["qid"].combine_chunks(), _matrix(asked["vector"]), k
        self.least = np.full(len(asked), -np.inf)  # of queries that have k points, the similarity that others must exceed
        self.rows, self.at, self.values, self.ids = [], [], [], []
        self.held = self.hits = self.seen = self.new = 0
        self.wait = max(WAIT, 2 * len(asked) * k)

    def meet(self, points: pa.RecordBatch) -> None:
        ids, x = points.column("id"), _matrix(points.column("vector"))
        at = 0
        while at < len(x):
            n = min(max(self.seen, STEP[0]), STEP[1], len(x) - at)
            step, first = x[at : at + n].T, self._hold(ids.slice(at, n))
            for q in range(0, len(self.asks), 256):
                s = self.asks[q : q + 256] @ step
                r, c = np.nonzero(s > self.least[q : q + 256, None])
                self._add(r + q, c + first, np.round(s[r, c], 6))
                if self.hits > self.wait:
                    self._rank()
                    first = self._hold(ids.slice(at, n))
            at += n
            self.seen += n
            self.new += n
            if 2 * self.new >= self.seen or self.new > self.wait:  # thresholds rise whenever the points have doubled
                self._rank()

    def _hold(self, ids: pa.Array) -> int:
        self.ids.append(ids)
        self.held += len(ids)
        return self.held - len(ids)

    def _add(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        self.rows.append(rows)
        self.at.append(at)
        self.values.append(values)
        self.hits += len(rows)

    def _rank(self) -> None:
        """Keeps k points a query: the sort is stable, so of equal ones the first, that with the smallest id."""
        rows, at, values = np.concatenate(self.rows), np.concatenate(self.at), np.concatenate(self.values)
        order = np.lexsort((-values, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = rows[place == self.k - 1]
        self.least[last] = values[order][place == self.k - 1]
        kept = place < self.k
        ids = pa.concat_arrays(self.ids).take(pa.array(at[order][kept]))
        self.rows, self.at, self.values, self.ids = [], [], [], [ids]
        self.held, self.hits, self.new = len(ids), 0, 0
        self._add(rows[kept], np.arange(len(ids)), values[order][kept])

    def found(self) -> pa.Table:
        self._rank()
        return pa.table({"qid": self.qids.take(pa.array(self.rows[0])), "id": self.ids[0], "similarity": pa.array(self.values[0])})


def _streamed(asked: DataFrame, there: DataFrame, k: int) -> DataFrame:
    """(qid, id, similarity): blocks of queries meet all points of their (key, dim), which stream by, and keep k points a query.

    Each query is shuffled once and each point once a block. Blocks are as large as memory allows; where points are few beside queries they are
    smaller, so that there are more tasks.
    """
    by = ["key", "dim"]
    n, p = F.col("n"), F.col("p")
    sizes = asked.groupBy(*by).agg(F.count("*").alias("n")).join(there.groupBy(*by).agg(F.count("*").alias("p")), by)
    fewest = F.ceil(n / F.greatest(F.lit(BLOCK), F.floor(F.lit(VALUES) / F.greatest(F.col("dim"), F.lit(4 * k)))))
    blocks = F.greatest(fewest, F.least(F.ceil(n / F.lit(BLOCK)), F.floor(F.lit(COPIES) * (n + p) / p)))
    sizes = sizes.select(*by, blocks.cast("int").alias("blocks"))
    rows = asked.join(sizes, by).select(*by, F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("b"), F.lit(False).alias("point"), "qid", F.lit(None).cast(there.schema["id"].dataType).alias("id"), F.col("q").alias("vector"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    rows = rows.unionByName(there.join(sizes, by).select(*by, every, F.lit(True).alias("point"), F.lit(None).cast(asked.schema["qid"].dataType).alias("qid"), "id", "vector"))
    schema = T.StructType([asked.schema["qid"], there.schema["id"], T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries, best = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            new = np.ones(len(batch), bool)
            new[1:] = np.any([pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=0)
            ends = [*np.flatnonzero(new)[1:].tolist(), len(batch)]
            for a, z in zip([0, *ends], ends, strict=False):
                part = batch.slice(a, z - a)
                name = [c[0] for c in part.columns[:3]]
                if name != block:
                    if best:
                        yield from best.found().to_batches()
                    block, queries, best = name, [], None
                if not part.column("point")[0].as_py():
                    queries.append(part)
                elif queries:
                    best = best or Best(pa.Table.from_batches(queries), k)
                    best.meet(part)
        if best:
            yield from best.found().to_batches()

    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(3 * (sizes.agg(F.sum("blocks")).first()[0] or 0), 4096))
    return rows.repartition(parts, *by, "b").sortWithinPartitions(*by, "b", "point", "id").mapInArrow(run, schema)


class Cells:
    """Cells of points by their nearest centre in angle: centres, least and greatest angle, and number of points, per (key, dim).

    Keys that would get less than one of ``CELLS`` cells have none: their points are cell -1, which every
    query of the key visits. So the number of centres is bounded whatever the table holds.
    """

    def __init__(self, points: DataFrame):
        sizes = points.groupBy("key", "dim").agg(F.count("*").alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        share = F.least(F.ceil(F.col("n") / CELL), F.floor(F.col("n") * CELLS / F.lit(total)))
        large = sizes.where((F.col("n") > CHUNK) & (share > 1)).withColumn("cells", share.cast("int"))  # at most CELLS keys
        lot = F.xxhash64("id", F.lit(11))
        drawn = points.join(F.broadcast(large), ["key", "dim"]).where(F.pmod(lot, F.ceil(F.col("n") / F.col("cells"))) == 0)
        rank = F.row_number().over(Window.partitionBy("key", "dim").orderBy(lot, "id"))
        self.centres: dict[tuple, np.ndarray] = {}
        rows = drawn.withColumn("r", rank).where("r <= cells").select("key", "dim", "vector").collect()  # at most CELLS rows
        for r in rows:
            self.centres.setdefault((r["key"], r["dim"]), []).append(r["vector"])
        for key, vectors in self.centres.items():
            x = np.array(vectors, np.float64)
            self.centres[key] = x / np.sqrt((x * x).sum(axis=1))[:, None]

    def _angles(self, batch: pa.RecordBatch, vector: str) -> Iterator[tuple[tuple, np.ndarray, np.ndarray | None]]:
        """((key, dim), row numbers, angles to the key's centres) of a batch; None for keys without cells."""
        keys = list(zip(batch.column("key").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        codes, names = pd.factorize(pd.Series(keys, dtype=object))
        for i, key in enumerate(names):
            at = np.flatnonzero(codes == i)
            c = self.centres.get(key)
            yield key, at, None if c is None else np.arccos(np.clip(_matrix(batch.column(vector).take(pa.array(at))) @ c.T, -1, 1))

    def placed(self, points: DataFrame) -> DataFrame:
        """``points`` with their cell and the angle to its centre."""
        schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, angle = np.full(len(b), -1, np.int32), np.zeros(len(b))
                for _, at, a in self._angles(b, "vector"):
                    if a is not None:
                        cell[at] = a.argmin(axis=1)
                        angle[at] = a.min(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=schema.names)

        return points.mapInArrow(run, schema)

    def measured(self, placed: DataFrame) -> Cells:
        """Itself, knowing each cell's size and angles."""
        stats = placed.where("cell >= 0").groupBy("key", "dim", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()  # a row per centre
        self.stats = {k: np.zeros((len(c), 3)) for k, c in self.centres.items()}
        for r in stats:
            self.stats[r["key"], r["dim"]][r["cell"]] = r["n"], r["lo"], r["hi"]
        return self

    def visits(self, asked: DataFrame, k: int) -> DataFrame:
        """``asked`` once for each cell to visit. With a column ``least``, the k-th best similarity so far, the cells not ruled out by it that
        the first visit left; without one the first visit: the cells of the nearest centres that hold k points together.

        A point of a cell whose centre is at angle a from the query, and whose own angles lie within lo and hi, is at least
        max(a - hi, lo - a) away.
        """
        again = "least" in asked.columns
        out = [c for c in asked.columns if c != "least"]
        schema = T.StructType([*(asked.schema[c] for c in out), T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least = b.column("least").to_numpy(zero_copy_only=False) if again else None
                for key, at, a in self._angles(b, "q"):
                    if a is None:
                        rows, cells = (at, np.full(len(at), -1)) if not again else (at[:0], at[:0])
                    else:
                        n, lo, hi = self.stats[key].T
                        order = a.argsort(axis=1, kind="stable")
                        before = np.take_along_axis(np.broadcast_to(n, a.shape), order, axis=1).cumsum(axis=1)
                        first = np.zeros(a.shape, bool)
                        np.put_along_axis(first, order, np.concatenate([np.zeros((len(a), 1)), before[:, :-1]], axis=1) < k, axis=1)
                        if again:
                            # similarities are rounded to 6 digits, so a point may be better by half a digit than it looks
                            reach = np.arccos(np.clip(np.nan_to_num(least[at], nan=-2.0) - 1e-6, -1, 1)) + SLACK
                            first = ~first & (np.maximum(a - hi, lo - a) <= reach[:, None])
                        r, cells = np.nonzero(first & (n > 0))
                        rows = at[r]
                    part = b.select(out).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], names=schema.names)

        return asked.mapInArrow(run, schema)


def _worth(cells: Cells, asked: DataFrame, there: DataFrame, k: int) -> bool:
    """Whether some queries, tried, would visit few cells beside those around them: this decides how the rest are worked out, not what is found."""
    n = asked.count()
    probes = asked.where(F.pmod(F.xxhash64("qid", F.lit(5)), F.lit(-(-n // PROBES) or 1)) == 0)
    near = _compared(cells.visits(probes, k).where("cell >= 0"), there, k)
    visits = cells.visits(probes.join(_kth(near, k), "qid", "left"), k)
    return visits.count() <= VISITS * min(n, PROBES)


def _kth(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("qid").agg(F.sort_array(F.collect_list("similarity"), False).alias("s")).select("qid", F.get("s", F.lit(k - 1)).alias("least"))  # a few lists of k a query


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(qid, id, similarity, ord): each query's k most similar points of its key: queries (qid, key, q), points (id, key, vector).

    Similarity is the cosine, rounded to 6 digits; ties go to the smaller id. Null and zero vectors, those with a component
    that is null or not finite, and null keys take no part; vectors of different lengths don't meet.

    Points stream by blocks of queries. Keys of more than a chunk of points are cut into cells first, and some queries
    are tried on them. A query visits the cells around it; its k-th similarity there rules out, by the triangle inequality on angles,
    cells that can't hold a better point. Where that leaves few cells, as on clustered vectors, each query visits its own. Where it leaves
    most, a copy of each query for each cell would fill the disk, so all points stream by as before. Either way is exact.
    """
    asked, there = _usable(queries.select("qid", "key", "q"), "q"), _usable(points.select("id", "key", "vector"), "vector")
    most = there.groupBy("key", "dim").count().agg(F.max("count")).first()[0] or 0
    cells = Cells(there) if most > CHUNK else None
    if cells and cells.centres:
        placed = stored(cells.placed(there), "placed")
        cells.measured(placed)
        there = placed.drop("angle")
        if _worth(cells, asked, there, k):
            first = cells.visits(asked, k)
            near = stored(_compared(first.where("cell >= 0"), there, k), "near")
            found = near.unionByName(_compared(cells.visits(asked.join(_kth(near, k), "qid", "left"), k), there, k))
            found = found.unionByName(_streamed(first.where("cell < 0").drop("cell"), there.where("cell < 0").drop("cell"), k))
        else:
            found = _streamed(asked, there.drop("cell"), k)
    else:
        found = _streamed(asked, there, k)
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return found.withColumn("ord", F.row_number().over(w).cast("long")).where(F.col("ord") <= k)


def recall(tags: DataFrame, queries: DataFrame, k: int = RECALL) -> DataFrame:
    """Each query's k most similar reusable tags of its country: queries (qid, country, q), tags (id, ..., vector)."""
    usable, asked = stored(tags.where(F.col("compliance_status") == REUSABLE), "usable"), stored(queries, "asked")
    found = nearest(asked.withColumnRenamed("country", "key"), usable.withColumnRenamed("country", "key"), k)
    return found.join(asked.drop("country", "q"), "qid").join(usable.drop("vector"), "id")


def category_filter(candidates: DataFrame, category: Column) -> DataFrame:
    """After recall: candidates without a category stay, others only if it is the one asked for (if any is)."""
    return candidates.where(category.isNull() | F.col("category").isNull() | (F.col("category") == category))


def recommend(tags: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """queries (qid, country, q, want): 16 recalled, filtered by category, 8 kept, k returned."""
    kept = category_filter(recall(tags, queries), F.col("want"))
    w = Window.partitionBy("qid").orderBy("ord")
    return kept.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= min(k, RERANK))


def align(words: DataFrame, anchors: DataFrame, with_category: float = THRESHOLD_WITH_CATEGORY, without: float = THRESHOLD_WITHOUT) -> DataFrame:
    """Each word's best anchor (of its category, if it has one) at or over the threshold, else nulls: words (id, category, vector)."""
    each = F.when(F.col("category").isNotNull(), F.concat(F.lit("c:"), "category")).otherwise("*")
    asked = words.select(F.col("id").alias("qid"), each.alias("key"), F.col("vector").alias("q"))
    # words without a category meet all anchors, others those that share it
    keys = F.array_compact(F.array(F.lit("*"), F.concat(F.lit("c:"), "category")))
    there = anchors.select("id", F.explode(keys).alias("key"), "vector")
    best = nearest(asked, there, 1).select(F.col("qid").alias("id"), F.col("id").alias("_anchor"), F.col("similarity").alias("_s"))
    best = best.join(anchors.select(F.col("id").alias("_anchor"), F.col("cn_word").alias("_w")), "_anchor")
    out = words.drop("vector").join(best, "id", "left")
    enough = F.col("_s") >= F.when(F.col("category").isNotNull(), with_category).otherwise(without)
    hit = lambda c: F.when(enough, c)
    return out.select(*words.drop("vector").columns, hit(F.col("_anchor")).alias("anchor_id"), hit(F.col("_w")).alias("anchor_word"), hit(F.col("_s")).alias("anchor_score"))


def rerank(candidates: DataFrame, picks: DataFrame, k: int) -> DataFrame:
    """Model picks (qid, pick_ord, word, reason) that are candidates (qid, word, similarity) first, in their order, then the most similar others.

    Of candidates that differ in case only, picks take the last and the fill the first.
    """
    c = candidates.withColumn("key", casefold(F.col("word")))
    by_key = Window.partitionBy("qid", "key")
    c = c.withColumn("first", F.row_number().over(by_key.orderBy(F.desc("similarity"), "id"))).withColumn("last", F.row_number().over(by_key.orderBy("similarity", F.desc("id"))))
    p = picks.withColumn("key", casefold(F.col("word"))).groupBy("qid", "key").agg(F.min("pick_ord").alias("pick_ord"), F.min_by("reason", "pick_ord").alias("ai_reason"))
    # one left join says of each candidate whether it was picked, so candidates are worked out once
    picked = F.coalesce(F.col("picked"), F.lit(False))
    m = c.join(p.withColumn("picked", F.lit(True)), ["qid", "key"], "left").where((picked & (F.col("last") == 1)) | (~picked & (F.col("first") == 1)))
    m = m.withColumn("phase", F.when(picked, 0).otherwise(1)).withColumn("place", F.when(picked, F.col("pick_ord").cast("double")).otherwise(-F.col("similarity")))
    w = Window.partitionBy("qid").orderBy("phase", "place", "id")
    out = m.withColumn("position", F.row_number().over(w).cast("long"))
    return out.where(F.col("position") <= k).withColumn("ai_generated", F.col("phase") == 0).drop("key", "first", "last", "picked", "place", "phase")
