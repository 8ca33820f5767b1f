"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def contract(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over pairs: each node that is not the least of its class -> that least node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: a forest of stars over the same classes, so bounded by one batch's nodes."""
    for b in batches:
        star = contract(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if star:
            yield pa.RecordBatch.from_arrays([pa.array(star.keys(), pa.int64()), pa.array(star.values(), pa.int64())], schema=EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable over ``edges`` (a, b: long).

    Large-star and small-star steps, each an aggregation and a join; every round is written to
    the shared folder. Only nodes that have an edge are returned; nulls and loops are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = stored(now.mapInArrow(_contract_batches, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        before, now = now, stored(small.where("a <> b").distinct(), "edges")
        dropped(before)
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
