"""Lists, counts and flags over stored rows, as pages and reports show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCKED, DOUBTFUL, REUSABLE


def latest(rows: DataFrame, n: int, *by: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` greatest rows by the columns ``by``; equal ones in the order of ``ties``."""
    return rows.orderBy(*(F.desc(c) for c in by), *ties).limit(n)


def unseen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among those seen, repeated ones as often as they come; a null key was never seen."""
    return rows.join(seen.select(*keys).distinct(), [*keys], "left_anti")


def flagged(rows: DataFrame, known: DataFrame, *keys: str, name: str = "known") -> DataFrame:
    """``rows`` with whether their keys are known."""
    there = known.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(there, [*keys], "left").withColumn(name, F.col(name).isNotNull())


def counts(rows: DataFrame, *keys: str, holds: str | None = None, column: str = "word") -> DataFrame:
    """Rows per ``keys`` whose column holds a text, in its case; all rows without one."""
    found = rows if holds is None else rows.where(F.contains(F.col(column), F.lit(holds)))
    return found.groupBy(*keys).agg(F.count("*").alias("n"))


def linked(anchors: DataFrame, tags: DataFrame) -> DataFrame:
    """Anchors with the number of tags that name them."""
    n = tags.groupBy(F.col("anchor_id").alias("id")).agg(F.count("*").alias("linked"))
    return anchors.join(n, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))


def dashboard(anchors: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of totals; the ratio is that of reusable tags among those that are reusable or doubtful, 0 without any."""
    none = F.lit(None).cast("string")
    rows = anchors.select(F.lit(True).alias("anchor"), none.alias("status"), none.alias("country"))
    rows = rows.unionByName(tags.select(F.lit(False).alias("anchor"), F.col("compliance_status").alias("status"), "country"))
    status = lambda x: F.count_if(F.col("status") == x)
    total = rows.agg(F.count_if("anchor").alias("anchors"), status(REUSABLE).cast("double").alias("tags"), status(DOUBTFUL).cast("double").alias("pending"), status(BLOCKED).alias("blocked"), F.count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("countries"))
    return total.withColumn("ratio", F.coalesce(F.bround(F.try_divide(F.col("tags"), F.col("tags") + F.col("pending")), 3), F.lit(0.0)))
