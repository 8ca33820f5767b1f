"""Stored points: their form, defaults and metadata, guards, lookups, and cached translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CACHE_KEYS, DOUBTFUL, REUSABLE
from ..functions.vector import norm

UUID = r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def created(spark: SparkSession, name: str, schema: T.StructType, dim: int, vector: str = "vector") -> DataFrame:
    """The table ``name``, made empty if it isn't there; an error if the dimension it was made with is another."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{vector}_dim' = '{int(dim)}')")
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get(f"{vector}_dim")
    if told != str(dim):
        raise ValueError(f"{name} holds vectors of {told} dimensions, not {dim}")
    return spark.table(name)


def vector_problem(vector: Column, dim: int) -> Column:
    """What keeps a vector from being stored: missing, dimension, value or zero; null if nothing does."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dim, "dimension").when(odd, "value").when(norm(vector) == 0, "zero")


def guarded(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """``points``; a point whose vector can't be stored fails the job."""
    problem = vector_problem(F.col(vector), dim)
    wrong = F.raise_error(F.concat(F.lit("vector: "), problem)).cast(points.schema[vector].dataType)
    return points.withColumn(vector, F.when(problem.isNotNull(), wrong).otherwise(F.col(vector)))


def with_metadata(points: DataFrame, model: str, dim: int) -> DataFrame:
    return points.withColumns({"embedding_model": F.lit(model), "embedding_dim": F.lit(dim), "embedding_normalized": F.lit(True)})


def zero_vector(dim: int) -> Column:
    """A placeholder for points that are never searched."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def provenance(*columns: str) -> Column:
    """Where a word comes from, as one struct."""
    return F.struct(*columns).alias("provenance")


#: Defaults of what is shown of each kind of point.
DEFAULTS = {
    "tags": {"word": "", "country": "", "category": None, "compliance_status": DOUBTFUL, "reason": "", "source": "", "trend_score": 0.0},
    "anchors": {"cn_word": "", "category": None, "created_at": None},
    "pending": {"word": "", "country": "", "category": None, "assessment_reason": "", "source": "overseas"},
    "candidates": {"word": "", "category": None, "compliance_status": REUSABLE, "compliance_reason": "", "similarity": 0.0},
}


def shown(points: DataFrame, kind: str) -> DataFrame:
    """id and the kind's columns, defaults where a point lacks them; a missing column is all default."""
    def one(name: str, default) -> Column:
        c = F.col(name) if name in points.columns else F.lit(None)
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    return points.select("id", *(one(*x) for x in DEFAULTS[kind].items()))


def shown_reason(compliance_reason: Column, reason: Column) -> Column:
    """The reason of a recommendation: that of the compliance check, else the general one."""
    return F.coalesce(F.nullif(compliance_reason, F.lit("")), reason)


def looked_up(points: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """Points that are asked for; texts that are no UUID find nothing."""
    good = asked.select(key).distinct().where(F.col(key).rlike(UUID))
    return points.join(good, key, "left_semi")


def untranslated(words: DataFrame, cache: DataFrame) -> DataFrame:
    """(word, country, translation): cached translations that are texts with something in them; null asks for a new one."""
    good = cache.where(F.trim("translation") != "").select("word", "country", "translation").dropDuplicates(["word", "country"])
    return words.select("word", "country").distinct().join(good, ["word", "country"], "left")


def newest(cache: DataFrame, order: str, n: int = CACHE_KEYS) -> DataFrame:
    """The ``n`` newest keys of a cache; ties by word and country. What is left is bounded, whatever the cache was."""
    return cache.orderBy(F.desc(order), "word", "country").limit(n)


def hottest(words: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` words of the most heat, ties by the word."""
    return words.orderBy(F.desc("heat"), "word").limit(n)


def numbered(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """``rows`` with batch: every ``size`` rows of a key, in the order of a number."""
    out = running(rows, key, order, F.lit(1), "_n")
    return out.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def running(rows: DataFrame, key: str, order: str, what: Column, name: str, slices: int = 1024) -> DataFrame:
    """``rows`` with the running sum of ``what`` per key in the order of a number.

    A key may hold a third of all rows: each key's order is cut into ranges of about equal size,
    summed on its own, and the sums of the ranges before come from one row per range. A null key is a
    key; rows without an order come before all others of their key.
    """
    def by_key(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        other = right.withColumnsRenamed({c: f"_r_{c}" for c in (key, *more)})
        same = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        for c in more:
            same = same & (F.col(c) == F.col(f"_r_{c}"))
        return left.join(other, same).drop(*(f"_r_{c}" for c in (key, *more)))

    bounds = rows.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    dealt = by_key(rows, bounds).withColumn("_s", F.when(F.col(order).isNull(), -1).otherwise(F.least(F.floor((F.col(order) - F.col("_lo")) * slices / (F.col("_hi") - F.col("_lo") + 1)), F.lit(slices - 1)))).withColumn("_w", what)
    sums = dealt.groupBy(key, "_s").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows a key
    sums = sums.select(key, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = by_key(dealt.withColumn("_own", F.sum("_w").over(inside)), sums, "_s")
    return out.withColumn(name, F.col("_own") + F.col("_base")).select(*rows.columns, name)
