"""Table upkeep: keyed upserts, deletes, paging, and the governance records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import row_hash


def upsert(table: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, whole, by ``seq``; a null one is before all others, and of equal ones the new row counts.

    Of new rows equal in key and ``seq`` the greatest as JSON counts, so that a repeated run gives the same. Rows of a null key are one key.
    """
    old, new = (df.withColumn("_side", F.lit(i)) for i, df in enumerate((table, rows)))
    both = old.unionByName(new, allowMissingColumns=True)
    names = [c for c in both.columns if c != "_side"]
    whole = F.struct(*names)
    last = F.struct(F.col(seq).isNotNull(), F.col(seq), F.col("_side"), F.to_json(whole))
    return both.groupBy(key).agg(F.max_by(whole, last).alias("r")).select("r.*")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def keyset_page(table: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """A page of ``size`` rows from ``cursor`` on (the key of its first row), and one more that holds the next cursor."""
    rows = table if cursor is None else table.where(F.col(key) >= cursor)
    return rows.orderBy(key).limit(size + 1)


def offset_page(table: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(size)


def merged_cache(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of two maps in long form; the new value wins."""
    n = new.withColumnRenamed(value, "_new")
    return old.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", value).alias(value))


def chain_append(events: DataFrame, head: str, chain: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Events (id, ...) with hash and prev_hash, each over its predecessor's: a fold in id order, one chain at a time.

    The fold is sequential by nature: one task streams a chain's events in order and holds a batch
    and the last hash. ``chain`` names the column of independent chains; with ``heads`` (chain, head) each goes
    on from its own, and those without one from ``head``.
    """
    parts = ["id", "ts", "actor", "action", "rtype", "rid"]
    keys = [chain] if chain else []
    body = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).alias("body")
    rows = events.select(*keys, F.col("id").cast("long").alias("id"), body)
    start = F.lit(head)
    if heads is not None:
        rows = rows.join(heads.select(F.col("chain").alias(chain), "head"), chain, "left")
        start = F.coalesce("head", F.lit(head))
    rows = rows.select(*keys, "id", start.alias("start"), "body")
    rows = (rows.repartition(chain) if chain else rows.repartition(1)).sortWithinPartitions(*keys, "id", "body")
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["id"], T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = (), head
        for b in batches:
            hashes = []
            for *key, start, text in zip(*(b.column(i).to_pylist() for i in [*range(len(keys)), len(keys) + 1, len(keys) + 2])):
                if key != now:
                    now, last = key, start
                before, last = last, hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                hashes.append((before, last))
            columns = [pa.array([h[i] for h in hashes], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *columns], names=schema.names)

    return rows.mapInArrow(fold, schema)


def chain_verify(log: DataFrame, *chain: str) -> DataFrame:
    """``log`` with ok: the link to the row before (the first one's is not checked) and the recomputed hash."""
    w = Window.partitionBy(*chain).orderBy("id")
    own = row_hash(F.col("prev_hash"), *(F.col(c) for c in ("id", "ts", "actor", "action", "rtype", "rid")))
    before = F.lag("hash").over(w)
    return log.withColumn("ok", (own == F.col("hash")) & (before.isNull() | (before == F.col("prev_hash"))))


def purge(table: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than ``days``; those without a time stay."""
    return table.where(~F.coalesce(F.col(ts) < now - F.make_dt_interval(F.lit(days)), F.lit(False)))


def redact_json(c: Column, term: str, mark: str = "<REDACTED>") -> Column:
    """Replaces a term in all string values of a JSON text, whatever their depth; keys stay.

    A text without such a value stays as it was, letter for letter. In a text that isn't JSON, or is
    nested too deep for a parser, the term is replaced as it stands; an empty term replaces nothing.
    """
    def walk(v) -> bool:
        """Redacts a list or object in place; whether anything changed. Nesting is on a stack of its own."""
        open_, changed = [v], False
        while open_:
            x = open_.pop()
            for k, y in x.items() if isinstance(x, dict) else enumerate(x):
                if isinstance(y, str) and term in y:
                    x[k], changed = y.replace(term, mark), True
                elif isinstance(y, (dict, list)):
                    open_.append(y)
        return changed

    def one(t: str | None) -> str | None:
        if t is None or not term:
            return t
        try:
            v = [json.loads(t)]
            return json.dumps(v[0], ensure_ascii=False) if walk(v) else t
        except (ValueError, RecursionError):
            return t.replace(term, mark)

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(c)
