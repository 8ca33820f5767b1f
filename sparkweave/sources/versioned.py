"""Stored tables with a key: merges that rewrite only the parts they touch, and versions that are whole or absent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import store
from ..operators.shared import typed
from .commits import Commits, Conflict

PART = "part_"


class VersionedTable:
    """A table below ``folder``, dealt out by the hash of its key into ``parts`` parts.

    A version is a record that names the folder of each part. A merge reads and rewrites the parts that its
    rows fall into, by Spark's own readers and writers, into a new folder, and then commits the record of
    the next version; other parts keep their files. A job that fails, or a task that does, leaves the version
    before as it was. Of two writers that started from one version the second is refused, and tries again
    on the new version (``tries`` times in all). Rows of a null key are kept like any others.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str | None = None, schema: T.StructType | str | None = None, parts: int = 32, tries: int = 5):
        self.spark, self.folder, self.tries = spark, folder.rstrip("/"), tries
        self.commits = Commits(spark, f"{self.folder}/versions")
        if not self.commits.latest():
            if key is None or schema is None:
                raise ValueError(f"{folder} holds no table; give its key and schema")
            try:
                self.commits.commit(1, {"key": key, "schema": typed(schema).json(), "parts": parts, "places": {}})
            except Conflict:  # another writer made it meanwhile
                pass
        made = self.commits.read(self.commits.latest())
        self.key, self.parts, self.schema = made["key"], made["parts"], T.StructType.fromJson(json.loads(made["schema"]))
        if key is not None and key != self.key:
            raise ValueError(f"{folder} has the key {self.key}, not {key}")

    def version(self) -> int:
        return self.commits.latest()

    def part(self) -> Column:
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.parts)).cast("int")

    def _paths(self, record: dict, only: set[int] | None = None) -> list[str]:
        return [f"{self.folder}/data/{at}/{PART}={p}" for p, at in record["places"].items() if only is None or int(p) in only]

    def _rows(self, record: dict, only: set[int] | None = None) -> DataFrame:
        paths = self._paths(record, only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was."""
        return self._rows(self.commits.read(version or self.version()))

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is asked for; only the parts that can hold them are read."""
        asked = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
        return self._rows(self.commits.read(self.version()), self._touched(asked)).join(asked, self.key, "left_semi")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["p"] for r in rows.select(self.part().alias("p")).distinct().collect()}  # at most ``parts`` numbers

    def _changed(self, touched: Callable[[DataFrame], set[int]], change: Callable[[DataFrame], DataFrame]) -> int:
        for attempt in range(self.tries):
            at = self.version()
            record = self.commits.read(at)
            only = touched(self._rows(record))
            if not only:
                return at
            place = f"v{at + 1}-{uuid.uuid4().hex}"
            path = f"{self.folder}/data/{place}"
            after = change(self._rows(record, only)).select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn(PART, self.part())
            try:
                after.repartition(PART).write.partitionBy(PART).parquet(path)
                data = self._written(path)
                places = {p: x for p, x in record["places"].items() if int(p) not in only} | {str(p): place for p in sorted(only & data)}
                self.commits.commit(at + 1, {**record, "places": places})
                return at + 1
            except Conflict:
                self._remove(path)
                if attempt + 1 == self.tries:
                    raise
            except Exception:
                self._remove(path)
                raise
        raise Conflict(self.folder)

    def _written(self, path: str) -> set[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in self.commits.fs.listStatus(at)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{PART}=")}

    def _remove(self, path: str) -> None:
        self.commits.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def upsert(self, rows: DataFrame, seq: str) -> int:
        """Each key's last row by ``seq``, whole; see ``store.upsert`` for null and equal ones. The version after.

        The rows are worked out once and laid down, as they are read to find the parts and again for every try.
        """
        path = f"{self.folder}/incoming/{uuid.uuid4().hex}"
        try:
            mine = rows.select(*(c for c in rows.columns if c in self.schema.names))
            mine.write.parquet(path)
            mine = self.spark.read.schema(mine.schema).parquet(path)
            return self._changed(lambda _: self._touched(mine), lambda old: store.upsert(old, mine, self.key, seq))
        finally:
            self._remove(path)

    def delete(self, keys: DataFrame) -> int:
        """Without the rows whose key is among the first column of ``keys``."""
        gone = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull())
        return self._changed(lambda _: self._touched(gone), lambda old: store.delete(old, gone, self.key))

    def delete_where(self, condition: Column) -> int:
        """Without the rows that meet a condition; a null one meets none."""
        hit = F.coalesce(condition, F.lit(False))
        return self._changed(lambda table: self._touched(table.where(hit)), lambda old: old.where(~hit))

    def vacuum(self, keep: int = 1) -> None:
        """Removes the records and files that only versions before the newest ``keep`` use; no writer may be at work."""
        versions = self.commits.versions()
        kept = versions[-keep:]
        used = {at for v in kept for at in self.commits.read(v)["places"].values()}
        for v in versions[:-keep]:
            self.commits.drop(v)
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        if self.commits.fs.exists(data):
            for name in [s.getPath().getName() for s in self.commits.fs.listStatus(data)]:
                if name not in used:
                    self._remove(f"{self.folder}/data/{name}")
