"""Numbered commits in a shared folder: each number is taken once, so a lost update is refused."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..operators.shared import file_system


class Conflict(Exception):
    """Another writer took the version first."""


class Commits:
    """JSON records ``folder``/<number>.json. A record is written under a name of its own and then renamed, which fails where the number is taken."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs, self.at = file_system(spark, folder)
        self.fs.mkdirs(self.at)
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, record: dict) -> None:
        """Takes ``version``; a Conflict if it is taken."""
        made, final = self._path(f".{uuid.uuid4().hex}"), self._path(f"{version:012d}.json")
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self.fs.makeQualified(made).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(made), self.fs.makeQualified(final), never)
        except Exception as e:
            self.fs.delete(made, False)
            if self.fs.exists(final):
                raise Conflict(f"{self.folder}: version {version} is taken") from e
            raise

    def drop(self, version: int) -> None:
        self.fs.delete(self._path(f"{version:012d}.json"), False)
