"""Logs laid down by day: whole days go by name, and only the day in which the cut falls is rewritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import typed
from .commits import Commits, Conflict

#: The day of rows that have no time.
NO_DAY = "none"


class DailyLog:
    """A log below ``folder`` whose rows have a time ``ts``; each version is a record of the folders of each day and their rows.

    Days are those of the session's time zone. Appends and purges commit a version each, or leave the one before.
    Of two writers that began at one version the second is refused, and tries again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str | None = None, ts: str = "ts", tries: int = 5):
        self.spark, self.folder, self.tries = spark, folder.rstrip("/"), tries
        self.commits = Commits(spark, f"{self.folder}/versions")
        if not self.commits.latest():
            if schema is None:
                raise ValueError(f"{folder} holds no log; give its schema")
            try:
                self.commits.commit(1, {"schema": typed(schema).json(), "ts": ts, "days": {}})
            except Conflict:
                pass
        made = self.commits.read(self.commits.latest())
        self.ts, self.schema = made["ts"], T.StructType.fromJson(json.loads(made["schema"]))

    def _commit(self, change) -> dict:
        for attempt in range(self.tries):
            at = self.commits.latest()
            record = self.commits.read(at)
            days, told = change(record["days"])
            try:
                self.commits.commit(at + 1, {**record, "days": days})
                return told
            except Conflict:
                if attempt + 1 == self.tries:
                    raise
        raise Conflict(self.folder)

    def _written(self, rows: DataFrame) -> dict[str, list[dict]]:
        """Writes ``rows`` by day: per day the folder and how many they are."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        day = F.coalesce(F.date_format(self.ts, "yyyy-MM-dd"), F.lit(NO_DAY))
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("day_", day).write.partitionBy("day_").parquet(path)
        counts = self.spark.read.schema("day_ string").parquet(path).groupBy("day_").count().collect()  # a row per day
        return {r["day_"]: [{"at": f"{path}/day_={r['day_']}", "n": r["count"]}] for r in counts}

    def _rows(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(p["at"] for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        new = self._written(rows)
        self._commit(lambda days: ({d: days.get(d, []) + new.get(d, []) for d in {*days, *new}}, {}))

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Rows from ``since`` on and before ``until`` ("yyyy-MM-dd HH:mm:ss"), of the days that can hold them; without bounds all, those without a time included."""
        days = self.commits.read(self.commits.latest())["days"]
        bounded = since is not None or until is not None
        parts = [p for d, ps in days.items() for p in ps if not bounded or (d != NO_DAY and (since is None or d >= since[:10]) and (until is None or d <= until[:10]))]
        rows = self._rows(parts)
        rows = rows if since is None else rows.where(F.col(self.ts) >= F.lit(since).cast("timestamp"))
        return rows if until is None else rows.where(F.col(self.ts) < F.lit(until).cast("timestamp"))

    def purge(self, cut: str) -> int:
        """Without the rows before ``cut`` ("yyyy-MM-dd HH:mm:ss"); how many went. Rows without a time stay.

        Older days go by their names and count by the record, without being read; of the day of the cut the rows that stay are written anew.
        """
        def change(days: dict) -> tuple[dict, dict]:
            old = {d for d in days if d != NO_DAY and d < cut[:10]}
            gone = sum(p["n"] for d in old for p in days[d])
            kept = {d: ps for d, ps in days.items() if d not in old}
            if edge := kept.get(cut[:10]):
                new = self._written(self._rows(edge).where(F.col(self.ts) >= F.lit(cut).cast("timestamp"))).get(cut[:10], [])
                gone += sum(p["n"] for p in edge) - sum(p["n"] for p in new)
                kept = {d: ps for d, ps in kept.items() if d != cut[:10]} | ({cut[:10]: new} if new else {})
            return kept, {"gone": gone}

        return self._commit(change)["gone"]

    def vacuum(self) -> None:
        """Removes the files and records that the newest version doesn't use; no writer may be at work."""
        last, path = self.commits.latest(), self.spark._jvm.org.apache.hadoop.fs.Path
        used = {p["at"].rsplit("/", 2)[1]: set() for ps in self.commits.read(last)["days"].values() for p in ps}
        for ps in self.commits.read(last)["days"].values():
            for p in ps:
                used[p["at"].rsplit("/", 2)[1]].add(p["at"].rsplit("/", 1)[1])
        data = path(f"{self.folder}/data")
        for s in self.commits.fs.listStatus(data) if self.commits.fs.exists(data) else []:
            name = s.getPath().getName()
            for day in self.commits.fs.listStatus(s.getPath()):
                if day.getPath().getName() not in used.get(name, ()):
                    self.commits.fs.delete(day.getPath(), True)
        for v in self.commits.versions():
            if v != last:
                self.commits.drop(v)


def purged_by_policy(logs: Mapping[str, DailyLog], policies: DataFrame, now: str) -> dict[str, int]:
    """Purges each log that has a policy (key, days) by its days before ``now`` ("yyyy-MM-dd HH:mm:ss"); the rows that went per key, 0 where none did.

    A key without a log counts -1; a null number of days is no policy.
    """
    cut = F.date_format(F.lit(now).cast("timestamp") - F.make_dt_interval(F.col("days")), "yyyy-MM-dd HH:mm:ss")
    told = policies.where("days IS NOT NULL").select("key", cut.alias("cut")).collect()  # a row per key
    return {r["key"]: logs[r["key"]].purge(r["cut"]) if r["key"] in logs else -1 for r in told}
