"""Runs that leave START, then COMPLETE with what Spark counted on the way, or FAIL."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession

EVENTS = "run_id string, job_name string, event_type string, ts timestamp, event string"


def _got(seen: Observation, seconds: float) -> dict:
    """What Spark observed; nothing if no action ended within the time, as an observation waits for one."""
    found: dict = {}
    waiter = threading.Thread(target=lambda: found.update(seen.get), daemon=True)
    waiter.start()
    waiter.join(seconds)
    return dict(found)


class Run:
    """``with Run(spark, folder, job) as run:`` appends lineage events below ``folder``.

    ``run.counted(df, rows=F.count(F.lit(1)))`` gives ``df`` whose first write fills in the numbers, without a pass of its own;
    they are facets of the COMPLETE event, those of a frame that was never written are left out after ``wait``
    seconds. An error in the block leaves FAIL with its message and goes on up.
    """

    def __init__(self, spark: SparkSession, folder: str, job: str, run_id: str | None = None, wait: float = 10):
        self.spark, self.folder, self.job, self.run_id, self.wait = spark, folder, job, run_id or str(uuid.uuid4()), wait
        self._seen: list[tuple[str, Observation]] = []
        self.facets: dict = {}

    def _event(self, kind: str, **facets) -> None:
        now = datetime.now(timezone.utc)
        body = {"eventType": kind, "eventTime": now.isoformat(), "run": {"runId": self.run_id, **({"facets": facets} if facets else {})}, "job": {"name": self.job}}
        row = [(self.run_id, self.job, kind, now, json.dumps(body, ensure_ascii=False, default=str))]
        self.spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def counted(self, df: DataFrame, name: str = "", **what: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((name, seen))
        return df.observe(seen, *(c.alias(k) for k, c in what.items()))

    def __enter__(self) -> Run:
        self._event("START")
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None:
            self._event("FAIL", error=f"{kind.__name__}: {error}"[:500])
            return False
        for name, seen in self._seen:
            self.facets |= {f"{name}.{k}" if name else k: v for k, v in _got(seen, self.wait).items()}
        self._event("COMPLETE", **self.facets)
        return False
