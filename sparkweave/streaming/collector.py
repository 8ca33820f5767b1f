"""The collector as a stream: words that arrive again are dropped, the rest go to their sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..constants import PROGRESS_KEYS


def unseen(words: DataFrame, late: str = "30 days") -> DataFrame:
    """The first arrival of each (country, word) within the watermark; ``words`` has a timestamp ``at``."""
    return words.withWatermark("at", late).dropDuplicatesWithinWatermark(["country", "word"])


def collect_stream(words: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Judges each micro-batch of unseen words (``judge`` adds action) and appends it, by action, below ``out``.

    A batch that is repeated after a failure overwrites what it had written, as its number is part of the path.
    """
    def write(batch: DataFrame, number: int) -> None:
        judge(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("action", "batch").parquet(out)

    return unseen(words).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the collector says of each candidate, and the counters of its run and key so far.
DECISIONS = "job string, country string, run_id string, pos long, word string, category string, trend_score double, source string, action string, duplicate boolean, approved long, pending long, rejected long, duplicates long, added long, processed long"
_COUNTED = ("approved", "pending", "rejected", "duplicates", "added", "processed")


class History(StatefulProcessor):
    """Of each (job, country) the newest ``keys`` words that were processed, and the counters of the run at hand.

    A word among them is a duplicate and keeps its place; any other is processed and becomes the newest, whether
    the store knew it or not. The oldest goes when there are too many, or, with ``expire_ms``, when a run comes
    whose time is that much later. Expiry goes by the times of the runs, not by timers: a stream with timers on the
    clock never ends of itself, and one with timers on a watermark would drop the rows of late runs.
    """

    def __init__(self, keys: int, expire_ms: int | None):
        self.keys, self.expire_ms = keys, expire_ms

    def init(self, handle) -> None:
        self.place = handle.getMapState("place", "word string", "n long")
        self.order = handle.getMapState("order", "n long", "word string, at long")
        self.span = handle.getValueState("span", "first long, next long")
        self.run = handle.getValueState("run", "run_id string, " + ", ".join(f"{c} long" for c in _COUNTED))

    def _forget(self, first: int, upto: int, now: int) -> int:
        """Removes the oldest words beyond the limit or past their time; the number of the oldest left."""
        while first < upto:
            word, at = self.order.getValue((first,))
            if upto - first <= self.keys and (self.expire_ms is None or at + self.expire_ms > now):
                break
            self.order.removeKey((first,))
            self.place.removeKey((word,))
            first += 1
        return first

    def handleInputRows(self, key, rows, timerValues):
        job, country = key
        first, upto = self.span.get() if self.span.exists() else (0, 0)
        held = self.run.get() if self.run.exists() else None
        run, counts = (held[0], dict(zip(_COUNTED, held[1:], strict=True))) if held else (None, {})
        # a run has a bounded number of candidates a country, and a trigger reads one file
        todo = pd.concat(list(rows)).sort_values(["at", "run_id", "pos", "word"], kind="stable")
        out = []
        for r in todo.to_dict("records"):
            if r["run_id"] != run:
                run, counts = r["run_id"], dict.fromkeys(_COUNTED, 0)
            now = 0 if pd.isna(r["at"]) else int(r["at"].timestamp() * 1000)
            first = self._forget(first, upto, now)
            word, counts["processed"] = r["word"], counts["processed"] + 1
            old = self.place.containsKey((word,))
            duplicate = old or bool(r["known"])
            if duplicate:
                counts["duplicates"] += 1
            else:
                action = str(r["action"])
                counts["approved" if action in ("approved", "inserted") else "pending" if action.startswith("pending") else "rejected"] += 1
                counts["added"] += action in ("approved", "inserted")
            if not old:
                self.place.updateValue((word,), (upto,))
                self.order.updateValue((upto,), (word, now))
                upto += 1
                first = self._forget(first, upto, now)
            out.append({"job": job, "country": country, **{c: r[c] for c in ("run_id", "pos", "word", "category", "trend_score", "source")}, "action": None if duplicate else r["action"], "duplicate": duplicate, **counts})
        self.span.update((first, upto))
        self.run.update((run, *(counts[c] for c in _COUNTED)))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def decisions(candidates: DataFrame, known: DataFrame, keys: int = PROGRESS_KEYS, expire_ms: int | None = None) -> DataFrame:
    """What becomes of the candidates of collection runs, as a stream: see ``DECISIONS``.

    candidates: job, country, run_id, at, pos, word, category, trend_score, source, action (what the word's
    assessment says, see ``route``; inserted for Chinese words), rows of a run in the order of pos. known:
    (country, word) of the store. Words in the newest ``keys`` of their (job, country), or known, are
    duplicates without an action. Counters run on within a run and key; added counts what was stored.
    Candidates without a word are left out; a null country is a key of its own.
    """
    there = known.select("country", "word").distinct().withColumn("known", F.lit(True))
    rows = candidates.where("word IS NOT NULL").join(there, ["country", "word"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.select("job", "country", "run_id", "at", F.col("pos").cast("long").alias("pos"), "word", "category", F.col("trend_score").cast("double").alias("trend_score"), "source", "action", "known")
    return rows.groupBy("job", "country").transformWithStateInPandas(History(keys, expire_ms), DECISIONS, "Append", "None")


CANDIDATES = "job string, country string, run_id string, at timestamp, pos long, word string, category string, trend_score double, source string, action string"


def submit(candidates: DataFrame, folder: str) -> None:
    """Puts a run's candidates, as one file, where the collector's stream finds them."""
    schema = T._parse_datatype_string(CANDIDATES)
    candidates.select(*(F.col(f.name).cast(f.dataType) for f in schema)).coalesce(1).write.mode("append").parquet(folder)  # a run is capped


def run_collector(spark: SparkSession, folder: str, known: DataFrame, out: str, checkpoint: str, keys: int = PROGRESS_KEYS, expire_ms: int | None = None) -> StreamingQuery:
    """Decides on all runs submitted below ``folder`` since the last time, one a micro-batch in the order of arrival, and writes them below ``out``.

    Progress lives in the checkpoint: a restart goes on after the last whole micro-batch, and one that is repeated
    replaces what it had written, as its number is part of the path.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        rows = spark.readStream.schema(CANDIDATES).option("maxFilesPerTrigger", 1).parquet(folder)
        return decisions(rows, known, keys, expire_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)


def summaries(decided: DataFrame) -> DataFrame:
    """(job, run_id, total, skipped, approved, pending, rejected, duplicates, added): a run as its report gives it; skipped if all its words were duplicates."""
    a, fresh = F.col("action"), ~F.col("duplicate")
    count = lambda c, name: F.count_if(c).alias(name)
    stored = a.isin("approved", "inserted")
    out = decided.groupBy("job", "run_id").agg(F.count("*").alias("total"), count(fresh & stored, "approved"), count(fresh & a.startswith("pending"), "pending"), count(fresh & ~stored & ~a.startswith("pending"), "rejected"), count(~fresh, "duplicates"))
    return out.select("job", "run_id", "total", (F.col("duplicates") == F.col("total")).alias("skipped"), "approved", "pending", "rejected", "duplicates", F.col("approved").alias("added"))
