"""The collector as a stream, and models behind their interface."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sparkweave.sources import providers
from sparkweave.streaming import collector


def test_collector_stream(spark, tmp_path):
    schema = "country string, word string, at timestamp"
    at = dt.datetime(2026, 1, 1)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(*words: str) -> None:
        spark.createDataFrame([("DE", w, at) for w in words], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        judge = lambda df: df.withColumn("action", F.when(F.length("word") > 2, "approved").otherwise("blocked"))
        collector.collect_stream(stream, judge, out, state).awaitTermination(120)

    arrive("coat", "coat", "xy")
    arrive("coat", "shoe")
    got = sorted((r.action, r.word) for r in spark.read.parquet(out).collect())
    assert got == [("approved", "coat"), ("approved", "shoe"), ("blocked", "xy")]


def test_providers(spark):
    model = providers.Offline(8)
    words = spark.createDataFrame([("a", "DE", True), ("b", "DE", False), ("c", "DE", None)], "word string, country string, verdict boolean")
    got = {r.word: r.assessment for r in providers.assessed(words, model).collect()}
    assert got == {"a": "可复用", "b": "需拦截", "c": model.assess("c", "DE")}
    vectors = {r.text: r.vector for r in providers.embedded(spark.createDataFrame([("coat",), (" ",), (None,)], "text string"), model).collect()}
    assert abs(np.linalg.norm(vectors["coat"]) - 1) < 1e-9 and vectors[" "] is None and vectors[None] is None
