"""Bounds that must hold whatever the data: rows of one id, deep urls, nodes too large for one task."""

import time

from pyspark.sql import functions as F

from sparkweave.llm import mixing, toxicity, url_filter


def test_deep_urls_take_no_job_a_depth(spark):
    """A crawler trap of 2,000 segments, labelled often, between ordinary urls."""
    deep = ["http://t.org/" + "/".join(f"s{(i * j) % 7}" for j in range(2000 - i)) for i in range(12)]
    urls = deep + [f"http://t.org/{'ab'[i % 2]}/x{i % 3}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    assert time.time() - began < 30 and len(got) == len(urls)
    assert [got[i] for i in range(12, 16)] == ["allow", "block", "allow", "block"]


def test_large_nodes_grow_as_small_ones(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.org/{'abc'[i % 3]}/{'xyz'[i % 5 % 3]}{'/end' * (i % 4 == 0)}") for i in range(400)] + [(1000 + i, None) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 7 == 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    read = lambda: sorted(map(str, map(tuple, url_filter.judge(pages, labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))).collect())))
    whole = read()
    monkeypatch.setattr(url_filter, "SMALL", 2)
    assert read() == whole


def test_samples_bound_rows(spark):
    """30,000 rows of one labelled id: the driver gets as many as the sample says."""
    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text")).unionByName(spark.createDataFrame([(2, "other text")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels, {"a": 0.5, "b": 0.5}, sample=10)
    assert model.names == ["a", "b"] if hasattr(model, "names") else model.domains == ["a", "b"]
    seen = []
    fit = toxicity.ToxicityModel.fit_curve
    toxicity.ToxicityModel.fit_curve = lambda self, x, y: (seen.append(len(x)), fit(self, x, y))[1]
    try:
        toxicity.train(docs.limit(3000), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), calibration=10)
    finally:
        toxicity.ToxicityModel.fit_curve = fit
    assert seen == [10]
