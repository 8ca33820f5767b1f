"""Lists, counts, flags and the record helpers on literals."""

from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.functions import validate
from sparkweave.operators import collect, governance, listing, review


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lists_and_flags(spark):
    a = spark.createDataFrame([("DE", "x"), ("DE", "x"), ("DE", "y"), (None, "x")], "country string, word string")
    b = spark.createDataFrame([("DE", "y")], "country string, word string")
    assert rows(listing.unseen(a, b, "country", "word")) == [("DE", "x"), ("DE", "x"), (None, "x")]
    assert rows(listing.flagged(a.distinct(), b, "country", "word")) == [("DE", "x", False), ("DE", "y", True), (None, "x", False)]
    assert rows(listing.counts(a, "country", holds="x")) == [("DE", 2), (None, 1)]
    assert rows(listing.counts(a, "word")) == [("x", 3), ("y", 1)]
    t = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "id int, at int")
    assert [r["id"] for r in listing.latest(t, 2, "at", ties=("id",)).collect()] == [1, 2]


def test_totals_of_empty_tables_are_zero(spark):
    anchors = spark.createDataFrame([], "id int, cn_word string")
    tags = spark.createDataFrame([], "id int, anchor_id int, compliance_status string, country string")
    assert rows(listing.dashboard(anchors, tags)) == [(0, 0.0, 0.0, 0, 0, 0.0)]
    assert rows(listing.linked(anchors, tags)) == []


def test_word_scores(spark):
    s = spark.createDataFrame([("w", None, 0), ("w", "b", 3), ("w", "a", 3), ("v", None, 40)], "word string, category string, rank int")
    assert rows(collect.cn_scores(s)) == [("v", 0.1, None), ("w", 1.0, "a")]


def test_records(spark):
    t = spark.createDataFrame([(1, "a_c"), (2, "ABC"), (3, None)], "id int, text string")
    stores = {"t": (t, "text", F.col("id"))}
    traces = spark.createDataFrame([], "id int, ts int, word_sha256 string, prompt_hash string")
    # a store's word is matched exactly, the audit log by ILIKE
    assert rows(governance.subject_data(stores, traces, t.withColumn("ts", F.col("id")), "a_c", details=("text",))) == [("audit", "1"), ("audit", "2"), ("t", "1")]
    assert rows(governance.erasure_counts({"t": (t, "text")}, "a_c")) == [("t", 1, 2)]
    e = spark.createDataFrame([("r", 2), ("r", 1), ("s", 9)], "run string, ts int")
    assert rows(governance.lineage_steps(e, "run", "ts")) == [("r", 1, 1), ("r", 2, 2), ("s", 9, 1)]


def test_columns(spark):
    t = spark.createDataFrame([('{"k": "v"}', "存疑", True, ["a", "b"]), ("no json", "存疑", None, None), ("{}", "可复用", False, ["c"])], "j string, status string, approve boolean, roles array<string>")
    got = t.select(tx.json_text(F.col("j"), "$.k", "none").alias("k"), review.transition(F.col("status"), F.col("approve")).alias("t"), validate.allowed(F.col("roles"), ("b",)).alias("ok"))
    assert [tuple(r) for r in got.select("k", "t.transition", "t.status", "ok").collect()] == [("v", "approved", "可复用", True), ("none", "unchanged", "存疑", False), ("none", "unchanged", "可复用", False)]
