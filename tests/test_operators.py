"""The reference's operators on small literals, and a sample of queries against DuckDB."""

import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkweave.functions import text as tx
from sparkweave.functions.ids import point_id
from sparkweave.functions.pii import pseudonyms
from sparkweave.operators import collect, rules, search, store

SF = "/root/testdata/sf0.001"


def test_rules_in_order(spark):
    files = spark.createDataFrame([("DE", '{"safe": ["eco friendly bag"], "banned": [{"word": "Bag", "rule_id": ""}, 7, {"word": "shoe", "rule_id": "r2"}]}')], "country string, json string")
    words = spark.createDataFrame([("eco friendly bag", "DE"), ("Eco friendly bag", "DE"), ("handBAGs", "DE"), ("red shoe bag", "DE"), ("mode ÉCOLOGIQUE", "FR"), ("ecologiques", "FR"), ("handbag", "FR")], "word string, country string")
    got = {r.word: (r.verdict, r.rule_id) for r in rules.verdicts(words, rules.rule_entries(files, "safe"), rules.rule_entries(files, "banned")).collect()}
    assert got == {"eco friendly bag": (True, None), "Eco friendly bag": (False, "ucpd_env_generic"), "handBAGs": (False, "manual_banned"), "red shoe bag": (False, "manual_banned"), "mode ÉCOLOGIQUE": (False, "ucpd_env_generic"), "ecologiques": (None, None), "handbag": (None, None)}


def test_scores_and_quota(spark):
    s = spark.createDataFrame([("DE", "coat", "Coat", 0, "a"), ("DE", "coat", "12345", 1, "a"), ("DE", "coat", "x", 2, "a"), ("DE", "coat", "wool", 3, None), ("DE", "coat", "wool", 3, "b"), ("DE", "coat", "wool", 9, "a"), ("DE", "coat", "late", 40, None)], "country string, seed string, word string, rank int, category string")
    best = {r.word: (r.trend_score, r.category) for r in collect.best_scores(collect.hygiene(s), "country").collect()}
    assert best == {"wool": (0.8, "b"), "late": (0.1, None)}
    a = spark.createDataFrame([("DE", w, 1.0, None, i + 1) for i, w in enumerate(["A", "a", "b", "c"])], "country string, word string, trend_score double, category string, ord long")
    b = spark.createDataFrame([("DE", w, 1.0, None, i + 1) for i, w in enumerate(["B", "d"])], "country string, word string, trend_score double, category string, ord long")
    picked = [r.word for r in collect.quota_merge(a, b, 2, 4).orderBy("pick").collect()]
    assert picked == ["A", "B", "d", "c"]


def test_rerank_back_fill(spark):
    c = spark.createDataFrame([(1, 1, "winter coat", 0.92), (1, 2, "wool coat", 0.87)], "qid long, id long, word string, similarity double")
    p = spark.createDataFrame([(1, 0, "invented tag", "x"), (1, 1, "WOOL COAT", "y")], "qid long, pick_ord long, word string, reason string")
    assert [(r.word, r.ai_generated) for r in search.rerank(c, p, 2).orderBy("position").collect()] == [("wool coat", True), ("winter coat", False)]


def test_thresholds(spark):
    anchors = spark.createDataFrame([(1, "a", "c", [1.0, 0.0])], "id long, cn_word string, category string, vector array<double>")
    words = spark.createDataFrame([(1, "c", [0.641, 0.7675]), (2, None, [0.641, 0.7675])], "id long, category string, vector array<double>")
    assert {r.id: r.anchor_id for r in search.align(words, anchors).collect()} == {1: 1, 2: None}


def test_chain_and_page(spark):
    rows = spark.createDataFrame([(i, "t", "a", "x", "r", str(i)) for i in range(5)], "id long, ts string, actor string, action string, rtype string, rid string")
    log = rows.join(store.chain_append(rows, "G"), "id")
    assert store.chain_verify(log).where("NOT ok").count() == 0
    bad = log.withColumn("actor", F.when(F.col("id") == 2, "evil").otherwise(F.col("actor")))
    assert [r.id for r in store.chain_verify(bad).where("NOT ok").collect()] == [2]
    assert [r.id for r in store.keyset_page(rows, "id", 2, 2).collect()] == [2, 3, 4]


def test_chain_of_many_events_is_streamed(spark):
    n = 25_000  # several batches
    rows = spark.range(n).selectExpr("id", "'t' ts", "if(id % 5 = 0, 'b', 'a') actor", "'x' action", "'r' rtype", "cast(id AS string) rid")
    log = store.chain_append(rows, "G", "actor")
    last, want = {"a": "G", "b": "G"}, []
    for i in range(n):
        actor = "b" if i % 5 == 0 else "a"
        before, last[actor] = last[actor], hashlib.sha256(f"{last[actor]}|{i}|t|{actor}|x|r|{i}".encode()).hexdigest()
        want.append((actor, i, before, last[actor]))
    assert [tuple(r) for r in log.orderBy("id").collect()] == want
    assert "collect_list" not in log._jdf.queryExecution().toString()


def test_text(spark):
    row = spark.sql("SELECT '4539 1488 0343 6467' a, 'a:b' x, 'c' y, '<think>z</think>```json\n{}\n```' f, 'mail a@b.de 10.0.0.1' l")
    got = row.select(tx.luhn_ok(F.col("a")), point_id(F.col("x"), F.col("y")), point_id(F.lit("a"), F.lit("b:c")), tx.strip_fences(F.col("f")), tx.redact_log(F.col("l"))).first()
    assert got[0] and got[1] != got[2] and got[3] == "{}" and got[4] == "mail <EMAIL> <IP>"
    assert pseudonyms("a@b.de and c@d.fr") == ("<EMAIL_ADDRESS_0> and <EMAIL_ADDRESS_1>", {"<EMAIL_ADDRESS_0>": "a@b.de", "<EMAIL_ADDRESS_1>": "c@d.fr"})


@pytest.mark.parametrize("name", ["q01_recommend_topk", "q10_quota_merge", "q17_rule_verdict", "q26_rerank_backfill", "q39_chain_append"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("part", "events", "documents", "embeddings", "labels", "conversations", "orders", "customer", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = __spark_entry__.queries()[name](spark, SF)
    theirs = db.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda rows: sorted(str(["" if pd.isna(x) else (f"{float(x):.6g}" if isinstance(x, (int, float)) else str(x)) for x in r]) for r in rows)
    assert plain(mine.select(*columns).toPandas().astype(object).itertuples(index=False)) == plain(theirs[columns].astype(object).itertuples(index=False))
