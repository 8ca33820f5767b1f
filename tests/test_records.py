"""Requests, review, governance and stored points on small literals."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import text as tx
from sparkweave.functions import validate
from sparkweave.operators import collect, governance, points, review, rules, search, store
from sparkweave.sources import providers, suggestions


def test_requests(spark):
    rows = [("  wool coat  ", "de", None, 10), ("coat", "US", None, 5), ("coat", "DE", None, 0), ("coat", " Fr ", "x" * 101, 11), (None, None, "", None)]
    got = validate.requests(spark.createDataFrame(rows, "title string, target_country string, category string, top_k int")).collect()
    assert [(r.title, r.target_country, r.problems, r.query) for r in got[:3]] == [("wool coat", "DE", [], "wool coat"), ("coat", None, ["target_country"], "coat"), ("coat", "DE", ["top_k"], "coat")]
    assert got[3].problems == ["category", "top_k"] and got[4].problems == ["title", "target_country", "top_k"]


def test_cron(spark):
    good, bad = ["* * * * *", "*/5 0-23 1,15 jan-mar mon-fri", "59 23 31 12 7"], ["99 99 99 99 99", "60 1 1 1 1", "* * * *", "* * * * * *", "*/0 1 1 1 1", "1- 1 1 1 1", "", None]
    got = [r.ok for r in spark.createDataFrame([(c,) for c in good + bad], "c string").select(tx.cron_ok(F.col("c")).alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_rule_reader_keeps_types_apart(spark):
    files = spark.createDataFrame([("DE", json.dumps({"banned": ["100", "true", "[x]", 7, None, {"word": 3}, {"word": "w", "rule_id": 4}, ["y"]]})), ("FR", "no json"), ("UK", "{}"), ("IT", None)], "country string, json string")
    assert [(r.ord, r.word, r.rule_id) for r in rules.rule_entries(files, "banned").orderBy("ord").collect()] == [(0, "100", None), (1, "true", None), (2, "[x]", None), (6, "w", None)]


def test_rule_edits_and_files(spark, tmp_path):
    entries = spark.createDataFrame([("DE", "banned", "a", "r", None), ("DE", "banned", "b", None, None)], "country string, list string, word string, rule_id string, added_by string")
    edits = spark.createDataFrame([("DE", "banned", "a", "add"), ("DE", "banned", "b", "remove"), ("DE", "banned", "c", "add"), ("DE", "banned", "c", "add"), ("DE", "safe", "b", "remove"), ("FR", "banned", "a", "add")], "country string, list string, word string, op string")
    after, outcome = review.edited(entries, edits)
    assert {(r.country, r.list, r.word): r.action for r in outcome.collect()} == {("DE", "banned", "a"): "exists", ("DE", "banned", "b"): "removed", ("DE", "banned", "c"): "added", ("DE", "safe", "b"): "not_found", ("FR", "banned", "a"): "added"}
    assert sorted((r.country, r.word, r.rule_id or "") for r in after.collect()) == [("DE", "a", "r"), ("DE", "c", ""), ("FR", "a", "")]
    with pytest.raises(ValueError):
        review.write_rule_files(after, str(tmp_path / "rules"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        review.write_rule_files(after, str(tmp_path / "rules"))
        review.write_rule_files(after.where("country = 'FR'").withColumn("word", F.lit("new")), str(tmp_path / "rules"))
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    files = spark.read.parquet(str(tmp_path / "rules"))
    assert sorted((r.country, r.word) for r in rules.rule_entries(files, "entries").collect()) == [("DE", "a"), ("DE", "c"), ("FR", "new")]


def test_review(spark):
    pending = spark.createDataFrame([(1, "a", "de", "c", "why", "s"), (2, "b", "DE", None, "why", "s"), (3, "c", "US", None, "why", "s"), (4, "d", "FR", None, "why", "s")], "id long, word string, country string, category string, reason string, source string")
    decisions = spark.createDataFrame([(1, True, "n", None, "ann"), (2, False, None, "bad", "ann"), (3, True, None, None, "ann"), (4, False, None, "  ", "ann"), (9, True, None, None, "ann")], "id long, approve boolean, category string, reason string, by string")
    out = review.reviewed(pending, decisions)
    assert [(r.word, r.country, r.category, r.compliance_status, r.assessed_by) for r in out["tags"].collect()] == [("a", "DE", "n", "可复用", "manual")]
    assert sorted((r.list, r.word, r.rule_id, r.added_by) for r in out["rules"].collect()) == [("banned", "b", "manual_reject", "ann：bad"), ("safe", "a", None, "ann")]
    assert sorted(r.id for r in out["pending"].collect()) == [3, 4]


def test_rerank_fallbacks(spark):
    c = spark.createDataFrame([(q, i, w, s) for q in range(7) for i, w, s in ((1, "lower", 0.4), (2, "higher", 0.9))], "qid long, id long, word string, similarity double")
    said = [None, "rubbish", "[]", '{"recommendations": {"word": "lower"}}', '{"recommendations": [1, {"word": 2}]}', '```json\n{"recommendations": [{"word": " LOWER ", "reason": 5}]}\n```', '{"recommendations": []}']
    picks = review.picks_of(spark.createDataFrame(list(enumerate(said)), "qid long, answer string"))
    got = {(r.qid, r.position): (r.word, r.ai_generated) for r in search.rerank(c, picks, 2).collect()}
    for q in range(7):
        assert [got[q, 1], got[q, 2]] == ([("lower", True), ("higher", False)] if q == 5 else [("higher", False), ("lower", False)])


def test_counters(spark):
    routed = spark.createDataFrame([(1, "DE", "a", "approved"), (2, "DE", "a", "approved"), (3, "DE", "b", "blocked"), (4, "DE", "k", "pending")], "id long, country string, word string, action string")
    r = review.counters(routed, spark.createDataFrame([("DE", "k")], "country string, word string"), "country").first()
    assert (r.approved, r.pending, r.rejected, r.duplicate, r.new, r.total) == (1, 0, 1, 2, 2, 4)


def test_erasure(spark):
    tags = spark.createDataFrame([(1, "coat", "DE"), (2, "coat", "FR"), (3, "Coat", "DE"), (4, None, "DE")], "id long, word string, country string")
    h = lambda x: __import__("hashlib").sha256(x.encode()).hexdigest()
    traces = spark.createDataFrame([(1, h("coat"), None), (2, h("x"), h("coat")), (3, h("x"), None), (4, h("coat"), h("coat"))], "id long, word_sha256 string, prompt_hash string")
    audit = spark.createDataFrame([(1, '{"coat": ["a coat", {"k": "coat"}]}'), (2, "a coat, no json"), (3, None), (4, '{"a": 1}')], "id long, detail string")
    out = governance.erased({"tags": (tags, "word")}, traces, audit, "coat", F.lit("2026-01-02").cast("timestamp"), country="DE")
    assert sorted(r.id for r in out["tags"].collect()) == [2, 3, 4] and [r.id for r in out["traces"].collect()] == [3]
    assert {r.id: r.detail for r in out["audit"].collect()} == {1: '{"coat": ["a <REDACTED>", {"k": "<REDACTED>"}]}', 2: "a <REDACTED>, no json", 3: None, 4: '{"a": 1}'}
    p = out["proof"].first()
    assert (p.term_sha256, p.points_deleted, p.trace_rows_deleted, p.audit_rows_redacted) == (h("coat"), 1, 3, 2) and p.erased_at.startswith("2026-01-02T")
    assert json.loads(out["lineage"].first().event) == {"outputs": [{"term_sha256": h("coat")}]}
    assert audit.select(store.redact_json(F.col("detail"), "").alias("d")).first().d == audit.first().detail


def test_purge(spark):
    now = spark.createDataFrame([(dt.datetime(2026, 6, 1),)], "now timestamp")
    t = spark.createDataFrame([(1, dt.datetime(2026, 5, 2)), (2, dt.datetime(2026, 5, 1, 23, 59, 59)), (3, None)], "id long, ts timestamp")
    policies = spark.createDataFrame([("audit_log", 30, None), ("lineage_event", 30, None)], "key string, days int, updated_at timestamp")
    kept, counts = governance.purged({"audit_log": t, "llm_trace": t, "lineage_event": t.drop("ts")}, policies, now)
    assert sorted(r.id for r in kept["audit_log"].collect()) == [1, 3] and kept["llm_trace"].count() == kept["lineage_event"].count() == 3
    assert {r.key: r.removed for r in counts.collect()} == {"audit_log": 1, "lineage_event": -1}
    changes = spark.createDataFrame([("audit_log", d, dt.datetime(2026, 1, i + 1)) for i, d in enumerate((29, 30, 3650, 3651))] + [("x", 90, None)], "key string, days int, at timestamp")
    after, refused = governance.set_policies(policies, changes)
    assert {r.key: r.days for r in after.collect()} == {"audit_log": 3650, "lineage_event": 30} and refused.count() == 3
    assert sorted(r.key for r in governance.seeded_policies(policies).collect()) == ["audit_log", "lineage_event", "llm_trace"]


def test_logs_and_tickets(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, "r1", at), (2, "r1", at), (3, "r2", at)], "id long, run_id string, ts timestamp")
    path = str(tmp_path / "log")
    governance.appended(None, rows, path)
    governance.appended(rows, rows.limit(1).drop("ts"), path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and [r.id for r in governance.lineage_of(log.where("ts IS NOT NULL"), "r1").collect()] == [1, 2]
    open_ = governance.tickets(spark.createDataFrame([("t", "w", "a@b", "n" * 3000, at)], "ticket_id string, term string, contact string, note string, created_at timestamp"))
    assert (len(open_.first().note), open_.first().due_at) == (2000, dt.datetime(2026, 1, 31))
    done = governance.updated_tickets(open_, spark.createDataFrame([("t", "in_progress", "f", at), ("t", "completed", None, at + dt.timedelta(1)), ("t", "odd", "x", at + dt.timedelta(2))], "ticket_id string, status string, findings string, at timestamp")).first()
    # a null finding keeps the one before, that of an earlier update of the batch, too
    assert (done.status, done.findings, done.completed_at) == ("completed", "f", at + dt.timedelta(1))


def test_points(spark):
    schema = spark.createDataFrame([], "id string, vector array<float>").schema
    assert points.created(spark, "points_of_test", schema, 4).count() == 0 and points.created(spark, "points_of_test", schema, 4).count() == 0
    with pytest.raises(ValueError):
        points.created(spark, "points_of_test", schema, 3)
    spark.sql("DROP TABLE points_of_test")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])], "id long, vector array<float>")
    assert [r.p for r in v.orderBy("id").select(points.vector_problem(F.col("vector"), 2).alias("p")).collect()] == [None, "dimension", "missing", "zero", "value"]
    assert points.guarded(v.where("id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        points.guarded(v.where("id = 2"), 2).collect()
    r = points.shown(spark.createDataFrame([(1, None)], "id long, word string"), "tags").first()
    assert (r.word, r.compliance_status, r.trend_score, r.category) == ("", "存疑", 0.0, None)
    why = spark.sql("SELECT '' a, 'r' b UNION ALL SELECT 'c', 'r'").select(points.shown_reason(F.col("a"), F.col("b")).alias("w"), points.provenance("a", "b"))
    assert [x.w for x in why.collect()] == ["r", "c"]


def test_running(spark):
    rows = [(k, i * i, i % 3) for k in "ab" for i in range(200)]
    got = {(r.k, r.o): (r.t, r.batch) for r in points.numbered(points.running(spark.createDataFrame(rows, "k string, o long, w long"), "k", "o", F.col("w"), "t", slices=7), "k", "o", 12).collect()}
    for k in "ab":
        total = 0
        for i in range(200):
            total += i % 3
            assert got[k, i * i] == (total, i // 12)


def test_payloads_and_providers(spark):
    bodies = spark.createDataFrame([("DE", "coat", None, '["coat", ["wool coat", 3.5, true, null, {"a": 1}, "Coat", "7"]]'), ("DE", "coat", None, "rubbish")], "country string, seed string, category string, body string")
    assert [(r.rank, r.word) for r in suggestions.parse_pair(bodies).collect()] == [(0, "wool coat")]
    rows = bodies.limit(1).withColumn("body", F.lit('{"result": [["wool", "1"], ["coat", "2"], [" ", "3"]]}'))
    assert [r.word for r in suggestions.parse_rows(rows).collect()] == ["wool"]
    objects = bodies.limit(1).withColumn("body", F.lit('{"suggestions": [{"value": "coat"}, {"value": "wool coat"}, {"x": 1}]}'))
    assert [(r.rank, r.word) for r in suggestions.parse_object(objects).collect()] == [(1, "wool coat")]
    assert callable(providers.embedded) and callable(providers.assessed)


def test_small_text_functions(spark):
    one = spark.sql("SELECT '<a href=\"x\">&\\'' h, '/ok' p, '//evil' q, 'a、b, ,c' l")
    r = one.select(tx.html_escape(F.col("h")).alias("h"), tx.safe_redirect(F.col("p")).alias("p"), tx.safe_redirect(F.col("q")).alias("q"), tx.unlisted(F.col("l")).alias("l"), tx.listed(F.array(F.lit("a"), F.lit("b"))).alias("j")).first()
    assert tuple(r) == ("&lt;a href=&quot;x&quot;&gt;&amp;&#x27;", "/ok", "/", ["a", "b", "c"], "a、b")
    assert collect.country_quota(6) == 20


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks and chunks give what all pairs give."""
    import numpy as np

    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "CHUNK", 5)
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((60, 4)).round(1), rng.standard_normal((20, 4)).round(1)
    v[10:20] = v[10]
    points_ = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)] + [(98, "a", None), (99, "a", [0.0] * 4)], "id long, key string, vector array<double>")
    asked = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(q)] + [(50, "z", [1.0] * 4), (51, None, [1.0] * 4)], "qid long, key string, q array<double>")
    got = {(r.qid, r.ord): (r.id, r.similarity) for r in search.nearest(asked, points_, 3).collect()}
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 6)
    assert len(got) == 60
    for i in range(20):
        order = sorted((j for j in range(60) if j % 2 == i % 2), key=lambda j: (-s[i, j], j))[:3]
        assert [got[i, n + 1][0] for n in range(3)] == order
