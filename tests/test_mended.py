"""Cases that once came out wrong: null, tied, odd and repeated input of the small operators."""

import datetime as dt
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkweave.functions import ids, pii, validate
from sparkweave.functions.terms import Terms
from sparkweave.operators import collect, governance, points, review, route, rules, search, store
from sparkweave.operators.shared import dealt
from sparkweave.sources import suggestions

AT = dt.datetime(2026, 1, 1)


def test_routing_asks_the_verdict_first(spark):
    words = [(1, "可复用", 7), (2, "可复用", None), (3, "需拦截", None), (4, "需拦截", 7), (5, "存疑", None), (6, "存疑", 7), (7, None, 7), (8, "odd", None)]
    got = {r.id: r.action for r in route.routed(spark.createDataFrame(words, "id long, status string, anchor_id long")).collect()}
    assert got == {1: "approved", 2: "pending_no_anchor", 3: "blocked", 4: "blocked", 5: "pending", 6: "pending", 7: "pending", 8: "pending"}
    rows = [("a", True, None, None, None, "需拦截", "x"), ("b", False, "r", "t", "m", "可复用", "x"), ("c", False, None, None, "m", "可复用", "x"), ("d", None, None, None, None, "可复用", " "), ("e", None, None, None, None, None, None)]
    schema = "word string, verdict boolean, statutory_rule string, statutory_term string, banned_rule string, said_verdict string, said_reason string"
    got = {r.word: (r.status, r.reason) for r in route.assessed(spark.createDataFrame(rows, schema).withColumn("country", F.lit("DE"))).collect()}
    assert got["a"] == ("可复用", "通过安全词库") and got["b"] == ("需拦截", "命中UCPD禁用词库(r): t") and got["c"] == ("需拦截", "命中DE广告法禁用词库(m)")
    assert got["d"][0] == "可复用" and got["e"][0] == "存疑" and got["d"][1] == got["e"][1]


def test_sinks_hold_what_was_routed(spark):
    rows = [("w", "DE", "c", "s", 1.0, "可复用", "fine", None, 5, "锚", 0.9, "approved"), ("x", "DE", None, "s", 1.0, "可复用", "fine", None, None, None, None, "pending_no_anchor"), ("y", "FR", None, "s", 1.0, "需拦截", "bad", "r1", 5, "锚", 0.9, "blocked")]
    out = route.sinks(spark.createDataFrame(rows, "word string, country string, category string, source string, trend_score double, status string, reason string, rule_id string, anchor_id long, anchor_word string, anchor_score double, action string"), "run")
    tag, wait, block = (out[k].collect() for k in ("local_tags", "pending_review", "blocked_decisions"))
    assert [len(x) for x in (tag, wait, block)] == [1, 1, 1] and tag[0].anchor_cn_word == "锚" and tag[0].provenance.anchor_match_score == 0.9
    assert wait[0].assessment_reason == "fine [未找到对应中文锚点]" and block[0].rule_id == "r1" and tag[0].point_id == ids_of(spark, "w", "DE")
    assert out["lineage"].count() == 3 and all('"runId":"run"' in r.event for r in out["lineage"].collect())


def ids_of(spark, *parts):
    return spark.range(1).select(ids.point_id(*(F.lit(p) for p in parts)).alias("p")).first().p


def test_only_valid_decisions_count(spark):
    pending = spark.createDataFrame([(i, w, "DE", None, "why", "s") for i, w in enumerate("abc")], "id long, word string, country string, category string, reason string, source string")
    decisions = spark.createDataFrame([(0, None, "text", "ann"), (1, False, " ", "ann"), (1, True, None, "bob"), (2, False, "x", None), (2, True, None, "bob")], "id long, approve boolean, reason string, by string").withColumn("category", F.lit(None).cast("string"))
    out = review.reviewed(pending, decisions)
    assert [r.word for r in out["pending"].collect()] == ["a"]
    assert sorted((r.word, r.list, r.added_by) for r in out["rules"].collect()) == [("b", "safe", "bob"), ("c", "banned", "：x")]


def test_erasure_reads_values_not_text(spark):
    audit = spark.createDataFrame([(1, '{"a":"caf\\u00e9"}'), (2, '{"café":1}'), (3, '{"a": "x\\"café"}'), (4, '{"z":   1}'), (5, None), (6, "[" * 5000 + '"café"' + "]" * 5000)], "id long, detail string")
    none = spark.createDataFrame([], "id long, ts long, word_sha256 string, prompt_hash string")
    out = governance.erased({}, none, audit, "café", F.lit("2026-01-01").cast("timestamp"))
    got = {r.id: r.detail for r in out["audit"].collect()}
    assert got[1] == '{"a": "<REDACTED>"}' and got[2] == '{"café":1}' and got[3] == '{"a": "x\\"<REDACTED>"}' and got[4] == '{"z":   1}' and got[5] is None and "café" not in got[6]
    assert out["proof"].first().audit_rows_redacted == 3
    open_ = governance.tickets(spark.createDataFrame([(t, "w", "a@b", None, AT) for t in "ab"], "ticket_id string, term string, contact string, note string, created_at timestamp"))
    done = {r.ticket_id: r for r in governance.closed(open_, "a", out["proof"]).collect()}
    assert done["a"].status == "completed" and '"audit_rows_redacted":3' in done["a"].findings and done["a"].completed_at == AT and done["b"].status == "received"


def test_subject_search_is_exact_and_finds_what_erasure_removes(spark):
    tags = spark.createDataFrame([(1, "coat", "DE"), (2, "coats", "DE"), (3, "coat", "FR"), (4, None, "DE")], "id long, word string, country string")
    anchors = spark.createDataFrame([(7, "coat"), (8, "a coat")], "id long, cn_word string")
    sha = lambda t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]
    traces = spark.createDataFrame([(1, 1, sha("coat"), None), (2, 2, sha("x"), sha("coat")), (3, 3, sha("x"), sha("y"))], "id long, ts long, word_sha256 string, prompt_hash string")
    audit = spark.createDataFrame([(1, 1, '{"a": "Coats"}'), (2, 2, "none"), (3, 3, None)], "id long, ts long, detail string")
    stores = {"tags": (tags, "word", F.col("id")), "anchors": (anchors, "cn_word", F.col("id"))}
    hit = lambda country: sorted((r.store, r.rid) for r in governance.subject_data(stores, traces, audit, "coat", country).collect())
    assert hit(None) == [("anchors", "7"), ("audit", "1"), ("tags", "1"), ("tags", "3"), ("traces", "1"), ("traces", "2")]
    assert hit("DE") == [x for x in hit(None) if x != ("tags", "3")]
    counts = {r.store: (r.erased, r.kept) for r in governance.erasure_counts({"tags": (tags, "word"), "anchors": (anchors, "cn_word")}, "coat", "DE").collect()}
    assert counts == {"tags": (1, 3), "anchors": (1, 1)}
    assert governance.subject_data(stores, traces, audit, "x", limit=1).where("store = 'traces'").first().rid == "3"


def test_erasure_counts_hold_the_traces(spark):
    tags = spark.createDataFrame([(1, "coat", "DE"), (2, "coat", "FR"), (3, "hat", "DE"), (4, None, "DE")], "id long, word string, country string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, sha("coat"), None), (2, sha("x"), sha("coat")), (3, sha("coat"), sha("hat")), (4, sha("x"), sha("y")), (5, None, None), (6, sha("a coat"), None), (7, None, sha("hat"))]
    traces = spark.createDataFrame(rows, "id long, word_sha256 string, prompt_hash string")
    counts = lambda terms: {r.store: (r.erased, r.kept) for r in governance.erasure_counts({"tags": (tags, "word")}, terms, "DE", traces).collect()}
    assert counts("coat") == {"tags": (1, 3), "traces": (3, 4)} and counts(["coat", "hat"]) == {"tags": (2, 2), "traces": (4, 3)} and counts([]) == {"tags": (0, 4), "traces": (0, 7)}
    audit = spark.createDataFrame([], "id long, detail string")
    assert governance.erased({}, traces, audit, "coat", F.lit("2026-01-01").cast("timestamp"))["proof"].first().trace_rows_deleted == 3


def test_q44_counts_every_trace(spark, tmp_path):
    db = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations"):
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'"
        if t == "conversations":  # texts said again, in other conversations, and a null and an empty one
            rows += f" UNION ALL SELECT conv_id + 1000, turn, role, text FROM ({rows}) UNION ALL SELECT 5000 + i, 0, 'user', t FROM (VALUES (0, NULL), (1, '')) v(i, t)"
        db.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    mine = __spark_entry__.queries()["q44_dsar_erase_counts"](spark, str(tmp_path))
    assert sorted(map(tuple, mine.collect())) == sorted(db.execute(__spark_entry__.oracle_sql()["q44_dsar_erase_counts"]).fetchall())
    got = {r.store: (r.erased, r.kept) for r in mine.collect()}
    said = db.execute("SELECT conv_id, turn, text FROM conversations").fetchall()
    term = min(t for *_, t in said if t)
    gone = {(c, k) for c, k, t in said if t == term}
    gone |= {(c, k) for c, k, _ in said if (c, k - 1) in gone}
    assert set(got) == {"tags", "anchors", "traces"} and got["traces"] == (len(gone), len(said) - len(gone)) and len(gone) >= 2


def test_tickets_as_if_one_by_one(spark):
    open_ = governance.tickets(spark.createDataFrame([(t, "w", "a@b", None, AT) for t in "abc"], "ticket_id string, term string, contact string, note string, created_at timestamp"))
    day = lambda n: AT + dt.timedelta(n)
    updates = [("a", "completed", "found", day(1)), ("a", "in_progress", None, day(2)), ("b", "in_progress", "f1", day(1)), ("b", "completed", "f2", day(3)), ("b", "rejected", None, day(2)), ("b", "lost", "f3", day(9)), ("c", "completed", "z", None)]
    got = {r.ticket_id: (r.status, r.findings, r.completed_at) for r in governance.updated_tickets(open_, spark.createDataFrame(updates, "ticket_id string, status string, findings string, at timestamp")).collect()}
    assert got == {"a": ("in_progress", "found", day(1)), "b": ("completed", "f2", day(3)), "c": ("received", None, None)}


def test_purges_and_upserts_of_nulls(spark):
    t = spark.createDataFrame([(1, AT), (2, None), (3, dt.datetime(2020, 1, 1))], "id long, ts timestamp")
    assert sorted(r.id for r in store.purge(t, "ts", F.lit("2026-01-02").cast("timestamp"), 30).collect()) == [1, 2]
    now = spark.createDataFrame([(AT,)], "now timestamp")
    policies = spark.createDataFrame([("a", 30, None), ("b", None, None), ("c", 30, None)], "key string, days int, updated_at timestamp")
    kept, counts = governance.purged({"a": t.limit(0), "b": t, "c": t}, policies, now)
    assert {r.key: r.removed for r in counts.collect()} == {"a": 0, "c": 1} and kept["b"].count() == 3
    old = spark.createDataFrame([(1, None, "o"), (2, 5, "o"), (3, 5, "o"), (None, 1, "o")], "k long, seq long, v string")
    new = spark.createDataFrame([(1, None, "n"), (2, 5, "n"), (3, 4, "n"), (None, 2, "n"), (4, None, "x"), (4, None, "y")], "k long, seq long, v string")
    assert {r.k: r.v for r in store.upsert(old, new, "k", "seq").collect()} == {1: "n", 2: "n", 3: "o", None: "n", 4: "y"}


def test_running_keeps_null_keys_and_orders(spark):
    rows = [("a", 1), ("a", 3), (None, 2), (None, 5), ("a", None)]
    got = sorted(((r.k, r.o, r.n) for r in points.running(spark.createDataFrame(rows, "k string, o long"), "k", "o", F.lit(1), "n").collect()), key=str)
    assert got == sorted([("a", None, 1), ("a", 1, 2), ("a", 3, 3), (None, 2, 1), (None, 5, 2)], key=str)


def test_hygiene_without_seed_and_payload_items(spark):
    s = spark.createDataFrame([("DE", None, "coat", 0, "c"), ("DE", "coat", "Coat", 1, "c")], "country string, seed string, word string, rank int, category string")
    assert [r.word for r in collect.hygiene(s).collect()] == ["coat"]
    bodies = lambda *b: spark.createDataFrame([("DE", "coat", None, x) for x in b], "country string, seed string, category string, body string")
    objects = bodies('{"suggestions": [{"value": "wool coat"}, 3, "x", null, {"value": 12.5}, {"value": true}, {"value": "red coat"}]}', '{"suggestions": {"value": "no list"}}', "rubbish", None)
    assert sorted((r.rank, r.word) for r in suggestions.parse_object(objects).collect()) == [(0, "wool coat"), (6, "red coat")]
    lists = bodies('{"result": [["wool", "1"], 7, {"a": 1}, [], [5], [null], ["coat"], [" down "]]}', '{"result": 5}', "[1]")
    assert sorted((r.rank, r.word) for r in suggestions.parse_rows(lists).collect()) == [(0, "wool"), (7, "down")]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    there = spark.createDataFrame([(1, "k", [nan, 1.0]), (2, "k", [1.0, 0.0]), (3, "k", [1.0]), (4, "k", [inf, 1.0]), (5, "k", [0.6, 0.8]), (6, "k", [None, 1.0]), (7, "k", [])], "id long, key string, vector array<double>")
    asked = spark.createDataFrame([(1, "k", [1.0, 0.0]), (2, "k", [1.0]), (3, "k", [nan, 0.0]), (4, "k", None)], "qid long, key string, q array<double>")
    assert sorted((r.qid, r.ord, r.id) for r in search.nearest(asked, there, 3).collect()) == [(1, 1, 2), (1, 2, 5), (2, 1, 3)]


def test_cells_rule_out_most_pairs_and_change_nothing(spark, monkeypatch):
    """Clustered vectors, a key with copies of one vector, ties, and keys too small for cells."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    v = np.float32(np.concatenate([centres[rng.integers(0, 40, 4000)] + 0.15 * rng.standard_normal((4000, 16)), np.tile(centres[0], (600, 1)), rng.standard_normal((50, 16))]))
    key = ["a"] * 3000 + ["b"] * 1600 + ["c"] * 50
    q = np.float32(np.concatenate([centres + 0.1 * rng.standard_normal((40, 16)), centres[:3], rng.standard_normal((5, 16))]))
    there = spark.createDataFrame([(i, k, x.tolist()) for i, (k, x) in enumerate(zip(key, v, strict=True))], "id long, key string, vector array<float>")
    asked = spark.createDataFrame([(f"{k}{i}", k, x.tolist()) for i, x in enumerate(q) for k in "abc"], "qid string, key string, q array<float>")
    for name, value in (("BLOCK", 16), ("CHUNK", 300), ("CELL", 60)):
        monkeypatch.setattr(search, name, value)
    got = {(r.qid, r.ord): (r.id, r.similarity) for r in search.nearest(asked, there, 5).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit(q.astype(float)) @ unit(v.astype(float)).T, 6)
    for k in "abc":
        members = [j for j in range(len(v)) if key[j] == k]
        for i in range(len(q)):
            want = sorted(members, key=lambda j: (-s[i, j], j))[:5]
            assert [got[f"{k}{i}", n + 1][0] for n in range(5)] == want
    # how many pairs are worked out for the queries near clusters
    some = search._usable(there.where("key = 'a'"), "vector")
    cells = search.Cells(some)
    placed = cells.placed(some)
    cells.measured(placed)
    near = search._usable(asked.where("key = 'a'").limit(40), "q")
    sizes = placed.groupBy("cell").count()
    first = cells.visits(near, 5)
    kth = search._compared(first, placed.drop("angle"), 5).groupBy("qid").agg(F.sort_array(F.collect_list("similarity"), False)[4].alias("least"))
    pairs = lambda visits: visits.join(sizes, "cell").agg(F.sum("count")).first()[0] or 0
    assert pairs(first) + pairs(cells.visits(near.join(kth, "qid", "left"), 5)) < 0.2 * 40 * 3000


def test_terms_equal_regular_expressions():
    rnd = random.Random(1)
    letters = "abcÉéß-'_ 1ſK"
    for whole in (False, True):
        for _ in range(60):
            terms = list(dict.fromkeys("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 3))) for _ in range(8)))
            find = Terms(enumerate(terms), whole)
            for _ in range(40):
                text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))
                if whole:
                    hits = [i for i, t in enumerate(terms) if re.search(r"(?<!\w)" + re.escape(t) + r"(?!\w)", text, re.I)]
                else:
                    hits = [i for i, t in enumerate(terms) if t in text]
                assert find.first(text) == (hits[0] if hits else None), (terms, text, whole)
    assert Terms([(3, ""), (1, "x")]).first("yx") == 1 and Terms([(3, "")]).first("y") == 3 and Terms([]).first("y") is None and Terms([(0, "")], True).first("y") is None


@pytest.mark.parametrize("sent", [1 << 24, 900])
def test_banned_lists_of_any_length(spark, monkeypatch, sent):
    """Sent whole and cut in parts, the first entry of a country counts; 100,000 terms are one pass over a word."""
    monkeypatch.setattr(rules, "SENT", sent)
    n = 100_000 if sent > 900 else 100
    entries = spark.range(n).selectExpr("'DE' country", "id ord", "concat('term', id, 'x') word", "concat('r', id) rule_id").unionByName(spark.createDataFrame([("FR", 0, "ÉCO", None), ("FR", 1, "eco", "later"), ("FR", 2, None, "n"), (None, 0, "eco", "n")], "country string, ord long, word string, rule_id string"))
    words = spark.createDataFrame([(1, "a Term7X and term5x", "DE"), (2, "term7", "DE"), (3, "éco bag", "FR"), (4, "Eco bag", "FR"), (5, "eco bag", "UK"), (6, None, "DE"), (7, "eco", None), (8, "a Term7X and term5x", "DE")], "id long, word string, country string")
    got = {r.id: r.banned_rule for r in rules.banned(words, entries).collect()}
    assert got == {1: "r5", 2: None, 3: "manual_banned", 4: "later", 5: None, 6: None, 7: None, 8: "r5"}


def test_rule_files_by_country(spark, tmp_path):
    for name, text in (("de.json", '{"banned": ["a"]}'), ("DE_safe.json", '{"safe": ["b"]}'), ("xx.json", "{}"), ("fr.json", "no json"), ("notes.txt", "x")):
        (tmp_path / name).write_text(text)
    files = rules.read_rule_files(spark, str(tmp_path))
    assert sorted((r.country, r.list) for r in files.collect()) == [("DE", "banned"), ("DE", "safe"), ("FR", "banned")]
    assert [(r.country, r.word) for r in rules.rule_entries(files, "banned").collect()] == [("DE", "a")]


def test_few_parts_are_dealt_out(spark):
    """Read in one part, rows go to all cores; read in enough, they stay where they are."""
    few, many = (spark.range(0, 40, 1, n) for n in (1, 8))
    assert dealt(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt(few).count() == 40
    assert "Exchange" not in dealt(many)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_subject_requests(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, c string")
    assert t.where(ids.any_of([])).count() == 2 and t.where(ids.any_of([F.col("c") == "a", F.col("id") == 9])).count() == 1
    assert [r.c for r in spark.createDataFrame([(" De ",), ("US",), (None,)], "c string").select(validate.rule_country(F.col("c")).alias("c")).collect()] == ["de", None, None]
    rows = [("access", " a@b ", None, "t"), ("other", "x", "n" * 2001, " "), ("erasure", None, "", None)]
    got = validate.subject_requests(spark.createDataFrame(rows, "request_type string, contact string, note string, term string")).collect()
    assert [r.problems for r in got] == [[], ["request_type", "contact", "note", "term"], ["contact", "term"]] and got[0].contact == "a@b"


def test_personal_data_by_a_direct_loop(spark):
    """q50 against a search that tries every place of a text in turn."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    compiled = {name: (re.compile(p), score) for name, (p, score) in pii.PATTERNS.items()}

    def direct(text):
        found = []
        for name, (p, score) in compiled.items():
            at = 0
            while m := p.search(text, at):
                at = m.end() if m.end() > m.start() else m.end() + 1
                digits = "".join(c for c in m[0] if c.isdigit())
                total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
                if (name == "PHONE_NUMBER" and len(digits) < 7) or (name == "CREDIT_CARD" and not (13 <= len(digits) <= 19 and total % 10 == 0)):
                    continue
                found.append((m.start(), m.end(), name, score))
        kept = []
        while found:
            best = min(found, key=lambda f: (f[0], -(f[1] - f[0]), -f[3], f[2]))
            kept.append(best)
            found = [f for f in found if f[0] >= best[1]]
        out, undo, at = "", {}, 0
        for i, (a, b, name, _) in enumerate(kept):
            undo[f"<{name}_{i}>"] = text[a:b]
            out += f"{text[at:a]}<{name}_{i}>"
            at = b
        return out + text[at:], undo

    got = __spark_entry__.queries()["q50_pii_mask"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        text, undo = direct(texts[r.doc_id])
        assert (r.text, {e.key: e.value for e in r.entities}, r.n_entities) == (text, undo, len(undo))
