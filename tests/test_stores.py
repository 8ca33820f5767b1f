"""Stored tables: merges, chains, daily logs, collectors, caches, and what they do when a job fails."""

import datetime as dt
import hashlib
import http.server
import json
import os
import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkweave.operators import recommend, route
from sparkweave.operators.ledger import Ledger
from sparkweave.operators.runs import Run
from sparkweave.sources import hotwords, providers, suggestions
from sparkweave.sources.commits import Commits, Conflict
from sparkweave.sources.daily import DailyLog, purged_by_policy
from sparkweave.sources.versioned import VersionedTable
from sparkweave.streaming import collector

AT = dt.datetime(2026, 1, 1)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_a_version_is_taken_once(spark, tmp_path):
    a, b = Commits(spark, str(tmp_path / "c")), Commits(spark, str(tmp_path / "c"))
    a.commit(1, {"x": "ü"})
    with pytest.raises(Conflict):
        b.commit(1, {"x": 2})
    assert b.latest() == 1 and b.read(1) == {"x": "ü"} and sorted(n for n in os.listdir(tmp_path / "c") if not n.startswith(".")) == ["000000000001.json"]


SCHEMA = "k long, seq long, v string"


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", SCHEMA, parts=8)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(i, 1, f"v{i}") for i in range(100)] + [(None, 1, "none")], SCHEMA), "seq")
    before, version = _files(tmp_path / "t" / "data"), t.version()
    assert t.upsert(spark.createDataFrame([(5, 2, "new"), (6, 0, "old")], SCHEMA), "seq") == version + 1
    places = {p: x for p, x in t.commits.read(version)["places"].items()}, {p: x for p, x in t.commits.read(version + 1)["places"].items()}
    same = [p for p in places[0] if places[0][p] == places[1][p]]
    assert len(same) >= 6 and before <= _files(tmp_path / "t" / "data")
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {**{i: f"v{i}" for i in range(100)}, None: "none", 5: "new"}
    assert {r.k: r.v for r in t.read(version).where("k = 5").collect()} == {5: "v5"}
    t.delete(spark.createDataFrame([(7,), (1000,), (None,)], "k long"))
    t.delete_where(F.col("v") == "v8")
    assert {r.k for r in t.read().collect()} == {*range(100), None} - {7, 8}
    last = t.version()
    assert t.delete_where(F.col("v") == "nothing") == last and t.upsert(spark.createDataFrame([], SCHEMA), "seq") == last
    assert sorted(r.k for r in t.get(spark.createDataFrame([(3,), (7,), (None,)], "id long")).collect()) == [3]
    t.vacuum()
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.key == "k" and again.read().count() == 99 and again.commits.versions() == [last]
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "t"), "v", SCHEMA)


def test_a_failed_task_leaves_the_version_before(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", SCHEMA, parts=4)
    t.upsert(spark.createDataFrame([(i, 1, "v") for i in range(20)], SCHEMA), "seq")
    version, files = t.version(), _files(tmp_path / "t")
    broken = spark.range(20).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("seq"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise("w").alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken, "seq")
    assert t.version() == version and _files(tmp_path / "t") == files and {r.v for r in t.read().collect()} == {"v"}


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second of two writers that began at one version works its change out anew, or is refused if it may not."""
    a, b = (VersionedTable(spark, str(tmp_path / "t"), "k", SCHEMA, parts=2) for _ in range(2))
    a.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), "seq")
    commit, fired = b.commits.commit, []

    def late(version, record):
        if not fired:
            fired.append(a.upsert(spark.createDataFrame([(2, 1, "a"), (1, 5, "a5")], SCHEMA), "seq"))
        commit(version, record)

    monkeypatch.setattr(b.commits, "commit", late)
    b.upsert(spark.createDataFrame([(1, 3, "b"), (3, 1, "b")], SCHEMA), "seq")
    assert {r.k: r.v for r in a.read().collect()} == {1: "a5", 2: "a", 3: "b"}
    fired.clear()
    b.tries = 1
    with pytest.raises(Conflict):
        b.upsert(spark.createDataFrame([(9, 1, "b")], SCHEMA), "seq")
    assert a.read().where("k = 9").count() == 0


EVENT = "id long, ts string, actor string, action string, rtype string, rid string, detail string"


def _events(spark, ids):
    return spark.createDataFrame([(i, f"t{i}", "ab"[i % 3 == 0], "x", "r", str(i), "d") for i in ids], EVENT)


def _fold(ids, chain=None):
    heads = {}
    for i in ids:
        actor = "ab"[i % 3 == 0]
        key = actor if chain else ""
        heads[key] = hashlib.sha256(f"{heads.get(key, 'GENESIS')}|{i}|t{i}|{actor}|x|r|{i}".encode()).hexdigest()
    return heads


@pytest.mark.parametrize("chain", ["actor", None])
def test_batches_append_to_their_heads(spark, tmp_path, chain):
    once, three = (Ledger(spark, str(tmp_path / n), EVENT) for n in ("once", "three"))
    once.append(_events(spark, range(90)), chain)
    for part in (range(20), range(20, 21), range(21, 90)):
        three.append(_events(spark, part), chain)
    heads = [{r.chain: r.head for r in x.heads().collect()} for x in (once, three)]
    assert heads[0] == heads[1] == _fold(range(90), chain)
    columns = ["chain", "id", "prev_hash", "hash"]
    assert sorted(map(tuple, once.log().select(columns).collect())) == sorted(map(tuple, three.log().select(columns).collect()))
    assert all(r.ok for r in three.verified().collect())


def test_ledger_refuses_and_finds(spark, tmp_path):
    a = Ledger(spark, str(tmp_path / "l"), EVENT)
    seen = a.append(_events(spark, range(10)), "actor")
    a.append(_events(spark, range(10, 20)), "actor", expected=seen)
    with pytest.raises(Conflict):
        a.append(_events(spark, range(20, 30)), "actor", expected=seen)
    with pytest.raises(ValueError, match="not after"):
        a.append(_events(spark, [5]), "actor")
    b = Ledger(spark, str(tmp_path / "l"), EVENT)
    commit = b.commits.commit
    b.commits.commit = lambda v, r: (a.append(_events(spark, range(20, 25)), "actor"), commit(v, r))
    with pytest.raises(Conflict):
        b.append(_events(spark, range(20, 30)), "actor")
    assert b.log().count() == 25 and all(r.ok for r in a.verified().collect())

    class Forged(Ledger):
        change = staticmethod(lambda rows: rows)

        def log(self):
            return self.change(super().log())

    c = Forged(spark, str(tmp_path / "l"), EVENT)
    for change, bad in ((lambda r: r.withColumn("action", F.when(F.col("id") == 11, "evil").otherwise(F.col("action"))), {("a", 2)}), (lambda r: r.where("id <> 3"), {("b", 1)}), (lambda r: r.where("segment <> 2 OR chain <> 'a'"), {("a", 2)}), (lambda r: r.withColumn("detail", F.lit("<REDACTED>")), set())):
        c.change = change
        assert {(r.chain, r.segment) for r in c.verified().where("NOT ok").collect()} == bad


def test_days_go_by_name(spark, tmp_path):
    log = DailyLog(spark, str(tmp_path / "log"), "id long, ts timestamp")
    rows = [(i, AT + dt.timedelta(hours=6 * i)) for i in range(40)] + [(99, None)]
    log.append(spark.createDataFrame(rows[:25], "id long, ts timestamp"))
    log.append(spark.createDataFrame(rows[25:], "id long, ts timestamp"))
    for name in [f for f in _files(tmp_path / "log") if "day_=2026-01-02" in f]:
        os.remove(name)  # what goes by name is not read
    kept = {f for f in _files(tmp_path / "log") if "day_=2026-01-07" in f}
    cut = AT + dt.timedelta(days=5, hours=9)
    assert log.purge(cut.strftime("%Y-%m-%d %H:%M:%S")) == sum(1 for _, t in rows if t is not None and t < cut)
    assert sorted(r.id for r in log.read().collect()) == sorted(i for i, t in rows if t is None or t >= cut)
    read = log.read("2026-01-07 06:00:00", "2026-01-08 00:00:00")
    assert sorted(r.id for r in read.collect()) == [25, 26, 27] and all("day_=2026-01-07" in f or "day_=2026-01-08" in f for f in read.inputFiles())
    assert kept <= _files(tmp_path / "log") and log.purge("2020-01-01 00:00:00") == 0
    policies = spark.createDataFrame([("a", 30, None), ("b", None, None), ("c", 30, None)], "key string, days int, updated_at timestamp")
    assert purged_by_policy({"a": log, "b": log}, policies, "2026-02-05 09:00:00") == {"a": 0, "c": -1}
    log.vacuum()
    again = DailyLog(spark, str(tmp_path / "log"))
    assert again.read().count() == sum(1 for _, t in rows if t is None or t >= cut) and not [f for f in _files(tmp_path / "log") if "2026-01-03" in f]


def _candidates(spark, run, words, day, job="overseas", country="DE"):
    act = lambda w: "inserted" if job == "cn" else ("approved", "pending", "pending_no_anchor", "blocked")[len(w) % 4]
    return spark.createDataFrame([(job, country, run, AT + dt.timedelta(day), i, w, None, 1.0, "s", act(w) if w else None) for i, w in enumerate(words)], collector.CANDIDATES)


def _simulated(runs, known, keys):
    """The collector's definition: [(run, pos, word, action, duplicate, counters...)]."""
    history, out = [], []
    for run, words in runs:
        n = dict(approved=0, pending=0, rejected=0, duplicates=0, added=0, processed=0)
        for pos, w in enumerate(words):
            action = ("approved", "pending", "pending_no_anchor", "blocked")[len(w) % 4]
            n["processed"] += 1
            old = w in history
            dup = old or w in known
            if dup:
                n["duplicates"] += 1
            else:
                n["approved" if action == "approved" else "pending" if action.startswith("pending") else "rejected"] += 1
                n["added"] += action == "approved"
            if not old:
                history = [*history, w][-keys:]
            out.append((run, pos, w, None if dup else action, dup, *n.values()))
    return out


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SHOWN = ["run_id", "pos", "word", "action", "duplicate", "approved", "pending", "rejected", "duplicates", "added", "processed"]


def test_collector_keeps_the_newest_keys(spark, tmp_path, one_partition):
    """Runs that arrive one by one, with restarts between them, decide as one pass does; the oldest keys are forgotten."""
    known = spark.createDataFrame([("DE", "k"), ("FR", "a")], "country string, word string")
    runs = [("r1", ["a", "bb", "ccc", "dddd", "k"]), ("r2", ["a", "ee", "bb", "f"]), ("r3", ["a", "ccc", "ee", "a"]), ("r4", ["a", "ccc"])]
    where = lambda n: [str(tmp_path / f"{n}-{x}") for x in ("in", "out", "progress")]
    source, out, progress = where("steps")
    for i, (run, words) in enumerate(runs):
        collector.submit(_candidates(spark, run, words, i), source)
        if i != 1:  # two runs wait for the third start
            collector.run_collector(spark, source, known, out, progress, keys=4).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(SHOWN).collect()), key=str) == sorted(_simulated(runs, {"k"}, 4), key=str)
    collector.run_collector(spark, source, known, out, progress, keys=4).awaitTermination()
    assert spark.read.parquet(out).count() == got.count()  # nothing is decided twice
    summary = {r.run_id: (r.total, r.skipped, r.approved, r.pending, r.rejected, r.duplicates, r.added) for r in collector.summaries(got).collect()}
    assert summary["r1"] == (5, False, 1, 2, 1, 1, 1) and summary["r4"] == (2, True, 0, 0, 0, 2, 0)


def test_collector_of_two_jobs_and_expiry(spark, tmp_path, one_partition):
    """Chinese words, and words of two countries, in one stream; what a run saw is forgotten a day and a half later."""
    known = spark.createDataFrame([], "country string, word string")
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for run, day in (("r1", 0), ("r2", 1), ("r3", 3)):
        both = _candidates(spark, run, ["词", "衣", None], day, "cn", "CN").unionByName(_candidates(spark, run, ["aaaa"], day)).unionByName(_candidates(spark, run, ["aaaa"], day, country="FR"))
        collector.submit(both, source)
    collector.run_collector(spark, source, known, out, progress, expire_ms=36 * 3600 * 1000).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 12 and {r.run_id for r in rows if r.duplicate} == {"r2"} == {r.run_id for r in rows} - {"r1", "r3"}
    assert sorted((r.country, r.run_id, r.word, r.added) for r in rows if r.job == "cn" and r.run_id != "r2") == sorted(("CN", run, w, n) for run in ("r1", "r3") for n, w in ((1, "词"), (2, "衣")))


class Counting(providers.Offline):
    """Says in a file of the test what it was asked, and when it was made."""

    def __init__(self, path):
        super().__init__(8)
        self.path = path
        self.say("made")

    def say(self, what):
        with open(f"{self.path}/{os.getpid()}", "a", encoding="utf-8") as f:
            f.write(what + "\n")

    def assess(self, word, country):
        self.say(f"assess {country} {word}")
        return None if word == "odd" else "可复用"

    def embed(self, text):
        self.say(f"embed {text}")
        return super().embed(text) * 3


def test_each_text_is_embedded_once(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()
    folder = str(told)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
    model = providers.Model("counting", lambda: Counting(folder), 8)
    kept = providers.vector_table(spark, str(tmp_path / "vectors"), 2)
    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id long, text string")
    first = {r.id: r.vector for r in providers.embed_through(texts("a", "b", "a", " ", None), model, kept).collect()}
    assert first[0] == first[2] and first[3] is None and first[4] is None and abs(np.linalg.norm(first[1]) - 1) < 1e-6
    second = {r.id: r.vector for r in providers.embed_through(texts("b", "c"), model, kept).collect()}
    assert second[0] == first[1]
    lines = [x for f in told.iterdir() for x in f.read_text().splitlines()]
    assert sorted(x for x in lines if x != "made") == ["embed a", "embed b", "embed c"]
    assert all(f.read_text().splitlines().count("made") == 1 for f in told.iterdir())  # once a worker
    answers = providers.answer_table(spark, str(tmp_path / "answers"), 2)
    words = lambda *rows: spark.createDataFrame(list(rows), "word string, country string, verdict boolean")
    asked = [{(r.word, r.country): r.said_verdict for r in providers.assess_through(words(*rows), model, answers).collect()} for rows in ([("a", "DE", None), ("a", "DE", None), ("b", "DE", False), ("odd", "DE", None), (None, "DE", None)], [("a", "DE", None), ("a", "FR", None)])]
    assert asked == [{("a", "DE"): "可复用", ("b", "DE"): None, ("odd", "DE"): None, (None, "DE"): None}, {("a", "DE"): "可复用", ("a", "FR"): "可复用"}]
    lines = [x for f in told.iterdir() for x in f.read_text().splitlines() if x.startswith("assess")]
    assert sorted(lines) == ["assess DE a", "assess DE odd", "assess FR a"]
    with pytest.raises(Exception, match="shape"):
        providers.embed_new(texts("z"), providers.Model("odd", lambda: providers.Offline(5), 8), kept)
    out = route.anchored(spark.createDataFrame([("衣", "c", 0.5), ("衣", None, 0.9), (" ", "c", 0.1)], "word string, category string, heat double"), lambda df: providers.embed_through(df, model, kept, "word"))
    assert [(r.cn_word, len(r.vector)) for r in out["cn_anchors"].collect()] == [("衣", 8)] and out["lineage"].count() == 1


def test_runs_leave_their_events(spark, tmp_path):
    folder = str(tmp_path / "lineage")
    with Run(spark, folder, "job", "good", wait=20) as run:
        rows = run.counted(spark.range(10), "read", rows=F.count(F.lit(1)), most=F.max("id"))
        rows.write.parquet(str(tmp_path / "x"))
    with pytest.raises(ZeroDivisionError), Run(spark, folder, "job", "bad") as run:
        1 / 0
    got = {(r.run_id, r.event_type): json.loads(r.event) for r in spark.read.parquet(folder).collect()}
    assert set(got) == {("good", "START"), ("good", "COMPLETE"), ("bad", "START"), ("bad", "FAIL")}
    assert got["good", "COMPLETE"]["run"]["facets"] == {"read.rows": 10, "read.most": 9} and "ZeroDivisionError" in got["bad", "FAIL"]["run"]["facets"]["error"]


@pytest.fixture
def server():
    seen = {}

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            if "flaky" in self.path and seen[self.path] <= 2 or "broken" in self.path:
                self.send_error(503)
                return
            body = json.dumps({"suggestions": [{"value": f"{self.path.split('/')[-1]} coat"}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{country}}/{{seed}}", seen
    s.shutdown()


def test_requests_are_tried_again_and_errors_are_rows(spark, tmp_path, server):
    url, seen = server
    seeds = spark.createDataFrame([("DE", "wool", "c"), ("DE", "flaky", None), ("FR", "broken", None), (None, "x", None)], "country string, seed string, category string")
    got = {r.seed: r for r in suggestions.fetched(seeds, url, retries=2, wait=0.01).collect()}
    assert got["wool"].tries == 1 and got["flaky"].tries == 3 and got["flaky"].error is None and got["wool"].category == "c"
    assert got["broken"].body is None and "503" in got["broken"].error and got["broken"].tries == 3 and got["x"].error == "no country or seed"
    assert sorted(r.word for r in suggestions.parse_object(suggestions.fetched(seeds.limit(1), url).drop("error", "tries")).collect()) == ["wool coat"]
    # a stream of seeds asks for each once
    source = str(tmp_path / "seeds")
    for name in ("one", "two"):
        spark.createDataFrame([("NL", name, None)], seeds.schema).coalesce(1).write.mode("append").parquet(source)
        query = suggestions.fetched(spark.readStream.schema(seeds.schema).parquet(source), url).writeStream.format("parquet").option("path", str(tmp_path / "bodies")).option("checkpointLocation", str(tmp_path / "place")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r.seed for r in spark.read.parquet(str(tmp_path / "bodies")).collect()) == ["one", "two"] and seen["/nl/one"] == seen["/nl/two"] == 1
    # the short list of a data source
    spark.dataSource.register(suggestions.SuggestionSource)
    rows = spark.read.format("suggestions").options(url=url, seeds="UK:hat,UK:broken", wait="0.01").load().collect()
    assert [(r.country, r.seed) for r in rows] == [("UK", "hat")]


def test_hot_words_grow_stale_and_are_served(spark, tmp_path):
    cache = VersionedTable(spark, str(tmp_path / "hot"), "country", hotwords.CACHE, 1)
    asked, answer = [], {"DE": ["a", "b", "c"], "FR": []}

    def fetch(countries):
        names = sorted(r.country for r in countries.collect())
        asked.append(names)
        rows = [(c, w, 1.0 - i / 15, None) for c in names for i, w in enumerate(answer.get(c, []))]
        return spark.createDataFrame(rows, "country string, query string, trend_score double, category string")

    at = lambda s: F.lit((AT + dt.timedelta(seconds=s)).isoformat(sep=" ")).cast("timestamp")
    words = lambda n=10: [(r.country, r["query"]) for r in hotwords.hot_words(cache.read(), spark.createDataFrame([(" de",), ("FR",), ("US",), (None,)], "country string"), n).orderBy("country", "ord").collect()]
    go = lambda s: hotwords.refreshed(cache, fetch, at(s), ("DE", "FR"))
    assert words() == []
    go(0)
    assert words(2) == [("DE", "a"), ("DE", "b")] and len(words()) == 3
    go(30)
    go(59)
    go(61)  # an empty list is tried again after a minute
    answer["DE"] = []
    go(600)  # a full one after ten; its old words are served on, as nothing new came
    assert len(words()) == 3
    answer["DE"] = ["z"]
    go(601)
    assert words() == [("DE", "z")]
    go(602)
    assert asked == [["DE", "FR"], [], [], ["FR"], ["DE", "FR"], ["DE"], []]


def test_recommendations_from_text(spark):
    """Requests of all kinds: refused, without candidates, without an answer, and answered with inventions."""
    tags = spark.createDataFrame([(1, "winter coat", "DE", "c", "s", 1.0, "可复用", "fine", "锚", [1.0, 0.0]), (2, "wool coat", "DE", None, "s", 0.0, "可复用", "ok", None, [0.9, 0.1]), (3, "hat", "DE", "d", "s", 1.0, "可复用", "", None, [0.8, 0.2]), (4, "bad", "DE", "c", "s", 1.0, "需拦截", "", None, [1.0, 0.0])], "id long, word string, country string, category string, source string, trend_score double, compliance_status string, reason string, anchor_cn_word string, vector array<double>")
    asked = spark.createDataFrame([("a", " coat ", "de", "c", 2), ("b", "coat a@b.de", "DE", "", None), ("n", "coat", "FR", None, 5), ("x", " ", "US", None, 11)], "qid string, title string, target_country string, category string, top_k int")
    said = {"a": '{"recommendations": [{"word": "invented"}, {"word": " WOOL COAT", "reason": " warm "}]}', "b": None}
    told = {}

    def ask(prompts):
        told.update({r.qid: r.prompt for r in prompts.collect()})
        return spark.createDataFrame(list(said.items()), "qid string, answer string")

    hot = spark.createDataFrame([("DE", 1, "z"), ("DE", 0, "y")], "country string, ord long, query string")
    out = recommend.recommendations(asked, tags, lambda q: q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), ask, hot)
    items = {(r.qid, r.position): (r.word, r.reason, r.ai_generated, r.anchor_cn_word) for r in out["items"].collect()}
    fill = "基于向量相似度补充推荐"
    assert items == {("a", 1): ("wool coat", "warm", True, None), ("a", 2): ("winter coat", fill, False, "锚"), ("b", 1): ("winter coat", fill, False, "锚"), ("b", 2): ("wool coat", fill, False, None), ("b", 3): ("hat", fill, False, None)}
    assert {r.qid: (r.total_candidates, r.filtered_candidates, r.ai_assisted) for r in out["answers"].collect()} == {"a": (3, 2, True), "b": (3, 3, False), "n": (0, 0, False)}
    assert [(r.qid, r.problems) for r in out["refused"].collect()] == [("x", ["title", "target_country", "top_k"])]
    assert set(told) == {"a", "b"} and "<EMAIL_ADDRESS_0>" in told["b"] and "a@b.de" not in told["b"] and "热销词：y, z" in told["a"] and "- winter coat (类目: c) (热度: 1.0) (相似度: 1.0000)" in told["a"] and "未指定" in told["b"]


def test_routed_words_are_stored_once(spark, tmp_path):
    schema = "word string, country string, category string, source string, trend_score double, status string, reason string, rule_id string, anchor_id long, anchor_word string, anchor_score double, action string"
    row = lambda word, action, reason: (word, "DE", None, "s", 1.0, "x", reason, None, 1, "锚", 0.9, action)
    run = lambda *rows: route.sinks(spark.createDataFrame(list(rows), schema))
    at = lambda day: F.lit(f"2026-01-0{day}").cast("timestamp")
    first = run(row("a", "approved", "one"), row("b", "pending", "one"), row("c", "blocked", "one"))
    tables = route.stores(spark, str(tmp_path), first, 2)
    route.write(first, tables, at(1))
    route.write(run(row("a", "approved", "two"), row("b", "blocked", "two"), row("d", "pending_no_anchor", "two"), row("d", "pending_no_anchor", "two")), route.stores(spark, str(tmp_path), first), at(2))
    tags, wait, block = (tables[n].read().collect() for n in ("local_tags", "pending_review", "blocked_decisions"))
    assert [(r.word, r.reason, r.created_at.day) for r in tags] == [("a", "two", 2)]
    assert sorted((r.word, r.assessment_reason) for r in wait) == [("b", "one"), ("d", "two [未找到对应中文锚点]")] and sorted((r.word, r.reason) for r in block) == [("b", "two"), ("c", "one")]
