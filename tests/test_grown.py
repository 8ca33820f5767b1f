"""Queries over tables larger than those they were written on, against their SQL."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from sparkweave.operators import search


def rows_of(found):
    return sorted(str([f"{x:.6g}" if isinstance(x, float) else x for x in r]) for r in found)


def same(spark, sf, name, tables):
    """The query's rows, which are those of its SQL."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = __spark_entry__.queries()[name](spark, str(sf))
    columns = sorted(mine.columns)
    theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in mine.select(*columns).collect()]
    assert rows_of(got) == rows_of(theirs)
    return got


def test_tickets_beyond_a_hundred_thousand_events(spark, tmp_path):
    """q69: ids that go round, so that a ticket has several updates, one of them twice, or none."""
    ids = [*range(60), *range(100_000, 100_090), *range(700_020, 700_050), 100_003]
    kinds = ["view" if i % 4 == 3 else "click" for i in ids]
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 400, minutes=k) for k, i in enumerate(ids)]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(ids, pa.int64()), "event_type": kinds}), tmp_path / "events.parquet")
    got = same(spark, tmp_path, "q69_tickets", ["events"])
    assert len(got) > 100


def shuffled(spark):
    """MB that the session's tasks have written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    all_ = sc.statusStore().executorList(False)
    return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size())) / 1e6


@pytest.fixture(scope="module")
def unclustered(tmp_path_factory):
    """1,500 vectors without clusters, some twice, and 9 MB of texts."""
    at, rng, n = tmp_path_factory.mktemp("unclustered"), np.random.default_rng(4), 1500
    v = rng.standard_normal((n, 16)).astype(np.float32)
    v[700:740] = v[100:140]
    ids = pa.array(np.arange(n))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array(np.arange(n) % 10, pa.int32())}), at / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": ids, "text": [f" w{i % 400}  x{i % 300} {rng.bytes(3000).hex()}" for i in range(n)], "lang": ["en"] * n, "source": ["s"] * n, "n_chars": ids}), at / "documents.parquet")
    pq.write_table(pa.table({"event_id": ids, "ts": pa.array([dt.datetime(2024, 1, 1)] * n, pa.timestamp("us")), "user_id": ids, "event_type": ["click"] * n}), at / "events.parquet")
    return at


@pytest.mark.parametrize("name", ["q27_provenance_join", "q01_recommend_topk", "q02_knn_topk_per_query", "q04_category_soft_filter", "q72_rerank_fallbacks", "q26_rerank_backfill", "q28_any_flag", "q29_candidate_text_block"])
def test_recall_moves_neither_texts_nor_a_query_for_each_cell(spark, unclustered, monkeypatch, name):
    for constant, value in (("BLOCK", 64), ("CHUNK", 100), ("CELL", 4), ("PROBES", 32)):
        monkeypatch.setattr(search, constant, value, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    try:
        same(spark, unclustered, name, ["embeddings", "documents", "events"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 6


def test_cells_are_visited_where_they_rule_most_out(spark, monkeypatch):
    """Clustered vectors go by cells, beside a key too small for any; others stream. Both find what all pairs give."""
    for constant, value in (("BLOCK", 16), ("CHUNK", 100), ("CELL", 40), ("PROBES", 32)):
        monkeypatch.setattr(search, constant, value)
    chosen, worth = [], search._worth
    monkeypatch.setattr(search, "_worth", lambda *a: chosen.append(worth(*a)) or chosen[-1])
    rng, unit = np.random.default_rng(5), lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    centres = rng.standard_normal((20, 16))
    for v in (centres[np.arange(1000) % 20] + 0.05 * rng.standard_normal((1000, 16)), rng.standard_normal((1000, 16))):
        v[990:] = v[980:990]
        key = ["b" if i % 50 == 0 else "a" for i in range(1000)]
        there = spark.createDataFrame([(f"p{i:04}", k, x.tolist()) for i, (k, x) in enumerate(zip(key, v, strict=True))], "id string, key string, vector array<double>")
        asked = spark.createDataFrame([(i, "ab"[i % 2], v[i].tolist()) for i in range(0, 1000, 9)], "qid long, key string, q array<double>")
        got = {(r.qid, r.ord): (int(r.id[1:]), r.similarity) for r in search.nearest(asked, there, 5).collect()}
        s = np.round(unit(v) @ unit(v).T, 6)
        for i in range(0, 1000, 9):
            want = sorted((j for j in range(1000) if key[j] == "ab"[i % 2]), key=lambda j: (-s[i, j], j))[:5]
            assert [got[i, n + 1] for n in range(5)] == [(j, s[i, j]) for j in want]
    assert chosen == [True, False]
