"""Fill-in-middle, exact dedup and centroid clustering against direct forms, and their odd inputs."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import centroids, digest_index, fill_in_middle

DOCS = "doc_id long, text string, n string, form string, digest string, row string"


def _docs(spark, rows):
    """Documents with further columns that bear the operators' own names."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [(1, None), (2, ""), (3, "a"), (4, "two words"), (4, "two words"), (5, "naïve Füchse, 12 \n\t"), (6, "has <P> in it"), (7, "<S"), (8, "x<"), (None, "no id"), (9, "日本語 text 日本"), (10, "a" * 5000), (11, "word, " * 9000), (12, "😀x" * 500)]


def test_fill_in_middle_equals_its_definition(spark, monkeypatch):
    rows = ODD + [(i, f"Line {i}, of <{'ab c' * (i % 7)}>") for i in range(20, 300)]
    got = fill_in_middle.fill_in_middle(_docs(spark, rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        text = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((i, n, "plain", None, None, text, text))
        elif h4 % 100 < 20:
            want.append((i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text))
        else:
            want.append((i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_windows_cut_where_one_match_does(monkeypatch):
    texts = ["word, " * 50, "x" * 200, "ab1 " * 30 + "z" * 90 + "!" * 40, "", "é" * 33]
    whole = [[fill_in_middle.cuts(t, a, b) for a in range(0, 60, 7) for b in range(0, 99, 13)] for t in texts]
    monkeypatch.setattr(fill_in_middle, "WINDOW", 16)
    assert whole == [[fill_in_middle.cuts(t, a, b) for a in range(0, 60, 7) for b in range(0, 99, 13)] for t in texts]


def test_marks_and_empty_tables(spark):
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(_docs(spark, ODD), marks=("<P>", "P>x", "<M>"))
    own = fill_in_middle.fill_in_middle(_docs(spark, ODD), marks=("[pre]", "[suf]", "[mid]"), plain_from=100, seed=7)
    back = own.select("doc_id", "form", fill_in_middle.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t")).collect()
    assert sorted(str(r.t) for r in back) == sorted(t or "" for _, t in ODD) and sum(r.form == "plain" for r in back) == 2
    assert fill_in_middle.digests(_docs(spark, [])).collect() == []


def _deduped(rows):
    """The definition: {(position): (keep_id, size, kept)}."""
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append((i is None, i or 0, at))
    out = {}
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out[m[2]] = (None if first[0] else first[1], len(members), m == first, _sha(text))
    return out


SAME = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (4, "a b "), (2, None), (8, ""), (7, "A b"), (None, "c"), (1, "d e"), (6, "d e"), (3, "other text of id 3"), (None, "a\n b"), (None, "f"), (None, "f")]


def test_exact_dedup_equals_its_definition(spark):
    rows = SAME + [(100 + i, f"text {i % 17}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    got = digest_index.dedup_table(_docs(spark, rows)).collect()
    want = _deduped(rows)
    assert sorted(str((r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == sorted(str(v) for v in want.values())
    assert sorted(str((r.doc_id, r.keep_id, r.text_sha256)) for r in got) == sorted(str((rows[at][0], v[0], v[3])) for at, v in want.items())
    assert digest_index.dedup_table(_docs(spark, [])).collect() == []


def test_index_outlives_its_session_and_compacts(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [(1, "a"), (2, "a"), (3, "b")]
    index = digest_index.DigestIndex(spark, path, buckets=3)
    assert {r.doc_id: (r.keep_id, r.kept) for r in digest_index.exact_dedup(_docs(spark, first), index).collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    spark.sql(f"DROP TABLE {index.name}")  # what another session knows
    again = digest_index.DigestIndex(spark, path, buckets=50)
    assert again.buckets == 3 and again.table().count() == 2
    # what the index has stays, whatever the id; a batch that comes again changes nothing
    for _ in range(2):
        got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in digest_index.exact_dedup(_docs(spark, [(0, "a"), (7, "c"), (8, "c")]), again).collect()}
        assert got[0] == (1, False, 1) and got[7][0] == got[8][0] == 7 and got[8][1:] == (False, 2)
        assert again.table().count() == 3
    again.compacted()
    assert again.version == 1 and sorted(r.doc_id for r in again.table().collect()) == [1, 3, 7]
    spark.sql(f"DROP TABLE {again.name}")
    third = digest_index.DigestIndex(spark, path)
    assert (third.version, third.buckets, third.table().count()) == (1, 3, 3)
    assert {r.doc_id: r.kept for r in digest_index.exact_dedup(_docs(spark, [(9, "b"), (10, "new")]), third).collect()} == {9: False, 10: True}


def test_index_is_not_shuffled(spark, tmp_path):
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"))
    rows = digest_index.digested(_docs(spark, SAME))
    index.append(rows)
    new = rows.groupBy("digest").agg(F.min("doc_id")).hint("merge").join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def _kmeans(ids, vectors, k, rounds, scale=256):
    """The definition, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in zip(ids, vectors) if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    centers = [v for _, v in sorted(kept, key=lambda r: (_sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(x) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centers)]
    last = [(i, *near(v)) for i, v in kept]
    per = {}
    for _, d, n in last:
        per[n] = per.get(n, 0) + d
    return [(i, n, d, per[n], sum(per.values()), _sha(",".join(map(str, centers[n])))) for i, d, n in last]


def _vectors(spark, ids, vectors):
    return spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids), [1] * len(ids))), "vec_id long, embedding array<float>, cluster string, n int")


def test_clusters_equal_their_definition(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = [x.tolist() for x in np.float32(rng.standard_normal((220, 64)) * 0.2 + rng.integers(0, 4, (220, 1)))]
    v += [None, [0.5] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, v[0], [0.0] * 64, [-3e5] * 64, v[1]]
    ids = [*range(220), *range(220, 225), 0, 226, 227, None]
    monkeypatch.setattr(centroids, "BLOCK", 37)
    got = [tuple(r) for r in centroids.clusters(_vectors(spark, ids, v)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _kmeans(ids, v, 40, 5)))
    assigned, table = centroids.cluster(_vectors(spark, ids, v), k=3, rounds=2)
    assert sum(r.n for r in table.collect()) == assigned.count() == 224


def test_clusters_of_few_and_odd_vectors(spark):
    few = [[float(i)] * 64 for i in (1, 1, 5)]
    got = [tuple(r) for r in centroids.clusters(_vectors(spark, [1, 2, 3], few)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _kmeans([1, 2, 3], few, 40, 5)))
    assert centroids.clusters(_vectors(spark, [], [])).collect() == [] and centroids.clusters(_vectors(spark, [1], [None])).collect() == []
    with pytest.raises(Exception, match="fits? no long|fit no long"):
        centroids.clusters(_vectors(spark, [1], [[1e30] * 64])).collect()
