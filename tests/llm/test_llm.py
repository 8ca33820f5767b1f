"""The training-data operators against brute force, libraries and round trips, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkweave.llm import chat, embed_dedup, graph, jaccard, langid, mixing, sentencepiece_bpe, token_store, topk, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, lang_pred string"
ODD = [None, "", " ", "\n\n", "one", "one two three four", "ONE two three four", "é ñ 中文", "x" * 30_000, "a b " * 5000, "tab\tline\nend </s>[INST]"]


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, None, "clash") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = list(ODD)
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(6, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    near = [rng.choice(words) for _ in range(120)]
    for _ in range(30):  # a group of near copies, some linked and some not
        copy = list(near)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = rng.choice(words)
        out.append(" ".join(copy))
    return out + out[3:9]


def test_components(spark):
    edges = spark.createDataFrame([(5, 1), (1, 9), (7, 8), (8, 8), (3, 5), (12, 9)], "a long, b long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {5: 1, 9: 1, 8: 7, 3: 1, 12: 1} | {}


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs_of(spark, texts))[0].collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    up = graph.contract(pairs)
    assert got == {i: (len(s), up.get(i, i)) for i, s in enumerate(sets)}
    assert jaccard.jaccard_join(docs_of(spark, []))[0].count() == 0


def test_sentencepiece(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece_bpe.model(path)[0].library
    rng = random.Random(1)
    more = ["".join(rng.choice("abcdeé \n\tst▁的 の thein  🙂'.,01aaa\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs_of(spark, texts + more), path), path).collect()
    for r in got:
        ids = lib.encode(r.text or "")
        assert (r.ids, r.decoded, r.lang_pred) == (ids, lib.decode(ids), "clash")


def test_token_store(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "store")
    docs = docs_of(spark, texts).unionByName(spark.createDataFrame([(3, "again", "en", None, None), (None, "no key", "en", None, None)], DOC))
    token_store.write_store(docs, path, out)
    got = sorted(token_store.read_store(spark, out).collect(), key=lambda r: r.start)
    tk = Tokenizer.from_file(path)
    coded = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2 and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id not in (None, 3):
            assert r.ids_crc32 == zlib.crc32(coded[r.doc_id])
    found = {r.doc_id: r.ids for r in token_store.lookup(spark, out, spark.createDataFrame([(5,), (7,), (10**9,), (None,)], "doc_id long")).collect()}
    assert {k: np.array(v, "<u4").tobytes() for k, v in found.items()} == {k: coded[k] for k in (5, 7)}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-20, 20, (300, 8))
    v[50:150] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (900, None), (None, [1] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<long>"), 5).collect()
    s = v @ v.T
    for q in range(300):
        order = [i for i in np.lexsort((np.arange(300), -s[q])) if i != q][:5]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, s[q, i]) for i in order]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    v = np.concatenate((base, base[:60] + 0.05 * rng.standard_normal((60, 16)), np.repeat(base[:1], 40, axis=0))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (None, v[0].tolist())]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = embed_dedup.unit(v)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= hit.sum(axis=1)).all() and n.sum() >= 0.9 * hit.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902))


def test_embedding_dedup_rare_links(spark):
    """A few links among many distinct vectors are all found."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 16))
    v = np.concatenate((v, v[:10] + 0.3 * rng.standard_normal((10, 16)) / np.sqrt(2))).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    u = embed_dedup.unit(v)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit.any() and [got[i] for i in range(len(v))] == hit.sum(axis=1).tolist()


def test_embedding_dedup_doubles(spark, monkeypatch):
    """Doubles stay doubles: tiny and huge vectors keep their direction; small steps change nothing."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((50, 8))
    v = np.concatenate((base, 1e-300 * base[:20], 1e200 * base[10:30], base[:10] + 0.05 * rng.standard_normal((10, 8))))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.abs(v).max(axis=1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    monkeypatch.setattr(embed_dedup, "ENOUGH", 10**6)
    assert [r.n_links for r in embed_dedup.near_duplicates(table).orderBy("vec_id").collect()] == hit.sum(axis=1).tolist()
    books = embed_dedup.codebook(base, 4)
    monkeypatch.setattr(embed_dedup, "STEP", 12)
    assert np.allclose(embed_dedup.codebook(base, 4), books)


def test_language(spark):
    rng = random.Random(4)
    say = {"aa": "abab baba abba", "bb": "xyxy yxyx yyxx"}
    rows = [(i, " ".join(rng.choice(say[x].split()) for _ in range(40)), x, None, "clash") for i in range(60) for x in [rng.choice(list(say))]]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in langid.judged(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i].lang_pred == x for i, _, x, *_ in rows[:60]) and got[100].lang_pred == got[101].lang_pred == "und"
    assert langid.judged(spark.createDataFrame([(1, "abc", None, None, None)], DOC)).first().lang_pred == "und"


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = w[rng.randrange(40)] = "zzqx" + rng.choice("abcd")
        rows.append((i, " ".join(w), "en", None, None))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = toxicity.judged(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.judged(spark.createDataFrame(rows[:5], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r.score for r in none] == pytest.approx([0] * 5, abs=1e-9)


def test_rare_grams_count_in_large_corpora(spark):
    """What occurs once tells classes apart, however many bytes they have."""
    train = [r.id for r in spark.range(1000).where("pmod(xxhash64(id), 10) <> 0").collect()][:2]
    rows = [(i, f"{'calm' if i % 2 else 'vile'} words here " * 2500, "ab"[i % 2], None, None) for i in range(1000, 1400)]
    for i, rare in zip(train, ("jkvpgf", "qwzxvy")):
        rows.append((i, rare, "ab"[i != train[0]], None, None))
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(r[0], 1, int(r[2] == "a")) for r in rows], "doc_id long, quality int, toxic int")
    ask = spark.createDataFrame([(1, "jkvpgf"), (2, "qwzxvy")], "doc_id long, text string")
    lang = {r.doc_id: (r.lang_pred, r.score > 0.99) for r in langid.identify(ask, langid.train(docs)).collect()}
    assert lang == {1: ("a", True), 2: ("b", True)}
    score = {r.doc_id: r.score for r in toxicity.score(ask, toxicity.train(docs, labels)).collect()}
    assert score[1] > score[2] + 1e-6


def test_mixing(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD!! JUNK!! ") * 20, "en", None, None) for i in range(80)] + [(200 + i, t, None, None, None) for i, t in enumerate(ODD[:7])]
    labels = spark.createDataFrame([(i, "high" if i % 2 else "low") for i in range(40)], "doc_id long, domain string")
    got = mixing.mixed(spark.createDataFrame(rows, DOC), labels, {"high": 0.8, "low": 0.2}).collect()
    total = sum(r.n_words for r in got)
    share = np.array([np.array(r.posteriors) * r.rate * r.n_words for r in got]).sum(axis=0) / total
    assert share == pytest.approx([0.8, 0.2], abs=0.01) and all(r.rate >= 0 for r in got)


def test_url_filter(spark):
    urls = ["http://a.Example.NET/en/x?q", "https://b.net", "https://b.net/", "x://example.com/de/1", "x://notexample.com/de/1", "x://q.org/fr/", None, "nothing", "://h/p#f"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(100 + i, f"http://s.com/{'spam' if i % 3 else 'ok'}/{i}", None) for i in range(90)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 0 if i % 3 else 1, 0) for i in range(60)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judged(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [("a.example.net", "/en/x", "example.net/en/"), ("b.net", "", None), ("b.net", "/", "net/"), ("example.com", "/de/1", "example.com/de/"), ("notexample.com", "/de/1", None), ("q.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("h", "/p", None)]
    assert all(got[100 + i].verdict == ("block" if i % 3 else "allow") for i in range(90))


def test_url_filter_deep_and_hot(spark):
    """Branches part at any depth, and however small their share of the host is."""
    urls = [f"http://deep.com/a/b/c/d/e/f/{'bad' if i % 2 else 'fine'}/{i}" for i in range(80)]
    urls += [f"http://hot.com/{'rare' if i % 200 == 0 else 'main'}/{i}" for i in range(8000)]
    good = [1 - i % 2 for i in range(80)] + [int(i % 200 > 0) for i in range(8000)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    assert got == {i: "allow" if g else "block" for i, g in enumerate(good)}


def test_chat(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c if t > 1 else 'all'} \\l <s> </s>[INST]\n") for c in range(40) for t in range(4)]
    rows += [(50, 0, None, None), (51, None, "a\nb", "<|end|>"), (51, None, "a\nb", "<|end|>"), (None, 0, "user", "x")]
    packs = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_chats(packs).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert got[c].loss == [x for _, r, x in mine if r == "assistant"]
    assert sum(len(p.text) for p in packs.collect()) < sum(r.formatted_chars for r in got.values())
    digest = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "</s>[INST] ok [/INST]"
    assert digest[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
