"""Direct, slow forms of the methods as brute force; empty tables, clashing columns, repeated ids; the pipeline's stages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import chat, embed_dedup, jaccard, langid, mixing, sentencepiece_bpe, token_store, topk, toxicity, url_filter, words
from sparkweave.llm.common import STEP_BYTES

DOC = "doc_id long, text string, lang string, source string"
LABEL = "doc_id long, quality int, toxic int"


def _ppm(texts: list[bytes]):
    """Counts of what follows each context of 0 to 3 bytes (shorter ones at a text's begin count as padded with zeros)."""
    tree = defaultdict(Counter)
    for t in texts:
        padded = bytes(3) + t
        for i in range(len(t)):
            for k in range(4):
                tree[padded[i + 3 - k : i + 3]][padded[i + 3]] += 1
    return tree


def _bits(tree, text: bytes) -> float:
    total, padded = 0.0, bytes(3) + text
    for i in range(len(text)):
        for k in (3, 2, 1, 0):
            context = padded[i + 3 - k : i + 3]
            seen, byte = tree.get(context), padded[i + 3]
            if not seen:
                if not k:
                    total += 8
                continue
            followed, kinds = sum(seen.values()), len(seen)
            # how often the context itself came, also where nothing followed
            came = tree[context[:-1]][context[-1]] if k else 0
            whole = max(followed, came)
            if byte in seen:
                total -= math.log2(seen[byte] / (whole + kinds))
                break
            total -= math.log2((kinds + whole - followed) / (whole + kinds))
            if not k:
                total += 8
    return total


def test_language_code_lengths(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcab é" if i % 2 else "xyzxa é") for _ in range(rng.randint(1, 60))), "ab"[i % 2], None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    trees = {x: _ppm([t.encode() for _, t, y, _ in rows if y == x]) for x in "ab"}
    ask = [(i, t, None, None) for i, t in enumerate(["abc", "xyz é", "q", "ab" * 30, "aq bx"])]
    for local in (langid.LOCAL, 0):
        got = langid.identify(spark.createDataFrame(ask, DOC), langid.train(docs, local=local)).collect()
        for r in got:
            want = {x: _bits(trees[x], r.text.encode()) for x in "ab"}
            best = min(want, key=lambda x: (round(want[x], 6), x))
            assert r.lang_pred == best and r.bits * len(r.text.encode()) == pytest.approx(want[best], rel=1e-5)
            assert r.score == pytest.approx(1 / sum(2 ** (want[best] - w) for w in want.values()), rel=1e-4)


def _kneser_ney(toxic: list[bytes], ordinary: list[bytes]):
    """The log-likelihood difference of one byte after four others, directly from the definition."""
    n = toxicity.ORDER
    count = [Counter(), Counter()]
    for c, texts in enumerate((ordinary, toxic)):
        for t in texts:
            p = bytes(n - 1) + t
            count[c].update(p[i : i + n] for i in range(len(t)))
    levels = {n: count[0] + count[1]}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(c: Counter) -> float:
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(one / (one + 2 * two), 0.95) if one and two else 0.75

    def shared(gram: bytes) -> float:
        k = len(gram)
        if not k:
            return 1 / 256
        own = {g: v for g, v in levels[k].items() if g[:-1] == gram[:-1]}
        d, total = discount(levels[k]), sum(own.values())
        return (own[gram] - d) / total + d * len(own) / total * shared(gram[1:])

    def log_p(gram: bytes, c: Counter) -> float:
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        d, total = discount(c), sum(own.values())
        if not total:
            return math.log(shared(gram))
        return math.log(max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * shared(gram))

    return lambda gram: log_p(gram, count[1]) - log_p(gram, count[0]), levels[n]


def test_toxicity_likelihoods(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abca " if i % 3 else "abxx ") for _ in range(rng.randint(5, 40))), "en", None) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], LABEL)
    kept = {r.id for r in spark.range(60).where("pmod(xxhash64(id), 10) <> 0").collect()}
    ratio, seen = _kneser_ney([t.encode() for i, t, *_ in rows if i % 3 == 0 and i in kept], [t.encode() for i, t, *_ in rows if i % 3 and i in kept])
    for local in (toxicity.LOCAL, 0):
        model = toxicity.train(docs, labels, local=local)
        for r in model.features(docs.where("doc_id IN (0, 1, 2, 3)"), "text").collect():
            p = bytes(4) + r.text.encode()
            grams = [p[i : i + 5] for i in range(len(r.text))]
            if all(g in seen for g in grams):  # what no class has seen after a context is one value for all such bytes
                assert r.whole == pytest.approx(sum(map(ratio, grams)) / len(grams), abs=1e-4)


def test_toxicity_curve_needs_no_luck(spark):
    """Where the rows kept for the curve lack a class, the labels' others stand in."""
    aside = {r.id for r in spark.range(400).where("pmod(xxhash64(id), 10) = 0").collect()}
    vile = [i for i in range(400) if i not in aside][:40]
    rows = [(i, ("zzqx " if i in vile else "calm ") * 8 + f"word{i}", "en", None) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i in vile)) for i in range(400)], LABEL)
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert min(got[i] for i in vile) > 0.5 > max(s for i, s in got.items() if i not in vile)


def test_long_texts_in_windows(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc é") for _ in range(3000)), "ab"[i % 2], None) for i in range(4)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, 1, i % 2) for i in range(4)], LABEL)
    lang, tox = langid.train(docs), toxicity.train(docs, labels)
    data = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
    one = np.array([0, len(data)])
    whole = toxicity._features(data, one, tox.table.of)
    from sparkweave.llm import common

    cut = lambda d, o, b, a=0, limit=1000: common.windows(d, o, b, a, 1000)
    monkeypatch.setattr(toxicity, "windows", cut)
    assert toxicity._features(data, one, tox.table.of) == pytest.approx(whole, rel=1e-9)
    own = [np.concatenate([langid._grams(p, o)[a:b] for p, o, a, b in common.windows(data, one, langid.ORDER, 0, 1000)]), langid._grams(data, one)]
    assert (own[0] == own[1]).all() and lang.trees.of(own[0]).shape == (len(data), 2) and STEP_BYTES > 1000


def test_mixing_against_least_squares(spark):
    """On a table so small that the dense problem can be solved directly, the distance from the targets is the same."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good words here", "BAD!! JUNK!!", "mid way"]) for _ in range(rng.randint(1, 30))), "en", None) for i in range(60)]
    labels = spark.createDataFrame([(i, "high" if "good" in rows[i][1] else "low") for i in range(60)], "doc_id long, domain string")
    got = mixing.mixed(spark.createDataFrame(rows, DOC), labels, {"high": 0.7, "low": 0.3}).collect()
    a = np.array([np.array(r.posteriors) * r.n_words for r in got]).T
    goal = np.array([0.7, 0.3]) * sum(r.n_words for r in got)
    r = np.ones(a.shape[1])
    for _ in range(20_000):  # plain projected gradient, all in one place
        r = np.maximum(0, r - (a.T @ (a @ r - goal)) / np.linalg.norm(a, 2) ** 2)
    direct, ours = (np.linalg.norm(a @ x - goal) / goal.sum() for x in (r, np.array([x.rate for x in got])))
    assert ours <= direct + 2e-4 and min(x.rate for x in got) >= 0


def _tree_verdicts(urls: list[tuple[str, list[str], int | None]]) -> list[str]:
    """The template tree by recursion over lists."""
    labels = [g for *_, g in urls if g is not None]
    prior = sum(labels) / len(labels) if labels else 1.0
    out = [""] * len(urls)

    def walk(rows: list[int], depth: int) -> None:
        if all(len(urls[i][1]) <= depth for i in rows):
            g = [urls[i][2] for i in rows if urls[i][2] is not None]
            purity = (sum(g) + url_filter.WEIGHT * prior) / (len(g) + url_filter.WEIGHT)
            for i in rows:
                out[i] = "block" if purity < url_filter.LEAST else "allow"
            return
        by, all_ = defaultdict(list), [urls[i][2] for i in rows if urls[i][2] is not None]
        for i in rows:
            by[urls[i][1][depth] if len(urls[i][1]) > depth else ""].append(i)
        mean, merged = sum(all_) / max(len(all_), 1), defaultdict(list)
        for seg, own in by.items():
            g = [urls[i][2] for i in own if urls[i][2] is not None]
            chance = math.sqrt(max(mean * (1 - mean), 1e-4) / max(len(g), 1))
            apart = len(g) >= url_filter.LABELS and abs(sum(g) / max(len(g), 1) - mean) > 2 * chance
            merged[seg if seg == "" or apart else "*"] += own
        for own in merged.values():
            walk(own, depth + 1)

    for host in {h for h, *_ in urls}:
        walk([i for i, (h, *_) in enumerate(urls) if h == host], 0)
    return out


def test_url_trees_by_recursion(spark):
    rng = random.Random(4)
    urls, good = [], []
    for _ in range(600):
        path = [rng.choice(["a", "b", "news", "x"]) for _ in range(rng.randint(0, 5))]
        urls.append(f"http://{rng.choice(['h.com', 'k.com'])}/" + "/".join(path))
        good.append(None if rng.random() < 0.3 else int(rng.random() < (0.1 if path[:1] == ["x"] or "b" in path[2:] else 0.9)))
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if g is not None], LABEL)
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, labels).collect()}
    want = _tree_verdicts([(u.split("/")[2], [x for x in u.split("/")[3:] if x], g) for u, g in zip(urls, good)])
    assert [got[i] for i in range(len(urls))] == want and {"block", "allow"} == set(want)


def test_top_k_repeated_ids_and_large_numbers(spark):
    rows = [(0, [10, 10, i % 3]) for i in range(60)] + [(i, [i % 7, -i % 5, 1]) for i in range(1, 60)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<long>"), 20, is_query=F.col("id") == 0).where("query_id = 0").collect()
    assert len(got) == 20 and 0 not in {r.id for r in got}
    big = [(i, [2**30 + i, 1]) for i in range(8)]
    one = topk.top_k(spark.createDataFrame(big, "id long, vector array<long>"), 3, is_query=F.col("id") == 0).orderBy("rank").collect()
    assert [(r.id, r.score) for r in one] == [(i, 2**30 * (2**30 + i) + 1) for i in (7, 6, 5)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [2**33])], "id long, vector array<long>"), 3)


def test_embedding_rare_links_in_a_grid(spark, monkeypatch):
    """The exact way, with cells ruled out by the triangle inequality."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((6, 16))
    v = centers[rng.integers(0, 6, 800)] + 0.45 * rng.standard_normal((800, 16))
    v = np.concatenate((v, v[:8] + 0.2 * rng.standard_normal((8, 16)) / np.sqrt(2))).astype(np.float32)
    monkeypatch.setattr(embed_dedup, "ENOUGH", 10**6)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    u = embed_dedup.unit(v)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit.any() and [got[i] for i in range(len(v))] == hit.sum(axis=1).tolist()


def test_lookup_of_wide_ids(spark, tmp_path):
    import public_tokenizers

    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "store")
    rng = random.Random(7)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(200)]
    docs = spark.createDataFrame([(d, f"text {i}", None, None) for i, d in enumerate(ids)], DOC)
    token_store.write_store(docs, path, out)
    asked = spark.createDataFrame([(d,) for d in ids[:50]] + [(1,), (None,), (2**62,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_store.lookup(spark, out, asked).collect()}
    lib = token_store.encoder(path).tokenizer
    assert found == {d: [*lib.encode(f"text {i}", add_special_tokens=False).ids, 0] for i, d in enumerate(ids[:50])}


def test_pieces_equal_the_library():
    import public_tokenizers

    e = token_store.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdeé \n\t的  🙂''.,01sllre　\x1c\x85“\r") for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a<|endoftext|> b", "x" * 9000]
    raw = [t.encode() for t in texts]
    ids, off = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_store_survives_equal_hashes(monkeypatch):
    """Different words of one hash are told apart by the second one."""
    real = words.hashes
    monkeypatch.setattr(words, "hashes", lambda d, s, n: (real(d, s, n)[0] % np.uint64(3), real(d, s, n)[1]))
    store = words.WordIds(lambda ws: (np.array([x for w in ws for x in w], np.int32), np.array([len(w) for w in ws])))
    raw = b"abc" + b"de" + b"f" + b"abc" + b"xyz" * 200
    cut = np.array([0, 3, 5, 6, 9, len(raw)])
    for _ in range(2):
        ids, n = store.ids(np.frombuffer(raw, np.uint8), cut[:-1], cut[1:])
        assert bytes(ids.astype(np.uint8)) == raw and n.tolist() == [3, 2, 1, 3, 600]


def test_empty_tables_and_clashes(spark):
    import public_tokenizers

    piece = public_tokenizers.path("piece_bpe_32k.model")
    names = "ids, decoded, score, predicted, lang_pred, bits, odd, whole, window, size, n_words, posteriors, rate, copies, component_id, g, f1, block, cells, x"
    clash = [F.lit("own").alias(n) for n in names.split(", ")]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], LABEL)
    some = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(["one two three", "four five six", None, ""])], DOC).select("*", *clash)
    for docs in (some, some.limit(0)):
        n = docs.count()
        assert langid.identify(docs, langid.train(docs)).count() == n
        assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
        assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, piece), piece).select("ids", "decoded").count() == n
        assert mixing.mixed(docs, mixing.domains_of(labels), {"high": 1.0}).select("rate", "copies").count() == n
        assert jaccard.jaccard_join(docs)[0].count() == n
        assert token_store.store_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n
        v = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), *clash)
        assert embed_dedup.near_duplicates(v).count() == n
        assert topk.integer_search(v).count() == (3 if n else 0)
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), *clash, F.lit("own").alias("template"), F.lit(1).alias("segs"))
        assert url_filter.judged(pages, labels).count() == n
        turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *clash, F.lit(1).alias("added"), F.lit(2).alias("alone"), F.lit(3).alias("order"))
        assert chat.chat_digests(turns).count() == n + 1


def test_chats_without_a_number(spark):
    rows = [(None, i, "assistant", f"t{i}") for i in range(5)] + [(-1, 0, "assistant", "mine")]
    got = chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(-1, 1), (-1, 2)] + [(0, 1)] * 5


def test_near_duplicate_classes_of_one_id(spark):
    t = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    docs = spark.createDataFrame([(1, t[0]), (1, t[1]), (2, t[1]), (3, t[2])], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_join(docs)[0].collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 3): 1}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(0, 90)], LABEL).write.parquet(f"{folder}/labels.parquet")
    return folder


def _corpus(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randint(3, 60)) + (" zzqxvile kjzzqx" if i % 9 == 0 else "") for i in range(90)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(200, texts[1], "en", "s"), (1, "other text of the same number " + say(30), None, None), (1, texts[1], "en", "s"), (None, texts[1], None, None)]
    rows += [(300, None, "en", None), (301, "", "en", None), (302, "12 34", "en", None), (303, "".join(rng.choice("bcdfgjkmpqvwxyz") for _ in range(300)), None, None), (304, "и слова и буквы " * 9, None, None)]
    names = [F.lit(x).alias(x) for x in ("score", "lang_pred", "copies", "rate", "n_words", "odd", "row_", "copy_", "f1")]
    return spark.createDataFrame(rows, DOC).select("*", *names)


def test_pipeline_stages(spark, small):
    docs = _corpus(spark)
    stages, at = dict(corpus_pipeline.STAGES), docs
    assert list(stages) == ["language_id", "toxicity", "near_duplicates", "mixing", "sentencepiece"]
    seen = {}
    for name in list(stages)[:-1]:
        seen[name] = at = spark.createDataFrame(stages[name](spark, at, small).collect(), docs.schema)
        assert at.columns == docs.columns and all(r.score == "score" and r.copies == "copies" and r.row_ == "row_" for r in at.collect())
    ids = {k: sorted((r.doc_id if r.doc_id is not None else -1) for r in v.collect()) for k, v in seen.items()}
    assert ids["language_id"] == sorted([*range(90), 200, 1, 1, -1])  # no text, no letter, letters at random, other letters
    assert not {i for i in range(0, 90, 9)} & set(ids["toxicity"]) and set(range(90)) - {i for i in range(0, 90, 9)} <= set(ids["toxicity"])
    kept = ids["near_duplicates"]
    assert 200 not in kept and -1 not in kept and kept.count(1) == 2
    last = stages["sentencepiece"](spark, at, small)
    assert last.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and last.count() == at.count()
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_pipeline_keeps_the_least(spark, small):
    t = [" ".join(f"{p}{i}" for i in range(40)) for p in "ab"]
    docs = spark.createDataFrame([(5, t[0], "en", "x"), (3, t[0], "en", "y"), (None, t[0], "en", "z"), (3, t[1], "en", "w"), (3, t[1], "en", "w"), (8, None, None, None), (9, "", None, None)], DOC)
    got = sorted((r.doc_id, r.source or "") for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    assert got == [(3, "w"), (3, "y"), (8, ""), (9, "")]
