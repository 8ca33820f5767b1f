"""Language identification by prediction by partial matching over bytes.

For each language, a tree of byte contexts of 0 to 3 bytes with the counts of the bytes that
follow. A byte that a context has seen costs -log2 n/(N+T); one that it hasn't costs the escape,
-log2 (T+ended)/(N+T), and its cost in the context shorter by one byte, at last 8 bits. With
frozen counts, a text's code length is the sum of its bytes' costs; the language with the
shortest code wins (ties: the least name), and its posterior under equal priors is the score.

All training texts are counted by Spark and the trees keep every gram. Their size is counted: up to
``LOCAL`` costs, workers get the trees whole; larger trees stay tables, the distinct grams of the
texts to judge are joined to them, order by order, and texts meet their costs block by block. Both
ways give the same results.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing was
learned. Rows are judged one by one, so ties and repeated rows are no special case; training rows
with null text or language are left out. Long texts are worked on in windows. An empty table gives
an empty one. Columns named like the new ones (lang_pred, score, bits, odd) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answered, blocked, wanted
from .common import appended, batch, crc_mod, steps, stored, tidy, windows
from .ngrams import Counter, Index, codes, counted, text_sums

ORDER = 3
UNKNOWN = "und"
#: Costs (grams times languages) that a worker may hold.
LOCAL = 16_000_000
_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return codes(data, off, ORDER + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, Counter] = {}
    for b in batches:
        named = b.column(1).dictionary_encode()
        names, number = named.dictionary.to_pylist(), named.indices.to_numpy()
        for at, to, step, cut in steps(b.column(0)):
            for data, off, first, end in windows(step, cut, ORDER):
                g = _grams(data, off)[first:end]
                of = np.repeat(number[at:to], np.diff(off))[first:end]
                for i, name in enumerate(names):
                    sums.setdefault(name, Counter()).add(*counted(g[of == i]))
    for name, c in sums.items():
        gram, n = c.total()
        for i in range(0, len(gram), 100_000):
            part = gram[i : i + 100_000]
            yield batch(_COUNTS, [name] * len(part), part.astype(np.int64), n[i : i + 100_000])


def _shorter(gram: str, k: int) -> Column:
    """The last k bytes of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * k) - 1))


def _by_language(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang", "bits"))).alias(name))


class Trees:
    """The trees of all languages as arrays: for each order the grams with their costs, and the contexts with their escapes."""

    def __init__(self, size: int, seen: pa.Table, escapes: pa.Table):
        """seen, escapes: k, gram or context, number of the language, bits."""
        self.size, self.grams, self.costs, self.contexts, self.escapes = size, [], [], [], []
        for k in range(int(max(seen["k"].to_numpy(), default=-1)) + 1):
            contexts, escape = self._matrix(escapes, k, 0.0)
            self.contexts.append(Index(contexts))
            self.escapes.append(escape)
            grams, cost = self._matrix(seen, k, np.nan)
            unseen = np.isnan(cost)
            cost[unseen] = self._below(grams, k)[unseen]
            self.grams.append(Index(grams))
            self.costs.append(cost)

    def _matrix(self, rows: pa.Table, k: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
        own = rows.filter(pa.compute.equal(rows["k"], k))
        key, at = np.unique(own[1].to_numpy().astype(np.uint32), return_inverse=True)
        out = np.full((len(key), self.size), empty, np.float32)
        out[at, own["lang"].to_numpy()] = own["bits"].to_numpy()
        return key, out

    def _below(self, grams: np.ndarray, k: int) -> np.ndarray:
        """The escape and the costs in the context shorter by one byte."""
        if k:
            out = self.of(grams & np.uint32((1 << 8 * k) - 1), k - 1)
        else:
            out = np.full((len(grams), self.size), 8.0, np.float32)
        at = self.contexts[k].find(grams >> np.uint32(8))
        out[at >= 0] += self.escapes[k][at[at >= 0]]
        return out

    def of(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of the last of k+1 bytes under each language."""
        if k >= len(self.grams):  # no training text is so long
            return self.of(grams & np.uint32((1 << 8 * k) - 1), k - 1)
        at = self.grams[k].find(grams)
        out = self.costs[k][at] if len(self.costs[k]) else np.zeros((len(grams), self.size), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._below(grams[miss], k)
        return out


class LanguageModel:
    """The languages, and the costs by (lang, k, gram) and escapes by (lang, k, context) in bits; ``trees`` if workers may hold them."""

    def __init__(self, langs: list[str], seen: DataFrame | None = None, escapes: DataFrame | None = None, local: int = LOCAL):
        self.langs, self.seen, self.escapes, self.trees = langs, seen, escapes, None
        if langs:
            grams = seen.select("k", "gram").distinct().count() + escapes.select("k", "context").distinct().count()
            if grams * len(langs) <= local:
                self.trees = self._arrays(ORDER)
            pairs = (self.trees or self._arrays(1)).of
            # at most 65,536 pairs: what the byte before tells about a byte, less what is known without it
            every = np.arange(1 << 16, dtype=np.uint32)
            self.told = pairs(every, 1) - pairs(every & np.uint32(255), 0)

    def _arrays(self, most: int) -> Trees:
        number = F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang")).cast("int") - 1
        tables = (t.where(F.col("k") <= most).select("k", key, number.alias("lang"), "bits").toArrow() for t, key in ((self.seen, "gram"), (self.escapes, "context")))
        return Trees(len(self.langs), *tables)

    def by_language(self) -> tuple[DataFrame, DataFrame]:
        """Costs and escapes as maps from language to bits."""
        return stored(_by_language(self.seen, ["k", "gram"], "seen"), "seen"), stored(_by_language(self.escapes, ["k", "context"], "escapes"), "escapes")

    def joined(self, grams: DataFrame, tables: tuple[DataFrame, DataFrame], k: int = ORDER) -> DataFrame:
        """(gram, costs): bits of the last of k+1 bytes under each language, for distinct grams."""
        seen, escapes = (t.where(F.col("k") == k).drop("k") for t in tables)
        rows = grams.withColumn("context", F.shiftright("gram", 8)).join(seen, "gram", "left").join(escapes, "context", "left")
        if k:
            before = self.joined(grams.select(_shorter("gram", k).alias("gram")).distinct(), tables, k - 1)
            rows = rows.withColumn("shorter", _shorter("gram", k)).join(before.withColumnRenamed("gram", "shorter"), "shorter")
        else:
            rows = rows.withColumn("costs", F.array_repeat(F.lit(8.0), len(self.langs)))
        own = F.zip_with(F.array(*map(F.lit, self.langs)), "costs", lambda x, short: F.coalesce(F.try_element_at("seen", x), short + F.coalesce(F.try_element_at("escapes", x), F.lit(0.0))))
        return stored(rows.select("gram", F.transform(own, lambda x: x.cast("float")).alias("costs")), "costs")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", local: int = LOCAL) -> LanguageModel:
    own = labelled.select(F.col(text).cast("string"), F.col(lang).cast("string").alias("lang")).dropna()
    top = stored(own.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in top.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([])
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _shorter("gram", k + 1).alias("gram")) for k in range(ORDER + 1))))
    orders = top.select("lang", "n", cut.alias("o")).groupBy("lang", "o.k", "o.gram").agg(F.sum("n").alias("n"))
    orders = stored(orders.withColumn("context", F.shiftright("gram", 8)), "orders")
    # what ends a text follows its context with nothing, which counts for the escape
    short = orders.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("context"), F.col("n").alias("came"))
    places = orders.groupBy("lang", "k", "context").agg(F.sum("n").alias("followed"), F.count("*").alias("kinds"))
    places = places.join(short, ["lang", "k", "context"], "left").withColumn("whole", F.greatest("followed", F.coalesce("came", F.lit(0))))
    places = stored(places.select("lang", "k", "context", "followed", "kinds", "whole"), "places")
    seen = -F.log2(F.col("n") / (F.col("whole") + F.col("kinds")))
    seen = orders.join(places, ["lang", "k", "context"]).select("lang", "k", "gram", seen.cast("float").alias("bits"))
    missed = -F.log2((F.col("kinds") + F.col("whole") - F.col("followed")) / (F.col("whole") + F.col("kinds")))
    return LanguageModel(langs, stored(seen, "seen"), places.select("lang", "k", "context", missed.cast("float").alias("bits")), local)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, bits (the code length a byte under lang_pred) and odd.

    odd: how many bits longer the text's code gets at least, over all languages, when bytes are
    coded after the byte before them and not for themselves. In texts of a language it gets much shorter.
    """
    langs, spark = model.langs, docs.sparkSession
    fields = [T.StructField(x, T.StringType() if x == "lang_pred" else T.DoubleType()) for x in ("lang_pred", "score", "bits", "odd")]
    docs = docs.drop(*(f.name for f in fields))

    def judge(data: np.ndarray, off: np.ndarray, cost, told: np.ndarray):
        bits, odd = np.zeros((2, len(off) - 1, len(langs)))
        for part, cut, first, end in windows(data, off, ORDER):
            g = _grams(part, cut)[first:end]
            own = np.clip(cut, first, end) - first
            bits += text_sums(cost(g), own)
            # the first byte of a text comes after none
            odd += text_sums(told[g & np.uint32(0xFFFF)], own)
        best, at = bits.argmin(axis=1), np.arange(len(bits))
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
        return np.array(langs, object)[best], 1 / odds.sum(axis=1), bits[at, best] / np.maximum(np.diff(off), 1), odd.min(axis=1)

    if not langs:
        out = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits": F.lit(0.0), "odd": F.lit(0.0)})
    elif model.trees:
        shared = spark.sparkContext.broadcast((model.trees, model.told))  # of checked size
        out = appended(docs, text, fields, lambda data, off: judge(data, off, shared.value[0].of, shared.value[1]))
    else:
        told, blocks = model.told, blocked(docs, text)
        grams = stored(wanted(blocks, text, _grams), "wanted")
        costs = model.joined(grams.select("gram").distinct(), model.by_language())
        answers = grams.join(costs.hint("merge"), "gram").select("_block", "gram", F.col("costs").alias("value"))
        out = answered(docs, blocks, answers, text, fields, lambda data, off, index, value: judge(data, off, lambda g: value[index.find(g)], told))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letters, F.col("score")).otherwise(0.0)})


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 3) == 1


def judged(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, then judge all."""
    model = train(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model)
