"""Toxicity by class-conditional Kneser-Ney models over byte n-grams.

Two models, of toxic and of ordinary texts, give the probability of each byte after the four
bytes before it (A-Z lower-cased). Each is discounted on its own counts and backs off to one
shared Kneser-Ney model, whose lower orders are continuation counts of both classes together; so
expressions that either class has rarely or never seen weigh little, and where neither class has
seen the context the two agree. A text's log-likelihoods are compared per byte: over the whole
text, and over the stretch of ``WINDOW`` bytes where they differ most, which keeps a few toxic
expressions visible in a long text. A logistic curve, fitted on labelled rows that the counts
left out, turns the two differences into a score.

Counts cover all labelled rows of the training part but the tenth kept for the curve (of which at
most ``calibration`` rows are used: a bounded sample; where the tenth lacks a class that the labels
have, all training rows may be drawn). All grams are kept: discounts, totals and continuation counts
are aggregated by Spark. The table's size is counted: up to ``LOCAL`` grams, workers get it whole;
a larger one stays distributed and texts are joined to it block by block. Both ways give the same scores.

Null and empty texts score as a text without evidence. Labels that are null or of a null doc_id
are ignored; a doc_id that is labelled more than once counts as toxic if any of its labels says
so. Without labels of both classes every score is the share of toxic labels (0 without labels).
Rows are scored one by one, so ties and repeated rows are no special case; long texts are worked on
in windows; an empty table gives an empty one. Columns named score, predicted, whole, window or
size are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answered, blocked, wanted
from .common import appended, batch, crc_mod, steps, stored, tidy, windows
from .ngrams import Counter, Index, codes, counted, text_sums

ORDER = 5
WINDOW = 40
#: Grams that a worker may hold.
LOCAL = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = pa.schema([("toxic", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
_FEATURES = ("whole", "window", "size")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = (Counter(), Counter())
    for b in batches:
        toxic = b.column(1).to_numpy()
        for at, to, step, cut in steps(b.column(0)):
            for data, off, first, end in windows(step, cut, ORDER - 1):
                g = _grams(data, off)[first:end]
                of = np.repeat(toxic[at:to], np.diff(off))[first:end]
                for c in (0, 1):
                    sums[c].add(*counted(g[of == c]))
    for c in (0, 1):
        gram, n = sums[c].total()
        for i in range(0, len(gram), 100_000):
            part = gram[i : i + 100_000]
            yield batch(_COUNTS, np.full(len(part), c), part.astype(np.int64), n[i : i + 100_000])


def _discount(rows: DataFrame, n: str) -> float:
    one, two = rows.agg(F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)).first()
    return min(one / (one + 2 * two), 0.95) if one and two else 0.75


def _context(gram: str = "gram") -> Column:
    return F.shiftright(gram, 8)


def _shared(grams: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probabilities of the grams' last bytes: counts at the top, continuation counts below."""
    levels = [grams.select("gram", (F.col("t") + F.col("o")).alias("n"))]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram"))
        levels.append(stored(shorter.groupBy("gram").agg(F.count("*").alias("n")), "level"))
    p = None
    for k, rows in enumerate(reversed(levels)):  # grams of k+1 bytes
        d = _discount(rows, "n")
        contexts = rows.groupBy(_context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = rows.withColumn("context", _context()).join(contexts, "context")
        base = F.lit(1 / 256)
        if k:
            rows, base = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(p, "shorter"), F.col("p")
        rows = rows.select("gram", ((F.col("n") - d) / F.col("total") + d * F.col("kinds") / F.col("total") * base).alias("p"))
        p = stored(rows, "level").withColumnRenamed("gram", "shorter")
    return p.withColumnRenamed("shorter", "gram")


def _ratios(grams: DataFrame) -> DataFrame:
    """(context, missed, seen): log-likelihood differences (toxic less ordinary) of each context's bytes, and of all others after it."""
    rows = grams.join(_shared(grams), "gram")
    counts = [f(x).alias(name + x) for x in "to" for name, f in (("total_", F.sum), ("kinds_", lambda x: F.count_if(F.col(x) > 0)))]
    each = F.struct(F.col("gram").bitwiseAND(F.lit(255)).alias("byte"), "t", "o", "p")
    rows = rows.groupBy(_context().alias("context")).agg(*counts, F.collect_list(each).alias("bytes"))  # 256 at most
    d = {x: _discount(grams, x) for x in "to"}
    left = {x: F.when(F.col("total_" + x) > 0, d[x] * F.col("kinds_" + x) / F.col("total_" + x)).otherwise(1.0) for x in "to"}

    def log_p(b: Column, x: str) -> Column:
        own = F.when(F.col("total_" + x) > 0, F.greatest(b[x] - d[x], F.lit(0.0)) / F.col("total_" + x)).otherwise(0.0)
        return F.log(own + left[x] * b["p"])

    seen = F.transform("bytes", lambda b: F.struct(b["byte"], (log_p(b, "t") - log_p(b, "o")).cast("float")))
    missed = F.log(F.greatest(left["t"], F.lit(1e-6))) - F.log(F.greatest(left["o"], F.lit(1e-6)))
    return stored(rows.select("context", missed.cast("float").alias("missed"), F.map_from_entries(seen).alias("seen")), "ratios")


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return codes(_LOWER[data], off, ORDER)


def _features(data: np.ndarray, off: np.ndarray, ratios) -> np.ndarray:
    """whole, window and size of each text; ``ratios`` gives the log-likelihood differences of grams."""
    size = np.diff(off)
    total, best = np.zeros(len(size)), np.full(len(size), -np.inf)
    for part, cut, first, end in windows(data, off, ORDER - 1, WINDOW):
        llr = ratios(_grams(part, cut))
        own = np.clip(cut, first, end)
        total += text_sums(llr[first:end], own - first)
        # the best stretch: sums over WINDOW bytes, or the whole of a shorter text
        run = np.concatenate(([0.0], np.cumsum(llr, dtype=np.float64)))
        pos = np.arange(first, end)
        stop = np.minimum(pos + WINDOW, np.repeat(cut[1:], np.diff(own)))
        some = np.diff(own) > 0
        if some.any():
            best[some] = np.maximum(best[some], np.maximum.reduceat(run[stop] - run[pos], own[:-1][some] - first) / WINDOW)
    return np.stack((total / np.maximum(size, 1), np.where(size > 0, best, 0.0), np.log1p(size)), axis=1)


class Table:
    """The log-likelihood differences of grams, and of contexts for all other bytes after them."""

    def __init__(self, ratios: DataFrame):
        gram = F.shiftleft("context", 8).bitwiseOR(F.col("byte"))
        seen = ratios.select("context", F.explode("seen").alias("byte", "llr")).select(gram.alias("gram"), "llr").toArrow()
        missed = ratios.select("context", "missed").toArrow()
        self.grams, self.llr = Index(seen["gram"].to_numpy().astype(np.uint64)), seen["llr"].to_numpy()
        self.contexts, self.missed = Index(missed["context"].to_numpy().astype(np.uint64)), missed["missed"].to_numpy()

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = self.grams.find(grams)
        out = self.llr[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            c = self.contexts.find(grams[miss] >> np.uint64(8))
            out[miss] = np.where(c >= 0, self.missed[c], np.float32(0))
        return out


class ToxicityModel:
    """The table of log-likelihood differences (None if nothing was learned), whole if workers may hold it, and the curve."""

    def __init__(self, ratios: DataFrame | None, grams: int = 0, local: int = LOCAL):
        self.ratios = ratios
        self.table = Table(ratios) if ratios is not None and grams <= local else None
        self.weights, self.mean, self.scale = np.zeros(1 + len(_FEATURES)), np.zeros(len(_FEATURES)), np.ones(len(_FEATURES))
        self.weights[0] = -np.inf

    def features(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with whole, window and size."""
        fields = [T.StructField(x, T.DoubleType()) for x in _FEATURES]
        docs = docs.drop(*_FEATURES)
        if self.ratios is None:
            return appended(docs, text, fields, lambda data, off: [np.zeros(len(off) - 1)] * len(fields))
        if self.table:
            shared = docs.sparkSession.sparkContext.broadcast(self.table)  # of checked size
            return appended(docs, text, fields, lambda data, off: list(_features(data, off, shared.value.of).T))
        blocks = blocked(docs, text)
        grams = wanted(blocks, text, _grams)
        value = F.coalesce(F.try_element_at("seen", F.col("gram").bitwiseAND(F.lit(255))), "missed")
        # the table grows with the corpus, so the join shuffles at every size
        answers = grams.withColumn("context", _context()).join(self.ratios.hint("merge"), "context").select("_block", "gram", value.alias("value"))

        def make(data: np.ndarray, off: np.ndarray, index: Index, value: np.ndarray) -> list:
            def ratios(g: np.ndarray) -> np.ndarray:
                at = index.find(g)
                return np.where(at >= 0, value[at], np.float32(0)) if len(value) else np.zeros(len(g), np.float32)

            return list(_features(data, off, ratios).T)

        return answered(docs, blocks, answers, text, fields, make)

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        share = float(y.mean()) if len(y) else 0.0
        self.weights[:] = 0
        self.weights[0] = np.log(share / (1 - share)) if 0 < share < 1 else (-np.inf if share <= 0 else np.inf)
        if not 0 < share < 1:
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))
        w = self.weights.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            grad = z.T @ (p - y) + 0.1 * w * (np.arange(len(w)) > 0)
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6] + [0.1] * (len(w) - 1))
            step = np.linalg.solve(hess, grad)
            w = w - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with score."""
        z = F.lit(float(self.weights[0]))
        if self.ratios is not None:
            for x, w, mean, scale in zip(_FEATURES, self.weights[1:], self.mean, self.scale, strict=True):
                z = z + float(w) * (F.col(x) - float(mean)) / float(scale)
        z = F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))
        return self.features(docs, text).withColumn("score", 1 / (1 + F.exp(-z))).drop(*_FEATURES)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", calibration: int = 20_000, local: int = LOCAL) -> ToxicityModel:
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    # labels grow with the corpus, so the join shuffles at every size; only training rows reach it
    counts = own.join(known.where(~aside).hint("merge"), "doc_id").select("text", "toxic").mapInArrow(tidy(_count), "toxic int, gram long, n long")
    t, o = (F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(x) for x, c in (("t", 1), ("o", 0)))
    grams = stored(counts.groupBy("gram").agg(t, o), "grams")
    size = grams.count()
    model = ToxicityModel(_ratios(grams) if size else None, size, local)
    order = (F.xxhash64("doc_id", F.lit(1)), "doc_id")
    classes = known.agg(F.min("toxic"), F.max("toxic"), F.min(F.when(aside, F.col("toxic"))), F.max(F.when(aside, F.col("toxic")))).first()
    # where the tenth lacks a class, all labelled rows stand in for it
    sample = (known.where(aside) if classes[:2] == classes[2:] else known).orderBy(*order).limit(calibration)
    held = own.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    # an id may be on many rows, so these are limited, too, once they are numbers
    seen = model.features(held, "text").select("toxic", *_FEATURES).orderBy(F.xxhash64(*_FEATURES), "toxic").limit(calibration).toPandas()
    model.fit_curve(seen[list(_FEATURES)].to_numpy(np.float64), seen["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    return model.scores(docs.drop("score"), text).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 5) == 0


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score all documents."""
    model = train(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model)
