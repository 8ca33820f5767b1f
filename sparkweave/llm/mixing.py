"""Mixing documents to target weights of domains by soft membership.

A softmax classifier over hashed byte-pair frequencies, fitted on a bounded sample of a labelled
table (``sample`` rows), predicts for each document its posteriors of the domains. Rates r >= 0
per document then minimise |sum r t p - b|^2, where t are the document's words, p its posteriors
and b the targets times the words to be had: projected gradient descent from r = 1, in the metric
that weighs a document by its words, the gradient scaled by the posteriors' second moments. Every step is one distributed sum
of as many numbers as there are domains; the rates themselves never leave the tasks, as they
follow from a document's posteriors and the steps so far. Of each document, floor(rate + u) copies
are drawn, u a hash of its id and text.

Null and empty texts have no words; they get the rate that follows from their posteriors. Repeated
rows are rows of their own. Without labelled rows of at least one domain, posteriors are the targets.
An empty table gives an empty one. Columns named n_words, posteriors, rate or copies are replaced.
Where the targets can't be met within the tolerance, a warning says how far the mixture stays from them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SPACE, appended, stored, tidy

CELLS = 512
_PAIR = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, square roots of the shares of its byte pairs in CELLS cells)."""
    n, of = len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(off))
    begin = ~WORD_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    begin[1:] &= WORD_SPACE[data[:-1]] | first[1:-1]
    words = np.bincount(of[begin], minlength=n)
    inside = ~first[1:-1] if len(data) else np.zeros(0, bool)
    pair = _PAIR[(data[:-1].astype(np.int64) << 8 | data[1:])[inside]] if len(data) else np.zeros(0, np.int64)
    x = np.bincount(of[1:][inside] * CELLS + pair, minlength=n * CELLS).reshape(n, CELLS) if len(data) else np.zeros((n, CELLS))
    return words, np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


class DomainModel:
    def __init__(self, domains: list[str], prior: np.ndarray, x: np.ndarray, y: np.ndarray):
        """x: features; y: numbers of the domains. Softmax regression by gradient steps with momentum."""
        k = len(domains)
        self.domains, self.prior, self.mean = domains, prior, x.mean(axis=0) if len(x) else np.zeros(CELLS)
        self.w, self.bias = np.zeros((CELLS, k)), np.log(np.maximum(prior, 1e-9))
        if not len(x):
            return
        self.bias = np.log((np.bincount(y, minlength=k) + 1) / (len(y) + k))
        z, hot, speed = x - self.mean, np.eye(k)[y], np.zeros((CELLS, k))
        push = np.zeros(k)
        rate = 1 / (0.5 * max(np.linalg.norm(z.T @ z / len(z), 2), 1e-6) + 1e-3)
        for _ in range(300):
            p = self._softmax(z)
            speed = 0.9 * speed - rate * 0.5 * (z.T @ (p - hot) / len(z) + 1e-4 * self.w)
            push = 0.9 * push - 0.5 * (p - hot).mean(axis=0)
            self.w, self.bias = self.w + speed, self.bias + push

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.w + self.bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x - self.mean)


def fit_domains(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", doc_id: str = "doc_id", domain: str = "domain", sample: int = 10_000) -> DomainModel:
    """labels: doc_id and domain; rows whose domain isn't among ``targets`` are left out."""
    names = sorted(targets)
    prior = np.array([targets[x] for x in names], float)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain")).dropna().where(F.col("domain").isin(names))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # an id may be on many rows, so these are limited, too, once they are of fixed size
    seen = own.join(F.broadcast(known), "doc_id").select("domain", "text", F.xxhash64("doc_id", "text").alias("lot"))
    seen = appended(seen, "text", [T.StructField("x", T.BinaryType())], lambda data, off: [[r.tobytes() for r in features(data, off)[1].astype(np.float32)]]).select("domain", "x", "lot").orderBy("lot", "domain").limit(sample).toPandas()
    x = np.frombuffer(b"".join(seen["x"]), np.float32).reshape(len(seen), CELLS).astype(float)
    y = seen["domain"].map({d: i for i, d in enumerate(names)}).to_numpy(np.int64)
    return DomainModel(names, prior / prior.sum(), x, y)


def with_posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with n_words and posteriors (in the order of the model's domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(data: np.ndarray, off: np.ndarray):
        words, x = features(data, off)
        return [words, list(shared.value.posteriors(x))]

    return appended(docs, text, [T.StructField("n_words", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))], make)


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps, from 1."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def _posteriors(b: pa.RecordBatch, at: int, k: int) -> np.ndarray:
    return b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(b) else np.zeros((0, k))


def fit_rates(scored: DataFrame, model: DomainModel, total: float | None = None, rounds: int = 30, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The steps that bring expected words per domain to the targets; ``scored``: n_words and posteriors.

    The gradient is scaled by the second moments of the posteriors over documents with a rate above
    0, which come with the same sums; a step that doesn't lessen the distance is halved.
    """
    k = len(model.domains)
    names = [f"s{i}" for i in range(k + k * k)]

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, t = _posteriors(b, 1, k), b.column(0).to_numpy()
                r = rates_of(p, steps)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*((t * r) @ p), *((p * (t * (r > 0))[:, None]).T @ p).ravel())], names=names)

        got = scored.select("n_words", "posteriors").mapInArrow(tidy(run), ", ".join(f"{x} double" for x in names))
        x = np.array([x or 0.0 for x in got.agg(*(F.sum(n) for n in names)).first()], float)
        return x[:k], x[k:].reshape(k, k)

    now, moments = sums([])
    whole = now.sum()
    if not whole:
        return []
    goal = model.prior * (whole if total is None else total)
    steps, size = [], 1.0
    for _ in range(rounds):
        g = (now - goal) / whole
        if np.abs(g).max() < tolerance:
            break
        step = size * np.linalg.solve(moments / whole + 1e-6 * np.eye(k), g)
        then, moved = sums([*steps, step])
        if np.linalg.norm(then - goal) < np.linalg.norm(now - goal):
            steps, now, moments, size = [*steps, step], then, moved, min(1.0, 2 * size)
        else:
            size /= 2
    missed = float(np.abs(now - goal).max() / whole)
    if missed >= tolerance:
        warnings.warn(f"the mixture stays {missed:.2g} of all words from its targets", stacklevel=2)
    return steps


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", total: float | None = None) -> DataFrame:
    """``docs`` with n_words, posteriors, rate and copies."""
    spark = docs.sparkSession
    model = fit_domains(docs, labels, targets, text)
    scored = with_posteriors(docs.drop("rate", "copies"), model, text)
    small = stored(with_posteriors(docs.select(F.col(text).cast("string").alias("text")), model).select("n_words", "posteriors"), "posteriors")
    steps = spark.sparkContext.broadcast(fit_rates(small, model, total))
    k, at = len(model.domains), scored.columns.index("posteriors")
    schema = T.StructType([*scored.schema.fields, T.StructField("rate", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(rates_of(_posteriors(b, at, k), steps.value), 6))], names=names)

    u = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) / float(1 << 30)
    return scored.mapInArrow(tidy(run), schema).withColumn("copies", F.floor(F.col("rate") + u).cast("long"))


def domains_of(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: toxic, else high or low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))
