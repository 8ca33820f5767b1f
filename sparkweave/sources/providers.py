"""Models behind an interface: assessments and embeddings run in tasks, with an offline stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCKED, DOUBTFUL, REUSABLE
from .versioned import VersionedTable


class Provider(Protocol):
    def assess(self, word: str, country: str) -> str: ...

    def embed(self, text: str) -> np.ndarray: ...


class Offline:
    """Deterministic answers from hashes; no network."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def assess(self, word: str, country: str) -> str:
        return (REUSABLE, DOUBTFUL, BLOCKED)[hashlib.sha256(f"{country}:{word}".encode()).digest()[0] % 3]

    def embed(self, text: str) -> np.ndarray:
        v = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")).standard_normal(self.dim)
        return v / np.linalg.norm(v)


@dataclass(frozen=True)
class Model:
    """A model that each Python worker loads once, when its first task needs it. ``name`` stands for its weights, too."""

    name: str
    load: Callable[[], Provider]
    dim: int


#: What this worker has loaded.
_loaded: dict[str, Provider] = {}


def loaded(model: Model) -> Provider:
    if model.name not in _loaded:
        _loaded[model.name] = model.load()
    return _loaded[model.name]


def assessed(words: DataFrame, provider: Provider) -> DataFrame:
    """``words`` (word, country, verdict) with the model's verdict where rules have none; decided words never reach the model."""
    decided, open_ = words.where("verdict IS NOT NULL"), words.where("verdict IS NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(assessment=[provider.assess(w, c) for w, c in zip(p["word"], p["country"], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema) + ", assessment string"
    rule = F.when(F.col("verdict"), REUSABLE).otherwise(BLOCKED)
    return decided.withColumn("assessment", rule).unionByName(open_.mapInPandas(run, schema))


def embedded(texts: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """``texts`` with a vector of norm 1; blank texts get null."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(vector=[provider.embed(t).tolist() if isinstance(t, str) and t.strip() else None for t in p[text]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", vector array<double>"
    return texts.mapInPandas(run, schema)


VECTORS = "text_key string, model string, vector array<float>, made long"


def vector_table(spark, folder: str, parts: int = 32) -> VersionedTable:
    """Where vectors are kept by the content of their texts."""
    return VersionedTable(spark, folder, "text_key", VECTORS, parts)


def _key(model: Model, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model.name}\x00"), text), 256)


def embed_new(texts: DataFrame, model: Model, kept: VersionedTable, text: str = "text") -> int:
    """Embeds each distinct text that ``kept`` has no vector of and puts the vectors there; the version after.

    A vector of another dimension than the model's, or with a component that is not finite, fails the job; others are scaled to norm 1.
    """
    distinct = texts.select(F.col(text).alias("t")).where(F.trim("t") != "").distinct().withColumn("text_key", _key(model, F.col("t")))
    new = distinct.join(kept.read().select("text_key"), "text_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors = []
            for t in p["t"]:
                v = np.asarray(loaded(model).embed(t), np.float64)
                n = np.linalg.norm(v)
                if v.shape != (model.dim,) or not np.isfinite(n) or n == 0:
                    raise ValueError(f"{model.name} gave a vector of shape {v.shape} and norm {n}")
                vectors.append((v / n).astype(np.float32).tolist())
            yield pd.DataFrame({"text_key": p["text_key"], "model": model.name, "vector": vectors, "made": 0})

    return kept.upsert(new.mapInPandas(run, VECTORS), "made")


def embed_through(texts: DataFrame, model: Model, kept: VersionedTable, text: str = "text") -> DataFrame:
    """``texts`` with their vector, from ``kept`` after ``embed_new``; blank texts get null."""
    embed_new(texts, model, kept, text)
    keyed = texts.withColumn("text_key", F.when(F.trim(F.col(text)) != "", _key(model, F.col(text))))
    return keyed.join(kept.read().select("text_key", "vector"), "text_key", "left").drop("text_key")


ANSWERS = "answer_key string, model string, word_sha256 string, said string, made long"


def answer_table(spark, folder: str, parts: int = 32) -> VersionedTable:
    """Where a model's assessments are kept by word and country: the record of what it was asked, too."""
    return VersionedTable(spark, folder, "answer_key", ANSWERS, parts)


def assess_through(words: DataFrame, model: Model, kept: VersionedTable) -> DataFrame:
    """``words`` (word, country, verdict, ...) with said_verdict: what the model says of those that the rules leave open.

    Each distinct open (word, country) that ``kept`` has no answer to is asked once, and its answer put there; a second run
    asks only what is new. Decided words never reach the model, nor do null ones: they have no answer. An
    answer that isn't text is none, and is asked for again.
    """
    key = F.sha2(F.concat_ws("\x00", F.lit(model.name), "country", "word"), 256)
    open_ = F.col("verdict").isNull() & F.col("word").isNotNull() & F.col("country").isNotNull()
    keyed = words.drop("said_verdict").withColumn("answer_key", F.when(open_, key))
    new = keyed.where("answer_key IS NOT NULL").select("answer_key", "word", "country").distinct().join(kept.read().select("answer_key"), "answer_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            said = [loaded(model).assess(w, c) for w, c in zip(p["word"], p["country"], strict=True)]
            hashes = [hashlib.sha256(w.encode()).hexdigest() for w in p["word"]]
            yield pd.DataFrame({"answer_key": p["answer_key"], "model": model.name, "word_sha256": hashes, "said": [s if isinstance(s, str) else None for s in said], "made": 0})

    kept.upsert(new.mapInPandas(run, ANSWERS).where("said IS NOT NULL"), "made")
    answers = kept.read().select("answer_key", F.col("said").alias("said_verdict"))
    return keyed.join(answers, "answer_key", "left").drop("answer_key")
