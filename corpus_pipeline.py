"""From raw documents to token ids: language, toxicity, near duplicates, mixture, encoding.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet into
the shared folder and reads it for the next one.

In every stage nulls, empty and very long texts are ordinary input, an empty table gives an empty
one, repeated rows and doc_ids are rows of their own, and columns that bear names the operators use
stay what they were: they are put aside under other names and come back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import jaccard, langid, mixing, sentencepiece_bpe, toxicity
from sparkweave.llm.common import read, stored

#: Shares of words that the mixture aims at.
TARGETS = {"high": 0.9, "low": 0.1}


#: Rows of an Arrow batch: whole texts are long, and ten thousand of them at once fill buffers of JVM and workers that stay large.
BATCH_ROWS = 1000
#: A text isn't of a learned language if coding its bytes after each other takes so many bits more, in all and a byte.
ODD_BITS, ODD_SHARE = 40.0, 0.5


def _small_batches(stage: Callable) -> Callable:
    """A stage whose session sends texts to Python workers in batches of ``BATCH_ROWS`` rows at most, from then on."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        spark.conf.set(key, str(BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS)))
        return stage(spark, docs, sf_dir)

    return run


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but those used under names of their own, and what gives a result the columns of ``docs``."""
    names = [c if c in used else f"own_{i}_" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


@_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without a letter, and texts of no learned language.

    The last are texts that the model codes longer by the bytes' order in every learned language
    than without it (``odd``), as it is with random letters and with scripts never seen. A corpus
    without a null-free (text, lang) row teaches no language, so all go.
    """
    rows, back = _aside(docs, "text", "lang")
    told = langid.identify(rows, langid.train(rows))
    foreign = (F.col("odd") > ODD_BITS) & (F.col("odd") > ODD_SHARE * F.octet_length("text"))
    return back(told.where((F.col("lang_pred") != langid.UNKNOWN) & ~foreign))


@_small_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather toxic than not go; null and empty texts, and all texts if no labels are there, stay."""
    rows, back = _aside(docs, "doc_id", "text")
    model = toxicity.train(rows, read(spark, sf_dir, "labels"))
    return back(toxicity.score(rows, model).where("predicted = 0"))


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id, a null one last.

    Rows are told apart by a number of their own, so different documents of one doc_id stay, and of
    equal rows one does. Texts without words are linked with nothing and stay.
    """
    rows, back = _aside(docs, "doc_id", "text")
    rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "rows")
    classes, _ = jaccard.jaccard_join(rows, doc_id="row_")
    ids = rows.select(F.col("row_").alias("doc_id"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_")).alias("first"))
    kept = classes.join(ids, "doc_id").groupBy("component_id").agg(F.min("first").alias("first")).select("first.row_")
    return back(rows.join(kept, "row_", "left_semi"))


@_small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the fitted rates give; its columns stay as they are."""
    rows, back = _aside(docs, "doc_id", "text")
    out = mixing.mixed(rows, mixing.domains_of(read(spark, sf_dir, "labels")), TARGETS)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return back(out.where("copies > 0").withColumn("copy_", copies))


@_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and how many there are; null and empty texts have none."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mixture), ("sentencepiece", encode)]
#: The stages fit models and encode, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
