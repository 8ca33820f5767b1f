"""The thin queries over the given tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import CLUSTER_SQL
from .common import read
from .digest_index import DEDUP_SQL
from .fill_in_middle import DIGEST_SQL as FILL_SQL
from .topk import INTEGER_SQL as topk_sql


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_search

    return integer_search(read(spark, sf_dir, "embeddings"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for 85 % high, 10 % low quality and 5 % toxic words."""
    from .mixing import domains_of, mixed

    out = mixed(read(spark, sf_dir, "documents"), domains_of(read(spark, sf_dir, "labels")), {"high": 0.85, "low": 0.10, "toxic": 0.05})
    return out.select("doc_id", "n_words", "posteriors", "rate", "copies")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import digests

    return digests(read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import judged

    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"))[0]


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import judged

    return judged(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_digests

    return store_digests(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digests

    return chat_digests(read(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests

    return digests(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .digest_index import dedup_table

    return dedup_table(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clusters

    return clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_voronoi_topk, op2_soft_mixing, op3_sentencepiece, op4_toxicity, op5_ngram_jaccard, op6_embedding_dedup, op7_language_id, op8_token_store, op9_url_filter, op10_chat_format, op11_fill_in_middle, op12_exact_dedup, op13_centroid_clustering)}
#: The others fit models, tokenise or walk graphs; they are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {"op1_voronoi_topk": topk_sql, "op11_fill_in_middle": FILL_SQL, "op12_exact_dedup": DEDUP_SQL, "op13_centroid_clustering": CLUSTER_SQL}
