"""Recommendations end to end: requests in, checked, embedded, recalled, ranked by a model, and answered with where each word comes from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_OUTPUT, FILL_REASON, MAX_OUTPUT, PICK_REASON, RERANK
from ..functions import validate
from ..functions.pii import pseudonymise
from ..functions.text import strip
from . import review, search


def described(word: Column, category: Column, trend: Column, similarity: Column) -> Column:
    """A candidate as a prompt lists it: its word, and what is known of its category, heat and similarity."""
    kind = F.coalesce(F.concat(F.lit(" (类目: "), F.nullif(category, F.lit("")), F.lit(")")), F.lit(""))
    heat = F.coalesce(F.when(trend != 0, F.concat(F.lit(" (热度: "), trend.cast("string"), F.lit(")"))), F.lit(""))
    return F.concat(F.lit("- "), word, kind, heat, F.format_string(" (相似度: %.4f)", F.floor(similarity * 10000 + 0.5) / 10000))


def blocks(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys, block): the candidates of each key in the order of ord, a line each."""
    line = described(F.col("word"), F.col("category"), F.col("trend_score"), F.col("similarity"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))  # RERANK lines at most
    return candidates.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


def prompts(asked: DataFrame, candidates: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(qid, prompt) of requests (qid, title, category, country, top_k) that have candidates: personal data in titles stand as tokens.

    hot: (country, ord, query), the words that sell there; without any, nothing is said of them.
    """
    rows = asked.join(blocks(candidates, "qid"), "qid")
    context = F.lit("")
    if hot is not None:
        words = hot.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"]), ", ").alias("_hot"))  # ten words a country
        rows = rows.join(words, "country", "left")
        context = F.coalesce(F.concat(F.lit("\n当前"), "country", F.lit("电商热销词："), "_hot"), F.lit(""))
    title = pseudonymise(F.col("title"))["text"]
    kind = F.coalesce(F.nullif("category", F.lit("")), F.lit("未指定"))
    head = F.concat(F.lit("商品信息：\n- 标题："), title, F.lit("\n- 类目："), kind, F.lit("\n- 目标国家："), "country", context)
    return rows.select("qid", F.concat(head, F.lit("\n\n候选标签列表（附带元数据）：\n"), "block", F.lit("\n\n请从以上候选中选出最合适的 "), F.col("top_k").cast("string"), F.lit(" 个标签，排序并给出理由。")).alias("prompt"))


def recommendations(requests: DataFrame, tags: DataFrame, embed: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], hot: DataFrame | None = None) -> dict[str, DataFrame]:
    """What becomes of requests (qid, title, target_country, category, top_k): items, answers and refused.

    ``embed`` gives (query, vector) for distinct texts (query); ``ask`` gives (qid, answer) for (qid, prompt), a null answer
    where the model failed. tags: id, word, country, category, source, trend_score, compliance_status, reason,
    anchor_cn_word, vector.

    items: (qid, position, the tag's columns, similarity, ai_generated, reason), at most top_k a request: first the
    model's picks among the candidates, then the most similar others. answers: (qid, total_candidates,
    filtered_candidates, ai_assisted), a row for every good request, those without candidates included.
    refused: (qid, problems). A missing top_k is the default, requests without a vector have no candidates.
    """
    checked = validate.requests(requests.withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_OUTPUT))))
    refused = checked.where(F.size("problems") > 0).select("qid", "problems")
    good = checked.where(F.size("problems") == 0).select("qid", "title", F.col("target_country").alias("country"), F.nullif("category", F.lit("")).alias("category"), "top_k", "query")
    vectors = embed(good.select("query").distinct()).select("query", F.col("vector").alias("q"))
    asked = good.join(vectors, "query").select("qid", "country", "q", F.col("category").alias("want"), "top_k")
    named = tags.withColumnsRenamed({"reason": "compliance_reason"})
    found = search.recall(named, asked)
    kept = search.category_filter(found, F.col("want"))
    first = Window.partitionBy("qid").orderBy("ord")
    top = kept.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= RERANK).drop("_n")
    picks = review.picks_of(ask(prompts(good, top, hot)))
    ranked = search.rerank(top, picks, MAX_OUTPUT).where(F.col("position") <= F.col("top_k"))
    said = F.coalesce(F.nullif(strip(F.col("ai_reason")), F.lit("")), F.lit(PICK_REASON))
    items = ranked.withColumn("reason", F.when(F.col("ai_generated"), said).otherwise(FILL_REASON)).drop("ord", "want", "top_k", "pick_ord", "ai_reason", "compliance_status")
    count = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    answers = good.select("qid").join(count(found, "total_candidates"), "qid", "left").join(count(kept, "filtered_candidates"), "qid", "left")
    answers = answers.join(items.groupBy("qid").agg(F.bool_or("ai_generated").alias("ai_assisted")), "qid", "left")
    return {"items": items, "answers": answers.fillna(0, ["total_candidates", "filtered_candidates"]).fillna(False, ["ai_assisted"]), "refused": refused}
