"""Suggestions: hygiene, scores, best of duplicates, quotas, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FIRST_QUOTA, PER_COUNTRY, SCORE_FLOOR, SCORE_RANKS, TOP_PER_COUNTRY, TOTAL_CAP
from ..functions.text import casefold, strip


def hygiene(suggestions: DataFrame) -> DataFrame:
    """Drops blanks, echoes of the seed, numbers and single characters; ranks stay those of the source. A null seed has no echo."""
    # a generator of one row: filters on what it gives stay above it, so each word is stripped once, not once a condition
    once = F.inline(F.array(F.struct(strip(F.col("word")).alias("word"), casefold(strip(F.col("seed"))).alias("_echo"))))
    s = suggestions.select(*(c for c in suggestions.columns if c != "word"), once)
    s = s.where((F.length("word") >= 2) & ~casefold(F.col("word")).eqNullSafe(F.col("_echo")) & ~F.col("word").rlike(r"^\p{Nd}+$"))
    return s.select(*suggestions.columns)


def position_score(rank):
    return F.round(F.greatest(F.lit(SCORE_FLOOR), 1 - rank / float(SCORE_RANKS)), 4)


def best_scores(suggestions: DataFrame, *keys: str) -> DataFrame:
    """One row per word: its best score, and the first category by (rank, category) among the rows that have it.

    The score falls with the rank, so numbers decide: first a count of distinct (word, category) by
    their least rank, which combines before the shuffle, then one row per word.
    """
    least = suggestions.groupBy(*keys, "word", "category").agg(F.min("rank").alias("rank"))
    top = least.groupBy(*keys, "word").agg(F.min("rank").alias("r"), F.min(F.when(F.col("category").isNotNull(), F.struct(F.col("rank"), F.col("category")))).alias("c"))
    best, first = position_score(F.col("r")), position_score(F.col("c.rank"))
    return top.select(*keys, "word", best.alias("trend_score"), F.when(first == best, F.col("c.category")).alias("category"))


def top_per_country(scored: DataFrame, n: int = TOP_PER_COUNTRY, *keys: str) -> DataFrame:
    w = Window.partitionBy("country", *keys).orderBy(F.desc("trend_score"), "word")
    return scored.withColumn("ord", F.row_number().over(w).cast("long")).where(F.col("ord") <= n)


def quota_merge(first: DataFrame, second: DataFrame, quota: int = FIRST_QUOTA, per_country: int = PER_COUNTRY) -> DataFrame:
    """Per country: the first source's ``quota`` best, then the second source, then the rest of the first; words once whatever their case."""
    a = first.select("country", "word", "trend_score", "category", "ord", F.lit("amazon_suggest").alias("source"), F.when(F.col("ord") <= quota, 0).otherwise(2).alias("phase"))
    b = second.select("country", "word", "trend_score", "category", "ord", F.lit("ebay_suggest").alias("source"), F.lit(1).alias("phase"))
    key = Window.partitionBy("country", casefold(F.col("word"))).orderBy("phase", "ord")
    once = a.union(b).withColumn("k", F.row_number().over(key)).where("k = 1")
    pick = Window.partitionBy("country").orderBy("phase", "ord")
    return once.withColumn("pick", F.row_number().over(pick).cast("long")).where(F.col("pick") <= per_country).drop("k", "ord")


def capped(merged: DataFrame, countries: tuple[str, ...], cap: int = TOTAL_CAP) -> DataFrame:
    """The first ``cap`` rows in the order of the countries' list."""
    place = F.array_position(F.array(*(F.lit(c) for c in countries)), F.col("country"))
    return merged.withColumn("country_ord", place).orderBy("country_ord", "pick").limit(cap)


def with_fallback(dynamic: DataFrame, fixed: DataFrame) -> DataFrame:
    """Dynamic seeds; fixed ones for countries without any."""
    return dynamic.unionByName(fixed.join(dynamic.select("country").distinct(), "country", "left_anti"))


def positional_lookup(words: Column, clean: Column, pieces: Column, answers: Column) -> Column:
    """A batch's translations as an array of (word, translation).

    Words, their cleaned and their masked forms belong together by position, up to the shortest of
    the three. ``answers`` (a map) is asked for the masked form, then the cleaned one, then the word.
    Blank and missing translations are left out.
    """
    n = F.least(F.size(words), F.size(clean), F.size(pieces))
    rows = F.slice(F.arrays_zip(words.alias("word"), clean.alias("clean"), pieces.alias("piece")), F.lit(1), n)
    found = F.transform(rows, lambda x: F.struct(x["word"].alias("word"), strip(F.coalesce(*(F.try_element_at(answers, x[k]) for k in ("piece", "clean", "word")))).alias("translation")))
    return F.filter(found, lambda x: x["translation"] != "")


def country_quota(countries: int, total: int = TOTAL_CAP) -> int:
    """Words of each country in a run."""
    return total // countries


def first_words(words: DataFrame, n: int) -> DataFrame:
    """The ``n`` first words of each country by (rank, word)."""
    w = Window.partitionBy("country").orderBy("rank", "word")
    return words.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cn_scores(suggestions: DataFrame) -> DataFrame:
    """(word, heat, category): a word's best unrounded score, and the first category by (rank, category) among the rows that have one."""
    least = suggestions.groupBy("word", "category").agg(F.min("rank").alias("rank"))
    top = least.groupBy("word").agg(F.min("rank").alias("rank"), F.min(F.when(F.col("category").isNotNull(), F.struct("rank", "category"))).alias("c"))
    return top.select("word", F.greatest(F.lit(SCORE_FLOOR), 1 - F.col("rank") / F.lit(float(SCORE_RANKS))).alias("heat"), F.col("c.category").alias("category"))
