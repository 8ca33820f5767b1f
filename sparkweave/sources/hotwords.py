"""Hot words of a country, cached in a table: fresh ones are read, stale ones served while they are fetched anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COUNTRIES, HOT_MISS_SECONDS, HOT_SECONDS
from .versioned import VersionedTable

CACHE = "country string, fetched_at timestamp, words array<struct<query string, trend_score double, category string>>"


def _age(now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros(F.col("fetched_at"))


def hot_words(cache: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(country, ord, query, trend_score, category): the first words of each country asked for, as the cache has them, stale or not.

    Reading never fetches. Countries are trimmed and in upper case; one that isn't of the list, or was never fetched,
    has no words. The cache holds whole lists, so callers of different limits don't disturb each other.
    """
    country = F.upper(F.trim("country"))
    want = asked.select(country.alias("country")).where(F.col("country").isin(*COUNTRIES)).distinct()
    found = cache.join(want, "country", "left_semi").select("country", F.posexplode(F.slice("words", 1, limit)).alias("ord", "w"))
    return found.select("country", F.col("ord").cast("long").alias("ord"), "w.*")


def due(cache: DataFrame, now: Column, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """(country) whose words are to be fetched: never were, are past their time, or came empty and have cooled down."""
    life = F.when(F.size("words") > 0, HOT_SECONDS).otherwise(HOT_MISS_SECONDS) * F.lit(1_000_000)
    fresh = cache.where(_age(now) < life).select("country")
    every = cache.sparkSession.createDataFrame([(c,) for c in countries], "country string")
    return every.join(fresh, "country", "left_anti")


def refreshed(table: VersionedTable, fetch: Callable[[DataFrame], DataFrame], now: Column, countries: tuple[str, ...] = COUNTRIES) -> int:
    """Fetches what is due and merges it into the cache; the version after.

    ``fetch`` gives (country, query, trend_score, category) for a table of countries. A country that gives nothing
    keeps its old words, which are served on and tried again next time; without old words an empty
    list is put down, so that it isn't asked for again at once. Of two refreshes at once the one that commits second sees
    the first one's rows and replaces them by its own, one row per country, so no list is mixed.
    """
    want = due(table.read(), now, countries)
    words = fetch(want)
    item = F.struct(-F.col("trend_score").alias("s"), F.col("query").alias("q"), F.struct("query", "trend_score", "category").alias("w"))
    lists = words.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["w"]).alias("words"))  # a source's words of a country are capped
    empty = F.array().cast("array<struct<query string, trend_score double, category string>>")
    old = table.read().where(F.size("words") > 0).select("country", F.lit(True).alias("_old"))
    rows = want.join(lists, "country", "left").join(old, "country", "left").where("words IS NOT NULL OR _old IS NULL")
    return table.upsert(rows.select("country", now.alias("fetched_at"), F.coalesce("words", empty).alias("words")), "fetched_at")
