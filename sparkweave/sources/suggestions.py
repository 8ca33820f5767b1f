"""Suggestion payloads of three shapes, and the requests that fetch them.

A payload that isn't JSON, or not of the shape, gives no rows; an item that isn't what it should be is
skipped on its own, and ranks count it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.parse import quote
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip
from ..operators.collect import hygiene


def _kind(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(c), F.lit(""))


def _items(bodies: DataFrame, path: str) -> DataFrame:
    """(country, seed, category, rank, item) of the list at ``path``; none where there is no list."""
    listed = F.try_variant_get(F.try_parse_json("body"), path, "variant")
    rows = bodies.select("country", "seed", "category", listed.alias("listed")).where(F.startswith(_kind(F.col("listed")), F.lit("ARRAY")))
    return rows.select("country", "seed", "category", F.posexplode(F.try_variant_get("listed", "$", "array<variant>")).alias("rank", "item"))


def _text(c: Column) -> Column:
    """A variant's text; null for anything else, numbers and flags included."""
    return F.when(_kind(c) == "STRING", F.try_variant_get(c, "$", "string"))


def parse_object(bodies: DataFrame) -> DataFrame:
    """(country, seed, category, rank, word) from ``{"suggestions": [{"value": word}, ...]}``."""
    rows = _items(bodies, "$.suggestions").where(F.startswith(_kind(F.col("item")), F.lit("OBJECT")))
    word = _text(F.try_variant_get("item", "$.value", "variant"))
    return hygiene(rows.withColumn("word", word).where("word IS NOT NULL").drop("item"))


def parse_pair(bodies: DataFrame) -> DataFrame:
    """``[prefix, [word, ...]]``."""
    rows = _items(bodies, "$[1]").withColumn("word", _text(F.col("item")))
    return hygiene(rows.where("word IS NOT NULL").drop("item"))


def parse_rows(bodies: DataFrame) -> DataFrame:
    """``{"result": [[word, ...], ...]}``: blanks and exact echoes of the seed go, nothing else."""
    rows = _items(bodies, "$.result").where(F.startswith(_kind(F.col("item")), F.lit("ARRAY")))
    word = strip(_text(F.try_variant_get("item", "$[0]", "variant")))
    return rows.withColumn("word", word).where((F.coalesce(F.length("word"), F.lit(0)) > 0) & ~F.col("word").eqNullSafe(F.col("seed"))).drop("item")


#: What fetching gives.
FETCHED = "country string, seed string, category string, body string, error string, tries int"


def _asked(url: str, country: str, seed: str, timeout: float) -> str:
    with urlopen(url.format(country=country.lower(), seed=quote(seed)), timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def _tried(ask: Callable[[], str], retries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(answer, error, tries): again after ``wait`` times 1, 2, 4, ... seconds, at most ``retries`` times."""
    for n in range(retries + 1):
        try:
            return ask(), None, n + 1
        except (OSError, ValueError, HTTPException) as e:
            error = f"{type(e).__name__}: {e}"
            if n < retries:
                time.sleep(wait * 2**n)
    return None, error, retries + 1


def fetched(seeds: DataFrame, url: str, timeout: float = 10, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """One request per row of ``seeds`` (country, seed, category), in tasks: see ``FETCHED``.

    ``url`` is a template with {country} and {seed}. A request that still fails after its retries is a row with an
    error and no body, so nothing is lost and nothing fails the job. ``seeds`` may be a stream: its source
    keeps the place, and a restart asks only for seeds that no finished micro-batch had. Rows without a country or seed
    are errors of their own.
    """
    rows = seeds.select("country", "seed", F.col("category").cast("string").alias("category") if "category" in seeds.columns else F.lit(None).cast("string").alias("category"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                country, seed, category = (b.column(i)[at].as_py() for i in range(3))
                if country is None or seed is None:
                    body, error, tries = None, "no country or seed", 0
                else:
                    body, error, tries = _tried(lambda: _asked(url, country, seed, timeout), retries, wait)  # noqa: B023
                kinds = (pa.string(),) * 5 + (pa.int32(),)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((country, seed, category, body, error, tries), kinds, strict=True)], names=["country", "seed", "category", "body", "error", "tries"])

    return rows.mapInArrow(run, FETCHED)


class SuggestionSource(DataSource):
    """``spark.read.format("suggestions")``: one request per seed of a short list, a failed one gives no rows.

    Options: ``url`` (a template with {country} and {seed}), ``seeds`` (country:seed, separated by commas), ``timeout``,
    ``retries`` and ``wait``. Seeds of a table go through ``fetched``.
    """

    @classmethod
    def name(cls) -> str:
        return "suggestions"

    def schema(self) -> str:
        return "country string, seed string, category string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 10))
        self.retries, self.wait = int(options.get("retries", 0)), float(options.get("wait", 1))
        self.seeds = [tuple(x.split(":", 1)) for x in options.get("seeds", "").split(",") if ":" in x]

    def partitions(self):
        return [InputPartition(x) for x in self.seeds]

    def read(self, partition):
        country, seed = partition.value
        body, error, _ = _tried(lambda: _asked(self.url, country, seed, self.timeout), self.retries, self.wait)
        if error is None:
            yield country, seed, None, body
