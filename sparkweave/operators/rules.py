"""Rule files and the verdict of rules on words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from ..constants import MANUAL_RULE, STATUTORY_TERMS
from ..functions.terms import Terms
from ..functions.text import casefold
from ..functions.validate import country


def rule_entries(files: DataFrame, key: str) -> DataFrame:
    """(country, ord, word, rule_id) from ``files`` (country, json): entries are texts or objects with a text as word, others are dropped.

    Files that aren't JSON, or lack the list, have no entries. ord is the place in the list.
    """
    text = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    listed = F.try_variant_get(F.try_parse_json("json"), f"$.{key}", "variant")
    rows = files.select("country", listed.alias("listed")).where(F.startswith(F.schema_of_variant("listed"), F.lit("ARRAY")))
    entries = rows.select("country", F.posexplode(F.try_variant_get("listed", "$", "array<variant>")).alias("ord", "raw"))
    word = F.coalesce(text(F.col("raw"), "$"), text(F.col("raw"), "$.word"))
    return entries.select("country", "ord", word.alias("word"), text(F.col("raw"), "$.rule_id").alias("rule_id")).where("word IS NOT NULL")


def read_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(country, list, json) from a folder of rule files: ``de.json`` holds a country's banned words, ``de_safe.json`` its safe ones.

    Files of other names are left out; the country is in upper case. A folder without files has no rules.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"))
    name = F.lower(F.regexp_extract("file", r"^([A-Za-z]{2})(_safe)?\.json$", 1))
    kind = F.when(F.lower("file").endswith("_safe.json"), "safe").otherwise("banned")
    return files.select(country(name).alias("country"), kind.alias("list"), F.col("value").alias("json")).where("country IS NOT NULL")


#: Bytes of terms that are sent to every task; longer lists are dealt out in parts of this size.
SENT = 16 << 20


def _searcher(keyed: dict, whole: bool):
    """key -> Terms, each built when a worker first needs it."""
    built: dict = {}

    def terms(key) -> Terms | None:
        if key not in built:
            built[key] = Terms(keyed[key], whole) if key in keyed else None
        return built[key]

    return terms


def statutory(words: DataFrame, word: str = "word", terms: dict[str, tuple[str, ...]] = STATUTORY_TERMS) -> DataFrame:
    """``words`` with statutory_rule and statutory_term: the first term, in list order, that stands in the word.

    The list is one automaton per worker, so a word is read once whatever the number of terms; the list is
    written in the source and so bounded.
    """
    listed = [(r, t) for r, ts in terms.items() for t in ts]
    spark, sent = words.sparkSession, {"*": [(i, t) for i, (_, t) in enumerate(listed)]}

    def places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _searcher(sent, True)("*")
        for s in parts:
            yield pd.Series([find.first(t) for t in s], dtype="Int32")

    place = F.pandas_udf(places, "int", PandasUDFType.SCALAR_ITER)(F.col(word))
    names = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(listed)], "_place int, statutory_rule string, statutory_term string")
    out = words.drop("statutory_rule", "statutory_term").withColumn("_place", place)
    return out.join(F.broadcast(names), "_place", "left").drop("_place")


def banned(words: DataFrame, entries: DataFrame) -> DataFrame:
    """``words`` (word, country, ...) with banned_rule: of the country's first banned entry that the word contains, case folded.

    The entries of a country are one automaton. If all entries have no more than ``SENT`` bytes they go to every
    task, and words are searched where they are. Longer lists are cut in parts of that size: distinct
    words then meet each part of their country's list, and the least place of all parts counts.
    """
    mine = entries.where("country IS NOT NULL AND word IS NOT NULL").select("country", F.col("ord").cast("long").alias("ord"), casefold(F.col("word")).alias("term"), F.coalesce(F.when(F.col("rule_id") != "", F.col("rule_id")), F.lit(MANUAL_RULE)).alias("rule"))
    size = mine.agg(F.sum(F.octet_length("term") + F.octet_length("rule") + 16)).first()[0] or 0
    out = words.drop("banned_rule")
    if size <= SENT:
        keyed, rules = {}, {}
        for r in mine.collect():  # SENT bytes at most
            keyed.setdefault(r["country"], []).append((r["ord"], r["term"]))
            rules[r["country"], r["ord"]] = min(r["rule"], rules.get((r["country"], r["ord"]), r["rule"]))

        def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            search = _searcher(keyed, False)
            for cs, ts in parts:
                places = [find.first(t) if (find := search(c)) else None for c, t in zip(cs, ts, strict=True)]
                yield pd.Series([None if p is None else rules[c, p] for c, p in zip(cs, places, strict=True)], dtype=object)

        return out.withColumn("banned_rule", F.pandas_udf(found, "string", PandasUDFType.SCALAR_ITER)(F.col("country"), casefold(F.col("word"))))
    parts = -(-size // SENT)
    part = F.pmod(F.xxhash64("country", "ord"), F.lit(parts)).cast("int").alias("part")
    distinct = out.select("country", "word").distinct().withColumn("term", casefold(F.col("word")))
    asked = distinct.select("country", "word", "term", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("block"))
    lists = mine.select("country", "ord", "term", "rule", part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ords, terms, rules = (right[c].to_pylist() for c in ("ord", "term", "rule"))
        find, rule = Terms(zip(ords, terms, strict=True)), dict(sorted(zip(ords, rules, strict=True), reverse=True))
        places = [find.first(t) for t in left["term"].to_pylist()]
        table = pa.table({"country": left["country"], "word": left["word"], "ord": pa.array(places, pa.int64()), "rule": pa.array([None if p is None else rule[p] for p in places], pa.string())})
        return table.filter(table["ord"].is_valid())

    by = ("country", "part", "block")
    hits = asked.groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(meet, "country string, word string, ord long, rule string")
    first = hits.groupBy("country", "word").agg(F.min_by("rule", F.struct("ord", "rule")).alias("banned_rule"))
    return out.join(first, ["country", "word"], "left")


def verdicts(words: DataFrame, safe: DataFrame, entries: DataFrame) -> DataFrame:
    """``words`` with verdict (true: safe, false: blocked, null: undecided) and rule_id: safe, statutory, banned, in this order."""
    known = safe.select("country", "word").distinct().withColumn("_safe", F.lit(True))
    out = banned(statutory(words), entries).join(known, ["country", "word"], "left")
    is_safe = F.coalesce("_safe", F.lit(False))
    rule = F.when(~is_safe, F.coalesce("statutory_rule", "banned_rule"))
    return out.withColumn("verdict", F.when(is_safe, True).when(rule.isNotNull(), False)).withColumn("rule_id", rule).drop("_safe")
