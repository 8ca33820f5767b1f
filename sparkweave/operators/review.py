"""Review of undecided words, edits of rules, and what becomes of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLOCKED, DEFAULT_REASON, DOUBTFUL, MANUAL_REJECT, REASON_CHARS, REUSABLE, VERDICTS
from ..functions.text import strip, strip_fences
from ..functions.validate import country, within


def model_verdict(verdict: Column, reason: Column) -> Column:
    """(verdict, reason) of a model's answer: unknown verdicts are doubtful, blank reasons get the default, long ones are cut."""
    said = strip(reason)
    known = F.when(verdict.isin(*VERDICTS), verdict).otherwise(DOUBTFUL)
    return F.struct(known.alias("verdict"), F.left(F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(DEFAULT_REASON), F.lit(REASON_CHARS)).alias("reason"))


def edited(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries after, outcome of each edit): entries (country, list, word, ...), edits (country, list, word, op).

    op is add or remove; words are compared as they stand. Outcomes: added, exists, removed,
    not_found. An edit that repeats another is one edit; adding and removing one word at once removes it.
    """
    key = ["country", "list", "word"]
    one = edits.groupBy(*key).agg(F.when(F.bool_or(F.col("op") == "remove"), "remove").otherwise("add").alias("op"))
    there = entries.select(*key).distinct().withColumn("there", F.lit(True))
    outcome = one.join(there, key, "left").withColumn("there", F.col("there").isNotNull())
    action = F.when(F.col("op") == "add", F.when(F.col("there"), "exists").otherwise("added")).otherwise(F.when(F.col("there"), "removed").otherwise("not_found"))
    outcome = outcome.select(*key, action.alias("action"))
    kept = entries.join(outcome.where("action = 'removed'"), key, "left_anti")
    new = edits.where("op = 'add'").join(outcome.where("action = 'added'").select(*key), key, "left_semi").dropDuplicates(key)
    return kept.unionByName(new.drop("op"), allowMissingColumns=True), outcome


def rule_files(entries: DataFrame) -> DataFrame:
    """One JSON text per country and list, its words in order: what the rule reader reads."""
    each = F.struct("word", F.struct("word", "rule_id", "added_by").alias("entry"))
    words = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["entry"])
    return entries.groupBy("country", "list").agg(F.to_json(F.struct(words.alias("entries")), {"ignoreNullFields": "false"}).alias("json"))


def write_rule_files(entries: DataFrame, path: str) -> None:
    """Replaces the rule files below ``path`` of the countries that have entries; those of others stay."""
    partly = entries.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    if partly.lower() != "dynamic":
        raise ValueError("set spark.sql.sources.partitionOverwriteMode to dynamic, or other countries' files would go")
    rule_files(entries).write.mode("overwrite").partitionBy("country", "list").parquet(path)


def reviewed(pending: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """What decisions do to pending words: rules to add, tags to upsert, and the words that stay pending.

    pending: id, word, country, category, reason, source, ...; decisions: id, approve, category,
    reason, by. An approval makes a safe rule and a reusable tag, assessed by hand, with the
    decision's category if it has one. A rejection needs a reason (1 to 2000 characters) and makes a banned
    rule. Decisions that neither approve nor reject (null), on unknown ids, of unknown countries or without
    their reason are no decisions. Of several valid ones on a word, the rejection counts.
    """
    valid = decisions.where(F.col("approve") | (~F.col("approve") & within(F.col("reason"), "reason")))
    one = valid.groupBy("id").agg(F.min_by(F.struct("approve", F.col("category").alias("new_category"), F.col("reason").alias("why"), "by"), F.struct("approve", "reason")).alias("d")).select("id", "d.*")
    both = pending.join(one, "id").where(country(F.col("country")).isNotNull()).withColumn("country", country(F.col("country")))
    yes, no = both.where("approve"), both.where("NOT approve")
    empty = F.lit(None).cast("string")
    by = F.coalesce("by", F.lit(""))
    rules = yes.select("country", F.lit("safe").alias("list"), "word", empty.alias("rule_id"), F.col("by").alias("added_by"))
    rules = rules.unionByName(no.select("country", F.lit("banned").alias("list"), "word", F.lit(MANUAL_REJECT).alias("rule_id"), F.concat(by, F.lit("："), "why").alias("added_by")))
    category = F.coalesce(F.when(F.col("new_category") != "", F.col("new_category")), F.col("category"))
    tags = yes.select("word", "country", category.alias("category"), F.lit(REUSABLE).alias("compliance_status"), "reason", "source", F.lit("manual").alias("assessed_by"))
    return {"rules": rules, "tags": tags, "pending": pending.join(both.select("id"), "id", "left_anti")}


def picks_of(answers: DataFrame) -> DataFrame:
    """(qid, pick_ord, word, reason) from models' answers (qid, answer).

    An answer that is null, isn't JSON, isn't an object, has no list of recommendations, or has items
    that aren't objects with a text as word gives no pick for that part, so that vector order stands in.
    """
    v = F.try_parse_json(strip_fences(F.col("answer")))
    kind = lambda x: F.schema_of_variant(x)
    listed = F.try_variant_get(v, "$.recommendations", "variant")
    rows = answers.select("qid", listed.alias("listed")).where(F.startswith(kind(F.col("listed")), F.lit("ARRAY")))
    items = rows.select("qid", F.posexplode(F.try_variant_get("listed", "$", "array<variant>")).alias("pick_ord", "item"))
    word = F.try_variant_get("item", "$.word", "variant")
    items = items.where(F.startswith(kind(F.col("item")), F.lit("OBJECT")) & (kind(word) == "STRING"))
    said = F.coalesce(F.try_variant_get("item", "$.reason", "string"), F.lit(""))
    return items.select("qid", F.col("pick_ord").cast("long").alias("pick_ord"), strip(F.try_variant_get("item", "$.word", "string")).alias("word"), said.alias("reason"))


def counters(routed: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Of a run's routed words (country, word, action): approved, pending, rejected, duplicate (known before or earlier in the run), new and total per ``keys``."""
    seen = known.select("country", "word").distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy("country", "word").orderBy("id")
    rows = routed.withColumn("again", F.row_number().over(order) > 1).join(seen, ["country", "word"], "left")
    dup = F.col("again") | F.col("known").isNotNull()
    count = lambda c, name: F.count_if(c).alias(name)
    a = F.col("action")
    return rows.groupBy(*keys).agg(count(~dup & (a == "approved"), "approved"), count(~dup & a.startswith("pending"), "pending"), count(~dup & (a == "blocked"), "rejected"), count(dup, "duplicate"), count(~dup, "new"), F.count("*").alias("total"))


def transition(status: Column, approve: Column) -> Column:
    """(transition, status) of a decision: only doubtful words change; a missing decision rejects nothing."""
    open_ = status == DOUBTFUL
    kind = F.when(open_ & approve, "approved").when(open_ & ~approve, "rejected").otherwise("unchanged")
    return F.struct(kind.alias("transition"), F.when(kind == "approved", REUSABLE).when(kind == "rejected", BLOCKED).otherwise(status).alias("status"))
