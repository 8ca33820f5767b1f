"""Where an assessed word goes: to the tags, to the reviewers, or among the blocked."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BANNED_REASON, BLOCKED, NO_ANCHOR, REUSABLE, SAFE_REASON, STATUTORY_REASON
from ..functions.ids import point_id
from ..sources.versioned import VersionedTable
from .review import model_verdict

#: Actions and the stores they write to.
STORES = {"approved": "local_tags", "pending": "pending_review", "pending_no_anchor": "pending_review", "blocked": "blocked_decisions"}


def assessed(words: DataFrame) -> DataFrame:
    """``words`` (as rules.verdicts gives them, with said_verdict and said_reason of a model) with status and reason.

    Rules decide first, safe before statutory before banned, and name themselves as the reason; the
    model's answer counts only where they are silent. A missing or unknown answer is doubtful.
    """
    model = model_verdict(F.coalesce("said_verdict", F.lit("")), F.col("said_reason"))
    safe, no = F.coalesce(F.col("verdict"), F.lit(False)), F.coalesce(~F.col("verdict"), F.lit(False))
    status = F.when(safe, REUSABLE).when(no, BLOCKED).otherwise(model["verdict"])
    by_term = F.format_string(STATUTORY_REASON, F.col("statutory_rule"), F.col("statutory_term"))
    by_list = F.format_string(BANNED_REASON, F.col("country"), F.col("banned_rule"))
    reason = F.when(safe, SAFE_REASON).when(no & F.col("statutory_rule").isNotNull(), by_term).when(no, by_list).otherwise(model["reason"])
    return words.withColumns({"status": status, "reason": reason})


def action(status: Column, anchor: Column) -> Column:
    """What becomes of a word: only a reusable one needs an anchor; the blocked are blocked, all others wait for a reviewer."""
    reusable = F.when(anchor.isNull(), "pending_no_anchor").otherwise("approved")
    return F.when(status == REUSABLE, reusable).when(status == BLOCKED, "blocked").otherwise("pending")


def routed(words: DataFrame) -> DataFrame:
    """``words`` (status, anchor_id, ...) with their action."""
    return words.withColumn("action", action(F.col("status"), F.col("anchor_id")))


def sinks(words: DataFrame, run_id: str = "manual", job: str = "overseas_collection") -> dict[str, DataFrame]:
    """The rows that routed words add to each store, and their lineage.

    words: word, country, category, source, trend_score, status, reason, rule_id, anchor_id,
    anchor_word, anchor_score, action. Each row has the point id of (word, country), so that it is
    an upsert. A word without an anchor says so in its reason; a null status went to the reviewers.
    """
    id_ = point_id(F.coalesce("word", F.lit("")), F.coalesce("country", F.lit(""))).alias("point_id")
    rules = F.when(F.col("rule_id").isNotNull(), F.array("rule_id")).alias("rule_ids")
    origin = F.struct(F.col("source").alias("source_type"), F.lit(run_id).alias("collection_run_id"), F.col("anchor_score").alias("anchor_match_score")).alias("provenance")
    by = F.lit("llm").alias("assessed_by")
    waits, lost = F.col("action").startswith("pending"), F.col("action") == "pending_no_anchor"
    out = {
        "local_tags": words.where("action = 'approved'").select(id_, "word", "country", F.col("status").alias("compliance_status"), "reason", F.col("anchor_id").alias("anchor_cn_id"), F.col("anchor_word").alias("anchor_cn_word"), "source", "category", "trend_score", origin, rules, by),
        "pending_review": words.where(waits).select(id_, "word", "country", F.when(lost, F.concat(F.coalesce("reason", F.lit("")), F.lit(NO_ANCHOR))).otherwise(F.col("reason")).alias("assessment_reason"), "source", "category", F.lit("pending").alias("status"), origin, rules, by),
        "blocked_decisions": words.where("action = 'blocked'").select(id_, "word", "country", "reason", "source", "category", F.col("anchor_word").alias("cn_word"), "rule_id", "trend_score", origin),
    }
    store = F.element_at(F.create_map(*(F.lit(x) for kv in STORES.items() for x in kv)), F.col("action"))
    blocked = F.col("action") == "blocked"
    detail = F.when(lost, F.struct(F.lit("multilingual").alias("query_language"), F.lit(None).cast("string").alias("anchor_cn_word"), F.lit(None).cast("string").alias("rule_id")))
    detail = detail.otherwise(F.struct(F.lit(None).cast("string").alias("query_language"), F.col("anchor_word").alias("anchor_cn_word"), F.when(blocked, F.col("rule_id")).alias("rule_id")))
    facets = F.struct("action", "country", detail.alias("detail"))
    outputs = F.array(F.struct(store.alias("namespace"), F.col("word").alias("name"), facets.alias("facets")))
    event = F.to_json(F.struct(F.lit("OUTPUT").alias("eventType"), F.struct(F.lit(run_id).alias("runId")).alias("run"), F.struct(F.lit(job).alias("name")).alias("job"), outputs.alias("outputs")))
    out["lineage"] = words.select(F.lit(run_id).alias("run_id"), F.lit(job).alias("job_name"), F.lit("OUTPUT").alias("event_type"), event.alias("event"))
    return out


def anchored(words: DataFrame, embed, run_id: str = "manual") -> dict[str, DataFrame]:
    """What Chinese words (word, category, heat) become: anchors to upsert, each with its vector, and their lineage; nothing is assessed.

    ``embed`` is a function from (word) rows to rows with a vector; each distinct word is embedded once. Blank words are left out.
    """
    good = words.where(F.trim("word") != "").groupBy("word").agg(F.max_by("category", F.col("heat")).alias("category"), F.max("heat").alias("heat"))
    points = embed(good).select(point_id(F.col("word")).alias("point_id"), F.col("word").alias("cn_word"), "category", "vector")
    event = F.to_json(F.struct(F.lit("OUTPUT").alias("eventType"), F.struct(F.lit(run_id).alias("runId")).alias("run"), F.array(F.struct(F.lit("cn_anchors").alias("namespace"), F.col("word").alias("name"), F.struct(F.lit("inserted").alias("action")).alias("facets"))).alias("outputs")))
    lineage = good.select(F.lit(run_id).alias("run_id"), F.lit("cn_collection").alias("job_name"), F.lit("OUTPUT").alias("event_type"), event.alias("event"))
    return {"cn_anchors": points, "lineage": lineage}


def stores(spark: SparkSession, folder: str, out: Mapping[str, DataFrame], parts: int = 32) -> dict[str, VersionedTable]:
    """The three stores below ``folder``, keyed by point id, made with the columns of ``out`` (what ``sinks`` gave) where they aren't there yet."""
    made = T.StructType([T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])
    return {name: VersionedTable(spark, f"{folder}/{name}", "point_id", T.StructType([*out[name].schema.fields, *made.fields]), parts) for name in dict.fromkeys(STORES.values())}


def write(out: Mapping[str, DataFrame], tables: Mapping[str, VersionedTable], now: Column) -> dict[str, int]:
    """Merges routed words into their stores; the version of each after.

    A word of a country that is there already is replaced as a whole, its time of creation included. Of a word that a
    run routed to one store more than once one row stays.
    """
    return {name: table.upsert(out[name].withColumns({"created_at": now, "updated_at": now}), "updated_at") for name, table in tables.items()}
