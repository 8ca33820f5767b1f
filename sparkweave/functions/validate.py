"""Checks of requests as column expressions: a row says what is wrong with it, none fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOUNDS, COUNTRIES, REQUEST_TYPES
from .text import cron_ok, strip


def country(c: Column) -> Column:
    """A country of the list, trimmed and in upper case; null if it is none of them."""
    known = F.upper(strip(c))
    return F.when(known.isin(*COUNTRIES), known)


def rule_country(c: Column) -> Column:
    """The country as rule files are named: trimmed and in lower case; null if it is none of the list."""
    return F.lower(country(c))


def within(c: Column, field: str) -> Column:
    """Whether a text, trimmed, or a number lies within the field's bounds. Null doesn't."""
    low, high, kind = BOUNDS[field]
    size = F.length(strip(c)) if kind == "text" else c
    return F.coalesce(size.between(low, high), F.lit(False))


def query_text(title: Column, category: Column) -> Column:
    """What is embedded of a request: the title, and the category after it if there is one."""
    return F.concat_ws(" ", title, F.when(category != "", category))


def requests(rows: DataFrame) -> DataFrame:
    """Recommendation requests (title, target_country, category, top_k) with title trimmed, country normalised, query and problems.

    problems: the names of the fields that are out of bounds, in this order; empty for a good request.
    """
    bad = {
        "title": ~within(F.col("title"), "title"),
        "target_country": country(F.col("target_country")).isNull(),
        "category": F.col("category").isNotNull() & ~within(F.coalesce("category", F.lit("")), "category"),
        "top_k": ~within(F.col("top_k"), "top_k"),
    }
    problems = F.array_compact(F.array(*(F.when(is_bad, name) for name, is_bad in bad.items())))
    out = rows.withColumn("problems", problems).withColumn("title", strip(F.col("title")))
    return out.withColumn("target_country", country(F.col("target_country"))).withColumn("query", query_text(F.col("title"), F.col("category")))


def subject_requests(rows: DataFrame) -> DataFrame:
    """Subjects' requests (request_type, contact, note, term) with contact, note and term trimmed, and problems: the fields out of bounds, in this order.

    A missing note is an empty one; a missing term is asked for only where the column is there.
    """
    bad = {
        "request_type": ~F.coalesce(F.col("request_type").isin(*REQUEST_TYPES), F.lit(False)),
        "contact": ~within(F.col("contact"), "contact"),
        "note": ~within(F.coalesce("note", F.lit("")), "note"),
        "term": ~within(F.col("term"), "term") if "term" in rows.columns else F.lit(False),
    }
    problems = F.array_compact(F.array(*(F.when(is_bad, name) for name, is_bad in bad.items())))
    texts = {c: strip(F.col(c)) for c in ("contact", "note", "term") if c in rows.columns}
    return rows.withColumn("problems", problems).withColumns(texts)


def schedules(rows: DataFrame) -> DataFrame:
    """Schedules (cron) with ok: the length is in bounds and the five fields are valid."""
    return rows.withColumn("ok", within(F.col("cron"), "cron") & cron_ok(F.col("cron")))


def allowed(roles: Column, required: tuple[str, ...]) -> Column:
    """Whether a user has one of the required roles; without roles no."""
    return F.coalesce(F.arrays_overlap(roles, F.array(*(F.lit(r) for r in required))), F.lit(False))
