"""Deterministic ids and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_id(*parts: Column) -> Column:
    """UUID-shaped md5 of the parts, each with its length in front, so that parts can't run into each other."""
    joined = F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))
    return F.regexp_replace(F.md5(joined), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def row_hash(prev: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; no conditions: true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """Disjunction; no conditions: true, as an absent filter."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def text_hash(c: Column) -> Column:
    """SHA-256 of a text, a null one as empty; logs show its first 12 characters."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)
