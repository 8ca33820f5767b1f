"""String functions as column expressions (JVM only)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def casefold(c: Column) -> Column:
    """Case folding for comparisons: lower case with sharp s and final sigma folded."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


#: All characters that are white space in Unicode: controls 9 to 13, and the separators.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Unicode white space off both ends; only texts that have some at an end meet the regular expression."""
    ends = F.contains(F.lit(BLANKS), F.left(c, F.lit(1))) | F.contains(F.lit(BLANKS), F.right(c, F.lit(1)))
    return F.when(ends, F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(c)


def has_word(c: Column, term: str) -> Column:
    """Whether ``term`` stands in the text between non-word characters, any case."""
    return c.rlike(r"(?iu)(?<![\p{L}\p{N}_])" + re.sub(r"([^\w\s])", r"\\\1", term) + r"(?![\p{L}\p{N}_])")


def contains_folded(c: Column, term: Column) -> Column:
    return F.contains(casefold(c), casefold(term))


def sanitise(c: Column, limit: int = 500) -> Column:
    """Control characters out, at most ``limit`` characters."""
    return F.left(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), F.lit(limit))


def strip_fences(c: Column) -> Column:
    """Model output without its thinking and its code fence."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = trim(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))
    return trim(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


# The redaction patterns of log lines, in the order in which they apply.
LOG_PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "<IBAN>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}\b", "<PHONE>"),
    (r"\b\d{12,}\b", "<DIGITS>"),
)
# end of fixed values


def redact_log(c: Column) -> Column:
    for pattern, mark in LOG_PATTERNS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def html_escape(c: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def luhn_ok(c: Column) -> Column:
    """Whether the digits of a text are 13 to 19 and pass the Luhn check."""
    digits = F.regexp_replace(c, r"\D", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


# The least and greatest number of each cron field, and the names that stand for numbers.
CRON = ((0, 59, ()), (0, 23, ()), (1, 31, ()), (1, 12, ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")), (0, 7, ("sun", "mon", "tue", "wed", "thu", "fri", "sat")))
# end of fixed values


def cron_ok(c: Column) -> Column:
    """Five fields, each a list of *, values or ranges, with steps, whose numbers are in the field's bounds."""
    fields = F.split(strip(c), r"[\s\p{Z}]+")
    ok = F.size(fields) == 5
    for i, (low, high, names) in enumerate(CRON):
        numbers = "|".join(f"0?{n}" if n < 10 else str(n) for n in range(high, low - 1, -1))
        value = f"(?:{'|'.join([numbers, *names])})"
        part = rf"(?:\*|{value}(?:-{value})?)(?:/0*[1-9]\d{{0,2}})?"
        ok = ok & F.coalesce(F.lower(F.get(fields, F.lit(i))).rlike(f"^{part}(?:,{part})*$"), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def safe_redirect(c: Column) -> Column:
    return F.when(c.startswith("/") & ~c.startswith("//"), c).otherwise("/")


def listed(words: Column) -> Column:
    """Words as a prompt names them."""
    return F.array_join(words, "、")


def unlisted(text: Column) -> Column:
    """The words of a text that separates them by either comma, without blanks."""
    return F.filter(F.transform(F.split(text, "[、,]"), strip), lambda x: x != "")


def json_text(c: Column, path: str, default: str) -> Column:
    """The text at a path of a JSON text; the default where the text isn't JSON or has nothing there."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), path, "string"), F.lit(default))
