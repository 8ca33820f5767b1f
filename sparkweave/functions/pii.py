"""Personal data in texts: spans, and pseudonyms with a map to undo them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PandasUDFType

# Entity names, their patterns and scores.
PATTERNS = {
    "EMAIL_ADDRESS": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.85),
    "IP_ADDRESS": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.85),
    "IBAN_CODE": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.8),
    "PHONE_NUMBER": (r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}\b", 0.6),
    "CREDIT_CARD": (r"\b(?:\d[ -]?){13,19}\b", 0.6),
}
# end of fixed values


def _luhn(digits: str) -> bool:
    each = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(each) % 10 == 0


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, entity) without overlaps: the earliest first, of those the longest, then by score."""
    found = []
    for name, (pattern, score) in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if (name != "PHONE_NUMBER" or len(digits) >= 7) and (name != "CREDIT_CARD" or _luhn(digits)):
                found.append((m.start(), -m.end(), -score, name))
    out, at = [], 0
    for start, end, _, name in sorted(found):
        if start >= at:
            out.append((start, -end, name))
            at = -end
    return out


def pseudonyms(text: str | None) -> tuple[str, dict[str, str]]:
    out, at, undo, text = [], 0, {}, text or ""
    for i, (start, end, name) in enumerate(spans(text)):
        token = f"<{name}_{i}>"
        undo[token] = text[start:end]
        out += (text[at:start], token)
        at = end
    return "".join(out) + text[at:], undo


def _pseudonymised(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([pseudonyms(t) for t in s], columns=["text", "map"])


def pseudonymise(c: Column) -> Column:
    """struct<text, map>: the text with numbered tokens, and what each token stands for."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.MapType(T.StringType(), T.StringType()))])
    return F.pandas_udf(_pseudonymised, kind, PandasUDFType.SCALAR_ITER)(c)
