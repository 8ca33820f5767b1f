"""Fill-in-middle: a text cut in three, its parts moved so that a model learns to write the middle.

One ``fullmatch`` of the repeated unit keeps every repetition, so the ends of the group's captures are
all places where a text may be cut: their number is n, and two of them are the cuts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, tidy

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
BREAK = regex.compile(r"[^A-Za-z]")
#: Characters of which one match keeps the captures; a longer text is matched in windows that end where a unit ends.
WINDOW = 1 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(n, end of prefix, end of middle): the cuts are after ``first`` and ``second`` modulo n + 1 units, the smaller one first."""
    if len(text) <= WINDOW:
        ends = UNITS.fullmatch(text).ends(1)
        n = len(ends)
        a, b = sorted((first % (n + 1), second % (n + 1)))
        return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0
    borders, upto = [0], [0]
    while borders[-1] < len(text):
        cut = BREAK.search(text, min(borders[-1] + WINDOW, len(text)))
        borders.append(cut.start() if cut else len(text))
        upto.append(upto[-1] + len(UNITS.fullmatch(text, borders[-2], borders[-1]).ends(1)))
    n = upto[-1]

    def place(units: int) -> int:
        if not units:
            return 0
        w = bisect_left(upto, units)
        return UNITS.fullmatch(text, borders[w - 1], borders[w]).ends(1)[units - upto[w - 1] - 1]

    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, place(a), place(b)


def draws(doc_id: object, seed: int) -> list[int]:
    """Four 32-bit numbers that only the seed and the id decide; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arranged(text: str, draw: list[int], plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(n, form, characters of prefix, of middle, output) of one text; plain ones have no parts."""
    n, a, b = cuts(text, draw[0], draw[1])
    if not text or any(m in text for m in marks) or draw[2] % 100 >= plain_from:
        return n, PLAIN, None, None, text
    prefix, suffix, middle = marks[0] + text[:a], marks[1] + text[b:], marks[2] + text[a:b]
    spm = draw[3] % 100 < spm_below
    return n, SPM if spm else PSM, a, b - a, (suffix + prefix if spm else prefix + suffix) + middle


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must not run into each other or into themselves, or a text's end and a mark could make another one."""
    if any(a[-i:] == b[:i] for a in marks for b in marks for i in range(1, min(len(a), len(b)) + (a != b))) or not all(marks):
        raise ValueError(f"marks that overlap: {marks}")


def fill_in_middle(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text", plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document of ``docs`` with its text arranged anew.

    n counts the units of the text: runs of A-Z and a-z, and single other characters. Of the hundred
    values of a draw those from ``plain_from`` on leave the text plain, and those below ``spm_below``
    put the suffix first. Null texts count as empty; empty texts and texts that hold a mark stay
    plain. Repeated rows and ids give a row each (equal ids draw alike), an empty table gives an
    empty one, and other columns are neither read nor passed on. No shuffle: each text is a matter
    of its own, and a text of any length is matched in bounded windows.
    """
    _checked(marks)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, _, _ in steps(b.column(1)):
                ids, texts = (c.slice(first, end - first) for c in b.columns)
                made = [arranged(t or "", draws(i, seed), plain_from, spm_below, marks) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made of, from these two alone."""
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(at(1), at(3), at(2))).when(form == SPM, F.concat(at(2), at(3), at(1)))


def digests(docs: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` makes of each document, with the output and the text rebuilt from it as SHA-256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same in SQL: units as a list, cuts as the lengths of its first items.
DIGEST_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, coalesce(list_sum(list_transform(u[1:least(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0) AS a, coalesce(list_sum(list_transform(u[1:greatest(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))), 0) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, a, b, form, substr(t, 1, CAST(a AS BIGINT)) AS prefix, substr(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS middle, substr(t, CAST(b AS BIGINT) + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
