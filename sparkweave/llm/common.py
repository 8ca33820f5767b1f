"""Shared helpers of the training-data operators.

Everything that leaves a task goes through Spark's readers and writers; intermediate
tables are written below ``spark.checkpoint.dir`` so that they outlive any executor.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a single longer text is a step of its own).
STEP_BYTES = 2 << 20
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class _Freed:
    """While open, Spark removes a query's shuffle files when the query ends, not when the driver collects its garbage.

    Sessions may write from several threads: the first to enter notes the setting, the last to leave puts it back.
    """

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self):
        self.lock, self.open, self.before = threading.Lock(), 0, "false"

    def enter(self, spark: SparkSession) -> None:
        with self.lock:
            if not self.open:
                self.before = spark.conf.get(self.KEY)
                spark.conf.set(self.KEY, "true")
            self.open += 1

    def leave(self, spark: SparkSession) -> None:
        with self.lock:
            self.open -= 1
            if not self.open:
                spark.conf.set(self.KEY, self.before)


_freed: dict[int, _Freed] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives executors.

    Once the table is there, nothing reads the shuffles that made it, so they go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = _freed.setdefault(spark._jsparkSession.hashCode(), _Freed())
    held.enter(spark)
    try:
        df.write.parquet(path)
    finally:
        held.leave(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote for tables that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.pop("_folder", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


#: What this Python worker holds between tasks.
_held: list = []


def per_worker(make: Callable) -> Callable:
    """``make(path)``, kept by a worker from task to task for as long as its tasks say that they use it."""
    kept = functools.lru_cache(2)(make)
    _held.append(kept)
    return kept


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable, uses: Callable | None = None) -> Callable:
    """``run`` over batches in a Python worker, which gives freed memory back to the machine when the task ends.

    What the worker held for other operators goes before the task starts; ``uses`` names what it may go on holding.
    """

    @functools.wraps(run)
    def tidied(batches):
        for kept in _held:
            if kept is not uses:
                kept.cache_clear()
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def tidy_group(run: Callable, size: int = 8 << 20) -> Callable:
    """``run`` over one group as an Arrow table; freed memory goes back after groups of ``size`` bytes and more."""

    @functools.wraps(run)
    def tidied(table):
        try:
            return run(table)
        finally:
            if table.nbytes >= size:
                _trim()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, mod: int):
    """crc32 of an id written as decimal text, modulo ``mod`` (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one row."""
    data, off = text_bytes(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def windows(data: np.ndarray, off: np.ndarray, before: int, after: int = 0, limit: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first own byte, end of own bytes): a step as it is, or the windows of one long text with some bytes around each."""
    n = len(data)
    if n <= limit or len(off) > 2:
        yield data, off, 0, n
        return
    for a in range(0, n, limit):
        b, low, high = min(a + limit, n), max(0, a - before), min(n, a + limit + after)
        yield data[low:high], np.array([0, high - low]), a - low, b - low


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Of all groups at most so many can be larger than rows / HOT.
HOT = 4096


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, ``groups`` having a row per group and its number of rows in ``size``.

    A group may hold a third of all rows. Groups larger than ``total`` / HOT are fewer than HOT, so they are sent to all
    tasks and their rows stay where they are; only the others' rows are shuffled.
    """
    hot, rest = groups.where(F.col(size) > total / HOT), groups.where(F.col(size) <= total / HOT)
    near = rows.join(F.broadcast(hot), keys)  # fewer than HOT rows
    return near.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def appended(df: DataFrame, source: str, fields: list, make, uses: Callable | None = None) -> DataFrame:
    """``df`` with more columns, made from the string column ``source`` in steps of bounded size.

    ``make(bytes, offsets)`` gives an array for each of ``fields`` (StructFields). Columns of ``df``
    that have the name of a new one are replaced.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.drop(*(f.name for f in fields))
    at, schema = df.columns.index(source), T.StructType([*df.schema.fields, *fields])
    kinds, names = [to_arrow_type(f.dataType) for f in fields], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in steps(b.column(at)):
                new = [pa.array(x, k) for x, k in zip(make(data, off), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(first, end - first).columns, *new], names=names)

    return df.mapInArrow(tidy(run, uses), schema)
