"""Lookups of grams in tables that no worker could hold.

Texts go into blocks of bounded size. Each block's distinct grams are joined to the table by a
shuffle, and the answers meet the block's texts again. A frequent gram is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch, steps, stored, tidy
from .ngrams import Index

#: What a block holds at most (a single longer text is a block of its own).
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 20_000
_BLOCKS = pa.schema([("_block", pa.int64()), ("rows", pa.binary())])
_WANTED = pa.schema([("_block", pa.int64()), ("gram", pa.int64())])


def _packed(parts: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        for p in parts:
            to.write_batch(p)
    return out.getvalue().to_pybytes()


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def blocked(docs: DataFrame, text: str) -> DataFrame:
    """(_block, rows): the rows of ``docs``, compressed, one row a block; written once, so that the numbers stay what they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for b in batches:
            for first, end, data, _ in steps(b.column(at)):
                n = end - first
                if parts and (held + len(data) > BLOCK_BYTES or rows + n > BLOCK_ROWS):
                    yield batch(_BLOCKS, [number], [_packed(parts)])
                    number, held, rows, parts = number + 1, 0, 0, []
                held, rows = held + len(data), rows + n
                parts.append(b.slice(first, n))
        if parts:
            yield batch(_BLOCKS, [number], [_packed(parts)])

    return stored(docs.mapInArrow(tidy(run), "_block long, rows binary"), "blocks")


def wanted(blocks: DataFrame, text: str, grams) -> DataFrame:
    """(_block, gram): the distinct ones of what ``grams(bytes, offsets)`` gives in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, rows in zip(b.column(0).to_pylist(), b.column(1)):
                parts = [np.unique(grams(data, off)) for *_, data, off in steps(_unpacked(rows).column(text))]
                own = np.unique(np.concatenate(parts)).astype(np.int64)
                for i in range(0, len(own), 100_000):
                    part = own[i : i + 100_000]
                    yield batch(_WANTED, np.full(len(part), number), part)

    return blocks.mapInArrow(tidy(run), "_block long, gram long")


def answered(docs: DataFrame, blocks: DataFrame, answers: DataFrame, text: str, fields: list, make) -> DataFrame:
    """``docs``, from their blocks, with more columns: ``make(bytes, offsets, index of grams, their values)`` gives them.

    ``answers``: _block, gram, value (a number, or an array of one length).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*docs.schema.fields, *fields])
    kinds, names = [to_arrow_type(f.dataType) for f in fields], schema.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = right.column("gram").to_numpy().astype(np.uint64)
        value = right.column("value").combine_chunks()
        value = value.flatten().to_numpy(zero_copy_only=False).reshape(len(grams), -1) if pa.types.is_list(value.type) else value.to_numpy(zero_copy_only=False)
        index, parts = Index(grams), []
        for packed in left.column("rows"):
            rows = _unpacked(packed)
            for first, end, data, off in steps(rows.column(text)):
                new = [pa.chunked_array([pa.array(x, k)]) for x, k in zip(make(data, off, index, value), kinds, strict=True)]
                parts.append(pa.table([*rows.slice(first, end - first).columns, *new], names=names))
        return pa.concat_tables(parts)

    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, schema)
