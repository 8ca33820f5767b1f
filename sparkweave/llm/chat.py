"""Chat formatting into packed prefix trees.

A conversation is its turns in order; each is written as ``<|turn|>role\\ntext<|end|>``. Strings that
look like control strings of this or another chat template are escaped inside roles and texts,
reversibly. Conversations are sorted by their turns, so that those which share their first turns are
neighbours, and packed into sequences of bounded length. In a pack the conversations are a prefix
tree: shared turns are written once, depth first; every turn (node) has its span in the pack's
text, its position ids' start (the length of its ancestors), the intervals it may attend to
(itself and its ancestors, adjacent ones joined), and, for assistants, the span of its text under the loss mask.

Null roles and texts are empty. Turns of a conversation are ordered by (turn, role, text), nulls
first, so ties and repeated rows have a fixed place, and all are kept. Each row with a null conv_id is
a conversation of its own. Units are code points. A conversation is held whole by one task. An empty
table gives an empty one; columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy

TURN, END = "<|turn|>", "<|end|>"
PACK_CHARS, PACK_CONVERSATIONS = 1 << 16, 512
#: Control strings of this and of widely used templates.
CONTROL = re.compile(r"<\|[^<>|]*\|>|</?s>|<<SYS>>|<</SYS>>|\[/?INST\]|<unk>|<pad>|</?(?:start|end)_of_turn>")
_ESCAPED = re.compile(r"\\([\\lbn])")
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_SQL = (
    "pack string, text string, "
    "nodes array<struct<parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, "
    "members array<struct<conv_id:long,leaf:int>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([*((x, pa.int32()) for x in ("parent", "start", "end", "position", "loss_start", "loss_end")), ("attends", pa.list_(_SPAN))])
_PACK = pa.schema([("pack", pa.string()), ("text", pa.string()), ("nodes", pa.list_(_NODE)), ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])


def escape(text: str, line: bool = False) -> str:
    text = CONTROL.sub(lambda m: ("\\l" if m[0][0] == "<" else "\\b") + m[0][1:], text.replace("\\", "\\\\"))
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


class Pack:
    """A prefix tree that grows by conversations in sorted order."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.members, self.path = [], 0, [], [], []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        k = 0
        while k < len(self.path) and k < len(turns) and self.path[k][0] == turns[k]:
            k += 1
        return k

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            head, body = f"{TURN}{escape(role, True)}\n", escape(text)
            parent = self.path[-1][1] if self.path else -1
            start, end = self.size, self.size + len(head) + len(body) + len(END)
            above = self.nodes[parent] if self.path else None
            spans = [dict(s) for s in above["attends"]] if above else []
            if spans and spans[-1]["end"] == start:
                spans[-1]["end"] = end
            else:
                spans.append({"start": start, "end": end})
            mask = (start + len(head), end - len(END)) if role == "assistant" else (None, None)
            position = above["position"] + above["end"] - above["start"] if above else 0
            self.nodes.append({"parent": parent, "start": start, "end": end, "position": position, "loss_start": mask[0], "loss_end": mask[1], "attends": spans})
            self.parts += (head, body, END)
            self.size = end
            self.path.append(((role, text), len(self.nodes) - 1))
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def row(self, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, "".join(self.parts), self.nodes, self.members), _PACK, strict=True)], schema=_PACK)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, pack = TaskContext.get().partitionId(), 0, Pack()
    for b in batches:
        for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            turns = [(t["role"], t["text"]) for t in turns]
            more = sum(len(r) + len(t) + 20 for r, t in turns[pack.shared(turns) :])
            if pack.members and (pack.size + more > PACK_CHARS or len(pack.members) >= PACK_CONVERSATIONS):
                yield pack.row(f"{part}-{number}")
                number, pack = number + 1, Pack()
            pack.add(conv_id, turns)
    if pack.members:
        yield pack.row(f"{part}-{number}")


def format_chats(conversations: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Packs of conversations (conv_id, turn, role, text): pack, text, nodes, members. Rows that differ in ``apart`` belong to different ones."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), *apart).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("order", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    dealt = whole.repartitionByRange(partitions(conversations.sparkSession), "order", "conv_id").sortWithinPartitions("order", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(tidy(_packs), _SQL)


_READ = pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss", pa.list_(pa.string())), ("formatted_chars", pa.int64())])
_TURN = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END), re.S)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in b.to_pylist():
            rows = []
            for m in p["members"]:
                path, node = [], m["leaf"]
                while node >= 0:
                    path.append(p["nodes"][node])
                    node = path[-1]["parent"]
                path.reverse()
                text = "".join(p["text"][s["start"] : s["end"]] for s in path[-1]["attends"]) if path else ""
                turns = [{"role": unescape(r), "text": unescape(t)} for r, t in _TURN.findall(text)]
                loss = [unescape(p["text"][n["loss_start"] : n["loss_end"]]) for n in path if n["loss_start"] is not None]
                rows.append((m["conv_id"], turns, loss, len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_chats(packs: DataFrame) -> DataFrame:
    """Each conversation, read back from its leaf's attention intervals: conv_id, turns, loss (texts under the mask), formatted_chars."""
    return packs.mapInArrow(tidy(_unpack), "conv_id long, turns array<struct<role:string,text:string>>, loss array<string>, formatted_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        conv, turns, loss, chars = (b.column(i).to_pylist() for i in range(4))
        said = ["".join(f"{t['role']}\n{t['text']}\n" for t in x) for x in turns]
        lost = ["".join(x) for x in loss]
        sha = lambda xs: pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array([len(x) for x in turns], pa.int64()), sha(said), pa.array([len(x) for x in lost], pa.int64()), sha(lost), pa.array(chars, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(conversations: DataFrame) -> DataFrame:
    """All conversations and number -1, whose texts are control strings, formatted, packed and read back."""
    spark, said = conversations.sparkSession, "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("added", F.lit(False)).unionByName(extra.withColumn("added", F.lit(True)))
    packs = format_chats(rows, apart=("added",))
    return read_chats(packs).mapInArrow(tidy(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
