"""Token ids as raw binary shards with a minimal perfect hash index.

``write_store`` encodes every text with a byte-level BPE file of the tokenizers library, appends
an end id, and lays the ids out in ascending doc_id order as little-endian unsigned 32-bit
payloads. The file format is a folder of Parquet files, one row per shard: its place (part,
shard), the doc_ids and the number of ids of each document in payload order, the raw payload,
and the index: displacement seeds of a minimal perfect hash over the shard's distinct doc_ids,
which sends each key to a slot, and for each slot a 32-bit fingerprint of its key and the
key's place in the shard. A lookup hashes twice, compares the fingerprint and reads the
payload at the offset it finds. Shards are bounded in ids and documents; one longer document is a shard.

The byte-level pre-tokenizer never joins a letter or digit to a character of another kind, but for
a space in front and the apostrophe of an English ending, so texts are cut at such places and each
distinct piece is encoded once while a worker's store holds it. Pieces are merged by the file's own
vocabulary in tiktoken, which takes a fifth of the tokenizers library's time; where a file's merges
aren't in the order of its ids, or the two differ on pieces of the vocabulary, the library encodes
the pieces. Files with other pre-tokenizers or normalizers get whole texts from the library.

Null texts are empty (the end id only). Rows that repeat a doc_id stand next to each other and
are all stored; a key then finds the first. Rows with a null doc_id come first and have no key. An
empty table gives an empty store. Only the doc_id and text of a table are used, whatever else it has.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, partitions, per_worker, ragged, shared_dir, steps, tidy
from .words import WordIds

SHARD_IDS = 1 << 20
SHARD_DOCS = 1 << 13
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of bytes: 1 letters, 2 digits, 3 other marks, 4 the apostrophe, 5 white space but 6 the space, 0 others.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[39] = 3, 2, 1, 1, 4
_KIND[[9, 10, 13]], _KIND[32] = 5, 6
#: Between which kinds a text is cut.
_CUT = np.zeros((7, 7), bool)
_CUT[1, 2:] = _CUT[2, 1] = _CUT[2, 3:] = _CUT[3, [1, 2, 5, 6]] = _CUT[4, [5, 6]] = True
#: First bytes of characters that may follow a space without being white space.
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = _GRAPH[0xC3:0xE1] = _GRAPH[0xE4:0xF5] = True


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, and the end of the last one."""
    kind, cut = _KIND[data], np.ones(len(data) + 1, bool)
    if len(data):
        cut[1:-1] = _CUT[kind[:-1], kind[1:]]
        # before a space that goes with what follows
        cut[1:-1] |= np.append((kind[1:-1] == 6) & _GRAPH[data[2:]], False)
        # after a single white space that isn't a space
        alone = np.zeros(len(data), bool)
        alone[1:] = (kind[1:] == 5) & (kind[:-1] > 0) & (kind[:-1] < 5)
        cut[1:-1] |= alone[:-1] & (kind[1:] > 0) & (kind[1:] < 5)
    cut[off] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes the pieces of texts with a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tk = Tokenizer.from_file(path)
        says = json.loads(tk.to_str())
        before = says["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space") and not says["normalizer"]
        self.cuts &= not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in says["added_tokens"])
        self.added = [x["content"].encode() for x in says["added_tokens"]]
        marker = tk.encode(" a", add_special_tokens=False).tokens[0][0]
        size = tk.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(tk.id_to_token(i) or "").startswith(marker) for i in range(size)])
        self.words = WordIds(self.pieces)
        self.joined = self._joined(says["model"]) if self.cuts else None

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joined(self, bpe: dict):
        """What encodes a text of many pieces."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, merges = bpe["vocab"], [m if isinstance(m, str) else "".join(m) for m in bpe["merges"]]
        ids = [vocab[m.replace(" ", "")] for m in merges]
        if ids != sorted(ids) or bpe.get("type") != "BPE" or any(bpe.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return self._library
        # the file shows bytes as printable characters: those of one byte stand for themselves, the others follow from 256 on
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        assert {chr(b) for b in shown} <= set(ByteLevel.alphabet())
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = " ".join(t.decode() for t in list(ranks)[::16] if t.isascii() and t.decode().isalnum())
        return fast if fast(probe) == self._library(probe) else self._library

    def whole(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has). Those whose only space is their first byte go many as one text, cut at the spaces again."""
        n, begin, flat, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        plain = [i for i, w in enumerate(words) if w[:1] == b" " and w.rfind(b" ") == 0 and len(w) > 1]
        left = sorted({*range(len(words))} - {*plain})
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            got = np.array(self.joined(b"".join([words[i] for i in part]).decode()), np.int32)
            start = np.flatnonzero(self.spaced[got])
            if len(start) != len(part):
                left += part
                continue
            begin[part], n[part] = held + start, np.diff(np.append(start, len(got)))
            flat.append(got)
            held += len(got)
        for i, x in zip(left, self.whole([words[i].decode("utf-8", "replace") for i in left]), strict=True):
            begin[i], n[i] = held, len(x)
            flat.append(np.array(x, np.int32))
            held += len(x)
        return np.concatenate([*flat, np.zeros(0, np.int32)])[ragged(begin, n)], n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text)."""
        raw = data.tobytes()
        if not self.cuts or any(x in raw for x in self.added):
            ids = self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)])
            return np.concatenate([np.array(x, np.int32) for x in [*ids, []]]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        at = cuts(data, off)
        ids, n = self.words.ids(data, at[:-1], at[1:])
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, off)]


@per_worker
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ---------------------------------------------------------------- minimal perfect hash


def _hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    seed = np.asarray(seed, np.int64).astype(np.uint64)
    return mix(keys.view(np.uint64) ^ mix(seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32)


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Seeds, one per bucket of about four keys: a displacement, or -1-slot for a bucket of one key."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int32)
    buckets = max(1, n // 4)
    home = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(buckets + 1))
    size = np.diff(cut)
    seeds, taken = np.zeros(buckets, np.int32), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own, d = keys[order[cut[b] : cut[b + 1]]], 0
        while True:
            tries = np.arange(d + 1, d + 33)
            slot = (_hash(own[None], tries[:, None]) % np.uint64(n)).astype(np.int64)
            s = np.sort(slot, axis=1)
            good = ~taken[slot].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b] = tries[k]
                taken[slot[k]] = True
                break
            d += 32
    single = np.flatnonzero(size == 1)
    seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return seeds


def slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Where the hash sends keys, each to one of n slots; a key that isn't in the set goes to some slot, too."""
    s = seeds[(_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(s < 0, -1 - s.astype(np.int64), (_hash(keys, np.maximum(s, 0)) % np.uint64(n)).astype(np.int64))


class Shard:
    """Keyed access to one shard's payload."""

    def __init__(self, doc_ids, sizes: bytes, payload: bytes, seeds: bytes, prints: bytes, places: bytes):
        self.doc_ids, self.payload = doc_ids, payload
        self.begin = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))))
        self.seeds, self.prints, self.places = np.frombuffer(seeds, np.int32), np.frombuffer(prints, np.uint32), np.frombuffer(places, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the shard, -1 for those whose fingerprint isn't there."""
        if not len(self.seeds):
            return np.full(len(keys), -1, np.int64)
        s = slots(keys, self.seeds, len(self.prints))
        return np.where(self.prints[s] == fingerprints(keys), self.places[s].astype(np.int64), -1)

    def ids(self, place: int) -> bytes:
        return self.payload[4 * self.begin[place] : 4 * self.begin[place + 1]]


_SHARD_SQL = "part int, shard int, first_id long, last_id long, n_docs long, n_tokens long, doc_ids array<long>, sizes binary, payload binary, seeds binary, prints binary, places binary"
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((x, pa.int64()) for x in ("first_id", "last_id", "n_docs", "n_tokens")), ("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("sizes", "payload", "seeds", "prints", "places"))])


def _shard_row(part: int, shard: int, ids: list, sizes: np.ndarray, payload: bytes) -> pa.RecordBatch:
    keyed = [(d, i) for i, d in enumerate(ids) if d is not None and (i == 0 or ids[i - 1] != d)]
    keys, place = np.array([d for d, _ in keyed], np.int64), np.array([i for _, i in keyed], np.uint32)
    seeds = build_mph(keys)
    prints, places = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
    if len(keys):
        at = slots(keys, seeds, len(keys))
        prints[at], places[at] = fingerprints(keys), place
    row = [part, shard, int(keys[0]) if len(keys) else None, int(keys[-1]) if len(keys) else None, len(ids), int(sizes.sum(dtype=np.int64)), ids, sizes.astype(np.uint32).tobytes(), payload, seeds.tobytes(), prints.tobytes(), places.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD, strict=True)], schema=_SHARD)


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, docs, sizes, held = TaskContext.get().partitionId(), 0, [], [], []

        def row() -> pa.RecordBatch:
            return _shard_row(part, shard, docs, np.concatenate(sizes), b"".join(held))

        for b in batches:
            for first, last, data, off in steps(b.column(1)):
                ids, cut = encoder(path).encode(data, off)
                coded = np.insert(ids, cut[1:], end_id).astype("<u4")
                n, names, at = np.diff(cut) + 1, b.column(0).slice(first, last - first).to_pylist(), 0
                ends = np.concatenate(([0], np.cumsum(n)))
                while at < len(n):  # as many documents as the shard has room for
                    room = SHARD_IDS - sum(map(len, held)) // 4
                    to = min(int(np.searchsorted(ends, ends[at] + room, "right")) - 1, at + SHARD_DOCS - len(docs))
                    if to <= at and docs:
                        yield row()
                        shard, docs, sizes, held = shard + 1, [], [], []
                        continue
                    to = max(to, at + 1)
                    docs += names[at:to]
                    sizes.append(n[at:to])
                    held.append(coded[ends[at] : ends[to]].tobytes())
                    at = to
        if docs:
            yield row()

    return tidy(run, encoder)


def write_store(docs: DataFrame, path: str, out: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` with the tokenizer file ``path`` and write the store into the folder ``out``."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = own.repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    dealt.mapInArrow(_write(path, end_id), _SHARD_SQL).write.mode("errorifexists").option("compression", "zstd").parquet(out)


def _with_start(shards: DataFrame) -> DataFrame:
    """Shards and the ids before each: totals of parts (as many as partitions wrote them), then sums within a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own"))
    return own.join(parts, "part").select("part", "shard", (F.col("base") + F.col("own")).alias("shard_start"))


_DOC = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("shard", pa.int32())])


def _shard_of(row: dict) -> Shard:
    return Shard(row["doc_ids"], row["sizes"], row["payload"], row["seeds"], row["prints"], row["places"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            row = b.slice(i, 1).to_pylist()[0]
            s = _shard_of(row)
            keyed = np.array([d is not None for d in s.doc_ids], bool)
            place = np.arange(len(s.doc_ids))
            keys, which, times = np.unique(np.array([d for d in s.doc_ids if d is not None], np.int64), return_inverse=True, return_counts=True)
            found = s.find(keys)
            # of rows that repeat a key, the index finds the first; the others follow it
            place[keyed] = found[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            good = (found >= 0).all() and len(np.unique(place)) == len(place) and place.max(initial=0) < len(place)
            if not good or any(s.doc_ids[p] != d for p, d in zip(place.tolist(), s.doc_ids, strict=True)):
                raise ValueError(f"broken index in part {row['part']}, shard {row['shard']}")
            n = np.diff(s.begin)[place]
            crc = [zlib.crc32(s.ids(p)) for p in place]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((s.doc_ids, place, s.begin[:-1][place], n, crc, np.full(len(n), row["part"]), np.full(len(n), row["shard"])), _DOC, strict=True)], schema=_DOC)


def read_store(spark, out: str) -> DataFrame:
    """All documents of a store through its index: doc_id, start, n_tokens, ids_crc32, part, shard."""
    shards = spark.read.parquet(out)
    docs = shards.mapInArrow(tidy(_read_back), "doc_id long, place long, offset long, n_tokens long, ids_crc32 long, part int, shard int")
    return docs.join(_with_start(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def lookup(spark, out: str, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<long>) of those distinct keys that the store has.

    Parts of the store are ranges of keys, one for each task that wrote it, so their bounds are few:
    a key finds its part by them, then its shard among its part's. Only shards that are asked for
    are opened, each once.
    """
    shards = spark.read.parquet(out)
    asked = keys.select(F.col(doc_id).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    ranges = shards.where("first_id IS NOT NULL").select("part", "shard", "first_id", "last_id")
    parts = sorted((r["last"], r["part"]) for r in ranges.groupBy("part").agg(F.max("last_id").alias("last")).collect())
    ends, names = np.array([x for x, _ in parts], np.int64), np.array([x for _, x in parts], np.int32)

    def to_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            at = np.searchsorted(ends, key)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[at < len(ends)]]), pa.array(key[at < len(ends)])], names=["part", "key"])

    def to_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.sort_by([("last_id", "ascending"), ("shard", "ascending")])
        key = left["key"].to_numpy()
        at = np.searchsorted(own["last_id"].to_numpy(), key)  # the first that reaches the key
        in_one = at < len(own)
        key, at = key[in_one], at[in_one]
        has = own["first_id"].to_numpy()[at] <= key
        return pa.table({"part": own["part"].take(pa.array(at[has])), "shard": own["shard"].take(pa.array(at[has])), "key": pa.array(key[has], pa.int64())})

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s, own = _shard_of(row), np.array(row["keys"], np.int64)
                found = [(k, np.frombuffer(s.ids(p), "<u4").astype(np.int64)) for k, p in zip(own.tolist(), s.find(own), strict=True) if p >= 0 and s.doc_ids[p] == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    dealt = asked.mapInArrow(to_part, "part int, key long").groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(to_shard, "part int, shard int, key long")
    hits = dealt.groupBy("part", "shard").agg(F.collect_list("key").alias("keys"))  # at most as many as a shard has documents
    return shards.join(hits, ["part", "shard"]).mapInArrow(tidy(get), "doc_id long, ids array<long>")


def store_digests(docs: DataFrame, path: str) -> DataFrame:
    """Write a store into the shared folder and return its documents, read back through the index."""
    import uuid

    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_store(docs, path, out)
    return read_store(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")
