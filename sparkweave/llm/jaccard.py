"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Every shingle is a 64-bit token; XOR-ing
tokens into bit cells gives a parity sketch, and the Hamming distance of two sketches is at most
the symmetric difference of the two sets. With J >= t a pair's symmetric difference is at most
(|A|+|B|)(1-t)/(1+t); so, for each band of sizes, the token space is cut into more cells than
that bound, and a linked pair agrees in the XOR of at least one cell (pigeonhole). Cells that
are empty in both sets could be the only ones that agree; only documents with that many empty
cells send keys for them, so the join misses no pair.

Steps: (1) one row per document with set size, 128-bit set fingerprint and sketch; equal sets
become one class. (2) keys of cells, packed per task and bucket, meet in a bucket; each key group
proposes its least member with every other one, small groups all pairs. (3) sketches reject, the
shingle sets of the rest are compared whole. (4) in the larger groups, members that are still in
different components are compared, too, in blocks. No cap on groups or candidates. Shingles are
compared by 64-bit hashes of their words.

The links that come out connect the components; pairs of a component that other links connect
already aren't compared.

Null, empty and word-less texts have an empty set and no links. Rows that repeat a doc_id are
rows of their own, also with different texts: classes are named by their sets. Null doc_ids take no
part in links and get a null component. An empty table gives an empty one. Only the doc_id and text
of a table are used, whatever other columns it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, batch, mix, partitions, ragged, steps, stored, tidy, tidy_group
from .graph import components
from .words import names

#: Upper end of a size band over its lower end.
BAND = 1.6
#: Key groups up to this size propose all pairs at once.
ALL_PAIRS = 6
#: Members of a key group that one task compares with each other.
BLOCK = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased in A-Z, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    gap = WORD_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:n]
    end = ~gap
    end[:-1] &= gap[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return names(_LOWER[data], s, e + 1 - s), np.searchsorted(s, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle tokens of each text, and where each text's tokens begin."""
    w, first = word_hashes(data, off)
    count = np.diff(first)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(number)))
    at = ragged(first[:-1], number)
    full = np.repeat(count >= width, number)
    h = np.full(len(at), np.uint64(width))
    for k in range(width):
        h[full] = mix(h[full] * np.uint64(31) + w[at[full] + k])
    for d in np.flatnonzero((count > 0) & (count < width)):
        x = np.full(1, np.uint64(count[d]))
        for k in range(first[d], first[d + 1]):
            x = mix(x * np.uint64(31) + w[k : k + 1])
        h[begin[d]] = x[0]
    for d in np.flatnonzero(number > 1):
        h[begin[d] : begin[d + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][number > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[begin]


def fold(op, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """op.reduce over each text's values; 0 where it has none."""
    out, some = np.zeros(len(begin) - 1, np.uint64), np.diff(begin) > 0
    if some.any():
        out[some] = op.reduceat(values, begin[:-1][some])
    return out


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Cells of a sketch: the power of two from 4n, 64 at least, so that few differing tokens share a cell."""
    return np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64))


def sketches(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Parity of the tokens in each cell, by the tokens' low bits."""
    bits = sketch_bits(np.diff(begin))
    base = np.concatenate(([0], np.cumsum(bits)))
    low = h & np.repeat((bits - 1).astype(np.uint64), np.diff(begin))
    cell = np.repeat(base[:-1], np.diff(begin)) + low.astype(np.int64)
    packed = np.packbits((np.bincount(cell, minlength=base[-1]) & 1).astype(np.uint8))
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


def hamming_to(one: bytes, many: np.ndarray) -> np.ndarray:
    """Distances of a sketch to rows of sketches of at most its length (halves XOR-ed together)."""
    x = np.frombuffer(one, np.uint8)
    while len(x) > many.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.bitwise_count(many ^ x).sum(axis=1, dtype=np.int64)


def pair_hamming(a: bytes, b: bytes) -> int:
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    return int(hamming_to(x, np.frombuffer(y, np.uint8)[None])[0])


# ---------------------------------------------------------------- size bands and cells


def bands(t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands; the largest symmetric difference of a pair whose larger set is in the band; cells."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * BAND)))
    low = np.array(low, np.int64)
    most = np.floor(2 * (low[1:] - 1) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)
    return low, most, most + 1 + np.ceil(0.03 * most).astype(np.int64)


def cell_keys(h: np.ndarray, begin: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for the cells of each text, at its own band and, if it may be the smaller one there, the next."""
    low, most, cells = bands(t)
    n = np.diff(begin)
    own = np.searchsorted(low, n, "right") - 1
    texts, keys = [], []
    for up in (0, 1):
        level = own + up
        take = np.flatnonzero((n > 0) & ((up == 0) | (n >= np.floor(low[level] * t - 1e-9))))
        if not len(take):
            continue
        at = ragged(begin[take], n[take])
        of = np.repeat(take, n[take])
        m = cells[level][of].astype(np.uint64)
        cell = ((h[at] >> np.uint64(32)) * m) >> np.uint64(32)
        cut = np.ones(len(at), bool)
        cut[1:] = (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])
        s = np.flatnonzero(cut)
        x = np.bitwise_xor.reduceat(mix(h[at]), s)
        texts.append(of[s])
        keys.append(mix(x ^ mix(level[of[s]].astype(np.uint64) << np.uint64(40) | cell[s])))
        # of the pairs of a text, the largest symmetric difference; if so many cells are empty, they count as keys
        full = np.bincount(of[s], minlength=len(n))[take]
        k, size = level[take], n[take]
        other = np.minimum(low[k + 1] - 1, np.floor(size / t + 1e-9).astype(np.int64))
        diff = np.floor((size + other) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)
        for i in np.flatnonzero(cells[k] - full > cells[k] - diff - 1):
            d = take[i]
            have = cell[s][of[s] == d]
            none = np.setdiff1d(np.arange(cells[k[i]], dtype=np.uint64), have)
            texts.append(np.full(len(none), d))
            keys.append(mix(mix(np.uint64(k[i]) << np.uint64(40) | none) ^ np.uint64(0x5851F42D4C957F2D)))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(keys)


# ---------------------------------------------------------------- tasks

SET_SCHEMA = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"
_SET = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary())])


def _prints(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fold(np.bitwise_xor, mix(h), begin).view(np.int64), fold(np.add, mix(h ^ np.uint64(_BASE)), begin).view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, off in steps(b.column(1)):
                h, begin = shingle_sets(data, off, width)
                yield batch(_SET, b.column(0).slice(at, to - at), np.diff(begin), *_prints(h, begin), sketches(h, begin))

    return run


_KEYS = pa.schema([("bucket", pa.int32()), ("prints", pa.binary()), ("runs", pa.binary()), ("keys", pa.binary())])


def _keys(width: int, t: float, buckets: int):
    """Packs a batch's keys by bucket: fingerprints, how many keys each has, the keys. Copies within the batch go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, keys = [], []
            seen = np.zeros(0, np.int64)
            for _, _, data, off in steps(b.column(0)):
                h, begin = shingle_sets(data, off, width)
                f1, _ = _prints(h, begin)
                _, first = np.unique(f1, return_index=True)
                new = np.zeros(len(f1), bool)
                new[first] = True
                new &= ~np.isin(f1, seen) & (np.diff(begin) > 0)
                seen = np.concatenate((seen, f1[new]))
                d, k = cell_keys(h, begin, t)
                use = new[d]
                prints.append(f1[d[use]])
                keys.append(k[use])
            p, k = np.concatenate(prints or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])
            if not len(k):
                continue
            to = ((k >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((p, to))
            p, k, to = p[order], k[order], to[order]
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            rows = []
            for s, e in zip(cut, [*cut[1:], len(k)], strict=True):
                start = np.flatnonzero(np.concatenate(([True], p[s + 1 : e] != p[s : e - 1])))
                runs = np.diff(np.append(start, e - s)).astype(np.uint32)
                rows.append((to[s], p[s:e][start].tobytes(), runs.tobytes(), k[s:e].tobytes()))
            yield batch(_KEYS, *(list(x) for x in zip(*rows, strict=True)))

    return run


_GROUPS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("members", pa.list_(pa.int64()))])


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket: proposed pairs, and the member lists of the groups that proposed only a star."""
    p = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(r, np.uint32)) for x, r in zip(table["prints"].to_pylist(), table["runs"].to_pylist(), strict=True)])
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    order = np.argsort(k)
    p, k = p[order], k[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    p, k = p[same], k[same]
    order = np.lexsort((p, k))
    p, k = p[order], k[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    p, k = p[new], k[new]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    start, size = start[size > 1], size[size > 1]
    left, right, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for g in range(2, ALL_PAIRS + 1):
        s = start[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                left.append(p[s + i])
                right.append(p[s + j])
    for s, g in zip(start[size > ALL_PAIRS], size[size > ALL_PAIRS], strict=True):
        members = p[s : s + g]
        if lists.setdefault(hash(members.tobytes()), members) is members:
            left.append(np.repeat(members[:1], g - 1))
            right.append(members[1:])
    pair = np.stack((np.concatenate(left), np.concatenate(right)), axis=1)
    pair = np.unique(pair, axis=0) if len(pair) else pair
    n, m = len(pair), len(lists)
    return pa.table([pa.concat_arrays([pa.array(pair[:, 0]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(pair[:, 1]), pa.nulls(m, pa.int64())]), pa.array([None] * n + list(lists.values()), pa.list_(pa.int64()))], schema=_GROUPS)


def _near(t: float):  # a, b, sizes and sketches in the order of _sketched
    """Drops pairs whose sizes or sketches show that they are too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            most = np.floor((na + nb) * (1 - t) / (1 + t) + 1e-9)
            ok = np.abs(na - nb) <= most
            sa, sb = b.column(3), b.column(5)
            for i in np.flatnonzero(ok):
                ok[i] = pair_hamming(sa[i].as_py(), sb[i].as_py()) <= most[i]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(width: int, t: float):
    """Of one room: the host's text against each guest's, exactly."""

    def run(table: pa.Table) -> pa.Table:
        host, want = table["host"].to_pylist(), table["f1"].to_numpy()
        room, links = None, []
        sets = []
        for at, _, data, off in steps(table["text"].combine_chunks()):
            h, begin = shingle_sets(data, off, width)
            f1, _ = _prints(h, begin)
            for i in range(len(off) - 1):
                if f1[i] == want[at + i]:  # not the text of another row of the same doc_id
                    if host[at + i]:
                        room = (want[at + i], h[begin[i] : begin[i + 1]].copy())
                    else:
                        sets.append((want[at + i], h[begin[i] : begin[i + 1]].copy()))
        if room:
            for d, x in sets:
                both = np.intersect1d(x, room[1], assume_unique=True).size
                if both >= t * (len(x) + len(room[1]) - both) - 1e-9:
                    links.append((room[0], d))
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=_LINK)

    return run


def _blocks(t: float):
    """Of one block pair of a key group: pairs from different components that the sketches leave open.

    A pair that sits together in several groups is proposed by the first of them only; ``groups``
    has, for each member, its groups before this one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").sort_values("n_shingles", kind="stable")
        groups = [np.asarray(x) for x in pdf["groups"]]
        n, comp, rep = (pdf[c].to_numpy() for c in ("n_shingles", "comp", "rep"))
        sk, out = pdf["sketch"].tolist(), []
        lens = np.array([len(x) for x in sk])
        cuts = {w: np.frombuffer(b"".join(x for x in sk if len(x) == w), np.uint8).reshape(-1, w) for w in set(lens.tolist())}
        where = {w: np.flatnonzero(lens == w) for w in cuts}
        for i in range(len(n)):  # i is the larger set
            for w, rows in where.items():
                if w <= lens[i]:
                    use = (rows < i) & (n[rows] >= t * n[i] - 1e-9) & (comp[rows] != comp[i])
                    if use.any():
                        far = hamming_to(sk[i], cuts[w][use])
                        hit = rows[use][far <= np.floor((n[rows[use]] + n[i]) * (1 - t) / (1 + t) + 1e-9)]
                        if len(hit):
                            others = np.concatenate([groups[j] for j in hit])
                            of = np.repeat(np.arange(len(hit)), [len(groups[j]) for j in hit])
                            both = np.isin(others, groups[i])
                            hit = np.delete(hit, np.unique(of[both]))
                        out += [(min(rep[i], rep[j]), max(rep[i], rep[j])) for j in hit]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


# ---------------------------------------------------------------- the join


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: doc_id, n_shingles, component_id, one row per row of ``docs``. links: a, b, the
    verified pairs between class representatives (the least doc_id of equal sets) that connect
    the components, so not all pairs of a component; equal sets share their representative.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    t = float(threshold)
    sets = stored(own.mapInArrow(tidy(_sets(width)), SET_SCHEMA), "sets")
    reps = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles")
    reps = stored(reps.agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "reps")

    size = partitions(spark) * 4
    packed = own.select("text").mapInArrow(tidy(_keys(width, t, size)), "bucket int, prints binary, runs binary, keys binary")
    found = stored(packed.groupBy("bucket").applyInArrow(tidy_group(_groups), "a long, b long, members array<long>"), "keys")

    pairs = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(own, reps, _sketched(pairs, reps), t, width)

    # the rest of the larger groups: members that no link has brought together yet, pair by pair in blocks
    now = components(links)
    groups = found.where("members IS NOT NULL").select(F.xxhash64("members").alias("g"), F.size("members").alias("size"), F.explode("members").alias("f1"))
    sets_of = reps.select(F.col("f1").alias("rep"), "n_shingles", "sketch")
    seats = groups.withColumnRenamed("f1", "rep").join(sets_of.select("rep"), "rep").join(now, F.col("rep") == F.col("node"), "left")
    seats = stored(seats.select("g", "size", "rep", F.coalesce("component", "rep").alias("comp")).distinct(), "seats")
    apart = seats.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g")
    seats = stored(_numbered(seats, apart), "apart")
    member = seats.groupBy("rep").agg(F.collect_list("g").alias("groups"))  # at most as many as a set has cells
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    seats = seats.withColumn("x", F.pmod(F.hash("rep"), count)).withColumn("y", F.explode(F.sequence(F.lit(0), count - 1)))
    seats = seats.select("g", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "rep", "comp")
    seats = seats.join(sets_of.join(member, "rep"), "rep").select("g", "x", "y", "rep", "comp", "n_shingles", "sketch", F.filter("groups", lambda k: k < F.col("g")).alias("groups"))
    more = seats.groupBy("g", "x", "y").applyInPandas(_blocks(t), "a long, b long").distinct()
    links = links.union(_verified(own, reps, more, t, width, near=False))
    now = components(links)
    label = reps.join(now, F.col("f1") == F.col("node"), "left").select("f1", "f2", "n_shingles", "rep", F.coalesce("component", "f1").alias("c"))
    least = label.groupBy("c").agg(F.min("rep").alias("component_id"))
    out = sets.join(label.join(least, "c").drop("c", "rep"), ["f1", "f2", "n_shingles"], "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    for x in "ab":
        links = links.withColumnRenamed(x, "f1").join(reps.select("f1", F.col("rep").alias(x)), "f1").drop("f1")
    return out.select("doc_id", "n_shingles", whole.alias("component_id")), links.select("a", "b")


def _numbered(seats: DataFrame, apart: DataFrame) -> DataFrame:
    """``seats`` of the groups in ``apart``, with small numbers for the groups' hashes: members carry lists of them."""
    dealt = partitions(seats.sparkSession)
    place = F.row_number().over(Window.partitionBy("p").orderBy("g")).cast("long")
    names = apart.withColumn("p", F.pmod("g", F.lit(dealt))).select("g", (place * dealt + F.col("p")).alias("k"))
    names = stored(names, "groups")
    kind = "int" if (names.agg(F.max("k")).first()[0] or 0) < 2**31 else "long"
    return seats.join(names, "g").select(F.col("k").cast(kind).alias("g"), "size", "rep", "comp")


def _sketched(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs with the sizes and sketches of both."""
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("f1").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    return pairs.select("a", "b", "na", "sa", "nb", "sb")


def _verified(own: DataFrame, reps: DataFrame, pairs: DataFrame, t: float, width: int, near: bool = True) -> DataFrame:
    """Links among ``pairs``: the sketches reject first, then the texts meet in rooms, a host and some of its guests each."""
    spark = own.sparkSession
    if near:
        pairs = pairs.mapInArrow(tidy(_near(t)), "a long, b long").distinct()
    pairs = stored(pairs, "pairs")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 256))
    rooms = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", salt.alias("salt"))
    guests = rooms.select(F.col("b").alias("f1"), F.col("a").alias("room"), "salt", F.lit(False).alias("host"))
    hosts = rooms.select(F.col("a").alias("f1"), F.col("a").alias("room"), "salt", F.lit(True).alias("host")).distinct()
    visits = guests.union(hosts).join(reps.select(F.col("rep").alias("doc_id"), "f1"), "f1")
    seated = own.where("doc_id IS NOT NULL").join(visits, "doc_id").select("room", "salt", "host", "f1", "text")
    links = seated.groupBy("room", "salt").applyInArrow(tidy_group(_verify(width, t)), "a long, b long")
    return stored(links.repartition(max(1, partitions(spark) // 4)), "links")
