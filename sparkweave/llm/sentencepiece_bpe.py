"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The model file gives pieces and scores. Spaces become U+2581 and one is put in front of a text
that isn't empty (identity normalisation with dummy prefix, as the model file says). Texts fall into
independent words between characters that are neighbours in no piece, as before spaces. The distinct
words of a batch lie in one flat numpy array of symbols; in each round every word finds the least rank
among its adjacent pairs (segmented minimum), merges the leftmost occurrences of that rank
together, and is compacted; words without a pair leave the array. A word stops a round early
where a merge makes a pair of the same or a better rank, so the order of merges is the same as
one at a time. Characters outside the vocabulary become their UTF-8 byte pieces.

Decoding joins the pieces' bytes by table; texts with bytes that make no characters, or with control
pieces, are left to the library.

Null texts encode as empty, empty texts have no ids. Rows are independent of each other, so
repeated rows, ties and extra columns pass through unchanged; an empty table gives an empty one.
A column of the table that has the name of a new one (``ids``, ``decoded``) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, appended, per_worker, ragged, tidy
from .ngrams import Index
from .words import WordIds

SPACE = "▁"
_INF = np.iinfo(np.int32).max


class PieceModel:
    """Pieces, ranks and the table of pairs that merge, taken from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        known = {pieces[i]: i for i in plain}
        # which bytes follow each other in some piece; nothing merges across others
        self.joint = np.zeros((256, 256), bool)
        for p in known:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.joint[raw[:-1], raw[1:]] = True
        self.joint[:, 0x80:0xC0] = True
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.of_char = np.arange(0x110000, dtype=np.int32) + n
        for p, i in known.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = {-s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs = sorted((known[p[:k]] * n + known[p[k:]], i, scores[-sp.get_score(i)]) for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        pair, merged, rank = (np.array(x, d) for x, d in zip(zip(*pairs, strict=True), (np.uint64, np.int32, np.int32), strict=True))
        self.pair, self.merged, self.rank = Index(pair), merged, rank
        shown = [bytes.fromhex(p[3:5]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.odd = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) and shown[i] == b" " for i in range(n)])
        # a filter before the search: most adjacent symbols form no pair
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(pair)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of symbol pairs; rank _INF where they don't merge."""
        rank, merged = np.full(len(left), _INF, np.int32), np.zeros(len(left), np.int32)
        at = np.flatnonzero((left < self.size) & (right < self.size))
        key = left[at].astype(np.int64) * self.size + right[at]
        some = self.maybe[self._slot(key)]
        at, key = at[some], key[some]
        k = self.pair.find(key.astype(np.uint64))
        hit = k >= 0
        rank[at[hit]], merged[at[hit]] = self.rank[k[hit]], self.merged[k[hit]]
        return rank, merged

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, how many each has); a space in a word stands for U+2581."""
        raw = b"".join(words)
        char = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        size = np.diff(starts[np.concatenate(([0], ends))])
        sym = self.of_char[np.where(char == 0x20, np.uint32(ord(SPACE)), char)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        rank, merged = self._ranks(sym, word)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, start)
            run = np.diff(np.append(start, len(sym)))
            live = np.repeat(least < _INF, run)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, merged = sym[live], word[live], rank[live], merged[live]
                least, run = least[least < _INF], run[least < _INF]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(least, run))
            # of overlapping picks, every other one from the left
            chain = np.cumsum(np.concatenate(([True], np.diff(pick) != 1)))
            first = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
            pick = pick[(np.arange(len(pick)) - first[chain - 1]) % 2 == 0]
            pick = self._in_order(sym, word, rank, merged, pick)
            sym[pick] = merged[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[pick] = True
            moved[pick[pick > 0] - 1] = True
            sym, word, rank, merged, moved = sym[keep], word[keep], rank[keep], merged[keep], moved[keep]
            # where the left neighbour had itself been merged away, its first symbol is the neighbour
            moved[:-1] |= moved[1:]
            self._refresh(sym, word, rank, merged, np.flatnonzero(moved))
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(sym), _INF, np.int32), np.zeros(len(sym), np.int32)
        self._refresh(sym, word, rank, merged, np.arange(len(sym)))
        return rank, merged

    def _refresh(self, sym, word, rank, merged, at) -> None:
        rank[at] = _INF
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        rank[at], merged[at] = self.lookup(sym[at], sym[at + 1])

    def _in_order(self, sym, word, rank, merged, pick) -> np.ndarray:
        """Drops a word's picks after the first that makes a pair which goes before the next pick."""
        taken = np.zeros(len(sym), bool)
        taken[pick] = True
        new, bad = merged[pick], np.zeros(len(pick), bool)
        has = (pick > 0) & (word[pick] == word[pick - 1])
        p = pick[has]
        left = np.where((p > 1) & taken[p - 2], merged[p - 2], sym[p - 1])
        bad[has] = self.lookup(left, new[has])[0] <= rank[p]
        has = pick + 2 < len(sym)
        has[has] = word[pick[has]] == word[pick[has] + 2]
        bad[has] |= self.lookup(new[has], sym[pick[has] + 2])[0] <= rank[pick[has]]
        if not bad.any():
            return pick
        w = word[pick]
        group = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        earlier = np.cumsum(bad) - bad
        base = np.repeat(earlier[group], np.diff(np.append(group, len(w))))
        return pick[earlier == base]

    def _with_bytes(self, sym, word, n) -> tuple[np.ndarray, np.ndarray]:
        out = np.flatnonzero(sym >= self.size)
        if len(out):
            odd, back = np.unique(sym[out] - self.size, return_inverse=True)
            coded = [self.bytes[list(chr(c).encode("utf-8", "replace"))] for c in odd]
            lens = np.ones(len(sym), np.int64)
            lens[out] = np.array([len(x) for x in coded])[back]
            ends = np.cumsum(lens)
            flat = np.repeat(sym, lens)
            flat[ragged(ends[out] - lens[out], lens[out])] = np.concatenate([coded[i] for i in back])
            sym, word = flat, np.repeat(word, lens)
        return sym, np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str | None]:
        """The text of each run of ids; None where it has control pieces or bytes that make no characters."""
        n = self.shown_size[ids]
        raw = self.shown[ragged(self.shown_at[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[off].tolist()
        odd = np.diff(np.concatenate(([0], np.cumsum(self.odd[ids])))[off]).tolist()
        out = []
        for a, b, bad in zip(ends[:-1], ends[1:], odd, strict=True):
            try:  # the space put in front of a text goes again
                out.append(None if bad else raw[a + (raw[a : a + 1] == b" ") : b].decode())
            except UnicodeDecodeError:
                out.append(None)
        return out


@per_worker
def model(path: str) -> tuple[PieceModel, WordIds]:
    bpe = PieceModel(path)
    return bpe, WordIds(bpe.encode_words)


def encode_texts(path: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, offsets of each text)."""
    if SPACE.encode() in (raw := data.tobytes()):  # the mark itself counts as a space
        texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    bpe, words = model(path)
    size = np.diff(off)
    data = np.insert(data, off[:-1][size > 0], 0x20)  # the space in front of each text
    off = np.concatenate(([0], np.cumsum(size + (size > 0))))
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = ~bpe.joint[data[:-1], data[1:]]
    cut[off] = True
    at = np.flatnonzero(cut)
    ids, n = words.ids(data, at[:-1], at[1:])
    return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(at, off)]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array<int> column of ids, without begin and end ids."""

    def make(data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        flat, cut = encode_texts(path, data, off)
        return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))]

    return appended(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, uses=model)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts that the ids decode to (null ids: empty)."""
    df = df.drop(text).withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    schema, at = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]), df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = model(path)
        for b in batches:
            off, first = b.column(at).offsets.to_numpy(), 0
            while first < len(b):
                end = max(first + 1, int(np.searchsorted(off, off[first] + STEP_BYTES // 4, "right")) - 1)
                own, cut = b.column(at).values.to_numpy(zero_copy_only=False)[off[first] : off[end]], off[first : end + 1] - off[first]
                said = bpe.decode(own, cut)
                left = [i for i, t in enumerate(said) if t is None]
                for i, t in zip(left, bpe.library.decode([own[cut[i] : cut[i + 1]].tolist() for i in left], num_threads=1), strict=True):
                    said[i] = t
                yield pa.RecordBatch.from_arrays([*b.slice(first, end - first).columns, pa.array(said, pa.string())], names=schema.names)
                first = end

    return df.mapInArrow(tidy(run, model), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded text."""
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
