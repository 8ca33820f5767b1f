"""Near-duplicate embeddings by an inverted multi-index.

Each vector (scaled to norm 1) is cut into halves; one codebook per half, fitted by k-means on a
bounded sample of at most ``SAMPLE`` vectors, gives a grid of cells. Every vector lies in the cell
of its nearest pair of centroids and, in the order of the multi-sequence traversal (sums of the
halves' squared distances), visits the nearest cells. How many is found by brute force: a sample of
``PROBES`` vectors is compared with all, and the traversal goes as far as brings the target recall
of the sample's true links. The probes grow until ``ENOUGH`` of them have links; where even all
sampled vectors don't give so many, recall can't be measured, and every vector visits all cells of
a coarser grid that can hold a link: each half of a cell has a radius, and by the triangle inequality
a cell is out of reach if the halves' distances less the radii are. That is exact; how much it saves
depends on how the vectors lie. In a visited cell the visitors meet the residents in bounded blocks
and cosines are computed in double precision; pairs at or over the threshold are links. Vectors of
floats travel as floats, all others as doubles, and are scaled by a power of two before their squares
are summed, so that tiny and huge ones keep their direction.

A link counts from both sides, also if only one of the two visits the other's cell. Equal vectors
are one representative with a multiplicity, so that large groups of copies cost one vector.

Vectors that are null, zero or hold null or non-finite components link with nothing (0 links, a
component of their own). Rows with a null id take no part: 0 links, null component, not kept.
Vectors of different lengths don't link. Rows that repeat an id are rows of their own; an empty table
gives an empty one. Only the id and vector of a table are used, whatever other columns it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, tidy
from .graph import components, contract
from .topk import finite

SAMPLE = 65_536
PROBES, MOST_PROBES = 256, 20_000
BLOCK = 2048
#: Vectors that a cell shall hold on average, and sampled vectors for each code of a codebook.
PER_CELL, PER_CODE = 32, 8
#: Linked probes that a measured recall needs.
ENOUGH = 32
#: Cells that every vector visits at least.
LEAST_CELLS = 8
#: Numbers in a matrix of distances or cosines that one step works on.
STEP = 1 << 22


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])  # exact, and no square is lost
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    step = max(1, STEP // size)
    for _ in range(rounds):
        of = np.concatenate([_squared(x[at : at + step], c).argmin(axis=1) for at in range(0, len(x), step)])
        n = np.bincount(of, minlength=size)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Grid:
    """Cells of the product of two codebooks."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = sample.shape[1] // 2
        self.books = [codebook(x, size) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.size = size

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of the halves of rows to the codes."""
        return [_squared(h, b) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def traversal(self, x: np.ndarray, steps: int) -> np.ndarray:
        """The ``steps`` nearest cells of each row, nearest first."""
        steps = min(steps, self.size**2)
        order, near = [], []
        for d in self.distances(x):
            few = np.argpartition(d, steps, axis=1)[:, :steps] if steps < self.size else np.broadcast_to(np.arange(self.size), d.shape)
            few = np.take_along_axis(few, np.argsort(np.take_along_axis(d, few, axis=1), axis=1, kind="stable"), axis=1)
            order.append(few)
            near.append(np.take_along_axis(d, few, axis=1))
        # a cell that is (i, j)th in the halves has (i+1)(j+1)-1 cells before it
        i, j = np.array([(i, j) for i in range(near[0].shape[1]) for j in range(min(near[1].shape[1], steps // (i + 1)))]).T
        first = np.argsort(near[0][:, i] + near[1][:, j], axis=1, kind="stable")[:, :steps]
        return order[0][np.arange(len(x))[:, None], i[first]] * self.size + order[1][np.arange(len(x))[:, None], j[first]]

    def place(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells come before ``cell`` in each row's traversal."""
        a, b = self.distances(x)
        at = np.arange(len(x))
        own = a[at, cell // self.size] + b[at, cell % self.size]
        b = np.sort(b, axis=1)
        return np.array([np.searchsorted(y, own[i] - a[i] - 1e-12).sum() for i, y in enumerate(b)], np.int64)

    def within(self, x: np.ndarray, radii: list[np.ndarray], most: float) -> list[np.ndarray]:
        """Of each row, the cells that can hold a vector within the squared distance ``most``, the row's own first."""
        near = [np.maximum(np.sqrt(d) - r, 0) ** 2 for d, r in zip(self.distances(x), radii, strict=True)]
        home, out = self.traversal(x, 1)[:, 0], []
        for a, b, h in zip(*near, home, strict=True):
            i, j = np.nonzero(a[:, None] + b <= most)
            cells = i * self.size + j
            out.append(np.concatenate(([h], cells[cells != h])).astype(np.int32))
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors from binaries of ``dim`` floats or doubles."""
    return _unpacked(column.to_pylist(), dim)


def _unpacked(rows: Sequence[bytes], dim: int) -> np.ndarray:
    kind = np.float64 if len(rows) and len(rows[0]) == 8 * dim else np.float32
    return unit(np.frombuffer(b"".join(rows), kind).reshape(-1, dim))


def _steps_for(grid: Grid, reps: DataFrame, sample: np.ndarray, dim: int, threshold: float, recall: float) -> int | None:
    """Cells to visit so that the target recall of the sample's links is found; None if too few vectors of it have a link."""
    homes, step = grid.traversal(sample, 1)[:, 0], max(1, STEP // max(1, len(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (_vectors(b.column(0).slice(at, step), dim) for b in batches for at in range(0, len(b), step)):
            cosine = sample @ x.T
            s, r = np.nonzero((cosine >= threshold) & (cosine < 1 - 1e-9))
            for at in range(0, len(s), 1024):
                i, j = s[at : at + 1024], r[at : at + 1024]
                home = grid.traversal(x[j], 1)[:, 0]
                far = np.minimum(grid.place(sample[i], home), grid.place(x[j], homes[i]))
                pair, n = np.unique(np.stack((i, far)), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int64)) for y in (*pair, n)], names=["s", "place", "n"])

    seen = reps.select("x").mapInArrow(tidy(run), "s long, place long, n long").groupBy("s", "place").agg(F.sum("n").alias("n")).toPandas()
    if seen["s"].nunique() < ENOUGH:
        return None
    # each vector of the sample counts alike, however many links it has
    share = (seen["n"] / seen.groupby("s")["n"].transform("sum")).groupby(seen["place"]).sum().sort_index().cumsum()
    return min(max(int(share.index[int(np.searchsorted(share.to_numpy(), recall * share.iloc[-1]))]) + 1, LEAST_CELLS), grid.size**2)


def _radii(grid: Grid, reps: DataFrame, dim: int) -> list[np.ndarray]:
    """Of each code, how far the farthest vector that lies in its cells is, in its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.zeros((2, grid.size))
        for b in batches:
            for at in range(0, len(b), 1024):
                x = _vectors(b.column(0).slice(at, 1024), dim)
                home = grid.traversal(x, 1)[:, 0]
                for half, (d, code) in enumerate(zip(grid.distances(x), (home // grid.size, home % grid.size), strict=True)):
                    np.maximum.at(far[half], code, d[np.arange(len(x)), code])
        half, code = np.nonzero(far)
        yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(code), pa.array(far[half, code])], names=["half", "code", "far"])

    out = np.zeros((2, grid.size))
    for r in reps.select("x").mapInArrow(tidy(run), "half long, code long, far double").groupBy("half", "code").agg(F.max("far").alias("far")).collect():
        out[r["half"], r["code"]] = r["far"]
    return list(np.sqrt(out) + 1e-9)


def _local(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links in a block: rows are visitors ``left``, columns residents ``right``."""
    rows, cols = np.nonzero(hit)
    if len(rows) <= 50_000:
        return list(contract(zip(left[rows].tolist(), right[cols].tolist(), strict=True)).items())
    edges, open_ = [], hit.any(axis=1)
    while open_.any():
        i = int(np.argmax(open_))
        mine, theirs = np.zeros(len(left), bool), np.zeros(len(right), bool)
        new = np.zeros(len(left), bool)
        new[i] = True
        while new.any():
            mine |= new
            more = hit[new].any(axis=0) & ~theirs
            theirs |= more
            new = hit[:, more].any(axis=1) & ~mine
        open_ &= ~mine
        nodes = np.unique(np.concatenate((left[mine], right[theirs])))
        edges += [(int(x), int(nodes[0])) for x in nodes[1:]]
    return edges


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    kind = vectors.select(vector).schema[0].dataType.simpleString()
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    usable = finite("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    own = own.withColumn("v", F.when(usable, F.col("v")))
    reps = own.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    reps = stored(reps.withColumn("size", F.size("v")), "reps")
    shape = reps.groupBy("size").agg(F.count("*").alias("n")).collect()
    parts = [_links_of(reps.where(F.col("size") == r["size"]), r["size"], r["n"], threshold, recall) for r in shape]
    if not parts:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0][0]
    for p, _ in parts[1:]:
        found = found.union(p)
    found = stored(found, "links")
    dropped(*(t for _, made in parts for t in made))
    links = found.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    comp = components(found.where("edge").select("a", "b"))
    facts = reps.select("v", "rep", "mult").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    facts = facts.select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = own.join(facts, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of(reps: DataFrame, dim: int, n: int, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, edge): edges of a forest of the links, else b links that a has, copies counted; and the stored tables it reads."""
    kind = np.float32 if reps.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], names=["x", "rep", "mult"])

    reps = stored(reps.select("v", "rep", "mult").mapInArrow(tidy(raw), "x binary, rep long, mult long"), "vectors")
    size = int(max(2, np.ceil(np.sqrt(n / PER_CELL))))
    wanted = min(SAMPLE, max(MOST_PROBES, PER_CODE * size))
    taken = reps.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("x").collect()
    sample = _unpacked([bytes(r["x"]) for r in taken], dim)
    grid = Grid(sample, min(size, -(-len(sample) // PER_CODE)))
    probes, steps = PROBES, None
    while steps is None:  # where links are rare, more probes
        steps = _steps_for(grid, reps, sample[:: max(1, len(sample) // probes)][:probes], dim, threshold, recall)
        if probes >= min(len(sample), MOST_PROBES):
            break
        probes *= 4
    radii, most = [], 2 - 2 * threshold + 1e-9
    if whole := steps is None:  # too few links to measure recall by
        grid = Grid(sample, int(min(max(1, np.ceil(np.sqrt(n / BLOCK))), len(sample))))
        radii = _radii(grid, reps, dim)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                x = _vectors(part.column(0), dim)
                cells = grid.within(x, radii, most) if whole else list(grid.traversal(x, steps).astype(np.int32))
                home = pa.array(np.array([c[0] for c in cells], np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b"" if whole else c.tobytes() for c in cells], pa.binary()), home, pa.array(cells, pa.list_(pa.int32()))], names=["x", "rep", "mult", "visits", "home", "cells"])

    placed = stored(reps.mapInArrow(tidy(visit), "x binary, rep long, mult long, visits binary, home int, cells array<int>"), "cells")
    # how many blocks the residents and the visitors of each cell with residents make
    blocks = lambda n: F.ceil(F.count("*") / BLOCK).cast("int").alias(n)
    come = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(blocks("vn"))
    cells = stored(placed.groupBy(F.col("home").alias("cell")).agg(blocks("rn")).join(come, "cell"), "blocks")
    mine = F.pmod(F.xxhash64("rep"), F.col("rn")).cast("int")
    come = F.pmod(F.xxhash64("rep"), F.col("vn")).cast("int")
    stay = placed.join(cells, F.col("home") == F.col("cell")).withColumn("rb", mine).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vn") - 1)))
    stay = stay.select("cell", "rb", "vb", "rep", "mult", "x", "visits")
    guest = placed.withColumn("cell", F.explode("cells")).join(cells, "cell").withColumn("vb", come).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)))
    guest = guest.select(F.col("cell").alias("gc"), F.col("rb").alias("grb"), F.col("vb").alias("gvb"), F.col("rep").alias("grep"), F.col("mult").alias("gmult"), F.col("x").alias("gx"), F.col("home").alias("ghome"))

    def meet(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(hosts):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "edge": np.zeros(0, bool)})
        g, h = (_unpacked(x.to_list(), dim) for x in (guests["gx"], hosts["x"]))
        gid, hid = guests["grep"].to_numpy(), hosts["rep"].to_numpy()
        hit = (g @ h.T >= threshold) & (gid[:, None] != hid)
        gm, hm, home = guests["gmult"].to_numpy(), hosts["mult"].to_numpy(), guests["ghome"].to_numpy()
        # the resident gets its share where it visits the visitor's home itself; without limits it always does
        back = np.full_like(hit, whole)
        if not whole:
            visits = np.frombuffer(b"".join(hosts["visits"]), np.int32).reshape(len(hosts), -1)
            for c in np.unique(home[hit.any(axis=1)]):
                back[home == c] = (visits == c).any(axis=1)
        to_guest, to_host = hit @ hm, gm @ (hit & ~back)
        edges = _local(hit, gid, hid)
        a = np.concatenate((gid[to_guest > 0], hid[to_host > 0], np.array([e[0] for e in edges], np.int64)))
        b = np.concatenate((to_guest[to_guest > 0], to_host[to_host > 0], np.array([e[1] for e in edges], np.int64)))
        return pd.DataFrame({"a": a, "b": b, "edge": np.arange(len(a)) >= len(a) - len(edges)})

    links = guest.groupBy("gc", "grb", "gvb").cogroup(stay.groupBy("cell", "rb", "vb")).applyInPandas(meet, "a long, b long, edge boolean")
    return links, [reps, placed, cells]
