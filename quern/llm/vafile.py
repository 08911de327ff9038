"""Centroid clustering over a vector-approximation file.

Each vector becomes a record of its file in the shared folder and a row of cells: a few bits for each
dimension, which say between which marks a component lies. A round of clustering reads cells only. A
lookup table per dimension gives the least and the largest contribution of a cell to the squared
distance from each centroid; their sums are a distance interval per centroid. Where the nearest
centroid's interval overlaps another's, a second table bounds the difference of the two distances,
and where that is open too the vector's record is read. Sums of clusters are carried on: a round adds
what came and takes away what left, so records are read only of vectors that are open or that move.

All arithmetic is on whole numbers and exact. Blocks with components of 2**27 and more, and rounds
with such centroids, are worked with Python's unbounded integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, filesystem, materialize, scratch, small_batches

#: Bits of a cell, rows the marks are taken from, components below which 64-bit sums are exact.
BITS, SAMPLE_ROWS, SMALL = 7, 2048, 1 << 27
_LIMB = 60
_STATE = (
    "path string, start long, n int, wide boolean, low string, high string, cells binary, cluster binary, "
    "moved array<struct<cluster:int,dim:int,limb:int,value:bigint>>, fetched int"
)
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))


def valid_rows(table: DataFrame, dim: int) -> DataFrame:
    """vec_id and vector (64-bit floats) of rows with ``dim`` components, none null or not finite."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")
    )


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit where that is exact and small, otherwise unbounded integers."""
    y = x * scale if np.abs(x).max(initial=0) < SMALL else None
    if y is not None and np.abs(y).max(initial=0) < SMALL - 1:
        return np.floor(y).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for at, value in np.ndenumerate(x):
        top, below = float(value).as_integer_ratio()
        out[at] = top * scale // below
    return out


def _fits(*arrays: np.ndarray) -> bool:
    return all(a.dtype != object for a in arrays)


def centroid_array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(y) < SMALL for c in centroids for y in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def exact(vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances [vectors, centroids]."""
    if not _fits(vectors, c):
        vectors, c = vectors.astype(object), c.astype(object)
    return np.stack([((vectors - y) ** 2).sum(axis=1) for y in c], axis=1)


def cells_of(vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Cell numbers [vectors, dimensions]: how many marks of the dimension are at most the component."""
    return np.stack([np.searchsorted(marks[d], vectors[:, d], side="right") for d in range(vectors.shape[1])], axis=1).astype(
        np.uint8
    )


class Bounds:
    """A block's cells against centroids: what the lookup tables can tell without the vectors."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray, marks: np.ndarray, c: np.ndarray):
        kind = np.int64 if _fits(low, high, marks, c) else object
        self.cells, self.c = cells, c.astype(kind)
        # the least and the largest component a cell can hold; the outer cells end at the block's own
        self.lo = np.concatenate([low[:, None], marks], axis=1).astype(kind)
        self.hi = np.concatenate([marks - 1, high[:, None]], axis=1).astype(kind)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance [vectors, centroids]."""
        below = self.lo[:, :, None] - self.c.T[:, None, :]
        above = self.hi[:, :, None] - self.c.T[:, None, :]
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        near = np.maximum(np.maximum(below, -above), 0) ** 2
        return self._sum(near, self.cells), self._sum(far, self.cells)

    def lead(self, rows: np.ndarray, best: int) -> np.ndarray:
        """Least of (squared distance from each centroid) - (that from ``best``) over the cells of rows."""
        step = (self.c - self.c[best]).T[:, None, :]
        fixed = (self.c**2 - self.c[best] ** 2).T[:, None, :]
        ends = np.minimum(self.lo[:, :, None] * (-2 * step), self.hi[:, :, None] * (-2 * step)) + fixed
        return self._sum(ends, self.cells[rows])

    @staticmethod
    def _sum(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), table.shape[2]), dtype=table.dtype)
        for d in range(cells.shape[1]):
            out += table[d][cells[:, d]]
        return out

    def decide(self) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, open): the nearest centroid of each row, ties to the smaller number, and the rows
        whose vectors are needed to tell."""
        near, far = self.intervals()
        k = len(self.c)
        best = far.argmin(axis=1)
        rows = np.arange(len(best))
        limit = far[rows, best]
        rival = near <= limit[:, None]
        rival[rows, best] = False
        left = np.flatnonzero(rival.any(axis=1))
        if len(left):
            best[left] = (near[left] + far[left]).argmin(axis=1)
            loses = np.zeros(len(left), dtype=bool)
            for b in range(k):
                mine = np.flatnonzero(best[left] == b)
                if len(mine):
                    lead = self.lead(left[mine], b)
                    lead[:, b] = 1
                    loses[mine] = ((lead < 0) | ((lead == 0) & (np.arange(k) < b))).any(axis=1)
            left = left[loses]
        return best, left


class Records:
    """Vectors of one file: fixed-length records of blocks, read by range."""

    def __init__(self):
        self.path, self.file = None, None

    def _open(self, path: str):
        if path != self.path:
            self.close()
            system, inner = filesystem(path)
            self.path, self.file = path, system.open_input_file(inner)
        return self.file

    def read(self, path: str, start: int, rows: np.ndarray, dim: int, wide: bool, scale: int) -> np.ndarray:
        """The whole-number vectors of some rows (ascending) of a block; near ones are read together."""
        kind, size = ("<f8", 8 * dim) if wide else ("<i4", 4 * dim)
        out = np.empty((len(rows), dim), dtype=kind)
        cut = np.flatnonzero(np.diff(rows, prepend=-1 << 40) > 16)
        for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True):
            first, last = int(rows[a]), int(rows[b - 1]) + 1
            raw = self._open(path).read_at((last - first) * size, start + first * size)
            out[a:b] = np.frombuffer(raw, dtype=kind).reshape(-1, dim)[rows[a:b] - first]
        return whole(out, scale) if wide else out.astype(np.int64)

    def ids(self, path: str, start: int, n: int, dim: int, wide: bool) -> list:
        """The block's vec_ids, which follow its vectors."""
        raw = self._open(path).read_at(9 * n, start + n * dim * (8 if wide else 4))
        known = np.frombuffer(raw, dtype=np.uint8, offset=8 * n)
        return [i if k else None for i, k in zip(np.frombuffer(raw, dtype="<i8", count=n).tolist(), known, strict=True)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def _limbs(cluster: int, dim: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    limb = 0
    while abs(value) >> _LIMB:
        yield cluster, dim, limb, value & ((1 << _LIMB) - 1)
        value, limb = value >> _LIMB, limb + 1
    if value:
        yield cluster, dim, limb, value


def moves(vectors: np.ndarray, new: np.ndarray, old: np.ndarray, k: int) -> list[dict]:
    """What rows that change from ``old`` (k: none) to ``new`` add to sums and counts (dimension -1)."""
    out = []
    for j in range(k):
        came, left = new == j, old == j
        if came.any() or left.any():
            total = vectors[came].sum(axis=0) - vectors[left].sum(axis=0)
            each = [(-1, int(came.sum()) - int(left.sum())), *enumerate(int(x) for x in np.atleast_1d(total))]
            for d, value in each:
                out += [dict(zip(("cluster", "dim", "limb", "value"), x, strict=True)) for x in _limbs(j, d, value)]
    return out


def _numbers(text: str) -> np.ndarray:
    return centroid_array([[int(x) for x in text.split(",")]])[0]


def _text(values) -> str:
    return ",".join(str(int(x)) for x in values)


class Clusters:
    """The marks, the file and the rounds over it."""

    def __init__(self, table: DataFrame, k: int = 8, dim: int = 64, scale: int = 1024, seed: int = 3, bits: int = BITS):
        self.spark, self.dim, self.scale, self.bits = table.sparkSession, dim, scale, bits
        small_batches(self.spark)
        self.rows = valid_rows(table, dim)
        # a bounded sample in hash order: its first rows start as centroids, and quantiles of all of it are the marks
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = self.rows.orderBy(name.asc_nulls_last(), "vector").limit(max(k, SAMPLE_ROWS)).select("vector").collect()
        sample = [whole(np.array(r.vector, dtype=np.float64), scale) for r in first]
        self.centroids = [[int(x) for x in v] for v in sample[:k]]
        cells = 1 << bits
        marks = []
        for d in range(dim if sample else 0):
            values = sorted(int(v[d]) for v in sample)
            marks.append([values[min(len(values) - 1, len(values) * i // cells)] for i in range(1, cells)])
        self.marks = marks
        self.sums = [[0] * (dim + 1) for _ in range(k)]

    def build(self) -> DataFrame:
        """Writes records and cells, with every vector in its first cluster; one row per block."""
        folder, dim, scale = scratch(self.spark, "vectors"), self.dim, self.scale
        marks, c = centroid_array(self.marks), centroid_array(self.centroids)

        def run(batches):
            sink, at, path = None, 0, ""
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                v = whole(x, scale)
                wide = v.dtype == object
                ids = batch.column(0)
                if sink is None:
                    system, inner = filesystem(folder)
                    system.create_dir(inner, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    sink, path = system.open_output_stream(f"{inner}/{name}"), f"{folder}/{name}"
                raw = x.astype("<f8").tobytes() if wide else v.astype("<i4").tobytes()
                raw += ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                raw += ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                sink.write(raw)
                cluster = exact(v, c).argmin(axis=1)
                row = {
                    "path": path, "start": at, "n": n, "wide": wide, "low": _text(v.min(axis=0)), "high": _text(v.max(axis=0)),
                    "cells": cells_of(v, marks).tobytes(), "cluster": cluster.astype(np.uint8).tobytes(),
                    "moved": moves(v, cluster, np.full(n, len(c)), len(c)), "fetched": n,
                }
                at += len(raw)
                yield _block(row)
            if sink is not None:
                sink.close()

        return materialize(self.rows.mapInArrow(run, _STATE), "cells")

    def update(self, state: DataFrame) -> int:
        """New centroids from what moved: floor(sum / count), empty clusters stay. Returns the number of entries."""
        x = F.explode("moved").alias("x")
        found = state.select(x).groupBy("x.cluster", "x.dim", "x.limb").agg(F.sum(F.col("x.value").cast("decimal(38,0)")).alias("v"))
        rows = found.where("v <> 0").collect()  # at most (dim + 1) limbed numbers per centroid
        for r in rows:
            self.sums[r.cluster][r.dim] += int(r.v) << (_LIMB * r.limb)
        for j, total in enumerate(self.sums[: len(self.centroids)]):
            if total[-1]:
                self.centroids[j] = [s // total[-1] for s in total[:-1]]
        return len(rows)

    def assign(self, state: DataFrame) -> DataFrame:
        """One more assignment of all blocks, by cells; records are read of open rows and of those that move."""
        dim, scale = self.dim, self.scale
        marks, c = centroid_array(self.marks), centroid_array(self.centroids)

        def run(batches):
            records = Records()
            for row in _rows(batches):
                b, old = _bounds(row, marks, c, dim), np.frombuffer(row["cluster"], dtype=np.uint8).astype(np.int64)
                new, left = b.decide()
                need = np.union1d(left, np.flatnonzero(new != old))
                if len(need):
                    v = records.read(row["path"], row["start"], need, dim, row["wide"], scale)
                    here = np.searchsorted(need, left)
                    if len(left):
                        new[left] = exact(v[here], c).argmin(axis=1)
                moved = moves(v, new[need], old[need], len(c)) if (new != old).any() else []
                yield _block(row | {"cluster": new.astype(np.uint8).tobytes(), "moved": moved, "fetched": len(need)})
            records.close()

        return materialize(state.mapInArrow(run, _STATE), "cells")

    def distances(self, state: DataFrame) -> DataFrame:
        """vec_id, cluster and distance of all vectors: each record is read once. A distance of 2**63 and more is null."""
        dim, scale = self.dim, self.scale
        c = centroid_array(self.centroids)

        def run(batches):
            records = Records()
            for row in _rows(batches):
                n, where = row["n"], (row["path"], row["start"])
                v = records.read(*where, np.arange(n), dim, row["wide"], scale)
                cluster = np.frombuffer(row["cluster"], dtype=np.uint8).astype(np.int64)
                mine = c[cluster]
                if not _fits(v, mine):
                    v, mine = v.astype(object), mine.astype(object)
                far = ((v - mine) ** 2).sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(records.ids(*where, n, dim, row["wide"]), pa.int64()),
                        pa.array(cluster, pa.int32()),
                        pa.array([x if x < 1 << 63 else None for x in far], pa.int64()),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )
            records.close()

        return materialize(state.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")


def _block(row: dict) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.binary(), _MOVED, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _bounds(row: dict, marks: np.ndarray, c: np.ndarray, dim: int) -> Bounds:
    cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, dim)
    return Bounds(cells, _numbers(row["low"]), _numbers(row["high"]), marks, c)


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Kept are vectors of ``dim`` components, none null, NaN or infinite. Repeated rows count each; a
    null vec_id is kept and comes last among starting centroids; fewer than k vectors make fewer
    centroids; an empty table gives no rows; extra columns are ignored. A distance or an inertia that
    a 64-bit integer cannot hold is null.
    """
    work = Clusters(table, k, dim, scale, seed, bits)
    if not work.centroids:
        return work.rows.select(
            "vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"))),
            F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"),
        ).limit(0)
    state = work.build()
    for _ in range(rounds):
        if not work.update(state):  # nothing moved: all further rounds give the same
            break
        before, state = state, work.assign(state)
        discard(before)
    out = work.distances(state)
    discard(state)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: None if r.lost else int(r.s) for r in out.groupBy("cluster").agg(total.alias("s"), F.max(F.col("distance").isNull()).alias("lost")).collect()}
    every = None if None in sums.values() else sum(sums.values())

    def long(x: int | None):
        return F.lit(x if x is not None and x < 1 << 63 else None).cast("long")

    names = {j: hashlib.sha256(_text(v).encode()).hexdigest() for j, v in enumerate(work.centroids)}
    pick = lambda values, of: F.element_at(F.create_map(*(y for j, v in values.items() for y in (F.lit(j), of(v)))), F.col("cluster"))
    return out.select(
        "vec_id", "cluster", "distance", pick(sums, long).alias("cluster_inertia"), long(every).alias("inertia"),
        pick(names, F.lit).alias("centroid_sha256"),
    )
