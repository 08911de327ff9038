"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors form one class (its smallest ids are kept), so copies neither crowd a graph nor a task.
Classes are dealt to shards by the power of two nearest to their norm, then by hash; a shard is a
hierarchical graph stored as flat neighbour arrays, one per layer. Inner product becomes nearness by one
more dimension that gives all vectors the same norm; norms of a shard differ by a factor of two at most,
and a shard is scaled by its largest, so that no long vector drowns the differences of the others. Each
shard measures its recall against brute force on some of its own vectors and widens its beam until that
is TARGET or more. Queries go to every shard in blocks, and shard results are merged by exact scores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, small_batches

#: Links per node (twice as many in the lowest layer), candidates at building, beam width at search.
LINKS, CANDIDATES, BEAM = 16, 64, 96
SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Recall that each shard reaches on its sample.
TARGET = 0.97


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, also where the squares would leave the range of 64-bit floats."""
    top = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def augment(x: np.ndarray) -> np.ndarray:
    """Vectors of equal norm, by one component more, scaled so that the longest has norm 1."""
    far = np.max(norms(x), initial=np.finfo(np.float64).tiny)
    y = x / far
    extra = np.sqrt(np.maximum(1 - (y**2).sum(axis=1), 0))
    return np.concatenate([y, extra[:, None]], axis=1).astype(np.float32)


def _nearest(a: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """The k most similar others among the first ``hi`` of rows lo to hi, most similar first."""
    out = []
    for at in range(lo, hi, 256):
        stop = min(at + 256, hi)
        sims = a[at:stop] @ a[:hi].T
        sims[np.arange(stop - at), np.arange(at, stop)] = -np.inf
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, best, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(best, order, axis=1))
    return np.concatenate(out)


def _own_links(a: np.ndarray, lo: int, hi: int, links: int) -> np.ndarray:
    """Up to ``links`` diverse neighbours of rows lo to hi among the first ``hi``: one counts if it is
    nearer than any that was taken before it; places that stay free go to the nearest."""
    near = _nearest(a, lo, hi, min(CANDIDATES, hi - 1))
    x, n = a[lo:hi], hi - lo
    kept = np.full((n, links), -1, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for r in range(near.shape[1]):
        c = near[:, r]
        mine = np.einsum("nd,nd->n", x, a[c])
        worst = np.full(n, -np.inf, dtype=np.float32)
        for k in range(links):
            has = kept[:, k] >= 0
            if not has.any():
                break
            worst[has] = np.maximum(worst[has], np.einsum("nd,nd->n", a[c[has]], a[kept[has, k]]))
        take = (mine > worst) & (count < links)
        kept[rows[take], count[take]] = c[take]
        count[take] += 1
    for r in range(near.shape[1]):
        free = (count < links) & ~(kept == near[:, r : r + 1]).any(axis=1)
        kept[rows[free], count[free]] = near[free, r]
        count[free] += 1
    return kept


def _links(a: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbours [n, most] of a layer (-1: none): own links first, then links back.

    Nodes enter in batches that double, and choose among those that have entered: the early ones
    link far apart, as in insertion one by one, so that no cluster is cut off.
    """
    n = len(a)
    if n < 2:
        return np.full((n, most), -1, dtype=np.int32)
    rows = np.arange(n)
    own, lo, hi = [], 0, min(32, n)
    while lo < n:
        own.append(_own_links(a, lo, hi, links))
        lo, hi = hi, min(2 * hi, n)
    kept = np.concatenate(own)
    src = np.repeat(rows, links)
    dst = kept.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    own = np.concatenate([np.zeros(len(src), dtype=np.int64), np.ones(len(src), dtype=np.int64)])
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    _, first = np.unique(src * n + dst, return_index=True)  # an own link precedes the same link back
    src, dst, own = src[first], dst[first], own[first]
    order = np.lexsort((-np.einsum("nd,nd->n", a[src], a[dst]), own, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, most), -1, dtype=np.int32)
    fits = place < most
    out[src[fits], place[fits]] = dst[fits]
    return out


class Graph:
    """A shard's graph: vectors, and for each layer its nodes and flat neighbour array."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.a, self.layers = augment(vectors), layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        n, a = len(vectors), augment(vectors)
        level = np.floor(np.random.default_rng(seed).exponential(1 / np.log(LINKS), n)).astype(int)
        level = np.minimum(level, level.max(initial=0))
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k)
            near = _links(a[nodes], LINKS, 2 * LINKS if k == 0 else LINKS)
            layers.append((nodes.astype(np.int32), np.where(near >= 0, nodes[near], -1).astype(np.int32)))
        return cls(vectors, layers)

    def flat(self) -> list[tuple[bytes, bytes]]:
        return [(nodes.astype("<i4").tobytes(), near.astype("<i4").tobytes()) for nodes, near in self.layers]

    @classmethod
    def from_flat(cls, vectors: np.ndarray, flat) -> Graph:
        layers = []
        for nodes, near in flat:
            nodes = np.frombuffer(nodes, dtype="<i4")
            layers.append((nodes, np.frombuffer(near, dtype="<i4").reshape(len(nodes), -1)))
        return cls(vectors, layers)

    def beam_for(self, vectors: np.ndarray, k: int, sample: int = 64) -> int:
        """The narrowest of some doubling beams with a recall of TARGET for the k nearest of ``sample`` own vectors."""
        some = np.linspace(0, len(vectors) - 1, min(sample, len(vectors))).astype(int)
        k, beam = min(k, len(vectors)), min(BEAM, len(vectors))
        exact = (vectors[some] / norms(vectors[some])[:, None]) @ (vectors / norms(vectors).max()).T
        truth = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        while beam < len(vectors):
            found = self.search(vectors[some], beam)
            if np.mean([np.isin(t, f).mean() for t, f in zip(truth, found, strict=True)]) >= TARGET:
                break
            beam = min(2 * beam, len(vectors))
        return beam

    def search(self, queries: np.ndarray, beam: int = BEAM, width: int = 4) -> np.ndarray:
        """The best nodes found [queries, up to beam] (-1: none), all queries stepping together."""
        unit = queries / norms(queries)[:, None]  # a query's length changes nothing in the order
        q = np.concatenate([unit, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        m, n = len(q), len(self.a)
        rows = np.arange(m)
        at = np.full(m, self.layers[-1][0][0], dtype=np.int64)
        best = q @ self.a[at[0]]
        for nodes, near in reversed(self.layers[1:]):
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            moving = rows
            while len(moving):
                to = near[place[at[moving]]]
                s = np.einsum("qd,qkd->qk", q[moving], self.a[to])
                s[to < 0] = -np.inf
                k = s.argmax(axis=1)
                top = s[np.arange(len(moving)), k]
                better = top > best[moving]
                at[moving[better]] = to[np.flatnonzero(better), k[better]]
                best[moving[better]] = top[better]
                moving = moving[better]
        near = self.layers[0][1]
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -np.inf, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, best, False
        seen = np.zeros((m, n), dtype=bool)
        seen[rows, at] = True
        active = rows
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            pick = np.argsort(-open_, axis=1)[:, :width]
            good = np.take_along_axis(open_, pick, axis=1) > -np.inf
            active, pick, good = active[good[:, 0]], pick[good[:, 0]], good[good[:, 0]]
            if not len(active):
                break
            r = np.broadcast_to(active[:, None], pick.shape)
            done[r[good], pick[good]] = True
            to = near[np.where(good, ids[r, pick], 0)].astype(np.int64)
            to[~good] = -1
            to = to.reshape(len(active), -1)
            own = np.repeat(active, to.shape[1])
            flat = to.ravel()
            new = flat >= 0
            new[new] = ~seen[own[new], flat[new]]
            key = np.unique(own[new] * n + flat[new])  # a node reached twice counts once
            own, flat = key // n, key % n
            seen[own, flat] = True
            s = np.einsum("kd,kd->k", q[own], self.a[flat])
            first = np.searchsorted(own, active)
            count = np.searchsorted(own, active, side="right") - first
            wide = max(int(count.max(initial=0)), 1)
            col = np.arange(len(own)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(active)), count)
            more_ids = np.full((len(active), wide), -1, dtype=np.int64)
            more_sims = np.full((len(active), wide), -np.inf, dtype=np.float32)
            more_ids[line, col], more_sims[line, col] = flat, s
            all_sims = np.concatenate([sims[active], more_sims], axis=1)
            all_ids = np.concatenate([ids[active], more_ids], axis=1)
            all_done = np.concatenate([done[active], more_ids < 0], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, axis=1)
            ids[active] = np.take_along_axis(all_ids, top, axis=1)
            done[active] = np.take_along_axis(all_done, top, axis=1)
        return ids


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, d1, d2 (digest), dim, bucket (of the norm) and vector (64-bit floats) of rows that can take part.

    Null vectors, zero vectors, vectors with null or non-finite components and null ids take none.
    """
    small_batches(table.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if len(x) and np.isfinite(x).all() and x.any():
                    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                    a, b = np.frombuffer(d, dtype="<i8")
                    bucket = int(np.rint(np.log2(norms(x[None])[0])))
                    rows.append((i, int(a), int(b), len(x), bucket, x.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["vec_id", "d1", "d2", "dim", "bucket", "vector"]
            )

    keyed = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return keyed.mapInArrow(run, "vec_id long, d1 long, d2 long, dim int, bucket int, vector binary")


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """d1, d2, dim, bucket, vector and ids: the ``keep`` smallest ids of each distinct vector, ascending."""
    # cut within 64 parts of a class before its rows meet
    part = rows.select("d1", "d2", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).distinct()
    for keys in (["d1", "d2", "part"], ["d1", "d2"]):
        w = Window.partitionBy(*keys).orderBy("vec_id")
        part = part.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")
    ids = part.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in ("dim", "bucket", "vector")))
    return vectors.join(ids, ["d1", "d2"])


def build_index(classes: DataFrame, shards: int, k: int) -> DataFrame:
    """One row per (dim, shard, norm bucket): members' ids, vectors, the graph's layers as flat arrays, and its beam."""

    def build(key, table):
        dim = key[0].as_py()
        vectors = _matrix(table.column("vector"), dim)
        graph = Graph.build(vectors)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int32()),
                "beam": pa.array([graph.beam_for(vectors, k)], pa.int32()),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([b"".join(table.column("vector").to_pylist())], pa.binary()),
                "layers": pa.array(
                    [[{"nodes": a, "near": b} for a, b in graph.flat()]],
                    pa.list_(pa.struct([("nodes", pa.binary()), ("near", pa.binary())])),
                ),
            }
        )

    return (
        classes.withColumn("shard", F.pmod("d1", F.lit(shards)).cast("int"))
        .groupBy("dim", "shard", "bucket")
        .applyInArrow(
            build,
            "dim int, shard int, beam int, ids array<array<bigint>>, vectors binary, layers array<struct<nodes:binary,near:binary>>",
        )
    )


def search(table: DataFrame, query_modulus: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: for each valid row whose vec_id is divisible by
    ``query_modulus``, the k nearest other rows found, ties to the smaller vec_id.

    Vectors are compared with those of their own length. Repeated rows of one vec_id count once; an
    empty table gives no rows; extra columns are ignored.
    """
    rows = materialize(valid_vectors(table), "vectors")
    classes = materialize(vector_classes(rows, k + 1), "vector-classes")
    shards = max(1, -(-classes.count() // shard_rows))
    index = materialize(build_index(classes, shards, k + 1), "graphs")
    queries = materialize(
        rows.where(F.col("vec_id") % query_modulus == 0).select(F.col("vec_id").alias("query_id"), "d1", "d2").distinct(),
        "queries",
    )
    wanted = materialize(queries.select("d1", "d2").distinct(), "query-classes")
    blocks = max(1, -(-wanted.count() // BLOCK_ROWS))

    def gather(key, t):
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "q1": pa.array([t.column("d1").to_pylist()], pa.list_(pa.int64())),
                "q2": pa.array([t.column("d2").to_pylist()], pa.list_(pa.int64())),
                "queries": pa.array([b"".join(t.column("vector").to_pylist())], pa.binary()),
            }
        )

    asked = (
        classes.select("d1", "d2", "dim", "vector")
        .join(wanted, ["d1", "d2"])
        .withColumn("block", F.pmod("d2", F.lit(blocks)))
        .groupBy("dim", "block")
        .applyInArrow(gather, "dim int, q1 array<bigint>, q2 array<bigint>, queries binary")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .repartition(shards * blocks, "dim", "shard", F.xxhash64("q1"))
    )

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = col["dim"][r].as_py()
                vectors = np.frombuffer(col["vectors"][r].as_py(), dtype="<f8").reshape(-1, dim)
                q = np.frombuffer(col["queries"][r].as_py(), dtype="<f8").reshape(-1, dim)
                members = col["ids"][r].as_py()
                graph = Graph.from_flat(vectors, [(x["nodes"], x["near"]) for x in col["layers"][r].as_py()])
                found = graph.search(q, col["beam"][r].as_py())
                out_ids, out_scores = [], []
                for i, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    scores = (vectors[nodes] * q[i]).sum(axis=1)
                    each = [(-s, v) for n, s in zip(nodes, scores.tolist(), strict=True) for v in members[n]]
                    each.sort()
                    out_ids.append([v for _, v in each[: k + 1]])
                    out_scores.append([-s for s, _ in each[: k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(col["q1"][r].as_py(), pa.int64()),
                        pa.array(col["q2"][r].as_py(), pa.int64()),
                        pa.array(out_ids, pa.list_(pa.int64())),
                        pa.array(out_scores, pa.list_(pa.float64())),
                    ],
                    names=["d1", "d2", "ids", "scores"],
                )

    hits = asked.join(index, ["dim", "shard"]).mapInArrow(
        run, "d1 long, d2 long, ids array<bigint>, scores array<double>"
    )
    hits = hits.select("d1", "d2", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "d1", "d2", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
    )
    w = Window.partitionBy("d1", "d2").orderBy(F.col("score").desc(), "vec_id")
    best = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k + 1)
    best = materialize(
        best.groupBy("d1", "d2").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best")), "hits"
    )
    mine = queries.join(best, ["d1", "d2"]).select(
        "query_id", F.filter("best", lambda x: x["vec_id"] != F.col("query_id")).alias("best")
    )
    return mine.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
