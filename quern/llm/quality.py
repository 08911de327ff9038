"""Quality classifier: a factorisation machine over hashed words, text structure and size.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2]): the pairwise part
takes linear time by the sum-of-squares identity. Fitted on a bounded sample of labelled rows by
AdaGrad in mini-batches; scoring is a sparse product in numpy over whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, keep_rows, segment_ids, small_batches, word_hashes
from quern.llm.langid import held_out

#: Hash buckets of words, rank of the interactions, and the bound on labelled rows that are fitted.
BUCKETS, RANK, TRAIN_ROWS = 1 << 13, 4, 6_000
THRESHOLD = 0.3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1  # A-Z
_CLASS[97:123] = 2  # a-z
_CLASS[48:58] = 3  # digits
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5  # line ends
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_CLASS[[ord(c) for c in "!"]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~+=<>|\\/_{}[]`"]] = 8
_CLASS[128:] = 9
_CLASSES = 10
STRUCTURE = 4 * (_CLASSES + 6)
_LINES = re.compile("[^\n]+")


def structure(texts: list[str], bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Ratios [texts, 16] of a text: character classes, word length, repeated words and lines, sizes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), _CLASSES + 6))
    words = np.maximum(np.diff(bounds), 1)
    sizes = np.array([len(b) for b in raw])
    for i, b in enumerate(raw):
        out[i, :_CLASSES] = np.bincount(_CLASS[np.frombuffer(b, dtype=np.uint8)], minlength=_CLASSES)
    out[:, :_CLASSES] /= np.maximum(sizes, 1)[:, None]
    out[:, _CLASSES] = np.minimum(sizes / words / 20, 1)
    out[:, _CLASSES + 1] = np.log1p(sizes) / 16
    owner = segment_ids(bounds)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    out[:, _CLASSES + 2] = np.bincount(o, weights=again, minlength=len(texts)) / words
    # longest share of one word
    if len(h):
        first = np.flatnonzero(~again)
        runs = np.diff(np.append(first, len(h)))
        top = np.zeros(len(texts))
        np.maximum.at(top, o[first], runs)
        out[:, _CLASSES + 3] = top / words
    for i, t in enumerate(texts):
        lines = _LINES.findall(t)
        out[i, _CLASSES + 4] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, _CLASSES + 5] = min(len(lines) / words[i], 1)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, bounds) of sparse rows: hashed words (share of the text) and structure.

    A structure ratio enters at four sizes (itself, its root, and whether it is above 2 % and 10 %).
    """
    hashes, bounds = word_hashes(texts)
    n = len(texts)
    owner = segment_ids(bounds)
    key = owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row, col = key // BUCKETS, key % BUCKETS
    words = np.maximum(np.diff(bounds), 1)
    value = np.sqrt(count / words[row])
    s = structure(texts, bounds, hashes)
    s = np.concatenate([s, np.sqrt(s), (s > 0.02) * 0.5, (s > 0.1) * 0.5], axis=1)
    row = np.concatenate([row, np.repeat(np.arange(n), STRUCTURE)])
    col = np.concatenate([col, BUCKETS + np.tile(np.arange(STRUCTURE), n)])
    value = np.concatenate([value, s.ravel()])
    order = np.argsort(row, kind="stable")
    return col[order], value[order], np.searchsorted(row[order], np.arange(n + 1))


class FactorisationMachine:
    """Weights of the machine, with linear-time scoring."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logits(self, col: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n, owner = len(bounds) - 1, segment_ids(bounds)
        total = self.w0 + np.bincount(owner, weights=self.w[col] * value, minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[:, f][col] * value
            total += 0.5 * (
                np.bincount(owner, weights=x, minlength=n) ** 2 - np.bincount(owner, weights=x * x, minlength=n)
            )
        return total

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.logits(*features(texts)), -30, 30)
        return 1 / (1 + np.exp(-z))


def train(col, value, bounds, y, epochs: int = 30, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed=7):
    """Fits the machine on sparse rows by AdaGrad; deterministic for the same rows."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STRUCTURE
    p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    w0, w, v = np.log(p / (1 - p)), np.zeros(size), rng.normal(0, 0.02, (size, RANK)) * bool(len(y))
    g0, gw, gv = 1.0, np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            own = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            c, x = col[at], value[at]
            vx = v[c] * x[:, None]
            sums = np.stack([np.bincount(own, weights=vx[:, f], minlength=len(rows)) for f in range(RANK)], axis=1)
            squares = np.bincount(own, weights=(vx * vx).sum(axis=1), minlength=len(rows))
            z = w0 + np.bincount(own, weights=w[c] * x, minlength=len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            g0 += e.sum() ** 2
            w0 -= rate * e.sum() / np.sqrt(g0)
            cols, inverse = np.unique(c, return_inverse=True)
            d = np.bincount(inverse, weights=e[own] * x) + decay * w[cols]
            gw[cols] += d * d
            w[cols] -= rate * d / np.sqrt(gw[cols])
            dv = (e[own] * x)[:, None] * (sums[own] - vx)
            d = np.stack([np.bincount(inverse, weights=dv[:, f]) for f in range(RANK)], axis=1) + decay * v[cols]
            gv[cols] += d * d
            v[cols] -= rate * d / np.sqrt(gv[cols])
    return FactorisationMachine(float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, rows: int = TRAIN_ROWS):
    """Fits on at most about ``rows`` labelled texts, one a doc_id, chosen by doc_id's hash; features come from Spark tasks."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(modulus, rest))
    n = known.count()
    if n > rows:
        share = int(rows / n * 1_000_000)
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    # at most about `rows` small rows, by the bound above
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    # a row a doc_id, however often it is repeated: of several texts, that of the least hash
    text = F.coalesce("text", F.lit(""))
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    keyed = chosen.select(F.struct("doc_id", "quality").alias("k"), "text")

    def run(batches):
        for keys, texts in doc_chunks(batches, 1 << 19):
            col, value, bounds = features(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k["doc_id"] for k in keys], pa.int64()),
                    pa.array([int(k["quality"]) for k in keys], pa.int32()),
                    pa.array([col[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                    pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                ],
                names=["doc_id", "quality", "col", "value"],
            )

    got = keyed.mapInArrow(run, "doc_id long, quality int, col binary, value binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["col"], r["value"]))
    sizes = [len(r["col"]) // 4 for r in got]
    col = np.frombuffer(b"".join(r["col"] for r in got), dtype="<i4").astype(np.int64)
    value = np.frombuffer(b"".join(r["value"] for r in got), dtype="<f4").astype(np.float64)
    y = np.array([r["quality"] for r in got], dtype=np.float64)
    return train(col, value, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64), y)


def predict(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of each text (null: empty)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))

    def run(batches):
        machine = FactorisationMachine(*shared.value)
        for ids, texts in doc_chunks(batches, 1 << 19):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(machine.score(texts))], names=["doc_id", "score"]
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, train_rows: int = TRAIN_ROWS):
    """The rows of ``docs`` whose score reaches THRESHOLD, with all their columns.

    A null text is an empty one; repeated rows share their fate; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, modulus, rest, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    return keep_rows(docs, lambda texts: FactorisationMachine(*shared.value).score(texts) >= THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, train_rows: int = TRAIN_ROWS):
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Learns from labels of rows that are not held out (two labels of one doc_id: the higher; of several
    texts one is fitted). Without labelled rows every score is 0.5. Repeated rows each get a row; a null doc_id is not held out;
    extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    out = predict(docs, fit(docs, labels, modulus, rest, train_rows))
    return out.select(
        "doc_id",
        F.coalesce(held_out(modulus, rest), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
