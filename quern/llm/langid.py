"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over the training texts: each task adds up its n-grams per language and hands
over one vector a language and slice of the hash space; the slices are summed in parallel. The model
is a matrix [hash buckets, languages] of log-probabilities, of fixed size per language, broadcast and
applied to whole texts as a sparse product in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, keep_rows, segment_ids, small_batches

#: Hash buckets, and the lengths of the n-grams.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: At most so many labelled texts are counted, evenly spread over doc_id's hash.
TRAIN_ROWS = 40_000
SLICES = 16
#: At most so many languages: the matrix, collected and broadcast, takes 384 KB for each.
LANGUAGES = 500
UNKNOWN = "und"
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(modulus: int, rest: int) -> Column:
    """crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each character of the lower-cased texts, and the texts' bounds in them.

    A text is followed by as many line ends as the longest n-gram needs, so none reaches into the next text.
    """
    gap = "\n" * max(ORDERS)
    texts = [t.lower() for t in texts]
    lengths = [len(t) for t in texts]
    chars = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    own = np.arange(bounds[-1]) + len(gap) * segment_ids(bounds)
    h = np.zeros(len(chars), dtype=np.uint32)
    per = []
    for k, n in enumerate(ORDERS):
        h[: len(chars) - k] += (chars[k:] + np.uint32(1)) * _MULT[k]
        x = h + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        per.append((x[own] % np.uint32(BUCKETS)).astype(np.int32))
    return np.stack(per, axis=1), bounds


def _labelled(docs: DataFrame, label: str, modulus: int, rest: int, rows: int) -> DataFrame:
    """Training rows (text, label): at most about ``rows``, chosen by doc_id's hash alone."""
    out = F.coalesce(held_out(modulus, rest), F.lit(False))
    usable = docs.where(~out & F.col("text").isNotNull() & F.col(label).isNotNull())
    n = usable.select("doc_id").count()
    if n > rows:
        share = int(rows / n * 1_000_000)
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return usable.select(F.col(label).alias("label"), F.col("text").cast("string"))


def count_grams(train: DataFrame) -> DataFrame:
    """label, slice and summed counts (binary, 64-bit floats) of the training texts (label, text)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for labels, texts in doc_chunks(batches, 1 << 19):
            grams, bounds = gram_buckets(texts)
            labels = np.array(labels, dtype=object)
            for x in set(labels.tolist()):
                rows = np.flatnonzero(labels == x)
                mine = np.concatenate([grams[bounds[i] : bounds[i + 1]].ravel() for i in rows])
                sums.setdefault(x, np.zeros(BUCKETS))
                sums[x] += np.bincount(mine, minlength=BUCKETS)
        for x, total in sums.items():
            parts = [p.tobytes() for p in np.split(total, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=["label", "slice", "counts"],
            )

    def add(key, table):
        total = sum(np.frombuffer(x.as_py()) for x in table.column("counts"))
        return pa.table(
            {"label": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int32()), "counts": [total.tobytes()]}
        )

    schema = "label string, slice int, counts binary"
    return train.mapInArrow(run, schema).groupBy("label", "slice").applyInArrow(add, schema)


def fit(train: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Labels and the matrix [buckets, labels] of log-probabilities; no labels without training rows."""
    names = train.select("label").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages among the labels")
    rows = count_grams(train).collect()  # a vector of fixed size for each language
    labels = sorted({r["label"] for r in rows})
    matrix = np.zeros((BUCKETS, max(1, len(labels))), dtype=np.float32)
    for k, x in enumerate(labels):
        parts = sorted((r["slice"], r["counts"]) for r in rows if r["label"] == x)
        total = np.concatenate([np.frombuffer(c) for _, c in parts]) + smoothing
        matrix[:, k] = np.log(total / total.sum())
    return labels, matrix


def decide(texts: list[str], labels: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is the posterior under equal priors of the mean n-gram, sharpened by the text's length
    up to 200 characters: long texts do not reach certainty by length alone. ``und`` with score 0
    for an empty text, a text without letters, or without any learned language.
    """
    grams, bounds = gram_buckets(texts)
    owner = segment_ids(bounds)
    sums = np.stack(
        [
            np.bincount(owner, weights=matrix[:, k][grams].sum(axis=1), minlength=len(texts))
            for k in range(matrix.shape[1])
        ],
        axis=1,
    )
    chars = np.maximum(np.diff(bounds), 1)[:, None]
    z = sums / chars * np.minimum(chars, 200)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    known = [bool(labels) and any(map(str.isalpha, t)) for t in texts]
    names = [labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return names, np.where(known, z[np.arange(len(texts)), best], 0.0).astype(np.float64)


def predict(docs: DataFrame, labels: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of each text (null: empty)."""
    model = docs.sparkSession.sparkContext.broadcast((labels, matrix))
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, texts in doc_chunks(batches, 1 << 19):
            names, score = decide(texts, *model.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.3, modulus: int = 4, rest: int = 2, train_rows: int = TRAIN_ROWS):
    """The rows of ``docs`` in a learned language with at least this score, with all their columns.

    A null text is an empty one and goes; repeated rows share their fate; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(_labelled(docs, "lang", modulus, rest, train_rows)))

    def accept(texts: list[str]) -> np.ndarray:
        names, score = decide(texts, *model.value)
        return (np.array(names, dtype=object) != UNKNOWN) & (score >= least)

    return keep_rows(docs, accept)


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang, ...).

    Learns from text and non-null lang of rows that are not held out; a null doc_id counts as not
    held out. Repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    labels, matrix = fit(_labelled(docs, "lang", modulus, rest, train_rows))
    out = predict(docs, labels, matrix)
    return out.select("doc_id", F.coalesce(held_out(modulus, rest), F.lit(False)).alias("held_out"), "lang_pred", "score")
