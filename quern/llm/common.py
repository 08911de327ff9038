"""Shared helpers of the corpus operators: scratch tables, table access, batches of text."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, local mode takes a folder below the system's temporary one; on a
    cluster that folder would lie on single machines, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "quern")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def only_kept(spark: SparkSession):
    """Deletes, at the end, all scratch tables and files made within but those of the frames that are appended to its list."""
    made: list[str] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]  # by identity: nested scopes may hold equal lists
        stay = {t.scratch_path for t in kept}
        for path in made:
            if path not in stay:
                _delete(spark, path)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    The result's ``scratch_path`` names the folder.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def _delete(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, so that a batch of very long texts or large blobs stays small.

    Only the bytes are bounded: batches of short rows keep their number of rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


_kept: dict[str, dict] = {}


def kept_in_worker(operator: str) -> dict:
    """What a worker remembers for later tasks of the same operator; what another operator left there goes.

    Workers are used again, so the tables of all operators of a session would add up in each.
    """
    if operator not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(operator, {})


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows whose text ``decide`` (a list of texts to an array of booleans) accepts, as they are.

    Rows pass whole, with all their columns, so nothing is joined back. Null texts are empty. ``decide``
    gets few texts at a time, for it may need many times their size.
    """
    at = docs.columns.index("text")

    def run(batches):
        kept_in_worker("filter")
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at).cast(pa.string())
                numbered = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["row", "text"])
                kept = [np.asarray(decide(some), dtype=bool) for _, some in doc_chunks([numbered], 1 << 19)]
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def filesystem(uri: str):
    """(file system, path) of a shared folder or file, for real byte-range reads and writes."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def doc_chunks(
    batches: Iterable[pa.RecordBatch], max_bytes: int, max_texts: int | None = None
) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``max_bytes`` characters and ``max_texts`` texts at most, or one text; null texts are empty."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            if ids and (size + len(t) > max_bytes or len(ids) == max_texts):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def planes(codes: np.ndarray) -> bytes:
    """Codes as all their low bytes, then all second bytes, and so on: small codes compress well."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


# --- words of a chunk of texts, hashed without a Python loop over words -------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise, modulo 2**64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte; white space counts nothing.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[_SPACE] = 0
_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, np.uint64(base), dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` and each text's first position in them.

    A-Z are lower-cased first. The second array has len(texts) + 1 entries. The hash is a
    polynomial over random byte values, equal for equal words wherever they stand.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw], dtype=np.int64)
    joined = b"\n".join(raw) + b"\n"
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    pw, inv = _power_tables(len(data) + 1)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]
    total = _BYTE[data]
    total *= pw[: len(data)]
    np.cumsum(total, out=total)
    h = total[stops - 1]
    before = starts > 0
    h[before] -= total[starts[before] - 1]
    h *= inv[starts]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(starts, ends)
    return mix64(h), bounds


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each element, the number of the segment that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
