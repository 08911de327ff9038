"""Token ids as wavelet matrices: one compressed file per shard, read by rank and select.

A shard holds consecutive documents (ascending doc_id). Its ids are cut into blocks; a block is a
wavelet matrix: for each bit, from the highest, a plane of that bit over the ids in the order that
the planes above gave (zeros first, then ones, both stable). Planes are packed to bits, and deflated
where that helps.
The footer lists the blocks, so a reader fetches only the byte ranges it needs.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, filesystem, materialize, scratch, small_batches
from quern.llm.tokens import encoder

MAGIC = b"QWM1"
#: Distinct chunks that a worker's encoder remembers: more than by default, as few other tables stand beside them.
KEEP = 600_000
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _huffman(raw: bytes) -> bytes:
    """Deflated without a search for repeats, which bit planes hardly have: half the time, 1 % larger files."""
    packer = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(raw) + packer.flush()


def _deflate(raw: bytes) -> bytes:
    """Deflated bytes if a first part shrinks and the whole gets smaller, else the bytes themselves."""
    start = raw[:4096]
    if len(_huffman(start)) > 0.95 * len(start):
        return raw
    packed = _huffman(raw)
    return packed if len(packed) < len(raw) else raw


class WaveletMatrix:
    """Bit planes of one block, with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.levels = len(planes)
        self._before: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            x = np.concatenate([x.take(low), x.take(np.flatnonzero(bit))])
        return cls(len(ids), planes, zeros)

    def to_bytes(self) -> bytes:
        """Header (json, length-prefixed) and planes, deflated where that makes them smaller."""
        packed = [_deflate(p.tobytes()) for p in self.planes]
        head = json.dumps({"n": self.n, "zeros": self.zeros, "sizes": [len(p) for p in packed]}).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        at = 4 + int.from_bytes(data[:4], "little")
        head = json.loads(data[4:at])
        planes = []
        for size in head["sizes"]:
            part = data[at : at + size]
            whole = (head["n"] + 7) // 8
            planes.append(np.frombuffer(part if size == whole else zlib.decompress(part), dtype=np.uint8))
            at += size
        return cls(head["n"], planes, head["zeros"])

    def _ones_before(self, level: int) -> np.ndarray:
        """Ones before each byte of a plane (the rank directory)."""
        if self._before[level] is None:
            ones = np.zeros(len(self.planes[level]) + 1, dtype=np.uint32)
            np.cumsum(_ONES[self.planes[level]], out=ones[1:])
            self._before[level] = ones
        return self._before[level]

    def rank1(self, level: int, i):
        """Ones among the first i bits of a plane."""
        i = np.asarray(i, dtype=np.int64)
        plane = np.append(self.planes[level], np.uint8(0))
        part = plane[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)
        return self._ones_before(level)[i >> 3].astype(np.int64) + _ONES[part]

    def select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = int(self.rank1(level, mid + 1))
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i):
        """The ids at the given positions."""
        i = np.asarray(i, dtype=np.int64)
        out = np.zeros_like(i)
        for level in range(self.levels):
            bit = (self.planes[level][i >> 3] >> (i & 7).astype(np.uint8)) & 1
            ones = self.rank1(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            out = (out << 1) | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = (int(x) for x in self.rank1(level, [lo, hi]))
            if (token >> (self.levels - 1 - level)) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in positions lo up to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """All positions of a token, ascending."""
        a, b = self._range(token, 0, self.n)
        out = []
        for i in range(a, b):
            for level in range(self.levels - 1, -1, -1):
                bit = (token >> (self.levels - 1 - level)) & 1
                i = self.select(level, bit, i - self.zeros[level] if bit else i)
            out.append(i)
        return sorted(out)

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest bit up."""
        x = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[: self.zeros[level]]
            y[np.flatnonzero(bit)] = x[self.zeros[level] :] | x.dtype.type(1 << (self.levels - 1 - level))
            x = y
        return x.astype(np.uint32)


class ShardWriter:
    """Writes one shard file block by block; memory is bounded by a block and the documents' index."""

    def __init__(self, sink, levels: int, block: int = 1 << 18):
        self.sink, self.levels, self.block = sink, levels, block
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)
        self.blocks: list[tuple[int, int, int]] = []  # first token, byte offset, byte length
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = 0
        self.doc_ids: list = []
        self.lengths: list[int] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(self.n_waiting // self.block * self.block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        for lo in range(0, upto, self.block):
            part = ids[lo : min(lo + self.block, upto)]
            data = WaveletMatrix.build(part, self.levels).to_bytes()
            self.sink.write(data)
            self.blocks.append((self.n, self.at, len(data)))
            self.at += len(data)
            self.n += len(part)
        self.waiting = [ids[upto:]]
        self.n_waiting = len(ids) - upto

    def close(self) -> int:
        """Writes the footer; returns the file's size."""
        if self.n_waiting:
            self._flush(self.n_waiting)
        known = np.array([i is not None for i in self.doc_ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], dtype="<i8")
        docs = zlib.compress(known.tobytes() + ids.tobytes() + np.array(self.lengths, dtype="<i8").tobytes(), 1)
        self.sink.write(docs)
        foot = json.dumps(
            {"n": self.n, "docs": len(ids), "at": self.at, "size": len(docs), "blocks": self.blocks}
        ).encode()
        self.sink.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
        return self.at + len(docs) + len(foot) + 8


class ShardReader:
    """Reads a shard file by byte ranges."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8, size - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a shard file: {uri}")
        n = int.from_bytes(tail[:4], "little")
        self.foot = json.loads(self.file.read_at(n, size - 8 - n))
        self.n = self.foot["n"]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def documents(self) -> tuple[list, np.ndarray]:
        """doc_ids and lengths, in order."""
        raw = zlib.decompress(self.file.read_at(self.foot["size"], self.foot["at"]))
        k = self.foot["docs"]
        ids = np.frombuffer(raw, dtype="<i8", count=k, offset=k)
        known = np.frombuffer(raw, dtype=np.uint8, count=k)
        return [int(i) if x else None for i, x in zip(ids, known, strict=True)], np.frombuffer(
            raw, dtype="<i8", count=k, offset=9 * k
        )

    def matrices(self):
        """(first token, wavelet matrix) of each block."""
        for first, at, size in self.foot["blocks"]:
            yield first, WaveletMatrix.from_bytes(self.file.read_at(size, at))

    def access(self, i: int) -> int:
        """The id at a position of the shard."""
        for first, at, size in self.foot["blocks"]:
            m = WaveletMatrix.from_bytes(self.file.read_at(size, at)) if first <= i else None
            if m and i < first + m.n:
                return int(m.access(i - first))
        raise IndexError(i)

    def count(self, token: int) -> int:
        """How often a token stands in the shard."""
        return sum(m.count(token) for _, m in self.matrices())

    def occurrences(self, token: int) -> list[int]:
        """All positions of a token in the shard."""
        return [first + i for first, m in self.matrices() for i in m.occurrences(token)]


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, levels: int = 16, shards: int | None = None
) -> DataFrame:
    """Encodes whole texts and writes shard files; returns the manifest: shard, path, n_docs, n_tokens, bytes.

    Documents are dealt by ranges of doc_id (nulls first, ties by text hash, repeated rows each) and
    sorted within. A null or empty text is its end id alone. An empty table gives no shard. Every
    attempt of a task writes its own file; the manifest names only those of attempts that ended.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "wavelet")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    end = np.array([end_id], dtype=np.uint32)

    def run(batches):
        enc, shard, name = encoder(tokenizer_path, False, KEEP), TaskContext.get().partitionId(), uuid.uuid4().hex
        writer = sink = None
        for ids, texts in doc_chunks(batches, 1 << 21):
            if writer is None:
                system, path = filesystem(folder)
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{shard:06d}-{name}.qwm")
                writer = ShardWriter(sink, levels)
            flat, bounds = enc.encode(texts)
            if max(int(flat.max(initial=0)), end_id) >> levels:
                raise ValueError(f"ids of {levels} bits do not hold all of this vocabulary")
            for i, lo, hi in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                writer.add(i, np.concatenate([flat[lo:hi], end]))
        if writer is not None:
            size = writer.close()
            sink.close()
            row = [[shard], [f"{folder}/{shard:06d}-{name}.qwm"], [len(writer.doc_ids)], [writer.n], [size]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 3], strict=True)],
                names=["shard", "path", "n_docs", "n_tokens", "bytes"],
            )

    return materialize(
        dealt.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long, bytes long"), "wavelet-manifest"
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, decoded from its file: doc_id, start (in the corpus), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows = manifest.orderBy("shard").collect()  # one row per shard file, as many as shuffle partitions
    base, todo = 0, []
    for r in rows:
        todo.append((r["shard"], r["path"], base))
        base += r["n_tokens"]
    work = spark.createDataFrame(todo, "shard int, path string, base long").repartition(max(1, len(todo)), "shard")

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with ShardReader(path) as shard:
                    doc_ids, lengths = shard.documents()
                    crc, k, left = [0] * len(doc_ids), 0, int(lengths[0]) if len(lengths) else 0
                    for _, m in shard.matrices():
                        ids = m.decode().astype("<u4")
                        at = 0
                        while at < len(ids):
                            take = min(left, len(ids) - at)
                            crc[k] = zlib.crc32(ids[at : at + take].tobytes(), crc[k])
                            at, left = at + take, left - take
                            if not left:
                                k += 1
                                left = int(lengths[k]) if k < len(lengths) else 0
                    starts = base + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return work.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
