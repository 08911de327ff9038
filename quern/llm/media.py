"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A payload is an image of 8-bit grey samples, 64 to a row, in lossless PNG. Each task writes one tar
shard; equal payloads of a task are stored once, under their digest. Rows carry digest, shard, offset
and length. Metadata columns come from the first bytes of a member, payloads from its whole range.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, filesystem, materialize, scratch, small_batches

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, name, data and checksum.
HEADER_BYTES = 33
_BLOCK = 512


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey image of 8-bit samples, WIDTH to a row; the payload's length is a multiple of WIDTH."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each row starts with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(lines.tobytes(), level)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> dict:
    """Width, height, bits and colour kind from a PNG's first HEADER_BYTES bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bits": bits, "colour": colour}


def from_png(data: bytes) -> bytes:
    """The samples of such an image."""
    width, at, body = read_header(data)["width"], 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def pad(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def tar_header(name: str, size: int) -> bytes:
    """A tar member's header block."""
    import tarfile

    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def feature(payload: bytes) -> str:
    """16 hexadecimal digits of an average hash: 64 means of equal parts of the samples, against their mean."""
    x = np.frombuffer(payload, dtype=np.uint8)
    edges = np.arange(64) * len(x) // 64
    means = np.add.reduceat(x.astype(np.int64), edges) / np.diff(np.append(edges, len(x)))
    return np.packbits(means > x.mean()).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """Writes payloads of all texts to tar shards; one row per document: doc_id, n_bytes, digest (of the
    payload), shard, offset and length (of the stored form).

    A null text counts as empty. Rows of an attempt that did not end point nowhere: each attempt
    writes its own shard. An empty table writes nothing.
    """
    small_batches(docs.sparkSession)
    folder = scratch(docs.sparkSession, "media")

    def run(batches):
        sink = None
        at, stored = 0, {}
        for ids, texts in doc_chunks(batches, 1 << 20):
            if sink is None:
                system, path = filesystem(folder)
                system.create_dir(path, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
                sink = system.open_output_stream(f"{path}/{name}")
            rows = []
            for i, t in zip(ids, texts, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                payload = pad(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in stored:
                    png = to_png(payload)
                    sink.write(tar_header(f"{digest.hex()}.png", len(png)) + png + bytes(-len(png) % _BLOCK))
                    stored[digest] = (at + _BLOCK, len(png))
                    at += _BLOCK + len(png) + -len(png) % _BLOCK
                rows.append((i, len(raw), digest.hex(), f"{folder}/{name}", *stored[digest]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, k)
                    for c, k in zip(
                        zip(*rows, strict=True),
                        [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()],
                        strict=True,
                    )
                ],
                names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        if sink is not None:
            sink.write(bytes(2 * _BLOCK))
            sink.close()

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(
        keyed.mapInArrow(
            run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
        ),
        "media-rows",
    )


class Shards:
    """Range reads from tar shards; the last one stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = filesystem(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def metadata(rows: DataFrame) -> DataFrame:
    """Adds width, height, bits and colour by reading each member's first HEADER_BYTES bytes only."""

    def run(batches):
        shards = Shards()
        for b in batches:
            place = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset")), strict=True)
            heads = [read_header(shards.read(uri, at, HEADER_BYTES)) for uri, at in place]
            cols = [pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "bits", "colour")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *cols], names=[*b.schema.names, "width", "height", "bits", "colour"]
            )
        shards.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, width int, height int, bits int, colour int")


def digests(rows: DataFrame) -> DataFrame:
    """Reads every payload back from its range: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature, beside the given columns."""
    added = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        shards = Shards()
        for b in batches:
            place = zip(
                *(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True
            )
            got, last, row = [], None, None
            for key in place:
                if key != last:
                    data = shards.read(*key)
                    payload = from_png(data)
                    row = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-WIDTH:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        feature(payload),
                    )
                    last = key
                got.append(row)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)] if got else [
                pa.array([], k) for k in kinds
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *added])
        shards.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(
        run,
        f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )
