"""WARC 1.1 archives of pages, compressed record by record with a dictionary of their own.

A shard is one file: a skippable frame that holds a Zstandard dictionary, then one frame per record.
The dictionary is trained on records of that shard. Of pages with the same long payload one is written
as a response; the others become revisits, which carry headers and point to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, filesystem, materialize, scratch, small_batches

#: Payloads shorter than this are always written; the dictionary's bytes, and those of the records it is trained on.
LEAST_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 1000, 64 << 10, 4 << 20
#: Uncompressed bytes of a shard: a reader's task is one shard.
SHARD_BYTES, LEVEL = 64 << 20, 6
#: Losers of up to this many records (32 bytes each) are sent to all tasks, more are shuffled.
BROADCAST_ROWS = 100_000

# Fixed values of the WARC and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def frame_dictionary(dictionary: bytes) -> bytes:
    """The leading skippable frame; its dictionary is itself compressed."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; where they are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n" + b"".join(samples)[-DICTIONARY_BYTES:]  # raw content, for it lacks a dictionary's magic number


def header_value(text: str) -> str:
    """A text as a header's value: what would end the line is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def sha1_label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(kind: str, name: str, row: dict, payload: bytes) -> bytes:
    """One record: WARC header, HTTP header and, in a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(name)}>"),
        ("WARC-Target-URI", f"urn:page:{row['page_id']}" if row["url"] is None else header_value(row["url"])),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", sha1_label(row["digest"])),
        ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).hexdigest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["page_id"] is not None:
        head.append(("Page-ID", str(row["page_id"])))
    if kind == "revisit":
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(row['to_rid'])}>")]
        if row["to_page"] is not None:
            head.append(("Refers-To-Page-ID", str(row["to_page"])))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Shard:
    """One file being written; the first records wait for the dictionary they train."""

    def __init__(self, folder: str):
        system, inner = filesystem(folder)
        system.create_dir(inner, recursive=True)
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        self.uri, self.sink = f"{folder}/{self.name}", system.open_output_stream(f"{inner}/{self.name}", compression=None)
        self.waiting, self.raw, self.bytes, self.records, self.compressor = [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.raw, self.records = self.raw + len(data), self.records + 1
        if self.compressor:
            self._write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        if self.raw >= SAMPLE_BYTES:
            self._start()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        dictionary = train(self.waiting)
        self._write(frame_dictionary(dictionary))
        kept = zstandard.ZstdCompressionDict(dictionary)
        kept.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=True)
        for data in self.waiting:
            self._write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int, int]:
        if not self.compressor:
            self._start()
        self.sink.close()
        return self.uri, self.records, self.raw, self.bytes


def decide(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """The records to write, and the scratch tables they read: page_id, url, rid, digest, size, html (null in
    a revisit), to_rid and to_page (null in a response).

    Of equal payloads of ``least`` bytes and more, the largest page_id is the response (then the last
    row by rid; of rows alike in everything, one). Nulls are smallest. Only digests of groups meet;
    a group of more than a thousandth of all rows is found by a broadcast, which has 1000 rows at most.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("+"), "url"), F.lit("-")), F.lit("|"), "digest")
    rows = rows.withColumn("rid", F.md5(name))
    light = materialize(rows.select("rid", "page_id", "url", "digest", "size"), "page-digests")
    long = light.where(F.col("size") >= least)
    groups = materialize(
        long.groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("win"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "n", F.col("win.rid").alias("to_rid"), F.col("win.page_id").alias("to_page")),
        "payload-groups",
    )
    bound = max(1, light.count() // 1000)
    told = long.join(F.broadcast(groups.where(F.col("n") > bound).drop("n")), "digest", "left")
    hot = told.where("to_rid is not null")
    rest = told.where("to_rid is null").drop("to_rid", "to_page").join(groups.where(F.col("n") <= bound).drop("n").hint("shuffle_hash"), "digest")
    members = materialize(hot.unionByName(rest), "group-members")
    lost = members.where("rid <> to_rid")
    # rows alike in everything with the winner: one of them is the response
    again = materialize(members.where("rid = to_rid").groupBy(*members.columns).count().where("count > 1"), "again")
    gone = materialize(lost.select("rid").distinct(), "revisits")
    build = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    first = rows.join(build, "rid", "left_anti")
    columns = ["page_id", "url", "rid", "digest", "size"]
    visits = [lost.select(*columns, "to_rid", "to_page")]
    if not again.isEmpty():
        one = first.join(again.select("rid"), "rid", "left_semi")
        alike = one.groupBy(*columns).agg(F.first("html").alias("html"))
        first = first.join(again.select("rid"), "rid", "left_anti").select(*columns, "html").unionByName(alike)
        copies = again.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("count"))))
        visits.append(copies.select(*columns, "to_rid", "to_page"))
    none = F.lit(None).cast("string")
    out = first.select(*columns, "html", none.alias("to_rid"), F.lit(None).cast("long").alias("to_page"))
    for v in visits:
        out = out.unionByName(v.withColumn("html", none))
    return out, [light, groups, members, again, gone]


def write(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages to archives in the shared folder; one row per shard: shard, records, raw_bytes, bytes.

    A null html is an empty payload, a null url becomes ``urn:page:<id>``; each repeated row has a
    record of its own; extra columns are ignored; an empty table writes nothing. Every attempt of a
    task writes its own files, and only those of tasks that ended are named.
    """
    small_batches(pages.sparkSession)
    folder = scratch(pages.sparkSession, "warc")
    records, tables = decide(pages, least)

    def run(batches):
        shard, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if shard and shard.raw >= SHARD_BYTES:
                    done.append(shard.close())
                    shard = None
                shard = shard or Shard(folder)
                revisit = row["to_rid"] is not None
                name = hashlib.md5(f"{shard.name}:{shard.records}".encode()).hexdigest() if revisit else row["rid"]
                shard.add(record("revisit" if revisit else "response", name, row, (row["html"] or "").encode()))
        if shard:
            done.append(shard.close())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        cols = zip(*done, strict=True) if done else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "records", "raw_bytes", "bytes"]
        )

    out = materialize(records.mapInArrow(run, "shard string, records long, raw_bytes long, bytes long"), "warc-shards")
    discard(*tables)
    return out


def frames(uri: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed records of a shard, read from its start."""
    system, inner = filesystem(uri)
    with system.open_input_stream(inner, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"no dictionary frame in {uri}")
        dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        frame, parts, rest = reader.decompressobj(), [], source.read(step)
        while rest:
            parts.append(frame.decompress(rest))
            if frame.eof:
                yield b"".join(parts)
                rest, frame, parts = frame.unused_data, reader.decompressobj(), []
            else:
                rest = b""
            rest = rest or source.read(step)
        if parts:
            raise ValueError(f"{uri} ends within a record")


def parse(data: bytes) -> dict:
    """Fields of a record, its digests checked against what it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if sha1_label(hashlib.sha1(block).hexdigest()) != field["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {field['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if field["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if sha1_label(digest) != field["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of {field['WARC-Record-ID']}")
    page, to = field.get("Page-ID"), field.get("Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": digest,
        "record_type": field["WARC-Type"], "refers_to": None if to is None else int(to), "url": field["WARC-Target-URI"],
        "payload": payload if field["WARC-Type"] == "response" else None,
    }


_READ = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()))


def batches_of(rows: Iterable[dict], names: list[str], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    kinds, waiting, size = dict(_READ), [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in waiting], kinds[n]) for n in names], names=names)

    for row in rows:
        waiting.append(row)
        size += 200 + len(row["payload"] or b"")
        if size >= most:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def read(shards: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to and url, with
    ``payloads`` also payload (null in a revisit). A task reads one shard at a time, as a stream; a record
    whose digest does not fit stops the job."""
    names = [n for n, _ in _READ if payloads or n != "payload"]
    spread = shards.select("shard").repartition(max(1, min(shards.count(), 100_000)))

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                yield from batches_of(map(parse, frames(uri)), names)

    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    return spread.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
