"""Alignment of two tokenizers: token groups with common byte ends, and corpus-wide counts of linked ids.

A text is cut at single spaces after a sign that is no white space, where both vocabularies end a
token; each distinct cut is encoded and aligned once while it stays in the worker's memory. Only a
text that a cut does not reproduce is aligned as a whole.

Counts: tasks count the pairs of ids they link. Distinct pairs, united in a tree, get a minimal
perfect hash for each of SEGMENTS ranges of ids. Each task's counts become dense vectors in hash
order, summed in a tree. Hash, keys and sums of a range are one file in the shared folder. The second
pass aligns the documents again and looks counts up, range by range, each key compared with the stored one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, doc_chunks, filesystem, materialize, mix64, scratch, small_batches
from quern.llm.tokens import Pool, _byte_chars, _look

#: Ranges of the second vocabulary's ids, rows that one task of a tree takes, characters aligned together.
SEGMENTS, FAN, CHUNK = 128, 32, 4 << 20
#: Cuts that the libraries encode as one text.
TOGETHER = 256
#: Bytes of ranges a worker keeps open, characters of cuts it remembers.
OPEN_BYTES, KNOWN_CHARS = 32 << 20, 5 << 20
_BITS = 16
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")
#: Texts with a space after white space, at the start or at the end: not every space of theirs is a cut.
_ODD = r"[\s\v\pZ\x1c-\x1f\x85] |\A | \z"


def plain_tokens(path_a: str, path_b: str):
    """(A, B, A's bytes, B's bytes): the libraries' tokenizers and the bytes of every token."""
    import os

    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(_byte_chars())}
    vocabulary = a.get_vocab()
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        bytes_a[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    bytes_b = []
    for i in range(b.vocab_size()):
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if max(len(bytes_a), len(bytes_b)) > 1 << _BITS:
        raise ValueError("vocabularies of more than 65,536 ids")
    return a, b, bytes_a, bytes_b


class Alignment:
    """One text's groups: counts, the pairs linked and the groups as text; ``good`` if both give its bytes."""

    __slots__ = ("good", "n_a", "n_b", "groups", "pairs", "text")

    def __init__(self, wanted: bytes, a: list[int], b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]):
        parts_a, parts_b = [bytes_a[i] for i in a], [bytes_b[i] for i in b]
        self.good = b"".join(parts_a) == wanted and b"".join(parts_b) == wanted
        self.n_a, self.n_b, self.groups, self.pairs, self.text = len(a), len(b), 0, [], ""
        if not self.good:
            return
        out, i, j = [], 0, 0
        while i < len(a):
            from_i, from_j = i, j
            end_a, end_b = len(parts_a[i]), len(parts_b[j])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a, i = end_a + len(parts_a[i]), i + 1
                else:
                    end_b, j = end_b + len(parts_b[j]), j + 1
            # no token is empty, so one token of each kind ends here
            self.pairs.append(b[j - 1] << _BITS | a[i - 1])
            out.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
        self.groups, self.text = len(out), ";".join(out)


class Aligner:
    """Aligns texts cut by cut, with a bounded memory of cuts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.bytes_a, self.bytes_b = plain_tokens(path_a, path_b)
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size())):
            raise ValueError("a piece of the second vocabulary goes on after a space: cuts would change ids")
        self.size_a, self.size_b = (np.array([len(x) for x in b]) for b in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = (
            np.array([[f"{i}{mark}" for mark in marks] for i in range(len(b))], dtype=object) for b, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        )
        self._renew()

    def _renew(self) -> None:
        self.known, self.chars, self.n = {}, 0, 0
        self.pool, self.texts, self.numbers = Pool(), [], np.empty((1 << 12, 4), dtype=np.int64)

    def whole(self, text: str) -> Alignment:
        """A text as the libraries alone align it."""
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        return Alignment((" " + text).encode(), ids, self.b.encode(text), self.bytes_a, self.bytes_b)

    def _learn(self, new: list[str]) -> None:
        """Aligns new cuts (each without its first space)."""
        plain = [s[-1:].strip() != "" and "▁" not in s for s in new]
        order = [s for s, p in zip(new, plain, strict=True) if p]
        alone = [s for s, p in zip(new, plain, strict=True) if not p]
        for at in range(0, len(order), 32 * TOGETHER):
            alone += self._together(order[at : at + 32 * TOGETHER])
        if alone:
            each = [self.whole(s) for s in alone]
            pairs = np.array([p for one in each for p in one.pairs], dtype=np.uint32)
            rows = [(one.good, one.n_a, one.n_b, one.groups) for one in each]
            self._add(alone, pairs, np.array(rows, dtype=np.int64).reshape(-1, 4), [one.text + ";" for one in each])

    def _add(self, cuts: list[str], pairs: np.ndarray, rows: np.ndarray, texts: list[str]) -> None:
        numbers = self.pool.add(pairs, rows[:, 3])
        self.known.update(zip(cuts, numbers.tolist(), strict=True))
        self.chars += sum(map(len, cuts))
        self.texts += texts
        while self.n + len(rows) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.empty_like(self.numbers)])
        self.numbers[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    def _together(self, cuts: list[str]) -> list[str]:
        """Aligns cuts many at a time, each group as one text; returns those of groups that come back changed."""
        groups = [cuts[i : i + TOGETHER] for i in range(0, len(cuts), TOGETHER)]
        joined = [" ".join(g) for g in groups]
        coded = self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)
        kept, changed, flat_a, flat_b, text = [], [], [], [], []
        for g, t, x, y in zip(groups, joined, coded, self.b.encode(joined), strict=True):
            ids, wanted = x.ids, (" " + t).encode()
            get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
            if b"".join(map(get_a, ids)) == wanted and b"".join(map(get_b, y)) == wanted:
                kept += g
                flat_a += ids
                flat_b += y
                text.append(wanted)
            else:
                changed += g
        if kept:
            a, b = np.array(flat_a), np.array(flat_b)
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            ends = np.cumsum(np.array([len(s.encode()) + 1 for s in kept]))
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
            # tokens in the order of the groups' text: a group's A tokens, then its B tokens
            place_a = np.arange(len(a)) + np.concatenate([[0], at_b + 1])[np.searchsorted(at_a, np.arange(len(a)))]
            place_b = np.arange(len(b)) + (at_a + 1)[np.searchsorted(at_b, np.arange(len(b)))]
            names = np.empty(len(a) + len(b), dtype=object)
            names[place_a], names[place_b] = self.name_a[a, 0], self.name_b[b, 0]
            names[place_a[at_a]], names[place_b[at_b]] = self.name_a[a[at_a], 1], self.name_b[b[at_b], 1]
            n_a, n_b, n_groups = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (ends_a, ends_b, common))
            stops = np.cumsum(n_a + n_b).tolist()
            names = names.tolist()
            texts = ["".join(names[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
            pairs = (b[at_b] << _BITS | a[at_a]).astype(np.uint32)
            self._add(kept, pairs, np.stack([np.ones_like(n_a), n_a, n_b, n_groups], axis=1), texts)
        return changed

    def cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(numbers of all texts' cuts one after another, the texts' bounds in them, texts to align whole)."""
        if self.chars > KNOWN_CHARS:
            self._renew()
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD).to_pylist()
        plain = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
        counts = np.diff(plain.offsets.to_numpy())
        pieces = plain.values
        if any(odd):
            where = plain.offsets.to_numpy()
            done, out = 0, []
            for i in np.flatnonzero(odd).tolist():
                mine = _CUT.split(texts[i])
                out += [pieces.slice(done, where[i] - done), pa.array(mine, pa.large_string())]
                done, counts[i] = where[i] + 1, len(mine)
            pieces = pa.concat_arrays([*out, pieces.slice(done)])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = _look(self.known, names)
        new = np.flatnonzero(found < 0)
        if len(new):
            some = [names[i] for i in new]
            self._learn(some)
            found[new] = _look(self.known, some)
        numbers = found[coded.indices.to_numpy()]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        bad = np.add.reduceat(self.numbers[numbers, 0] == 0, bounds[:-1]) if len(texts) else []
        return numbers, bounds, [i for i in np.flatnonzero(bad).tolist() if texts[i]]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two vocabularies."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


# --- minimal perfect hash -----------------------------------------------------------------------


class PerfectHash:
    """Distinct numbers to 0..n-1 without gaps: in each level, a key that falls alone on a bit sets it; its
    place is the number of bits set before. The others try the next level."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view(np.uint64)).astype(np.int64))])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys.astype(np.uint64) + np.uint64((level + 1) << 40)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place]]
        return cls(sizes, np.concatenate([*bits, np.zeros(0, np.uint8)]))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; a number that was no key gets any place or -1."""
        out, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        words = self.bits.view(np.uint64)
        for level, size in enumerate(self.sizes):
            at = base + self._place(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ones[at >> 6] + before)[hit]
            left, base = left[~hit], base + size
        return out

    def pack(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + self.bits.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        return cls(list(struct.unpack_from(f"<{n}Q", data, 4)), np.frombuffer(data, dtype=np.uint8, offset=4 + 8 * n).copy())


# --- counts -------------------------------------------------------------------------------------


def add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their counts."""
    keys, at = np.unique(np.concatenate([*codes, np.zeros(0, np.uint32)]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, at, np.concatenate([*counts, np.zeros(0, np.int64)]))
    return keys, total


def count_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """segment, part, codes, counts: the pairs each task links, by range of ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        work = aligner(path_a, path_b)
        codes, counts, held = [], [], 0
        for _, texts in doc_chunks(batches, CHUNK):
            numbers, bounds, bad = work.cuts(texts)
            drop = np.ones(len(numbers), dtype=bool)
            for i in bad:
                drop[bounds[i] : bounds[i + 1]] = False
                one = work.whole(texts[i])
                codes.append(np.array(one.pairs, dtype=np.uint32))
                counts.append(np.ones(len(one.pairs), dtype=np.int64))
            for i, t in enumerate(texts):
                if not t:
                    drop[bounds[i] : bounds[i + 1]] = False
            kinds, times = np.unique(numbers[drop], return_counts=True)
            flat, sizes = work.pool.get(kinds)
            codes.append(flat)
            counts.append(np.repeat(times, sizes))
            held += len(flat)
            if held > 1 << 20:
                keys, total = add_up(codes, counts)
                codes, counts, held = [keys], [total], 0
        keys, total = add_up(codes, counts)
        part = TaskContext.get().partitionId()
        where = (keys >> _BITS) % SEGMENTS
        for s in np.unique(where).tolist():
            mine = where == s
            yield _row((s, part, keys[mine].astype("<u4").tobytes(), total[mine].astype("<i8").tobytes()))

    keyed = docs.select(F.lit(0).alias("at"), F.col("text").cast("string").alias("text"))
    return materialize(keyed.mapInArrow(run, "segment int, part int, codes binary, counts binary"), "pair-counts")


def _row(values: tuple) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["segment", "part", "codes", "counts"])


def _ints(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]


def tree(rows: DataFrame, join) -> DataFrame:
    """Rows (segment, part, codes, counts) joined, FAN at a time, until each segment has one."""

    def run(key, table):
        codes, counts = join(_ints(table.column("codes"), "<u4"), _ints(table.column("counts"), "<i8"))
        return pa.Table.from_batches([_row((key[0].as_py(), key[1].as_py(), codes.astype("<u4").tobytes(), counts.astype("<i8").tobytes()))])

    top = rows.agg(F.max("part")).first()[0] or 0
    while True:
        top //= FAN
        rows = rows.groupBy("segment", F.floor(F.col("part") / FAN).cast("int").alias("p")).applyInArrow(run, rows.schema)
        if not top:
            return rows
        rows = materialize(rows, "tree")


def dense_counts(counted: DataFrame) -> DataFrame:
    """segment, hash, keys, counts: each range's perfect hash, its keys and their summed counts in hash order."""

    def hashed(key, table):
        codes = np.frombuffer(table.column("codes")[0].as_py(), dtype="<u4")
        found = PerfectHash.build(codes)
        keys = np.empty_like(codes)
        keys[found.index(codes)] = codes
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "hash": [found.pack()], "keys": [keys.tobytes()]})

    def dense(key, mine, table):
        found, size = PerfectHash.unpack(mine.column("hash")[0].as_py()), len(mine.column("keys")[0].as_py()) // 4
        total = np.zeros(size, dtype=np.int64)
        for codes, counts in zip(_ints(table.column("codes"), "<u4"), _ints(table.column("counts"), "<i8"), strict=True):
            total[found.index(codes)] += counts  # codes of one row are distinct
        return pa.Table.from_batches([_row((key[0].as_py(), key[1].as_py(), b"", total.astype("<i8").tobytes()))])

    none = np.zeros(0, dtype=np.uint32)
    distinct = tree(counted.withColumn("counts", F.lit(b"")), lambda codes, _: (np.unique(np.concatenate(codes)), none))
    hashes = materialize(distinct.groupBy("segment").applyInArrow(hashed, "segment int, hash binary, keys binary"), "pair-hashes")
    first = counted.withColumn("group", F.floor(F.col("part") / FAN).cast("int"))
    asked = first.select("segment", "group").distinct().join(hashes, "segment")
    tasks = counted.select(F.col("segment").alias("s"), F.floor(F.col("part") / FAN).cast("int").alias("g"), "codes", "counts")
    vectors = asked.groupBy("segment", "group").cogroup(tasks.groupBy("s", "g")).applyInArrow(dense, counted.schema)
    vectors = materialize(vectors, "pair-vectors")
    total = tree(vectors, lambda _, counts: (none, np.sum(counts, axis=0)))
    return materialize(hashes.join(total.select("segment", "counts"), "segment"), "pair-sums")


def write_table(sums: DataFrame) -> dict[int, str]:
    """Writes one file per range: hash, keys, counts and whether a count is its B id's largest. Returns the
    files by range (SEGMENTS at most)."""
    folder = scratch(sums.sparkSession, "pairs")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], dtype="<u4")
                counts = np.frombuffer(row["counts"], dtype="<i8")
                b = keys >> _BITS
                top = np.zeros(1 << _BITS, dtype=np.int64)
                np.maximum.at(top, b, counts)
                data = struct.pack("<QQ", len(row["hash"]), len(keys)) + row["hash"] + keys.tobytes() + counts.tobytes()
                data += (counts == top[b]).astype(np.uint8).tobytes()
                system, inner = filesystem(folder)
                system.create_dir(inner, recursive=True)
                name = f"{row['segment']:04d}-{uuid.uuid4().hex}"
                with system.open_output_stream(f"{inner}/{name}") as sink:
                    sink.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int32()), pa.array([f"{folder}/{name}"])], names=["segment", "path"])

    return {r.segment: r.path for r in materialize(sums.mapInArrow(run, "segment int, path string"), "pair-files").collect()}


class PairTable:
    """Counts of pairs from the ranges' files; the last ones used stay open, up to OPEN_BYTES."""

    def __init__(self, files: dict[int, str]):
        self.files, self.open, self.bytes = files, OrderedDict(), 0

    def _range(self, segment: int):
        if segment in self.open:
            self.open.move_to_end(segment)
            return self.open[segment]
        system, inner = filesystem(self.files[segment])
        with system.open_input_stream(inner, compression=None) as source:
            data = source.read()
        n_hash, n = struct.unpack_from("<QQ", data)
        found = PerfectHash.unpack(data[16 : 16 + n_hash])
        keys = np.frombuffer(data, dtype="<u4", offset=16 + n_hash, count=n)
        counts = np.frombuffer(data, dtype="<i8", offset=16 + n_hash + 4 * n, count=n)
        best = np.frombuffer(data, dtype=np.uint8, offset=16 + n_hash + 12 * n, count=n)
        self.open[segment] = (found, keys, counts, best, len(data))
        self.bytes += len(data)
        while self.bytes > OPEN_BYTES and len(self.open) > 1:
            self.bytes -= self.open.popitem(last=False)[1][-1]
        return self.open[segment]

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is its B id's largest) of each pair; an unknown pair is an error."""
        counts, best = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        where = (codes >> _BITS) % SEGMENTS
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(SEGMENTS + 1))
        for s in np.unique(where).tolist():
            mine = order[edges[s] : edges[s + 1]]
            found, keys, n, top, _ = self._range(s)
            at = found.index(codes[mine])
            if (at < 0).any() or (keys[at] != codes[mine]).any():
                raise ValueError("a pair that the first pass did not see")
            counts[mine], best[mine] = n[at], top[at]
        return counts, best


_tables: dict[str, PairTable] = {}


def _pair_table(files: dict[int, str]) -> PairTable:
    name = min(files.values(), default="")
    if name not in _tables:
        _tables.clear()
        _tables[name] = PairTable(files)
    return _tables[name]


_OUT = (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()))


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document, with
    ``groups`` also the groups as text.

    A null or empty text, or one whose tokens do not give its bytes back, has zeros and '' . Repeated
    rows count each; ties of the largest count all count as best; an empty table gives no rows; extra
    columns are ignored.
    """
    counted = count_pairs(docs, path_a, path_b)
    sums = dense_counts(counted)
    files = write_table(sums)
    discard(counted, sums)

    def run(batches):
        work, table = aligner(path_a, path_b), _pair_table(files)
        for ids, texts in doc_chunks(batches, CHUNK):
            numbers, bounds, bad = work.cuts(texts)
            plain = {i: work.whole(texts[i]) for i in bad}
            kinds, at = np.unique(numbers, return_inverse=True)
            flat, sizes = work.pool.get(kinds)
            more = [np.array(one.pairs, dtype=np.uint32) for one in plain.values()]
            empty = [i for i, t in enumerate(texts) if not t]
            good = np.ones(len(texts), dtype=bool)
            good[[*bad, *empty]] = False
            used = np.zeros(len(kinds), dtype=bool)
            used[at[np.repeat(good, np.diff(bounds))]] = True
            used = np.repeat(used, sizes)  # pairs of cuts that only texts aligned whole hold were not counted
            codes, back = np.unique(np.concatenate([flat[used], *more]), return_inverse=True)
            counts, best = table.look(codes)
            every = np.zeros((len(flat), 2), dtype=np.int64)
            every[used, 0], every[used, 1] = counts[back[: used.sum()]], best[back[: used.sum()]]
            run_of = np.concatenate([[0], np.cumsum(every[:, 0])]), np.concatenate([[0], np.cumsum(every[:, 1])])
            ends = np.cumsum(sizes)
            per = [(c[ends] - c[ends - sizes])[at] for c in run_of]
            per += [work.numbers[numbers, k] for k in (1, 2, 3)]
            count_sum, n_best, n_a, n_b, n_groups = (np.add.reduceat(x, bounds[:-1]).tolist() for x in per)
            rest = used.sum()
            rows = []
            for i, doc in enumerate(ids):
                if i in plain:
                    one, n = plain[i], len(plain[i].pairs)
                    mine, rest = back[rest : rest + n], rest + n
                    if one.good:
                        row = [one.n_a, one.n_b, one.groups, n, int(best[mine].sum()), int(counts[mine].sum()), one.text]
                    else:
                        row = [0, 0, 0, 0, 0, 0, ""]
                elif not texts[i]:
                    row = [0, 0, 0, 0, 0, 0, ""]
                else:
                    text = "".join([work.texts[k] for k in numbers[bounds[i] : bounds[i + 1]].tolist()])[:-1]
                    row = [n_a[i], n_b[i], n_groups[i], n_groups[i], n_best[i], count_sum[i], text]
                text = row[-1]
                row[-1] = hashlib.sha256(text.encode()).hexdigest() if text else ""
                rows.append((doc, *row, *([text] if groups else [])))
            kept = [*_OUT, *([("groups", pa.string())] if groups else [])]
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kept, strict=True)], names=[n for n, _ in kept])

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return keyed.mapInArrow(run, f"doc_id long, {kinds}{', groups string' if groups else ''}")
