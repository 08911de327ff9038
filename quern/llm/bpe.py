"""Byte-level BPE: Spark folds ranked merges over distinct words; decoding concatenates binary pieces.

Words of a bounded sample of the corpus are folded first, each once, and written as a dictionary that
workers read from the shared folder. Then each block of documents (a few megabytes) becomes one row:
codes of dictionary words and of its own further words, which go through the same fold. The rows are
written; a second pass puts ids together and decodes them. Nothing is shuffled but the sample's words,
and no row outgrows its block. The sample decides how many words are folded again, never a result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import random
import re
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, filesystem, from_planes, kept_in_worker, materialize, planes, small_batches
from quern.llm.tokens import _LATIN, _ODD_SPACE, Pool, runs

#: More than any rank: no merge. No id: stands before and after a word.
NONE, SENTINEL = 1 << 20, (1 << 16) - 1
#: Buckets of the rank map, its places, and the bound on a bucket's shift.
BUCKETS, PLACES, SHIFTS = 32749, 163841, 1 << 13
#: Words of more bytes are merged with a heap instead: a fold takes quadratic time.
LONG_WORD = 256
#: Tags of a word's neighbours take as many values.
TAGS = 1024
#: The dictionary's words come from about so many bytes of text.
SAMPLE_BYTES = 3 << 24


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks (which are their ids) of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id * 65536 + right id) -> rank of the two joined, for all pairs that can merge."""
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


class RankMap:
    """The pairs as literal arrays that give a pair's rank in two reads.

    A pair's hash is its product with a factor without the last 20 bits. Its place is the hash's remainder
    by PLACES plus the shift of its bucket (the remainder by BUCKETS); shifts are chosen so that no two
    pairs meet. A place holds pair * 65536 + rank, or -2**50. Ranks of two bytes, which a word begins with,
    stand in an array of their own: one read.
    """

    def __init__(self, pairs: dict[int, int], byte_ids: list[int]):
        rng, clash = random.Random(1), True
        while clash:  # until no two pairs of a bucket have one remainder by PLACES
            self.factor = rng.randrange(1 << 29, 1 << 30)
            buckets = defaultdict(list)
            for pair, rank in sorted(pairs.items()):
                h = pair * self.factor >> 20
                buckets[h % BUCKETS].append((h % PLACES, pair << 16 | rank))
            clash = any(len({at for at, _ in x}) < len(x) for x in buckets.values())
        places, shifts = [-(1 << 50)] * (PLACES + SHIFTS), [0] * BUCKETS
        for bucket, entries in sorted(buckets.items(), key=lambda x: -len(x[1])):
            shift = 0
            while any(places[at + shift] >= 0 for at, _ in entries):
                shift = rng.randrange(SHIFTS)
            for at, entry in entries:
                places[at + shift] = entry
            shifts[bucket] = shift
        two_bytes = [pairs.get(a << 16 | b, NONE) for a in byte_ids for b in byte_ids]
        self.literal = F.struct(
            _literal(places, "array<bigint>").alias("places"),
            _literal(shifts, "array<int>").alias("shifts"),
            _literal(two_bytes, "array<bigint>").alias("bytes"),
        )

    def rank(self, table: Column, a: Column, b: Column) -> Column:
        """The rank of two neighbours, NONE if they never merge."""

        def look(pair: Column) -> Column:
            h = F.shiftright(pair * self.factor, 20)
            at = F.get(table["shifts"], F.pmod(h, F.lit(BUCKETS)).cast("int")) + F.pmod(h, F.lit(PLACES))
            return _let(
                F.get(table["places"], at.cast("int")),
                lambda x: F.when(F.shiftright(x, 16) == pair, x.bitwiseAND(F.lit(65535)).cast("int")).otherwise(F.lit(NONE)),
            )

        return _let(a.cast("long") * 65536 + b, look)


def _literal(value: list, schema: str) -> Column:
    """An array as a literal; Spark folds it to a constant."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a fold over nothing."""
    return F.aggregate(_literal([], "array<int>"), value, lambda x, _: x, body)


def fold_merges(word: Column, byte_ids: Column, ranks: RankMap, table: Column) -> Column:
    """Ids of a word (an array of at most LONG_WORD byte values): the lowest-ranked pair merges, the
    leftmost first.

    The state holds one number for each id and for a sentinel before them: the rank of the id and its
    next, a tag, and the id. Tags ascend, so no two numbers are equal and the least is the leftmost of the
    least rank. The rank of a merged pair is the new id.
    """
    per_rank = TAGS << 16  # ids take 16 bits

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(SENTINEL))

    def entry(a: Column, b: Column, low: Column) -> Column:
        """The number of the neighbours a and b; ``low`` holds tag and id."""
        return ranks.rank(table, a, b).cast("long") * per_rank + low

    def merge(e: Column, least: Column, at: Column) -> Column:
        # the ids at and at + 1 (from 1) become one
        new = F.shiftright(least, 26)
        before, after = F.get(e, at - 2), F.coalesce(F.get(e, at + 1), F.lit(SENTINEL).cast("long"))
        left = entry(id_of(before), new, before.bitwiseAND(F.lit(per_rank - 1)))
        # the tag of the id at ``at``, whose number stands one before: the sentinel counts
        tag = F.get(e, at).bitwiseAND(F.lit(per_rank - 1 - SENTINEL))
        right = entry(new, id_of(after), tag + new)
        return F.concat(F.slice(e, F.lit(1), at - 2), F.array(left, right), F.slice(e, at + 2, F.size(e)))

    def step(e: Column, _: Column) -> Column:
        return _let(
            F.array_min(e),
            lambda least: F.when(least >= NONE * per_rank, e).otherwise(
                _let(F.array_position(e, least).cast("int"), lambda at: merge(e, least, at))
            ),
        )

    first = F.lit(NONE * per_rank + SENTINEL)
    entries = F.transform(
        word,
        lambda b, i: F.coalesce(F.get(table["bytes"], b * 256 + F.get(word, i + 1)), F.lit(NONE).cast("long")) * per_rank
        + (i + 1) * (1 << 16)
        + F.get(byte_ids, b),
    )
    return F.aggregate(
        F.slice(word, F.lit(2), F.size(word)),
        F.concat(F.array(first), entries),
        step,
        lambda e: F.transform(F.slice(e, F.lit(2), F.size(e)), lambda x: id_of(x).cast("int")),
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one very long word, with a heap over linked pieces."""
    n = len(word)
    ends, alive, before = list(range(1, n + 1)), [True] * n, list(range(-1, n - 1))

    def pair(i: int):
        j = ends[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != stop:
            continue
        alive[ends[i]] = False
        ends[i] = stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[ends[k]]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _byte_lists(words: list[bytes]) -> pa.ListArray:
    sizes = np.array([0, *map(len, words)], dtype=np.int32)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))


def _sizes(lists) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def dictionary(docs: DataFrame, pattern: str, fold, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """word (binary), n and ids of the distinct words of a sample of about ``sample_bytes`` bytes of text.

    The sample bounds the dictionary: its words are parts of the sampled texts. Written once.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    sampled = docs.sample(min(1.0, sample_bytes / size), 7) if size else docs.limit(0)

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        for _, texts in doc_chunks(batches, 1 << 23):
            counts: Counter = Counter()
            for t in texts:
                counts.update(find(t))
            found = [(w.encode(), n) for w, n in counts.items() if len(w) <= LONG_WORD // 8]
            for lo in range(0, len(found), 1 << 14):
                cols = zip(*found[lo : lo + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int64()), strict=True)], names=["word", "n"]
                )

    def lists(batches):
        for batch in batches:
            words = _byte_lists(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, words], names=["word", "n", "bytes"])

    words = sampled.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word binary, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(lists, "word binary, n long, bytes array<int>")
    folded = fold(F.col("bytes"), lambda word, ids: ids(word)).alias("ids")
    return materialize(words.select("word", "n", folded), "bpe-words")


def _dictionary(path: str, with_words: bool) -> tuple:
    """The worker's copy of a written dictionary: its words by number, or how many runs and ids it has and the runs.

    Words are one Arrow array, a fifth of what a Python dictionary of them takes; each block looks its words up at once.
    """
    dictionaries = kept_in_worker("bpe")
    if (path, with_words) not in dictionaries:
        import pyarrow.dataset as ds

        dictionaries.clear()
        system, place = filesystem(path)
        table = ds.dataset(place, filesystem=system, format="parquet").to_table(["word", "n"] + ["ids"] * (not with_words))
        table = table.sort_by([("n", "descending"), ("word", "ascending")])  # frequent words have small codes
        if with_words:
            dictionaries[path, with_words] = table.column("word").combine_chunks()
        else:
            pool, ids = Pool(), table.column("ids").combine_chunks()
            pool.add(ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), _sizes(ids))
            dictionaries[path, with_words] = (pool.n, pool.n_ids), pool
            del ids
        del table
        pa.default_memory_pool().release_unused()  # else Arrow holds on to what the table took
    return dictionaries[path, with_words]


def letters_are_words(pattern: str) -> bool:
    """Letters with at most a space before them are one match: what the pattern tries before begins with an apostrophe."""
    before, found, _ = pattern.partition(r"| ?\p{L}+|")
    return bool(found) and re.fullmatch(r"'[a-z]+(\|'[a-z]+)*", before) is not None


def one_word(chunks: list[str]) -> np.ndarray:
    """Which chunks are Latin letters with at most a space before them."""
    chunks = pa.array([c.encode("utf-8", "replace") for c in chunks], pa.binary()).cast(pa.string())
    return pc.match_substring_regex(chunks, f"^ ?[{_LATIN}]+$").to_numpy(zero_copy_only=False)


def numbered(words: list[bytes], known: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of distinct words, those of ``known`` first, and the words that it lacks in the order of their numbers."""
    words = pa.array(words, pa.binary())
    number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
    new = number < 0
    number[new] = len(known) + np.arange(np.count_nonzero(new))
    return number, words.filter(pa.array(new)).to_pylist()


def blocks_of_words(docs: DataFrame, pattern: str, path: str, max_bytes: int) -> DataFrame:
    """One row per block of documents: doc_ids, n_words of each, codes of words, and the words that the
    dictionary lacks."""
    schema = "doc_ids array<bigint>, n_words binary, codes binary, words array<array<int>>, long_words array<binary>"

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        known, letters = _dictionary(path, True), letters_are_words(pattern)
        for ids, texts in doc_chunks(batches, max_bytes):
            chunk_of: defaultdict = defaultdict()
            chunk_of.default_factory = chunk_of.__len__
            chunks, bounds = [], []
            for t in texts:
                if _ODD_SPACE.search(t):
                    parts = [t]
                else:
                    first, *rest = t.split(" ")
                    parts = [first, *map(" ".__add__, rest)]
                chunks.append(np.fromiter(map(chunk_of.__getitem__, parts), dtype=np.int64, count=len(parts)))
                bounds.append(len(parts))
            names = list(chunk_of)
            chunk_of.clear()  # it refers to itself, so it would stay until Python looks for such circles
            alone = one_word(names) if letters else np.zeros(len(names), dtype=bool)
            word_of: defaultdict = defaultdict()
            word_of.default_factory = word_of.__len__
            found = [word_of[w] for w in compress(names, alone)]
            sizes, n_alone = np.ones(len(names), dtype=np.int64), len(found)
            for i in np.flatnonzero(~alone).tolist():
                before = len(found)
                found += map(word_of.__getitem__, find(names[i]))
                sizes[i] = len(found) - before
            distinct = [w.encode("utf-8", "surrogatepass") for w in word_of]
            names = None
            word_of.clear()
            numbers, words = numbered(distinct, known)
            flat, starts = np.empty(sizes.sum(), dtype=np.int64), np.cumsum(sizes) - sizes
            flat[starts[alone]] = numbers[found[:n_alone]]
            flat[runs(starts[~alone], sizes[~alone])] = numbers[found[n_alone:]]
            codes = np.concatenate(chunks)
            n_words = np.add.reduceat(sizes[codes], np.cumsum(bounds) - bounds)
            codes = flat[runs(starts[codes], sizes[codes])]
            if len(words):  # short words are numbered before long ones
                short = np.array([len(w) <= LONG_WORD for w in words], dtype=bool)
                number = np.where(short, np.cumsum(short) - 1, short.sum() + np.cumsum(~short) - 1) + len(known)
                own = codes >= len(known)
                codes[own] = number[codes[own] - len(known)]
            folded = _byte_lists([w for w in words if len(w) <= LONG_WORD])
            row = [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([n_words.astype("<i4").tobytes()], pa.binary()),
                pa.array([planes(codes)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(folded)], pa.int32()), folded),
                pa.array([[w for w in words if len(w) > LONG_WORD]], pa.list_(pa.binary())),
            ]
            block = pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in schema.split(", ")])
            # only the block stays while Spark takes it
            del chunks, codes, distinct, flat, folded, found, numbers, row, sizes, starts, words
            pa.default_memory_pool().release_unused()
            yield block

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 1 << 22, ids: bool = True):
    """Encodes whole texts and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, ids (little-endian unsigned 32-bit) and decoded (bytes).

    A null or empty text has no ids and decodes to no bytes. Rows keep their number; extra columns
    are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    ranks = load_ranks(ranks_path)
    ids_of_bytes = [ranks[bytes([i])] for i in range(256)]
    merges, byte_ids = RankMap(pair_ranks(ranks), ids_of_bytes), _literal(ids_of_bytes, "array<int>")

    def fold(value: Column, body) -> Column:
        # the literal map stands in the plan once
        return _let(merges.literal, lambda table: body(value, lambda word: fold_merges(word, byte_ids, merges, table)))

    path = dictionary(docs, pattern, fold).scratch_path
    blocks = blocks_of_words(docs, pattern, path, block_bytes).withColumn("words", fold(F.col("words"), F.transform))
    blocks = materialize(blocks, "bpe-blocks", "zstd")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded binary" * ids

    def finish(row: dict, pool: Pool, pieces: list[bytes]):
        """The documents of a block whose words are all in the pool."""
        codes, n_words = from_planes(row["codes"]), np.frombuffer(row["n_words"], dtype="<i4").astype(np.int64)
        all_ids, sizes = pool.get(codes)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n_words)])]
        cols = [[], [], [], []]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            mine = all_ids[a:b]
            raw, back = mine.astype("<u4").tobytes(), b"".join(map(pieces.__getitem__, mine.tolist()))
            for col, x in zip(cols, (hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), raw, back), strict=True):
                col.append(x)
        out = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(at))]
        out += [pa.array(x, t) for x, t in zip(cols, [pa.string()] * 2 + [pa.binary()] * 2, strict=True)][: 4 if ids else 2]
        return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    def run(batches):
        ranks = load_ranks(ranks_path)
        pieces = sorted(ranks, key=ranks.get)
        (n, n_ids), pool = _dictionary(path, False)
        for batch in batches:
            for r in range(batch.num_rows):
                pool.n, pool.n_ids = n, n_ids  # each block starts from the dictionary
                words = batch.column("words")[r].values
                row = {c: batch.column(c)[r].as_py() for c in ("doc_ids", "n_words", "codes", "long_words")}
                pool.add(words.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), _sizes(words))
                each = [merge_long(w, ranks) for w in row["long_words"]]
                pool.add(np.array([i for x in each for i in x], dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64))
                yield finish(row, pool, pieces)

    return blocks.mapInArrow(run, schema)
