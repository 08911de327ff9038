"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Texts are read once into blocks: a block's distinct words as 64-bit hashes and each document as codes
of them. Counts of words and word pairs are added up in segments of the hash space, from counts that
each block has summed before. A segment becomes a Bloom filter that holds, for an n-gram of quantised
count q, the items (n-gram, 1) to (n-gram, q); probing 1, 2, ... until one is missing gives q back.

Every filter then goes to the one task that probes its segment, and every block sends its distinct
n-grams there and gets the quantised counts back. So there is one way for all sizes, and no worker
holds more than one segment's filter, however large the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import (
    doc_chunks,
    from_planes,
    materialize,
    mix64,
    only_kept,
    planes,
    small_batches,
    word_hashes,
)

#: Hashes that stand for a text's end (a counted token) and its start (a context only).
END, START = np.uint64(0x5BF0_3635_F0A3_11E1), np.uint64(0x2545_F491_4F6C_DD1D)
#: Growth of the quantised counts; bits and probes per stored item (0.3 % false positives).
GROWTH, BITS, PROBES = 1.5, 12, 8
#: Weight of the unigram in the interpolated probability.
BACKOFF = 0.8
KEY = np.uint64((1 << 40) - 1)
_A, _B = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id, modulus: int = 7, rest: int = 2) -> bool:
    """crc32 of doc_id as text leaves this remainder; a null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def quantise(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)) to the base GROWTH, 0 for 0."""
    c = np.asarray(counts, dtype=np.float64)
    q = 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(GROWTH) + 1e-9)
    return np.where(c > 0, q, 0).astype(np.int32)


def expected(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a quantised count."""
    top = int(np.max(q, initial=0))
    edge = np.ceil(GROWTH ** np.arange(top + 1) - 1e-9)
    middle = np.concatenate([[0.0], (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2])
    return middle[q]


class LogFrequencyFilter:
    """A Bloom filter over (n-gram, level) items of one segment."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def _bases(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and step of an item's places."""
        a = mix64(x ^ (np.full(1, level, dtype=np.uint64) * _A))
        return a, a * _B | np.uint64(1)

    @staticmethod
    def _place(a: np.ndarray, size: int) -> np.ndarray:
        return (a >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)

    @classmethod
    def build(cls, ngrams: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        q = quantise(counts)
        size = max(64, int(q.sum()) * BITS)
        bits = np.zeros((size + 7) // 8 * 8, dtype=bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            a, step = cls._bases(ngrams[q >= level], level)
            for _ in range(PROBES):
                bits[cls._place(a, size)] = True
                a += step
        return cls(np.packbits(bits, bitorder="little"), size)

    def probe(self, ngrams: np.ndarray) -> np.ndarray:
        """Quantised counts of n-grams, by membership probes level by level."""
        q = np.zeros(len(ngrams), dtype=np.int32)
        alive = np.arange(len(ngrams))
        level = 0
        while len(alive):
            level += 1
            a, step = self._bases(ngrams[alive], level)
            for _ in range(PROBES):
                at = self._place(a, self.size)
                hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, a, step = alive[hit], a[hit] + step[hit], step[hit]
            q[alive] = level
        return q


def pack(x: np.ndarray) -> bytes:
    """Filter keys (n-gram hashes cut to 40 bits, besides those that name the segment) as five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(data) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(x ^ _B) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Block:
    """The documents of one block: words as codes into distinct hashes, the end being one of them."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["block"], row["doc_ids"]
        self.lengths = np.frombuffer(row["n_words"], dtype="<i4").astype(np.int64) + 1  # with the end
        self.words = np.frombuffer(row["words"], dtype="<u8")
        codes = from_planes(row["codes"])
        ends = np.cumsum(self.lengths) - 1
        self.codes = np.full(int(self.lengths.sum()), int(np.flatnonzero(self.words == END)[0]), dtype=np.int64)
        inside = np.ones(len(self.codes), dtype=bool)
        inside[ends] = False
        self.codes[inside] = codes
        self.starts = ends - self.lengths + 1
        self.held = np.array([is_held_out(i) for i in self.doc_ids])
        self.training = np.repeat(~self.held, self.lengths)

    def pairs(self) -> np.ndarray:
        """The hash of each token after its context."""
        h = self.words[self.codes]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = START
        return mix64(before * _A + mix64(h) * _B)

    def word_counts(self) -> np.ndarray:
        """Training counts of the distinct words."""
        return np.bincount(self.codes[self.training], minlength=len(self.words))

    def training_ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Words, pairs and the start of training documents, with their counts."""
        counts = self.word_counts()
        pairs, n = np.unique(self.pairs()[self.training], return_counts=True)
        starts = int((~self.held).sum())
        return (
            np.concatenate([self.words[counts > 0], pairs, [START] * bool(starts)]).astype(np.uint64),
            np.concatenate([counts[counts > 0], n, [starts] * bool(starts)]).astype(np.int64),
        )

    def contexts(self) -> np.ndarray:
        """The distinct pairs and the start, of all documents."""
        return np.append(np.unique(self.pairs()), START)


_BLOCK = "block long, doc_ids array<bigint>, n_words binary, codes binary, words binary"


def blocks(docs: DataFrame, block_bytes: int = 1 << 22) -> DataFrame:
    """One row per block of documents; its most frequent words have the least codes."""
    small_batches(docs.sparkSession)

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(doc_chunks(batches, block_bytes)):
            parts, sizes = [], []
            for lo in range(0, len(texts), 128):
                h, bounds = word_hashes(texts[lo : lo + 128])
                parts.append(h)
                sizes.append(np.diff(bounds))
            words, codes, n = np.unique(np.concatenate([*parts, [END]]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            words, codes = words[order], place[codes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | k], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    *(
                        pa.array([x], pa.binary())
                        for x in (np.concatenate(sizes).astype("<i4").tobytes(), planes(codes[:-1]), words.tobytes())
                    ),
                ],
                names=["block", "doc_ids", "n_words", "codes", "words"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, _BLOCK)


def _block_rows(batches) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block({n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names) if n in _BLOCK})


def _cuts(seg: np.ndarray, segments: int) -> list[np.ndarray]:
    """For each segment, the places of its members."""
    order = np.argsort(seg.astype(np.int32), kind="stable")
    at = np.searchsorted(seg[order], np.arange(segments + 1))
    return [order[a:c] for a, c in zip(at[:-1], at[1:], strict=True)]


def _rows(x: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """(segment, n-grams, counts) of the segments that have members."""
    cuts = [(k, rows) for k, rows in enumerate(_cuts(_segments(x, segments), segments)) if len(rows)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in cuts], pa.int32()),
            pa.array([pack(x[rows]) for _, rows in cuts], pa.binary()),
            pa.array([counts[rows].astype("<i4").tobytes() for _, rows in cuts], pa.binary()),
        ],
        names=["segment", "ngrams", "counts"],
    )


def _spread(batches, segments: int):
    """For each block and segment: its distinct words there with training counts, and its distinct pairs there."""
    for b in _block_rows(batches):
        pairs, counts = b.contexts(), b.word_counts()
        of_words, of_pairs = _cuts(_segments(b.words, segments), segments), _cuts(_segments(pairs, segments), segments)
        cuts = [(k, w, p) for k, (w, p) in enumerate(zip(of_words, of_pairs, strict=True)) if len(w) or len(p)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in cuts], pa.int32()),
                pa.array([b.id] * len(cuts), pa.int64()),
                pa.array([b.words[w].tobytes() for _, w, _ in cuts], pa.binary()),
                pa.array([counts[w].astype("<i4").tobytes() for _, w, _ in cuts], pa.binary()),
                pa.array([pack(pairs[p]) for _, _, p in cuts], pa.binary()),
            ],
            names=["segment", "block", "words", "counts", "pairs"],
        )


def _sums(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts."""
    order = np.argsort(x, kind="stable")
    x, counts = x[order], counts[order]
    first = np.flatnonzero(np.diff(x, prepend=~x[:1]) != 0) if len(x) else order
    return x[first], np.add.reduceat(counts, first) if len(first) else counts


def _training(batches, segments: int, most: int = 1 << 22):
    """Rows of training n-grams with counts, added up over a task's blocks, ``most`` n-grams at a time."""
    each: list = []
    for b in _block_rows(batches):
        each.append(b.training_ngrams())
        if sum(len(x) for x, _ in each) > most:
            each = [_sums(*map(np.concatenate, zip(*each, strict=True)))]
            if len(each[0][0]) > most // 2:
                yield _rows(*each.pop(), segments)
    if each:
        yield _rows(*_sums(*map(np.concatenate, zip(*each, strict=True))), segments)


def _joined(table: pa.Table, name: str, read) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays end to end, and where each ends but the last."""
    each = [read(x.as_buffer()) for chunk in table.column(name).chunks for x in chunk]
    return np.concatenate(each), np.cumsum([len(e) for e in each])[:-1]


def _u8(data) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def _i4(data) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4")


def _i8(data) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def filters(blocks_: DataFrame, segments: int) -> DataFrame:
    """segment, size and bits of the filter over all training n-grams of each segment."""

    def build(key, table):
        made = LogFrequencyFilter.build(*_sums(_joined(table, "ngrams", unpack)[0], _joined(table, "counts", _i4)[0]))
        return pa.table(
            {
                "segment": pa.array([key[0].as_py()], pa.int32()),
                "size": pa.array([made.size], pa.int64()),
                "bits": pa.array([made.bits.tobytes()], pa.binary()),
            }
        )

    spread = blocks_.mapInArrow(lambda b: _training(b, segments), "segment int, ngrams binary, counts binary")
    return spread.groupBy("segment").applyInArrow(build, "segment int, size long, bits binary")


_COUNTS = (
    "block long, segment int, totals binary, word_levels binary, pair_levels binary, tokens long, types long, mass double"
)


def probed_counts(blocks_: DataFrame, filters_: DataFrame, segments: int) -> DataFrame:
    """What each block gets back from each segment: exact training counts of its words there (``totals``)
    and the quantised counts that the filter gives for its words and pairs. Besides, of the segment itself:
    training tokens, distinct training words, and the sum of the latter's expected counts.
    """

    def probe(left, right):
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        (words, cuts), (n_each, _) = _joined(left, "words", _u8), _joined(left, "counts", _i4)
        x, inverse = np.unique(words, return_inverse=True)
        totals = np.bincount(inverse, weights=n_each, minlength=len(x)).astype(np.int64)
        pairs, pair_cuts = _joined(left, "pairs", unpack)
        levels, pair_levels = np.zeros(len(x), dtype=np.int32), np.zeros(len(pairs), dtype=np.int32)
        if right.num_rows:  # else no training n-gram is there
            bits, size = right.column("bits")[0].as_buffer(), right.column("size")[0].as_py()
            lf = LogFrequencyFilter(np.frombuffer(bits, dtype=np.uint8), size)
            levels, pair_levels = lf.probe(x & KEY), lf.probe(pairs)
        places, n = np.split(inverse, cuts), left.num_rows
        columns = [
            left.column("block").combine_chunks(),
            left.column("segment").combine_chunks(),
            [totals[p].astype("<i8").tobytes() for p in places],
            [levels[p].astype(np.uint8).tobytes() for p in places],
            [p.astype(np.uint8).tobytes() for p in np.split(pair_levels, pair_cuts)],
            [int(totals.sum())] * n,
            [int((totals > 0).sum())] * n,
            [float(expected(levels)[totals > 0].sum())] * n,
        ]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, types, strict=True)})

    names = [c.split()[0] for c in _COUNTS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
    spread = blocks_.mapInArrow(
        lambda b: _spread(b, segments), "segment int, block long, words binary, counts binary, pairs binary"
    )
    return spread.groupBy("segment").cogroup(filters_.groupBy("segment")).applyInArrow(probe, _COUNTS)


def probabilities(word, context, pair, mass: float, n_types: int) -> np.ndarray:
    """p(w | u) of counts from the filter: of the words, of their contexts and of the pairs.

    The unigram part sums to one over the training words and one unknown word, as ``mass`` is the sum of
    the training words' counts. A pair counts no more than its parts, which cuts false positives.
    """
    pair = np.minimum(np.minimum(pair, context), word)
    p = BACKOFF * (word + 1) / (mass + n_types + 1)
    return p + (1 - BACKOFF) * np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)


def score(docs: DataFrame, block_bytes: int = 1 << 22, segment_tokens: int = 1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    p(w | u) = 0.8 p(w) + 0.2 c(uw) / c(u), with p(w) = (c(w) + 1) / (M + V + 1): the counts c come from
    the filter, M is the sum of the V training words' counts. A null or empty text is its end alone;
    repeated rows count each; extra columns are ignored; an empty table gives no rows.

    ``segment_tokens`` bounds the n-grams of a segment, thus a filter and what is probed at once.
    """
    spark = docs.sparkSession
    with only_kept(spark) as kept:
        held = materialize(blocks(docs, block_bytes), "lm-blocks", "zstd")
        tokens = held.agg(F.sum(F.octet_length("codes") / 4 + F.size("doc_ids"))).first()[0] or 0
        segments = max(4, -(-int(tokens) // segment_tokens))
        made = materialize(filters(held, segments), "lm-filters")
        found = materialize(probed_counts(held, made, segments), "lm-counts", "zstd")
        kept += [held, found]
    each = found.groupBy("segment").agg(*(F.first(c).alias(c) for c in ("tokens", "types", "mass")))
    stats = each.agg(F.sum("tokens"), F.sum("types"), F.sum("mass")).first()
    n_train, n_types, mass = int(stats[0] or 0), int(stats[1] or 0), float(stats[2] or 0)
    parts = F.collect_list(F.struct("segment", "totals", "word_levels", "pair_levels"))
    joined = held.join(found.groupBy("block").agg(parts.alias("parts")), "block")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                get = {n: batch.column(i)[row].as_py() for i, n in enumerate(names)}
                b = Block(get)
                pairs, pair_of = np.unique(b.pairs(), return_inverse=True)
                pairs = np.append(pairs, START)
                of_words, of_pairs = _cuts(_segments(b.words, segments), segments), _cuts(_segments(pairs, segments), segments)
                counts = np.zeros(len(b.words), dtype=np.int64)
                q_words, q_pairs = np.zeros(len(b.words), dtype=np.uint8), np.zeros(len(pairs), dtype=np.uint8)
                for part in get["parts"]:
                    k = part["segment"]
                    counts[of_words[k]] = _i8(part["totals"])
                    q_words[of_words[k]] = np.frombuffer(part["word_levels"], dtype=np.uint8)
                    q_pairs[of_pairs[k]] = np.frombuffer(part["pair_levels"], dtype=np.uint8)
                word, c_pairs = expected(q_words)[b.codes], expected(q_pairs)
                context = np.empty_like(word)
                context[1:] = word[:-1]
                context[b.starts] = c_pairs[-1]
                p = probabilities(word, context, c_pairs[pair_of], mass, n_types)
                base = np.log10((counts[b.codes] + 1.0) / (n_train + n_types + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.doc_ids, pa.int64()),
                        pa.array(b.held),
                        pa.array(b.lengths),
                        pa.array(np.add.reduceat((counts[b.codes] > 0).astype(np.int64), b.starts)),
                        pa.array(np.full(len(b.lengths), n_train, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, b.starts)),
                        pa.array(np.add.reduceat(np.log10(p), b.starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
