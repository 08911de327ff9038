"""Tokenised output: packing, wavelet shards and ranked merges against the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, packing, wavelet
from quern.llm.tokens import ChunkEncoder

EDGE = [None, "", " ", "a", "  two  spaces \n", "tail ", "x" * 700, "\n\n a\tb ", "'s it's", "Ünï ΑΣ é 🙂 <|endoftext|>", "w " * 5000]
PIECES = [" ", "  ", "\n", " \n", "\t", "a", "the", "é", "\u0301", "'s", "!", "##", "12", "\u00a0", "\x1c", "\0", "İ", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "\r\n", "Straße", "ÿ.", "É", "ª", "e\u0301", "a-b", "word,"]


def texts(n=150, seed=3):
    rng = random.Random(seed)
    return EDGE + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(P.path(name))


def frame(spark, values, clash=True):
    rows = [(i, v, "x", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, n_tokens long")
    return df.repartition(3) if clash else df.select("doc_id", "text")


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_like_whole_texts(name, spaces):
    data = [t or "" for t in texts(1500)]
    enc, lib = ChunkEncoder(P.path(name), spaces, keep=50), library(name)
    got = []
    for i in range(0, len(data), 40):
        flat, bounds = enc.encode(data[i : i + 40])
        got += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    want = [e.ids for e in lib.encode_batch(data, add_special_tokens=False)]
    assert got == want


def test_plan_places_all_and_is_tight():
    rng = random.Random(1)
    for capacity in (10, 64, 2048):
        counts = Counter(rng.randint(1, capacity) for _ in range(3000))
        used = Counter()
        spans = {}
        for length, lo, hi, first, offset in packing.plan_bins(counts, capacity):
            assert spans.get(length, 0) == lo
            spans[length] = hi
            for b in range(first, first + hi - lo):
                assert used[b] == offset  # gapless
                used[b] += length
        assert spans == dict(counts) and max(used.values()) <= capacity
        total = sum(k * n for k, n in counts.items())
        large = sum(n for k, n in counts.items() if 2 * k > capacity)
        assert len(used) <= max(1.05 * total / capacity, large) + 1


def test_large_lengths_pair_at_most_twice():
    plan = packing.plan_bins({6: 1, 5: 1, 4: 2, 1: 3}, 10)
    bins = Counter(b for _, lo, hi, first, _ in plan for b in range(first, first + hi - lo))
    assert len(bins) == 3 and packing.plan_bins({}, 10) == []


def test_packing_rows(spark):
    data = texts()
    got = packing.pack(frame(spark, data), P.path("byte_bpe_50k.json"), 64).toPandas()
    lib = library("byte_bpe_50k.json")
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(data)}
    assert set(got.doc_id) == set(want)
    for i, g in got.sort_values("piece").groupby("doc_id"):
        assert list(g.piece) == list(range(len(g))) and (g.length[1:] == 64).all()
        assert list(g.start) == list(g.length.cumsum() - g.length)
        assert [x for raw in g.ids for x in np.frombuffer(raw, dtype="<u4")] == want[i]
        assert all(zlib.crc32(raw) == c for raw, c in zip(g.ids, g.ids_crc32, strict=True))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 64
    joined = packing.sequences(packing.pack(frame(spark, data), P.path("byte_bpe_50k.json"), 64))
    assert joined.count() == got.sequence_id.nunique()


def test_packing_copies_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, "a b c")] * 200 + [(None, None)], "doc_id long, text string")
    got = packing.pack(rows, P.path("byte_bpe_50k.json"), 10, with_ids=False).toPandas()
    assert len(got) == 201 and got.doc_id.isna().sum() == 1 and got.sequence_id.nunique() == 100
    assert packing.pack(rows.limit(0), P.path("byte_bpe_50k.json"), 10).count() == 0


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.4, 5000) % 50000
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
    assert (m.decode() == ids).all() and (m.access(np.arange(5000)) == ids).all()
    for token in (1, 2, 77, 49999, 65535, 70000):
        assert m.count(token) == (ids == token).sum()
        assert m.count(token, 100, 900) == (ids[100:900] == token).sum()
        assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_wavelet_shards(spark):
    data = texts()
    manifest = wavelet.write_shards(frame(spark, data), P.path("word_bpe_49k.json"), 1, shards=4)
    got = wavelet.read_documents(manifest).toPandas().set_index("doc_id")
    lib, at, every = library("word_bpe_49k.json"), 0, []
    for i, t in enumerate(data):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == want
        at += len(ids)
        every += ids
    base = 0
    for r in manifest.orderBy("shard").collect():
        with wavelet.ShardReader(r.path) as shard:
            mine = every[base : base + r.n_tokens]
            assert shard.count(1) == mine.count(1) == r.n_docs
            assert shard.occurrences(mine[0]) == [k for k, x in enumerate(mine) if x == mine[0]]
            assert shard.access(r.n_tokens - 1) == 1
        base += r.n_tokens
    empty = wavelet.write_shards(frame(spark, data).limit(0), P.path("word_bpe_49k.json"))
    assert wavelet.read_documents(empty).count() == 0


def test_small_blocks_of_a_shard(tmp_path):
    path = tmp_path / "s.qwm"
    docs = [(None, [5]), (3, list(range(300))), (4, [1]), (9, [7] * 130)]
    with path.open("wb") as f:
        w = wavelet.ShardWriter(f, 16, block=64)
        for i, ids in docs:
            w.add(i, np.array(ids, dtype=np.uint32))
        assert w.close() == f.tell()
    with wavelet.ShardReader(str(path)) as r:
        assert r.documents()[0] == [None, 3, 4, 9] and r.documents()[1].tolist() == [1, 300, 1, 130]
        assert np.concatenate([m.decode() for _, m in r.matrices()]).tolist() == [x for _, ids in docs for x in ids]
        assert r.access(1) == 0 and r.count(7) == 131


def test_ranked_merges(spark):
    data = texts(60) + ["ab" * 400, "🙂" * 200, "zz " * 50]
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(frame(spark, data), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).toPandas().set_index("doc_id")
    for i, t in enumerate(data):
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        row = got.loc[i]
        assert row.n_tokens == len(ids) and row.ids == raw and row.decoded == (t or "").encode()
        assert row.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for word in ("a", "ab" * 500, "thentheaeating" * 40):
        assert bpe.merge_long(word.encode(), ranks) == enc.encode_ordinary(word)
    assert bpe.encode_decode(frame(spark, data).where(F.lit(False)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
