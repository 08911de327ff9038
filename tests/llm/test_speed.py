"""Shorter ways of op3_wavelet and op4_bpe give what the plain ones give."""

import zlib

import numpy as np
import public_tokenizers as P
import regex

from quern.llm import bpe, wavelet


def test_chunks_of_letters_are_one_match():
    assert bpe.letters_are_words(P.PATTERN)
    assert not bpe.letters_are_words(r"'s| ?[a-z]+| ?\p{L}+|\s+") and not bpe.letters_are_words(r"\p{L}+|\s+")
    chunks = ["", " ", "a", " a", "  a", "Straße", " Çà", "it's", "a1", " ab,", "a b", "×", "\n", "a\n", "x\ud800", "日本", "é" * 300]
    found = [regex.findall(P.PATTERN, c) for c in chunks]
    alone = bpe.one_word(chunks)
    assert all(f == [c] for f, c, x in zip(found, chunks, alone, strict=True) if x)
    assert [c for c, x in zip(chunks, alone, strict=True) if x] == ["a", " a", "Straße", " Çà", "é" * 300]


def test_fold_takes_the_leftmost_of_the_least_rank(spark):
    ranks = {bytes([i]): i for i in range(256)}
    # "abc" comes from "ab" + "c" and from "a" + "bc": the same rank by different neighbours
    for piece in (b"bc", b"ab", b"abc", b"abcabc", b"aa", b"aaa", b"cab"):
        ranks[piece] = len(ranks)
    ids = [ranks[bytes([i])] for i in range(256)]
    merges, byte_ids = bpe.RankMap(bpe.pair_ranks(ranks), ids), bpe._literal(ids, "array<int>")
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abc"), size=n)) for n in (1, 2, 3, 4, 7, 20, 100, 256) for _ in range(12)]
    rows = spark.createDataFrame([(w, list(w)) for w in words], "word binary, bytes array<int>")
    folded = bpe._let(merges.literal, lambda table: bpe.fold_merges(rows["bytes"], byte_ids, merges, table))
    for word, got in rows.select("word", folded).collect():
        assert got == bpe.merge_long(bytes(word), ranks)


def test_planes_are_deflated_without_a_search_for_repeats():
    bits = np.random.default_rng(5).random(1 << 18) < 0.05
    raw = np.packbits(bits).tobytes()
    packed = wavelet._deflate(raw)
    packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    assert packed == packer.compress(raw) + packer.flush() and len(packed) < len(raw) and zlib.decompress(packed) == raw
    ids = np.random.default_rng(6).integers(0, 40, 5000).astype(np.uint32)
    assert (wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes()).decode() == ids).all()
