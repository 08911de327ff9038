"""Workers of one session do not add up the memory of its operators."""

import gc
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from quern.llm import bpe, common, neardup, packing, tokens
from quern.llm.queries import tokenizer_file


def test_filters_judge_few_texts_at_a_time(spark):
    rows = [(i, "ab" * 50_000 if i % 3 else None, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1)

    def decide(texts):
        if sum(map(len, texts)) > 1 << 19:
            raise ValueError("too many at once")
        return np.array([not t for t in texts])

    kept = sorted(r["extra"] for r in common.keep_rows(docs, decide).collect())
    assert kept == [i for i in range(40) if i % 3 == 0]


def test_short_texts_are_sketched_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a"] * 5000)], names=["doc_id", "text"])
    parts = [ids for ids, _ in common.doc_chunks([batch, batch], 1 << 19, neardup.TEXTS)]
    assert max(map(len, parts)) <= neardup.TEXTS and [i for p in parts for i in p] == [*range(5000)] * 2


def test_a_worker_keeps_the_tables_of_one_operator():
    path = tokenizer_file("byte_bpe_50k.json")
    first = tokens.encoder(path, spaces=True)
    assert tokens.encoder(path, spaces=True) is first
    assert tokens.encoder(path, True, 1000) is not first and len(common.kept_in_worker("encoder")) == 1
    assert common.kept_in_worker("filter") == {} and list(common._kept) == ["filter"]


def test_packing_is_the_same_with_little_memory(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and {i * 7919} more {i % 11}") for i in range(400)], "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")

    def found(**keep):
        rows = packing.pack(docs, path, 64, 0, with_ids=False, **keep).collect()
        return sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)

    assert found(keep=20) == found()


def _block_run(path: str, max_bytes: int):
    """What a worker runs over batches of documents."""

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    return bpe.blocks_of_words(Docs(), public_tokenizers.PATTERN, f"file://{path}", max_bytes)


def _words_file(folder, words) -> str:
    folder.mkdir(exist_ok=True)
    table = pa.table({"word": pa.array([w.encode() for w in words], pa.binary()), "n": pa.array([1] * len(words), pa.int64())})
    pq.write_table(table, folder / "part-0.parquet")
    return str(folder)


def _taken() -> int:
    return tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()


def test_a_worker_keeps_the_words_in_little_memory(spark, tmp_path):
    words = [f" word{i:06}" for i in range(60_000)]
    path = f"file://{_words_file(tmp_path / 'all', words)}"
    bpe._dictionary(f"file://{_words_file(tmp_path / 'one', words[:1])}", True)  # imports are done
    tracemalloc.start()
    try:
        before = _taken()
        bpe._dictionary(path, True)
        assert _taken() - before < 40 * len(words)  # a Python dictionary took over 100 bytes a word
    finally:
        tracemalloc.stop()


def test_a_block_leaves_nothing_behind_in_its_worker(spark, tmp_path):
    run = _block_run(_words_file(tmp_path, [" of", " the"]), 50_000)
    texts = [" ".join(f"w{i}x{j} ({j}-{i})" for j in range(600)) for i in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    left = []
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for block in run([batch]):
            del block
            left.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
        gc.enable()
    assert len(left) > 8 and left[-2] - left[2] < 1 << 20


def test_numbers_of_known_and_new_words():
    known = pa.array([b" of", b" the"], pa.binary())
    number, new = bpe.numbered([b"x", b" the", "é".encode(), b"\xed\xa0\x80", b" of"], known)
    assert number.tolist() == [2, 1, 3, 4, 0] and new == [b"x", "é".encode(), b"\xed\xa0\x80"]
    number, new = bpe.numbered([], known)
    assert number.tolist() == [] and new == []
    number, new = bpe.numbered([b"x"], known[:0])
    assert number.tolist() == [0] and new == [b"x"]
