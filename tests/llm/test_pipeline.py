"""The pipeline's stages on odd rows, near-duplicates of repeated doc_ids, and the language model against a plain one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import langid, lm, neardup, quality
from quern.llm.common import word_hashes

A, B = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "web", 1, "k", "c") for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id string, component_id string"
    ).repartition(2)


@pytest.mark.parametrize("back", [False, True])
def test_texts_of_one_doc_id_are_tied(spark, back):
    rows = [(5, A), (7, A + " x"), (7, B), (9, B + " y"), (11, A + " x"), (12, ""), (None, A), (20, "q"), (20, "q")]
    got = neardup.near_duplicates(docs(spark, rows[::-1] if back else rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (11, 5), (12, 12), (None, None), (20, 20)}
    kept = corpus_pipeline.dedup_stage(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "20", "5", "None"]


def test_filters_judge_each_row_by_its_text(spark, sf):
    good = "the people of this town have a very old house and a garden " * 8
    rows = [(1, good), (1, None), (2, ""), (3, "12 345 !!"), (None, good), (4, good * 2000), (4, good)]
    frame = docs(spark, rows)
    kept = corpus_pipeline.language_stage(spark, frame, sf)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), len(r.text)) for r in kept.collect()) == sorted(
        (str(i), len(t)) for i, t in rows if t and "t" in t
    )
    kept = corpus_pipeline.quality_stage(spark, frame, sf)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.predicted for r in quality.classify(frame, spark.read.parquet(f"{sf}/labels.parquet")).collect())
    empty = frame.limit(0)
    assert [stage(spark, empty, sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 4


def test_a_null_doc_id_trains(spark):
    frame = docs(spark, [(None, "abc")])
    assert langid._labelled(frame, "lang", 4, 2, 10).count() == 1


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_scores_like_a_plain_model(spark, size):
    """A plain model of quantised counts gives the same score, with one segment and with many."""
    rows = [(i, f"w{i % 9} v{i} the w{i % 9} v{i} " + "the " * i if i % 5 else None) for i in range(40)]
    got = {r.doc_id: r for r in lm.score(docs(spark, rows), segment_tokens=size).collect()}
    uni, pairs, starts = Counter(), Counter(), Counter()
    texts = {i: [*(t or "").split(), "</s>"] for i, t in rows}
    for i, words in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            uni.update(words)
            pairs.update(zip(["<s>", *words], words))
            starts["<s>"] += 1
    # what the filters answer, asked one n-gram at a time: hardly ever more than the quantised count
    blocks = lm.blocks(docs(spark, rows))
    segments = max(4, -(-sum(map(len, texts.values())) // size))
    made = {
        r.segment: lm.LogFrequencyFilter(np.frombuffer(r.bits, dtype=np.uint8), r.size)
        for r in lm.filters(blocks, segments).collect()
    }
    hashes = {"<s>": lm.START, "</s>": lm.END}
    hashes |= {w: word_hashes([w])[0][0] for words in texts.values() for w in words if w != "</s>"}
    asked = {}

    def near(h, count):
        h = np.array([h], dtype=np.uint64)
        found = made.get(int(lm._segments(h, segments)[0]))
        level = int(found.probe(h & lm.KEY)[0]) if found else 0
        asked[int(h[0])] = level - int(lm.quantise([count])[0])
        return float(lm.expected(np.array([level]))[0])

    def pair(u, w):
        before, after = (np.array([hashes[x]], dtype=np.uint64) for x in (u, w))
        return lm.mix64(before * lm._A + lm.mix64(after) * lm._B)[0]

    z = sum(near(hashes[w], n) for w, n in uni.items()) + len(uni) + 1
    for i, words in texts.items():
        want = 0.0
        for u, w in zip(["<s>", *words], words):
            c, cw = near(pair(u, w), pairs[u, w]), near(hashes[w], uni[w])
            cu = near(hashes[u], (starts if u == "<s>" else uni)[u])
            want += math.log10(0.8 * (cw + 1) / z + 0.2 * (min(c, cu, cw) / cu if cu else 0))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].n_tokens == len(words)
    assert min(asked.values()) == 0 and np.mean([x > 0 for x in asked.values()]) < 0.03
