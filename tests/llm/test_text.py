"""Near-duplicates, language ID, quality, LM scores, media and the pipeline."""

import hashlib
import math
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import common, langid, lm, media, neardup, quality
from quern.llm.queries import QUERIES

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_texts(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [None, "", "  ", "one", "ONE", "a b c d", "A b c D", "a b c d e", "é É", "é é"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 220))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):  # near and not so near copies
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy) if rng.random() < 0.7 else "  ".join(copy).upper())
    return out


def test_near_duplicates_match_brute_force(spark):
    docs = list(enumerate(near_texts()))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, cls string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_near_duplicates_repeats_nulls_and_nothing(spark):
    rows = [(7, "a b c d e f")] * 3 + [(None, "a b c d e f"), (2, "A B c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 2, False)] * 3 + [(None, None, True), (2, 2, True), (3, 3, True)], key=repr)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.comp for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_word_hashes_agree_with_words():
    data = ["The the\x0bTHE", "", " x\u00a0y ", "the", "a" * 5000]
    h, bounds = common.word_hashes(data)
    flat = [w for t in data for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in data]
    assert len(set(h.tolist())) == len(set(flat)) and len({(x, y) for x, y in zip(h.tolist(), flat, strict=True)}) == len(set(flat))


def test_sketch_estimates_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(30, 330))
    x, bounds = neardup.shingle_sets([a, b, "one"])
    s = neardup.sketch(x, bounds, 360)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12 and len(set(s[2].tolist())) == 1


def test_language_accuracy_and_edges(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    labels, matrix = langid.fit(docs.selectExpr("lang as label", "text"))
    odd = spark.createDataFrame([(1, None), (2, "12 ²!"), (None, "the of and")], "doc_id long, text string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, labels, matrix).collect()}
    assert rows[1] == ("und", 0.0) and rows[2] == ("und", 0.0) and rows[None][0] == "en"
    blank = docs.where("false")
    assert langid.identify(blank).count() == 0
    assert langid.identify(odd.selectExpr("*", "cast(null as string) lang")).where("lang_pred != 'und'").count() == 0


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    none = quality.classify(docs.limit(3), labels.where("false")).toPandas()
    assert none.score.tolist() == [0.5] * 3 and quality.classify(docs.where("false"), labels).count() == 0


def test_pairwise_terms_by_sum_of_squares():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    col, value = np.array([1, 4, 7, 9]), rng.normal(size=4)
    plain = 0.3 + (fm.w[col] * value).sum()
    for i in range(4):
        for j in range(i):
            plain += fm.v[col[i]] @ fm.v[col[j]] * value[i] * value[j]
    assert math.isclose(fm.logits(col, value, np.array([0, 4]))[0], plain)


def test_filter_gives_quantised_counts():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    counts = rng.integers(1, 500, 4000)
    made = lm.LogFrequencyFilter.build(x, counts)
    assert (made.probe(x) >= lm.quantise(counts)).all() and (made.probe(x) == lm.quantise(counts)).mean() > 0.98
    other = rng.integers(0, 2**63, 4000).astype(np.uint64)
    assert (made.probe(other) > 0).mean() < 0.02
    low, high = lm.expected(lm.quantise(counts)), counts
    assert (np.abs(low - high) <= 0.5 * high + 1).all() and lm.quantise(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2, 3]


def test_unigrams_sum_to_one():
    rng = np.random.default_rng(3)
    x, counts = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.zipf(1.5, 3000).clip(1, 10**6)
    word = lm.expected(lm.LogFrequencyFilter.build(x, counts).probe(x))
    none = np.zeros_like(word)
    p = lm.probabilities(word, none, none, word.sum(), len(x))
    unknown = lm.probabilities(none[:1], none[:1], none[:1], word.sum(), len(x))
    assert math.isclose(p.sum() + unknown[0], lm.BACKOFF)


def test_lm_scores(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "the of")], "doc_id long, text string")
    docs = docs.union(odd)
    rows = docs.collect()
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    counts = Counter()
    for r in rows:
        if not lm.is_held_out(r.doc_id):
            counts.update([*words(r.text), 0])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*words(r.text), 0]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    many = {r.doc_id: r for r in lm.score(docs, segment_tokens=1 << 10).collect()}
    near = [abs(many[i].score - g.score) / g.n_tokens for i, g in got.items()]
    assert max(near) < 0.2 and np.mean(near) < 2e-3  # false positives differ between segmentations
    assert all(many[i].base_score == g.base_score for i, g in got.items())
    assert lm.score(docs.where("false")).count() == 0


def test_media(spark, tmp_path):
    data = [None, "", "a", "a", "é" * 40, "x" * 64, "long " * 50_000]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(2)
    stored = media.store(df)
    got = {r.doc_id: r for r in media.digests(media.metadata(stored)).collect()}
    for i, t in enumerate(data):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and (r.width, r.height) == (64, len(payload) // 64)
        assert r.digest == r.payload_sha256
    assert got[2].media_sha256 == got[3].media_sha256 and got[2].feature == got[3].feature
    with tarfile.open(got[6].shard.removeprefix("file://")) as tar:
        member = tar.getmember(f"{got[6].digest}.png")
        assert member.offset_data == got[6].offset and member.size == got[6].length
        assert hashlib.sha256(tar.extractfile(member).read()).hexdigest() == got[6].media_sha256
    assert media.digests(media.metadata(media.store(df.where("false")))).count() == 0


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents")
    names = docs.columns
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == names
        if name.startswith("MinHash"):
            whole = brute_components([(r.doc_id, r.text) for r in kept.collect()])
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in whole.items() if i == c}
        kept = common.materialize(out, "test")
    good = common.table(spark, sf, "labels").where("quality = 1").join(docs, "doc_id").select("doc_id")
    groups = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    left = {r.doc_id for r in kept.collect()}
    clean = [r.doc_id for r in good.collect() if groups[r.doc_id][1] == r.doc_id]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    packed = p.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_per_operator(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
