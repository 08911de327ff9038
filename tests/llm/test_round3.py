"""Centroid clustering, web archives and tokenizer alignment against plain versions."""

import hashlib
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__
from quern.llm import align, vafile, warc
from quern.llm.queries import tokenizer_file


@pytest.mark.parametrize("name", ["op11_vafile", "op12_warc"])
def test_same_rows_as_sql(spark, sf, name):
    frame = __spark_entry__.queries()[name](spark, sf)
    db = duckdb.connect()
    for t in ("embeddings", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(f"SELECT {', '.join(frame.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and want


# --- op11 ---------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(Fraction(x) * scale // 1) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, y: sum((a - b) ** 2 for a, b in zip(v, y, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else y for j, y in enumerate(c)]
    out = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, j, long(d), long(inertia[j]), long(sum(inertia.values())), names[j]) for i, j, d in out]


def compare_clusters(spark, rows, kind="array<float>", **kw):
    frame = spark.createDataFrame([(i, v, i) for i, v in rows], f"vec_id long, embedding {kind}, cluster long")
    args = dict(k=3, rounds=4, dim=4, scale=1024, seed=3) | kw
    got = vafile.cluster(frame.repartition(3), bits=3, **args).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) if "float" in kind else x for x in v]) for i, v in rows]
    assert sorted(map(tuple, got), key=key) == sorted(plain_clusters(exact, **args), key=key)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan")] * 4),
             (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [0.0] * 4), (906, [0.0] * 4), (None, [0.5] * 4)]
    compare_clusters(spark, rows + rows[:20])  # repeated rows count each


def test_clusters_with_ties_few_and_none(spark):
    grid = [(i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)]
    compare_clusters(spark, grid)
    compare_clusters(spark, grid[:2])
    compare_clusters(spark, [])


def test_clusters_of_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(60)] + [(99, [1e30, -1e12, 3.0, 0.1])]
    compare_clusters(spark, rows, "array<double>")


def test_bounds_never_decide_wrongly():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (2000, 8))
    c = v[:5].copy()
    c[4] = c[0]  # a tie of two centroids goes to the smaller number
    marks = np.sort(rng.integers(-300, 300, (8, 15)), axis=1)
    bounds = vafile.Bounds(vafile.cells_of(v, marks), v.min(axis=0), v.max(axis=0), marks, c)
    d = vafile.exact(v, c)
    near, far = bounds.intervals()
    assert (near <= d).all() and (d <= far).all()
    best, left = bounds.decide()
    sure = np.setdiff1d(np.arange(len(v)), left)
    assert (best[sure] == d[sure].argmin(axis=1)).all() and len(sure) > 100


# --- op12 ---------------------------------------------------------------------------------------


def test_archive_of_odd_pages(spark):
    long, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a/", long, "k"), (5, "http://b/ \n", long, "k"), (3, None, long, None), (7, "u", other, "k"), (7, "u", other, "k"),
            (6, "u", other, "k"), (8, "s", "short", "k"), (9, "s", "short", "k"), (10, "n", None, "k"), (None, None, None, None),
            (None, "z", other, "k"), (11, "y", "y" * 999, "k"), (12, "y", "y" * 999, "k"), (13, "big", "word " * 400_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    shards = warc.write(pages)
    got = warc.read(shards, payloads=True).collect()
    assert sum(r.records for r in shards.collect()) == len(rows) == len(got)
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    best = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    want, used = [], set()
    for i, _, h, _ in rows:
        first = h not in best or (best[h] == i and h not in used)
        if h in best and first:
            used.add(h)
        want.append((i, len((h or "").encode()), sha(h), "response" if first else "revisit", None if first else best[h]))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert all(sha(r.payload.decode()) == r.payload_digest for r in got if r.record_type == "response")


def test_shard_format_and_damage(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i}" + "page text " * 50) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    (shard,) = warc.write(pages).collect()
    raw = open(shard.shard.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    dictionary = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    assert magic == 0x184D2A5D and dictionary[:4] == b"\x37\xa4\x30\xec"  # a trained dictionary
    assert len(raw) == shard.bytes < shard.raw_bytes / 4 and raw[8 + size :].count(b"\x28\xb5\x2f\xfd") >= 400
    broken = tmp_path / "x.warc.zst"
    broken.write_bytes(raw[:-20])
    with pytest.raises(ValueError):
        list(warc.frames(f"file://{broken}"))
    assert warc.write(pages.where("page_id < 0")).count() == 0 == warc.read(warc.write(pages.where("page_id < 0"))).count()


# --- op13 ---------------------------------------------------------------------------------------


def plain_alignment(rows, path_a, path_b):
    a, b, bytes_a, bytes_b = align.plain_tokens(path_a, path_b)
    found, count = [], Counter()
    for i, t in rows:
        t = t or ""
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        wanted = (" " + t).encode()
        if not t or b"".join(bytes_a[k] for k in x) != wanted or b"".join(bytes_b[k] for k in y) != wanted:
            found.append((i, None))
            continue
        ends = [np.cumsum([len(by[k]) for k in ids]).tolist() for ids, by in ((x, bytes_a), (y, bytes_b))]
        at = [{e: n for n, e in enumerate(e)} for e in ends]
        groups, links, p, q = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            m, n = at[0][e] + 1, at[1][e] + 1
            groups.append(",".join(map(str, x[p:m])) + "|" + ",".join(map(str, y[q:n])))
            links.append((x[m - 1], y[n - 1]))
            p, q = m, n
        count.update(links)
        found.append((i, (len(x), len(y), ";".join(groups), links)))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, text, links = f
            best, total = sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links)
            out.append((i, n_a, n_b, text.count("|"), len(links), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = ["", None, " ", "  ", "a▁b c", "a▁ b", "  x\n y  z \t w ", "<s> </s> <|endoftext|> the the", "日本 語🎉 ok\r\n\r\n  a", "x ", "x  ", "  a  b",
       "don't he'll I'm", "a" * 5000, "it is " * 20000, "\x00 \x01a", "ﬁ é ½ Å", "a　 b   c", "1 22 333 4444"]


def test_alignment_of_odd_texts(spark, sf):
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, "again"), (None, "null id")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_a string").repartition(70)  # more than one level of the tree
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, align.align(frame, *paths).collect()), key=key) == sorted(plain_alignment(rows, *paths), key=key)
    assert align.align(frame.where("doc_id < 0"), *paths).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 31, 50_000)).astype(np.uint32)
    found = align.PerfectHash.unpack(align.PerfectHash.build(keys).pack())
    assert sorted(found.index(keys)) == list(range(len(keys)))
    assert len(found.bits) * 8 < 6 * len(keys)
    assert len(align.PerfectHash.build(keys[:0]).index(keys)) == len(keys)


# --- op7: norms, dimensions, shards --------------------------------------------------------------


def recall(spark, vectors, shard_rows):
    from quern.llm import ann

    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(frame.repartition(4), shard_rows=shard_rows).collect():
        got[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float((vectors[r.query_id] * vectors[r.vec_id]).sum()), rel=1e-9)
    hits = []
    for q in range(0, len(vectors), 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        want = set(np.argsort(-scores, kind="stable")[:20].tolist())
        hits.append(len(want & got[q]) / len(want))
    return np.mean(hits)


@pytest.mark.parametrize("factor", [1.0, 1e6, 1e39, 1e-30])
def test_recall_with_one_vector_of_another_length(spark, factor):
    vectors = np.random.default_rng(5).normal(size=(2000, 64))
    vectors[7] *= factor
    assert recall(spark, vectors, 4096) >= 0.9


def test_recall_in_many_dimensions_and_shards(spark):
    vectors = np.random.default_rng(6).normal(size=(9000, 256)).astype(np.float32).astype(np.float64)
    assert recall(spark, vectors, 3000) >= 0.9


def test_recall_with_norms_of_many_sizes(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=(4000, 1)) * 3)
    assert recall(spark, vectors, 1000) >= 0.9


def test_too_few_levels_are_refused(spark):
    from quern.llm import wavelet

    docs = spark.createDataFrame([(1, "the zebra 日本")], "doc_id long, text string")
    with pytest.raises(Exception, match="do not hold"):
        wavelet.write_shards(docs, tokenizer_file("word_bpe_49k.json"), 1, levels=8).count()


def test_near_duplicates_leave_one_table(spark, sf):
    import os

    from quern.llm import neardup
    from quern.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert found.count() == 200 and len(set(os.listdir(folder)) - before) == 1


def test_no_text_of_a_repeated_doc_id_is_lost(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:100]), " ".join(words[100:])
    rows = [(7, None, "x"), (7, a, "x"), (8, b, "x"), (9, a, "y"), (10, a, "p"), (10, b, "q"), (10, b + " more", "r"), (10, b, "q"), (11, "", "e"), (11, None, "e"),
            (12, "few words", "z"), (12, "other words", "z"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = sorted([(r.doc_id, r.text or "", r.rid) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()], key=str)
    kept = {(d, t) for d, t, _ in got}
    assert (7, a) in kept and (7, "") not in kept and (12, "few words") in kept and (12, "other words") in kept
    assert not any(d in (8, 9, 10) for d, _ in kept)  # 10 ties both texts to 7
    assert sum(d == 11 for d, _, _ in got) == 1 and sum(d is None for d, _, _ in got) == 2
    alone = docs.where("doc_id = 10")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, alone, "").collect()]
    assert len(got) == 2 and (10, a) in got  # two unlike texts of one document stay, near ones once
