"""Nearest neighbours and URL filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, common, urlfilter


def brute(ids, x, q, k):
    scores = (x * x[ids == q][0]).sum(axis=1)
    order = [int(ids[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q]
    return order[:k]


def test_recall_and_scores(spark, sf):
    table = common.table(spark, sf, "embeddings")
    got = ann.search(table).toPandas()
    rows = table.orderBy("vec_id").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=np.float64)
    recall = []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, (x[np.searchsorted(ids, g.vec_id)] * x[ids == q][0]).sum(axis=1))
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        recall.append(len(set(g.vec_id) & set(brute(ids, x, q, 20))) / 20)
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and np.mean(recall) >= 0.9


def test_graph_recall_on_clusters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    x *= rng.uniform(0.5, 2, (3000, 1))
    g = ann.Graph.build(x)
    g = ann.Graph.from_flat(x, g.flat())
    q = x[::60]
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    found = g.search(q)
    assert np.mean([len(set(a) & set(b[b >= 0])) / 20 for a, b in zip(want, found, strict=True)]) > 0.9


def test_copies_bad_vectors_and_few(spark):
    v = [1.0, 2.0]
    rows = [(i, v) for i in range(0, 100)] + [(200, [0.0, 0.0]), (220, None), (240, [float("nan"), 1.0]), (260, [None, 1.0])]
    rows += [(280, [1.0, 0.0, 0.0]), (281, [2.0, 2.0, 2.0]), (None, v), (0, v)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = ann.search(df).toPandas()
    assert set(got.query_id) == {0, 20, 40, 60, 80, 280}
    assert got[got.query_id == 40].sort_values("rank").vec_id.tolist() == list(range(20))
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 21))
    assert got[got.query_id == 280].vec_id.tolist() == [281] and got[got.query_id == 0].score.eq(5.0).all()
    assert ann.search(df.limit(0)).count() == 0


URLS = [
    ("https://A.Example.com/en/7x?q=/en/", "a.example.com", "/en/7x", "example.com/en/7"),
    ("http://x.com/en/1#f", "x.com", "/en/1", "com/en/"),
    ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8"),
    ("http://example.net/de/9", "example.net", "/de/9", "net/de/"),
    ("http://b.org/es/", "b.org", "/es/", "org/es/"),
    ("http://borg/es/", "borg", "/es/", None),
    ("http://h.org", "h.org", "", None),
    ("http://h.org?a://b", "h.org", "", None),
    ("nothing", "", "", None),
    (None, "", "", None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlfilter.judge(pages.select("page_id", "url"), labels).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert [got[i].verdict for i in range(10)] == ["allow", "block", "block", "allow", "block", *["allow"] * 5]
    assert urlfilter.judge(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://bad.example.org/{i}") for i in range(200)] + [(1000 + i, f"http://good{i % 9}.example.org/{i}") for i in range(300)]
    rows += [(5000, "http://one.example.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") >= 1000).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    labels = labels.union(spark.createDataFrame([(5000, 0, 0)], "doc_id long, quality int, toxic int"))
    got = {r.page_id: r for r in urlfilter.judge(pages, labels).collect()}
    assert got[0].verdict == "block" and got[1000].verdict == "allow"
    assert got[5000].verdict == "allow" and 0 < got[5000].bad_low < 0.5 < got[0].bad_low < got[0].bad_rate < 1


@pytest.mark.parametrize(
    "host,domain,end",
    [("a.b.example.com", "example.com", "com"), ("x.shop.co.uk", "shop.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("localhost", "localhost", "localhost"), ("", "", "")],
)
def test_domains(spark, host, domain, end):
    df = spark.createDataFrame([(host,)], "h string").select(urlfilter.registered_domain(F.col("h")), urlfilter.suffix(F.col("h")))
    assert tuple(df.first()) == (domain, end)


def test_same_rows_as_sql(spark, sf):
    import glob
    import os

    import duckdb

    from quern.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, sf)
        want = c.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, (tuple(r[k] for k in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
