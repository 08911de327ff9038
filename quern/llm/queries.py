"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import align, ann, bpe, langid, lm, media, neardup, packing, quality, urlfilter, vafile, warc, wavelet
from quern.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file (a parameter of the operators, not part of the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 0, with_ids=False).withColumn(
        "length", F.col("length").cast("long")
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity 0.75 and more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet-matrix shards, read back."""
    docs = table(spark, sf_dir, "documents")
    return wavelet.read_documents(wavelet.write_shards(docs, tokenizer_file("word_bpe_49k.json"), 1))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by ranked merges, and decoded."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every whole text."""
    return lm.score(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    out = urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_low")})


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in tar shards, its metadata and digests read back."""
    rows = media.digests(media.metadata(media.store(table(spark, sf_dir, "documents"))))
    return rows.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "width",
        "height",
    )


def op11_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 8 clusters after 10 rounds over their approximations."""
    return vafile.cluster(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in dictionary-compressed archives, read back."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers over all documents."""
    docs = table(spark, sf_dir, "documents")
    return align.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_wavelet": op3_wavelet,
    "op4_bpe": op4_bpe,
    "op5_lm": op5_lm,
    "op6_langid": op6_langid,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_urlfilter": op9_urlfilter,
    "op10_media": op10_media,
    "op11_vafile": op11_vafile,
    "op12_warc": op12_warc,
    "op13_align": op13_align,
}


def _weight(level: str) -> str:
    """The weight of a level's prior in SQL, from rows n, bad and prior."""
    return f"""(SELECT CASE WHEN coalesce(sum(n * (n - 1)), 0) = 0 THEN 10 ELSE least(greatest(1 / least(greatest(
      sum(pow(bad - n * prior, 2) / (prior * (1 - prior)) - n) / sum(n * (n - 1)), 0.001), 0.5) - 1, 1), 1000) END AS k
      FROM {level} WHERE n > 1 AND prior > 0 AND prior < 1)"""


_DEEP = "len(l) >= 3 AND length(l[len(l)]) = 2 AND list_contains(['ac', 'co', 'com', 'edu', 'gov', 'net', 'org'], l[len(l) - 1])"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP9_SQL = f"""
WITH s AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
counted AS (SELECT host, string_split(host, '.') AS l, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM s LEFT JOIN known USING (page_id) WHERE host <> '' GROUP BY host),
named AS (SELECT host, n, bad, array_to_string(l[greatest(1, len(l) - CASE WHEN {_DEEP} THEN 2 ELSE 1 END):], '.') AS domain FROM counted),
hosts AS (SELECT *, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM named),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hosts) AS prior FROM hosts GROUP BY suffix),
suffix_rates AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM suffixes, {_weight("suffixes")}),
domains AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM hosts JOIN suffix_rates USING (suffix) GROUP BY domain),
domain_rates AS (SELECT domain, (bad + k * prior) / (n + k) AS prior FROM domains, {_weight("domains")}),
rated AS (SELECT host, n, bad, prior FROM hosts JOIN domain_rates USING (domain)),
post AS (SELECT host, (bad + k * prior) / (n + k) AS rate, n + k AS w FROM rated, {_weight("rated")}),
low AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) AS low FROM post),
j AS (SELECT page_id, s.host, path, rate, low, CASE
    WHEN (s.host = 'example.com' OR ends_with(s.host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (s.host = 'example.net' OR ends_with(s.host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (s.host = 'com' OR ends_with(s.host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (s.host = 'net' OR ends_with(s.host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (s.host = 'org' OR ends_with(s.host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM s LEFT JOIN low ON s.host = low.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS bad_rate, round(low, 6) AS bad_low FROM j"""



def _cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Rounds of assignment and update over whole lists of components, one after another."""
    far = "CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, e) - 1 AS j, e AS c FROM v QUALIFY j < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': {far}, 'j': j}}) AS m FROM v CROSS JOIN c{n} GROUP BY r)"
        )
        if n < rounds:
            steps.append(f"""x{n} AS (SELECT m.j AS j, unnest(e) AS x, unnest(range({dim})) AS i FROM a{n}),
s{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM x{n} GROUP BY j, i),
g{n} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(g{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN g{n} USING (j))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON m.j = c{rounds}.j"""


OP12_SQL = """
WITH d AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN row_number() OVER w ELSE 1 END AS k, first_value(page_id) OVER w AS top
  FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM r"""

ORACLE: dict[str, str] = {"op9_urlfilter": OP9_SQL, "op11_vafile": _cluster_sql(), "op12_warc": OP12_SQL}
