"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of documents; the last returns the packing. ``run`` writes each result and reads it for the next.

In all stages: a null text is an empty one; extra columns, whatever their names, pass through the
filters as they are and are ignored by the packing; an empty table gives an empty one; a null doc_id
is a document of its own. The filters judge each row by its own text, so repeated rows and ties share
their fate, also where rows share a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, neardup, packing, quality
from quern.llm.common import discard, materialize, only_kept, table
from quern.llm.queries import tokenizer_file

#: SQL can express neither the classifiers nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: texts without letters, or undecided ones."""
    return langid.keep_identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier calls low quality."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates.

    Rows that share a doc_id are one document: those of a group that is dropped all go. Of those that
    stay, equal texts are kept once and so are near duplicates among them; unlike texts all stay. A
    row without words stays only where its doc_id has no other, and once.
    """
    found = neardup.near_duplicates(docs.where("doc_id is not null")).select("doc_id", "kept", "n_shingles")
    kept = found.groupBy(F.col("doc_id").alias("id")).agg(
        F.count("*").alias("rows"), F.min(F.when(F.col("n_shingles") > 0, F.col("kept"))).alias("stays")
    )
    gone = kept.where("not stays").select("id", F.lit(True).alias("known"))
    # by the row's text where it has no doc_id, so that such rows do not meet in one task
    key, known = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"])), docs["doc_id"].isNotNull()
    left = docs.join(gone.hint("shuffle_hash"), (key == gone["id"]) & (known == gone["known"]), "left_anti")
    again = kept.where("rows > 1 and coalesce(stays, true)").select("id")
    if again.isEmpty():
        return left
    again = materialize(again, "again")
    mine = left["doc_id"].cast("long") == again["id"]
    rest = left.join(again, mine, "left_anti")
    return rest.unionByName(_several_texts(left.join(again, mine, "left_semi")))


def _several_texts(rows: DataFrame) -> DataFrame:
    """Rows of repeated doc_ids without equal or near texts of the same doc_id, and without empty ones beside others."""
    alike = rows.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "text"])
    own = materialize(alike.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("own")), "repeated")
    found = neardup.near_duplicates(own.select(F.col("own").alias("doc_id"), F.col("row.text").alias("text")))
    place = found.select(F.col("doc_id").alias("own"), "component_id", F.col("n_shingles") > 0)
    all_rows = own.join(place.toDF("own", "component", "has_words"), "own")
    # near texts of one doc_id: the first; near texts of different doc_ids are no concern here
    first = all_rows.where("has_words").groupBy("row.doc_id", "component").agg(F.min("own").alias("own")).select("own")
    full = all_rows.where("has_words").select(F.col("row.doc_id").alias("id")).distinct()
    bare = all_rows.where("not has_words").groupBy("row.doc_id").agg(F.min("own").alias("own"))
    bare = bare.join(full, bare["doc_id"] == full["id"], "left_anti").select("own")
    return all_rows.join(first.union(bare), "own", "left_semi").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    # a smaller memory of chunks than by itself: executors that ran the other stages have large heaps
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 0, with_ids=False, keep=150_000)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage read is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with only_kept(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        discard(*before)
        before = [docs]
    return docs
