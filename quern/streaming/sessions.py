"""Structured Streaming over agent sessions: phases by event time, and repeats of once-only operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.behaviour import ONCE, named_phases, with_operation, writes_reads


def phase_stream(samples: DataFrame, gap_ms: int = 2000, watermark: str = "1 hour") -> DataFrame:
    """Closed phases of a stream of samples: session_id, n, w, r (any write, any read), first_ms and last_ms.

    A gap of more than ``gap_ms`` ends a phase, so a phase is a session window of one millisecond more.
    Rows may come in any order within the watermark; a phase is given once, when the watermark has passed
    its end. The state holds open phases only. Samples without a time are left out.
    """
    ops = with_operation(samples).withColumn("at", F.timestamp_millis("ms"))
    write, read = writes_reads(ops)
    rows = ops.select("session_id", "at", "ms", write.cast("int").alias("w"), read.cast("int").alias("r"))
    span = F.session_window("at", f"{gap_ms + 1} milliseconds")
    closed = rows.withWatermark("at", watermark).groupBy("session_id", span).agg(
        F.count("*").alias("n"),
        F.max("w").alias("w"),
        F.max("r").alias("r"),
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
    )
    return closed.drop("session_window")


def start_phases(samples: DataFrame, folder: str, checkpoint: str, gap_ms: int = 2000, watermark: str = "1 hour") -> StreamingQuery:
    """Appends closed phases to a folder, each once also after a restart, until all that has come is read."""
    writer = phase_stream(samples, gap_ms, watermark).writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def streamed_phases(closed: DataFrame) -> DataFrame:
    """Phases with their names, as ``behaviour.phases`` gives them, from what ``start_phases`` wrote: a row a phase."""
    w = Window.partitionBy("session_id").orderBy("first_ms")
    start = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = closed.select(
        "session_id",
        (F.row_number().over(w) - 1).cast("long").alias("phase"),
        "n",
        "w",
        "r",
        start.cast("int").alias("start_index"),
        (start + F.col("n") - 1).cast("int").alias("end_index"),
        (F.col("last_ms") - F.col("first_ms")).alias("duration"),
    )
    return named_phases(each)


def start_once_counts(samples: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts the operations that a session needs once; each batch writes the counts that it changed.

    A batch that runs again replaces what it wrote, so nothing counts twice. The state has three
    counters a session at most.
    """

    def put(rows: DataFrame, batch_id: int) -> None:
        writer = rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    counts = with_operation(samples).where(F.col("op").isin(ONCE)).groupBy("session_id", "op").agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("update").foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_counts(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, op and n as of the last batch that changed each, in the form that ``redundant_calls`` takes."""
    found = spark.read.schema("session_id string, op string, n long, batch long").parquet(folder)
    return found.groupBy("session_id", "op").agg(F.max_by("n", "batch").alias("n"))
