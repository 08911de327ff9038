"""Structured Streaming: captured pairs into samples, with a cumulative snapshot every N samples."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.capture import RAW_PAIRS, keep_pairs, to_samples
from quern.sources.store import Store

LOG = logging.getLogger(__name__)


def stream_pairs(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """An unbounded frame of raw pairs from a landing folder."""
    return spark.readStream.schema(RAW_PAIRS).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def start_capture(
    pairs: DataFrame,
    store: Store,
    session_id: str,
    checkpoint: str,
    every: int | None = None,
    available_now: bool = True,
    max_samples: int | None = None,
) -> StreamingQuery:
    """Adds samples of one session, without their bodies, and a snapshot whenever a multiple of ``every`` is passed.

    Snapshot k covers the first k * every admitted samples; it reads the state of the last one and what
    was admitted since, not the samples before. A batch that runs again (same batch id) replaces its
    samples and its counts in the ledger. With ``max_samples`` the first so many are admitted, by batch,
    then time and id; further ones are read and left out. A snapshot that fails is logged and tried again
    with the next batch; capture goes on.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        mine = rows.where(F.col("session_id") == session_id)
        skipped = keep_pairs(mine).where("skipped").count()
        samples = to_samples(mine)
        if max_samples is not None:
            left = max(0, max_samples - store.ledger(session_id, batch_id)[0])
            samples = samples.orderBy("captured_at", "id", "http_method", "path").limit(left)
        store.add_samples(samples, batch_id, session_id)
        written = store.batch(session_id, batch_id)
        admitted = 0 if written is None else written.count()
        store.note_batch(session_id, batch_id, admitted, skipped)
        LOG.info("batch %s of session %s: %s samples, %s skipped", batch_id, session_id, admitted, skipped)
        if every:
            store.add_parts(session_id, batch_id, every)
            done = store.ledger(session_id)[0] // every
            stored = store.schemas()
            last = 0
            if stored is not None:
                last = stored.where(F.col("session_id") == session_id).agg(F.max("snapshot")).first()[0] or 0
            for k in range(last + 1, done + 1):
                try:
                    store.aggregate(session_id, k, k * every)
                except Exception:
                    LOG.exception("snapshot %s of session %s failed; tried again with the next batch", k, session_id)
                    break

    writer = pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish_capture(store: Store, session_id: str) -> DataFrame | None:
    """The last snapshot of a session over all its samples; none for a session without samples."""
    if not store.has_samples() or store.count(session_id) == 0:
        return None
    stored = store.schemas()
    last = 0
    if stored is not None:
        last = stored.where(F.col("session_id") == session_id).agg(F.max("snapshot")).first()[0] or 0
    return store.aggregate(session_id, last + 1)


def operation_counts(samples: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Calls per session, operation and event-time window of a stream of samples; late ones are dropped."""
    return (
        samples.withWatermark("captured_at", watermark)
        .groupBy("session_id", "http_method", "normalized_path", F.window("captured_at", window).alias("window"))
        .agg(F.count("*").alias("n"))
    )
