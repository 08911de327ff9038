"""Stored tables: samples, aggregated schemas and sessions as partitioned Parquet in one folder."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.aggregate import numbered
from quern.operators.facts import without_bodies
from quern.operators.ordered import ranged, with_previous
from quern.operators.pipeline import with_versions
from quern.operators.state import STATE, endpoints_of, samples_in, state_of, union_states
from quern.sources.scratch import discard, written

#: Allowed changes of a session's status.
NEXT = {"active": {"aggregating", "failed"}, "aggregating": {"completed", "failed"}, "completed": set(), "failed": set()}
SESSIONS = (
    "id STRING, name STRING, target_url STRING, status STRING, consumer STRING, created_at TIMESTAMP, seq BIGINT, "
    "error_message STRING"
)


#: Escapes what a pattern of paths would read as its own.
_GLOB = str.maketrans({c: "\\" + c for c in "\\*?[]{}^"})


class StoreError(Exception):
    """An error with a suggestion for the user."""

    def __init__(self, message: str, suggestion: str = ""):
        super().__init__(message)
        self.suggestion = suggestion


class Store:
    """Tables below one folder; samples and schemas are partitioned by session, so reads prune."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}")
        except Exception as e:  # only a table that was never written
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    # --- samples: by session and batch, whoever writes them ---

    def add_samples(self, samples: DataFrame, batch: int | None = None, session_id: str | None = None) -> None:
        """Adds samples with the facts and shapes of their bodies; bodies are never stored.

        A batch that is written again replaces itself. Without a number the samples are a batch of their
        own, numbered below all others, so that it meets none of a stream's. With ``session_id``, only that
        session's part is replaced (also by nothing, where the samples are none).
        """
        number = -time.time_ns() if batch is None else batch
        self._forget(number)
        rows = without_bodies(samples).withColumn("batch", F.lit(number).cast("long"))
        if session_id is not None and rows.isEmpty():
            self._remove(f"samples/{self._of(session_id)}/batch={number}")
            return
        self._overwrite(rows, "samples", ["session_id", "batch"])

    def _overwrite(self, rows: DataFrame, name: str, keys: list[str]) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        writer.parquet(f"{self.root}/{name}")

    def _remove(self, name: str) -> None:
        discard(self.spark, f"{self.root}/{name}")

    def _of(self, session_id: str) -> str:
        """The folder of a session's rows within a table; characters that folder names lack are escaped."""
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(session_id)
        return f"session_id={name}"

    def _found(self, pattern: str) -> list[str]:
        """Paths of what there is by a pattern below the root."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
        return [str(x.getPath().toString()) for x in found or []]

    def batch(self, session_id: str, batch: int) -> DataFrame | None:
        """One batch of a session's samples, read from its own folder alone; none if it has no samples."""
        folder = f"{self.root}/samples/{self._of(session_id)}/batch={batch}"
        if not self._found(folder.removeprefix(f"{self.root}/").translate(_GLOB)):
            return None
        return self.spark.read.parquet(folder).withColumn("session_id", F.lit(session_id))

    def samples(self, session_id: str) -> DataFrame:
        found = self._read("samples")
        if found is None:
            raise StoreError("no samples are stored", "capture some traffic first")
        rows = found.where(F.col("session_id").cast("string") == session_id)
        return self._kept(rows.withColumn("session_id", F.col("session_id").cast("string")))

    # --- the ledger: what each batch of a capture admitted and skipped ---

    def note_batch(self, session_id: str, batch: int, admitted: int, skipped: int) -> None:
        """Notes a batch's counts; the same batch noted again replaces them, so nothing counts twice."""
        row = self.spark.createDataFrame([(admitted, skipped, session_id, batch)], "admitted long, skipped long, session_id string, batch long")
        self._overwrite(row, "ledger", ["session_id", "batch"])

    def ledger(self, session_id: str, before: int | None = None) -> tuple[int, int]:
        """(admitted, skipped) of a session, of its batches before one if that is given."""
        mine = self._noted(session_id)
        if mine is None:
            return 0, 0
        if before is not None:
            mine = mine.where(F.col("batch") < before)
        row = mine.agg(F.sum("admitted"), F.sum("skipped")).first()
        return row[0] or 0, row[1] or 0

    def _noted(self, session_id: str) -> DataFrame | None:
        found = self._read("ledger")
        return None if found is None else found.where(F.col("session_id").cast("string") == session_id)

    def has_samples(self) -> bool:
        """Whether any samples were ever stored."""
        return self._read("samples") is not None

    def count(self, session_id: str) -> int:
        return self.samples(session_id).count()

    # --- aggregated schemas ---

    def aggregate(self, session_id: str, snapshot: int = 1, upto: int | None = None) -> DataFrame:
        """Aggregates a session's samples as a snapshot; running it again replaces it.

        With ``upto`` these are the first so many that captures admitted, by batch, then time and id; they
        come from the state of an earlier snapshot and the parts admitted since, where these cover exactly
        so many samples, else from the samples. Without it they are all samples there are.
        """
        if upto is None:
            path, state = self._written_state(state_of(self.samples(session_id)))
        else:
            path, state = self._state(session_id, upto)
        stored = self.schemas()
        if stored is not None:
            stored = stored.where((F.col("session_id") != session_id) | (F.col("snapshot") != snapshot))
        rows = with_versions(endpoints_of(state), stored)
        rows = rows.withColumns({"snapshot": F.lit(snapshot), "created_at": F.current_timestamp()})
        self._overwrite(rows, "schemas", ["session_id", "snapshot"])
        if path:
            discard(self.spark, path)
        return self.snapshot(session_id, snapshot)

    # --- states: what snapshots are made of, so that each reads only what came since the last ---

    def add_parts(self, session_id: str, batch: int, every: int) -> None:
        """Stores the states of a batch's samples by the snapshot that they first belong to.

        Snapshots cover multiples of ``every`` samples; a part's ``upto`` is the least such number that its
        samples lie within. A batch that crosses none is one part and is not put in order.
        """
        rows = self.batch(session_id, batch)
        if rows is None:
            return
        before = self.ledger(session_id, batch)[0]
        path, n = None, rows.count()
        cut = lambda place: (F.floor((F.lit(before) + place) / every) + 1) * every
        if before // every == (before + n - 1) // every:
            rows = rows.withColumn("upto", cut(F.lit(0)))
        else:
            path, rows = self._placed(rows)
            rows = rows.withColumn("upto", cut(F.col("place")))
        parts = state_of(rows, ["upto"]).withColumn("batch", F.lit(batch))
        writer = parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto", "batch")
        writer.parquet(f"{self.root}/parts/{self._of(session_id)}")
        if path:
            discard(self.spark, path)

    def _forget(self, batch: int) -> None:
        """A batch that is about to be written again takes its parts with it, and the states that may hold them."""
        for part in self._found(f"parts/*/*/batch={batch}"):
            session = part.split("/")[-3]
            discard(self.spark, part)
            self._remove(f"states/{session}")

    def _placed(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Samples of one session with their place (from 0) by time and id, by ranges, and the folder to delete afterwards."""
        dealt = ranged(rows)
        return dealt.inputFiles()[0].rsplit("/", 1)[0], with_previous(dealt, ["id"])

    def _written_state(self, state: DataFrame, path: str | None = None) -> tuple[str | None, DataFrame]:
        """A state as a table: in scratch, with its folder, or in one of its own."""
        if path is None:
            kept = written(state, "state")
            files = kept.inputFiles()
            return (files[0].rsplit("/", 1)[0] if files else None), kept
        state.write.mode("overwrite").parquet(path)
        return None, self._stored_states([path])

    def _stored_states(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).option("recursiveFileLookup", True).parquet(*paths)

    def _upto(self, table: str, session_id: str) -> dict[int, str]:
        folder = self._of(session_id).translate(_GLOB)
        return {int(p.rsplit("=", 1)[1]): p for p in self._found(f"{table}/{folder}/upto=*")}

    def _state(self, session_id: str, upto: int) -> tuple[str | None, DataFrame]:
        """The state of the first ``upto`` admitted samples, stored if it covers so many."""
        path = f"{self.root}/states/{self._of(session_id)}/upto={upto}"
        states, parts = self._upto("states", session_id), self._upto("parts", session_id)
        if upto in states:
            found = self._stored_states([path])
            if samples_in(found) == upto:
                return None, found
        base = max((u for u in states if u < upto), default=0)
        folders = [p for u, p in parts.items() if base < u <= upto]
        if folders:
            rows = [self._stored_states(folders), *([self._stored_states([states[base]])] if base else [])]
            _, found = self._written_state(union_states(*rows), path)
            if samples_in(found) == upto:
                return None, found
        extra, first = self._first(session_id, upto)
        _, found = self._written_state(state_of(first), path)
        if samples_in(found) != upto:  # there are fewer yet, so this is no state to go on from
            scratch, found = self._written_state(found)
            self._remove(f"states/{self._of(session_id)}/upto={upto}")
            return scratch, found
        if extra:
            discard(self.spark, extra)
        return None, found

    def _first(self, session_id: str, upto: int) -> tuple[str | None, DataFrame]:
        """The first ``upto`` samples that captures admitted (of all samples, by time and id, where none did)."""
        samples, noted = self.samples(session_id), self._noted(session_id)
        if noted is None or noted.isEmpty():
            return None, numbered(samples).where(F.col("seq") <= upto).drop("seq")
        left, whole, path, last = upto, [], None, samples.limit(0)
        for row in noted.orderBy("batch").collect():  # one row a batch
            if row.admitted > left:
                if left > 0:
                    path, placed = self._placed(samples.where(F.col("batch") == row.batch))
                    last = placed.where(F.col("place") < left).select(*samples.columns)
                break
            left -= row.admitted
            whole.append(row.batch)
        edge = max(whole, default=-1)
        return path, samples.where(F.col("batch").between(0, edge)).unionByName(last)

    def schemas(self) -> DataFrame | None:
        found = self._read("schemas")
        return None if found is None else self._kept(found.withColumn("session_id", F.col("session_id").cast("string")))

    def snapshot(self, session_id: str, snapshot: int | None = None) -> DataFrame:
        """A session's endpoint rows of one snapshot (the latest by default), by path and method."""
        found = self.schemas()
        if found is None:
            raise StoreError("nothing is aggregated", "aggregate a session first")
        mine = found.where(F.col("session_id") == session_id)
        if snapshot is None:
            snapshot = mine.agg(F.max("snapshot")).first()[0] or 0
        return mine.where(F.col("snapshot") == snapshot).orderBy("normalized_path", "http_method")

    def snapshots(self, session_id: str) -> DataFrame:
        """Snapshots of a session: endpoints, samples, mean confidence and time."""
        found = self.schemas().where(F.col("session_id") == session_id)
        return found.groupBy("snapshot").agg(
            F.count("*").alias("endpoints"),
            F.sum("sample_count").alias("samples"),
            F.avg("confidence_score").alias("confidence"),
            F.max("created_at").alias("created_at"),
        )

    def delete_session(self, session_id: str) -> None:
        """Deletes a session with its samples, snapshots and counts; an active one is refused.

        First its state becomes ``deleted``, and it is no longer found or read; then its folders go. A
        deletion that stops midway is completed by calling it again.
        """
        log = self._read("sessions")
        last = None if log is None else log.where(F.col("id") == session_id).agg(F.max_by(F.struct("*"), "seq").alias("x")).first().x
        if last is None:
            raise StoreError(f"no session {session_id}", "list the sessions")
        if last.status in ("active", "aggregating"):
            raise StoreError("the session is still in use", "stop it first")
        if last.status != "deleted":
            row = (session_id, last["name"], last.target_url, "deleted", last.consumer, last.created_at, last.seq + 1, "")
            self.spark.createDataFrame([row], SESSIONS).write.mode("append").parquet(f"{self.root}/sessions")
        for name in ("samples", "schemas", "ledger", "parts", "states"):
            self._remove(f"{name}/{self._of(session_id)}")
        self._remove(f"progress/{session_id}")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Rows of sessions that are not deleted."""
        log = self._read("sessions")
        if log is None:
            return rows
        gone = log.where("status = 'deleted'").select(F.col("id").alias("session_id"))
        return rows.join(gone, "session_id", "left_anti")

    # --- sessions: a log of states, the last of each id counts ---

    def put_session(self, id: str, status: str = "active", name: str = "", target_url: str = "", consumer: str = "human", error: str = "") -> None:
        """Adds a session or its next state; states only move forward, and one session is active at a time."""
        if consumer not in ("human", "agent"):
            raise StoreError(f"unknown consumer {consumer}")
        known = self.sessions()
        old = known.where(F.col("id") == id).first()
        if old is not None:
            if status not in NEXT[old["status"]]:
                raise StoreError(f"a session cannot go from {old['status']} to {status}")
            name, target_url, consumer, created = old["name"], old["target_url"], old["consumer"], old["created_at"]
        else:
            if not known.where("status = 'active'").isEmpty():
                raise StoreError("a session is active", "stop it first")
            created = datetime.now(UTC).replace(tzinfo=None)
        log = self._read("sessions")
        seq = (0 if log is None else log.agg(F.max("seq")).first()[0]) + 1
        row = (id, name, target_url, status, consumer, created, seq, error)
        self.spark.createDataFrame([row], SESSIONS).write.mode("append").parquet(f"{self.root}/sessions")

    def sessions(self) -> DataFrame:
        """Sessions, the newest first."""
        found = self._read("sessions")
        if found is None:
            return self.spark.createDataFrame([], SESSIONS)
        last = found.groupBy("id").agg(F.max_by(F.struct(*(c for c in found.columns if c != "id")), "seq").alias("x"))
        return last.select("id", "x.*").where("status != 'deleted'").orderBy(F.desc("created_at"), F.desc("seq"))

    def resolve(self, wanted: str | None = None) -> str:
        """A session's id: by id, by name (the latest), else the active one, else the latest completed."""
        found = self.sessions()
        if wanted:
            hit = found.where((F.col("id") == wanted) | (F.col("name") == wanted)).orderBy(
                F.col("id") != wanted, F.desc("created_at")
            )
        else:
            hit = found.where(F.col("status").isin("active", "completed")).orderBy(
                F.col("status") != "active", F.desc("created_at")
            )
        row = hit.limit(1).first()
        if row is None:
            raise StoreError(f"no session {wanted or ''}".rstrip(), "list the sessions")
        return row["id"]
