"""Command line: capture logs, aggregate, export, compare and report."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators import aggregate, behaviour, diff, documents, reports
from quern.sources.store import Store, StoreError
from quern.streaming.capture import finish_capture, start_capture, stream_pairs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("--store", default="quern-store", help="folder of the stored tables")
    p.add_argument("-v", "--verbose", action="store_true", help="tell of each batch")
    p.add_argument("-q", "--quiet", action="store_true", help="warnings and errors only")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("capture", help="read a folder of captured pairs into a session")
    c.add_argument("path")
    c.add_argument("--session", required=True)
    c.add_argument("--name", default="")
    c.add_argument("--consumer", default="human", choices=["human", "agent"])
    c.add_argument("--every", type=int, help="a snapshot every so many samples")
    c.add_argument("--max-samples", type=int, help="admit no more samples than this")
    for name in ("status", "sessions"):
        sub.add_parser(name)
    for name in ("aggregate", "snapshots", "agent-report", "investigate", "stop", "delete"):
        sub.add_parser(name).add_argument("session", nargs="?")
    e = sub.add_parser("export", help="write an API document")
    e.add_argument("session", nargs="?")
    e.add_argument("--snapshot", type=int)
    e.add_argument("--format", default="yaml", choices=["yaml", "json", "raw"])
    e.add_argument("--openapi", default="3.1", choices=["3.1", "3.0"])
    e.add_argument("--min-confidence", type=float, default=0.0)
    e.add_argument("--metadata", action="store_true")
    e.add_argument("--nested-models", action="store_true", help="share objects within schemas too")
    d = sub.add_parser("diff", help="compare two snapshots or sessions")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--old-snapshot", type=int, help="the latest, if not given")
    d.add_argument("--new-snapshot", type=int)
    return p


def close(store: Store, session: str) -> None:
    """Aggregates a session and completes it; one that cannot be aggregated is marked as failed."""
    store.put_session(session, "aggregating")
    try:
        finish_capture(store, session)
    except Exception as e:
        store.put_session(session, "failed", error=str(e)[:500])
        raise
    store.put_session(session, "completed")


def _counts(store: Store, session: str) -> str:
    admitted = store.count(session) if store.has_samples() else 0
    skipped = store.ledger(session)[1]
    return f"{admitted} samples" + (f", {skipped} skipped" if skipped else "")


def run(spark: SparkSession, argv: list[str]) -> str:
    """Runs one command and returns its text."""
    a = parser().parse_args(argv)
    logging.getLogger("quern").setLevel(logging.WARNING if a.quiet else logging.INFO if a.verbose else logging.WARNING)
    store = Store(spark, a.store)
    if a.command == "capture":
        store.put_session(a.session, name=a.name, target_url=a.path, consumer=a.consumer)
        start_capture(stream_pairs(spark, a.path), store, a.session, f"{store.root}/progress/{a.session}", a.every, max_samples=a.max_samples).awaitTermination()
        close(store, a.session)
        return _counts(store, a.session)
    if a.command in ("status", "sessions"):
        found = store.sessions()
        if a.command == "sessions":
            return reports.lines(found)
        active = found.where("status = 'active'").first()
        return "  none" if active is None else f"{active['id']}: {_counts(store, active['id'])}"
    if a.command == "diff":
        sides = ((a.old, a.old_snapshot), (a.new, a.new_snapshot))
        old, new = (store.snapshot(store.resolve(x), k) for x, k in sides)
        both = old.select(*aggregate.ENDPOINT, F.col("primary_schema").alias("a")).join(
            new.select(*aggregate.ENDPOINT, F.col("primary_schema").alias("b")), aggregate.ENDPOINT
        )
        changed = both.select(*aggregate.ENDPOINT, F.inline(diff.changes_of(F.col("a"), F.col("b"))))
        changed = changed.orderBy("normalized_path", "http_method", "path", "kind")
        states = diff.diff_endpoints(old, new, aggregate.ENDPOINT).where("state != 'COMMON'")
        states = states.orderBy("normalized_path", "http_method")
        return f"Endpoints\n{reports.lines(states)}\nChanges\n{reports.lines(changed)}"
    session = store.resolve(a.session)
    if a.command == "aggregate":
        return reports.lines(store.aggregate(session).select(*aggregate.ENDPOINT, "sample_count", "confidence_score"))
    if a.command == "snapshots":
        return reports.lines(store.snapshots(session).orderBy("snapshot"))
    if a.command == "stop":
        close(store, session)
        return _counts(store, session)
    if a.command == "delete":
        store.delete_session(session)
        return f"deleted {session}"
    if a.command == "investigate":
        return reports.lines(reports.investigate(store.samples(session)))
    if a.command == "agent-report":
        kept = store.sessions().where(F.col("id") == session).first()
        if kept["consumer"] != "agent":
            raise StoreError("agent-report is for sessions of agents", "capture with --consumer agent")
        rows = store.snapshot(session)
        if rows.isEmpty():
            raise StoreError("the session has no schemas", "aggregate it first")
        return reports.session_report(store.samples(session), rows, kept["name"] or session)
    rows = store.snapshot(session, a.snapshot).where(F.col("confidence_score") >= a.min_confidence)
    if a.format == "raw":
        return "\n".join(r["value"] for r in documents.json_export(rows).collect())
    if store.sessions().where((F.col("id") == session) & (F.col("consumer") == "agent")).count():
        rows = behaviour.attach_extensions(rows, behaviour.session_extensions(store.samples(session), rows))
    named = rows.withColumn("headers", F.col("request_headers"))
    doc = documents.document(
        rows, aggregate.global_headers(named, aggregate.ENDPOINT), aggregate.security_schemes(named), metadata=a.metadata, nested=a.nested_models
    )
    return documents.serialize(documents.to_30(doc) if a.openapi == "3.0" else doc, a.format)


def main() -> int:
    logging.basicConfig(format="%(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]))
    except StoreError as e:
        print(f"error: {e}" + (f" ({e.suggestion})" if e.suggestion else ""), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
