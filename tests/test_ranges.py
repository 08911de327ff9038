"""Order within sessions by ranges against windows, and phases and once-only counts of a stream against a batch."""

import json
import random

from pyspark.sql import functions as F

from quern.operators import behaviour, ordered
from quern.sources.capture import RAW_PAIRS, to_samples
from quern.streaming import sessions
from quern.streaming.capture import stream_pairs
from tests.test_sessions import pair, write

CALLS = "session_id string, id long, captured_at timestamp, http_method string, normalized_path string, jsonrpc_method string, jsonrpc_tool string"


def calls(spark):
    """Half of all calls in one session; equal times, single calls and calls without a time."""
    rng, rows = random.Random(4), []
    for i in range(1200):
        session = "hot" if rng.random() < 0.5 else f"s{rng.randrange(60)}"
        rows.append((session, i, 1_700_000_000 + rng.randrange(0, 4000), rng.choice(["GET", "POST", "HEAD"]), f"/a/{rng.randrange(3)}"))
    rows.append(("none", 5000, None, "GET", "/a"))
    frame = spark.createDataFrame(rows, "session_id string, id long, s long, http_method string, normalized_path string")
    frame = frame.withColumns({"captured_at": F.timestamp_seconds("s"), "jsonrpc_method": F.lit(None).cast("string")})
    return frame.withColumn("jsonrpc_tool", F.lit(None).cast("string")).drop("s").repartition(5)


def same(a, b):
    return sorted(map(str, (r.asDict() for r in a.select(sorted(a.columns)).collect()))) == sorted(
        map(str, (r.asDict() for r in b.select(sorted(b.columns)).collect()))
    )


def test_ranges_give_the_rows_of_windows(spark):
    s = calls(spark)
    assert same(behaviour.phase_rows_by_range(s, 2000, 16), behaviour.phase_rows(s, 2000))
    assert same(behaviour.rest_sequences_by_range(s, 2000, 16), behaviour.rest_sequences(s, 2000))
    hot = ordered.ranged(s, 16).where("session_id = 'hot'").groupBy("part").count().collect()
    assert len(hot) >= 7 and max(r["count"] for r in hot) < 200
    none = s.where("false")
    assert behaviour.phase_rows_by_range(none).count() == behaviour.rest_sequences_by_range(none).count() == 0


def rpc(seq, method, at, session="s"):
    return pair(seq, "POST", "/rpc", "{}", session, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method}), at)


def test_streamed_phases_and_counts_are_those_of_a_batch(spark, tmp_path):
    at = lambda m, s: f"2024-01-01T00:{m:02d}:{s:02d}Z"
    first = [rpc(1, "initialize", at(0, 0)), rpc(2, "tools/list", at(0, 2)), pair(3, "POST", "/users", "{}", "s", "{}", at(0, 10))]
    first += [pair(4, session="t", at=at(0, 0)), pair(5, session="t", at=at(0, 3))]
    # late rows: one ties two phases together, one comes before all others
    second = [pair(6, at=at(0, 12)), pair(7, session="t", at=at(0, 1)), rpc(8, "initialize", at(5, 0)), rpc(9, "tools/list", at(5, 1))]
    end = [pair(99, session="end", at="2024-01-02T00:00:00Z")]
    folder, raw = tmp_path / "in", spark.read.schema(RAW_PAIRS)

    def run():
        stream = to_samples(stream_pairs(spark, str(folder), files_per_trigger=1))
        sessions.start_phases(stream, str(tmp_path / "phases"), str(tmp_path / "p1")).awaitTermination()
        sessions.start_once_counts(stream, str(tmp_path / "once"), str(tmp_path / "p2")).awaitTermination()

    for k, rows in enumerate((first, second, end)):  # a restart after each
        write(folder, f"{k}.json", rows)
        run()
    run()
    batch = to_samples(raw.json(str(folder)))
    closed = spark.read.parquet(str(tmp_path / "phases"))
    want = behaviour.phases(behaviour.phase_rows(batch)).where("session_id != 'end'")
    assert same(sessions.streamed_phases(closed), want) and want.count() == 4
    counts = sessions.once_counts(spark, str(tmp_path / "once"))
    expected = behaviour.redundant_calls(behaviour.tool_usage(batch))
    assert same(behaviour.redundant_calls(counts), expected) and expected.count() == 2
    # the last batch again, as after a failure before it was noted
    last = max((tmp_path / "p2" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    run()
    assert same(behaviour.redundant_calls(sessions.once_counts(spark, str(tmp_path / "once"))), expected)
