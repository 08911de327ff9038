"""Storage, streaming, the command line and the behaviour of sessions."""

import json

import pytest

from quern import cli
from quern.operators import behaviour
from quern.sources.capture import RAW_PAIRS, to_samples
from quern.sources.store import Store, StoreError
from quern.streaming.capture import finish_capture, start_capture, stream_pairs


def pair(seq, method="GET", url="/users/1", body='{"id":1,"name":"a"}', session="s", request=None, at=None):
    return {
        "seq": seq,
        "session_id": session,
        "method": method,
        "url": url,
        "status_code": 200,
        "request_content_type": "application/json",
        "response_content_type": "application/json",
        "request_headers": {"Authorization": "Bearer x", "X-A": "1"},
        "response_headers": {},
        "request_body": request,
        "response_body": body,
        "captured_at": at or f"2024-01-01T00:00:{seq:02d}Z",
    }


def write(folder, name, pairs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, pairs)))


def test_a_failing_snapshot_does_not_end_the_capture(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    aggregate, failed = store.aggregate, []

    def once(session, snapshot, samples):
        if not failed:
            failed.append(snapshot)
            raise RuntimeError("planted")
        return aggregate(session, snapshot, samples)

    monkeypatch.setattr(store, "aggregate", once)
    for name in ("a", "b"):
        write(tmp_path / "in", f"{name}.json", [pair(i + 3 * (name == "b")) for i in range(3)])
        start_capture(stream_pairs(spark, str(tmp_path / "in")), store, "s", str(tmp_path / "progress"), 3).awaitTermination()
    assert failed == [1] and store.count("s") == 6
    assert {r.snapshot: r.samples for r in store.snapshots("s").collect()} == {1: 3, 2: 6}


def test_snapshots_are_cumulative_and_batch_equals_stream(spark, tmp_path):
    write(tmp_path / "in", "a.json", [pair(i, url=f"/users/{i}?p={i}") for i in range(3)])
    store = Store(spark, str(tmp_path / "store"))

    def run():
        start_capture(stream_pairs(spark, str(tmp_path / "in")), store, "s", str(tmp_path / "progress"), 3).awaitTermination()

    run()
    write(tmp_path / "in", "b.json", [pair(i, url=f"/users/{i}?p={i}") for i in range(3, 6)])
    run()
    counts = {r.snapshot: r.samples for r in store.snapshots("s").collect()}
    assert counts == {1: 3, 2: 6}
    first = [r.asDict() for r in store.snapshot("s", 2).drop("created_at", "snapshot").collect()]
    assert finish_capture(store, "s").count() == 1
    again = [r.asDict() for r in store.aggregate("s", 2, 6).drop("created_at", "snapshot").collect()]
    assert first == again
    row = first[0]
    assert row["normalized_path"] == "/users/{userId}" and row["query_params"] == {"p": ["0", "1", "2", "3", "4", "5"]}
    assert row["path_param_values"] == {"userId": ["0", "1", "2", "3", "4", "5"]}
    assert finish_capture(store, "none") is None


def test_no_body_is_stored(spark, tmp_path):
    secret = {"note": "private " * 20, "id": 7}
    write(tmp_path / "in", "a.json", [pair(1, "POST", "/users", json.dumps(secret), request=json.dumps(secret))])
    store = Store(spark, str(tmp_path / "store"))
    start_capture(stream_pairs(spark, str(tmp_path / "in")), store, "s", str(tmp_path / "progress")).awaitTermination()
    raw = spark.read.schema(RAW_PAIRS).json(str(tmp_path / "in"))
    batch = Store(spark, str(tmp_path / "batch"))
    batch.add_samples(to_samples(raw))
    for kept in (store, batch):
        rows = kept.samples("s")
        assert not [c for c in rows.columns if c.endswith("_body")]
        assert "private" not in str(rows.collect())
        assert rows.first().request_shape == rows.first().response_shape == "{id:integer,note:string}"
        endpoint = kept.aggregate("s").first()
        assert json.loads(endpoint.request_schema)["required"] == ["id", "note"]


def test_versions_and_commands(spark, tmp_path):
    root = str(tmp_path / "store")
    write(tmp_path / "one", "a.json", [pair(i, session="one") for i in range(2)])
    write(tmp_path / "two", "a.json", [pair(i, session="two", body='{"id":1}') for i in range(2)])
    for s in ("one", "two"):
        assert cli.run(spark, ["--store", root, "capture", str(tmp_path / s), "--session", s]) == "2 samples"
    store = Store(spark, root)
    assert store.resolve() == "two" and store.resolve("one") == "one"
    row = store.snapshot("two").first()
    assert (row.version, row.previous_session_id) == (2, "one")
    assert [c.kind for c in row.changes] == ["required_field_removed"]
    assert "required_field_removed" in cli.run(spark, ["--store", root, "diff", "one", "two"])
    doc = json.loads(cli.run(spark, ["--store", root, "export", "one", "--format", "json", "--openapi", "3.0"]))
    op = doc["paths"]["/users/{userId}"]["get"]
    assert doc["openapi"] == "3.0.3" and op["operationId"] == "getUsersUserId" and "200" in op["responses"]
    assert doc["security"] == [{"bearerAuth": []}]
    assert "openapi" in cli.run(spark, ["--store", root, "export", "one"])
    with pytest.raises(StoreError, match="agents"):
        cli.run(spark, ["--store", root, "agent-report", "one"])
    with pytest.raises(StoreError):
        store.put_session("one", "active")
    with pytest.raises(StoreError):
        store.resolve("missing")


def test_snapshot_diff_stop_and_investigate(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    first = [pair(1), pair(2, url="/b"), pair(3, url="/a")]
    store.put_session("s")
    write(tmp_path / "in", "a.json", first)
    start_capture(stream_pairs(spark, str(tmp_path / "in")), store, "s", str(tmp_path / "progress"), 1).awaitTermination()
    out = cli.run(spark, ["--store", root, "diff", "s", "s", "--old-snapshot", "1", "--new-snapshot", "3"])
    assert out.count("NEW") == 2 and out.index("/a") < out.index("/b")
    assert cli.run(spark, ["--store", root, "investigate", "s"]) == "  none"
    assert cli.run(spark, ["--store", root, "stop"]) == "3 samples"
    assert store.sessions().first().status == "completed"
    write(tmp_path / "two", "a.json", [pair(i, session="t") for i in range(1, 4)])
    monkeypatch.setattr(Store, "aggregate", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cli.run(spark, ["--store", root, "capture", str(tmp_path / "two"), "--session", "t"])
    failed = store.sessions().where("id = 't'").first()
    assert failed.status == "failed" and "division" in failed.error_message
    repeated = cli.run(spark, ["--store", root, "investigate", "t"])
    assert "op=GET /users/{userId}" in repeated and "pairs=2" in repeated


def test_capture_rules(spark):
    big = "x" * 50
    rows = [
        pair(1, "POST", body="{}", request=big),
        pair(2, body=big),
        pair(3) | {"response_content_type": "text/plain", "response_body": big},
        pair(4) | {"response_content_type": "application/problem+json"},
        pair(5) | {"response_body": None},
    ]
    raw = spark.read.schema(RAW_PAIRS).json(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").rdd.map(lambda r: r[0]))
    got = {r.id: r.response_body for r in to_samples(raw, 40).collect()}
    assert got == {3: None, 4: None, 5: None}


def samples(spark, calls, rpc=False):
    rows = [
        (
            i,
            "s",
            "POST" if rpc else c[0],
            None if rpc else c[1],
            c[1].split(":")[0] if rpc else None,
            (c[1].split(":") + [None])[1] if rpc else None,
            c[2],
            c[3] if len(c) > 3 else 200,
        )
        for i, c in enumerate(calls)
    ]
    df = spark.createDataFrame(
        rows, "id long, session_id string, http_method string, normalized_path string, jsonrpc_method string, jsonrpc_tool string, ms long, status_code int"
    )
    return df.selectExpr("*", "timestamp_millis(ms) as captured_at", "cast(null as string) request_shape", "'x' response_shape").drop("ms")


def test_retries_within_the_window(spark):
    s = samples(spark, [("", "tools/call:get_x", 0), ("", "tools/call:get_x", 10), ("", "tools/call:get_x", 20)], rpc=True)
    assert [(r.pattern, r.n) for r in behaviour.rpc_sequences(s).collect()] == [("retry", 3)]


def test_phases_and_causes(spark):
    calls = [("GET", "/a", 0), ("POST", "/a", 3000), ("GET", "/a", 3100), ("GET", "/a", 6000, 500), ("GET", "/a", 6500)]
    rows = behaviour.phase_rows(samples(spark, calls))
    named = behaviour.phases(rows)
    assert [r.name for r in named.orderBy("phase").collect()] == ["discovery", "creation", "verification"]
    tools = {r.tool: r.phases for r in behaviour.phase_tools(rows, named).collect()}
    assert tools["GET /a"] == ["discovery", "creation", "verification"]
    pairs = behaviour.call_pairs(rows, named).orderBy("from_index")
    assert [r.cause for r in pairs.collect()] == ["different_phase", "different_phase", "retry_after_error"]
    assert behaviour.primary_causes(pairs).first().primary_cause == "different_phase"
    assert [r.intervening for r in behaviour.intervening(rows, pairs).orderBy("from_index").collect()] == [["POST /a"], None, None]


def test_completeness(spark):
    fields = [
        ("POST", "/users", 0, ["id", "name"]),
        ("GET", "/users/{userId}", 1, [f"f{i}" for i in range(8)] + ["id", "name"]),
        ("PUT", "/users/{userId}", 2, ["id"]),
        ("POST", "/other", 3, ["id"]),
    ]
    df = spark.createDataFrame(fields, "http_method string, normalized_path string, ord int, fields array<string>")
    got = {r.http_method: r.completeness for r in behaviour.write_read_completeness(df).collect()}
    assert got == {"POST": 0.2, "PUT": 0.1}
