"""One layout of samples, exact admission, deletion, and reports of agent sessions from what is stored."""

import json

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.operators import behaviour, reports
from quern.sources.capture import RAW_PAIRS, to_samples
from quern.sources.store import Store, StoreError
from quern.streaming.capture import start_capture, stream_pairs
from tests.test_sessions import pair, write


def capture(spark, tmp_path, store, name="s", **kw):
    start_capture(stream_pairs(spark, str(tmp_path / "in"), files_per_trigger=1), store, name, str(tmp_path / f"progress-{name}"), **kw).awaitTermination()


def test_batch_and_stream_writes_share_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "in", "a.json", [pair(1), pair(2)])
    raw = spark.read.schema(RAW_PAIRS).json(str(tmp_path / "in"))
    store.add_samples(to_samples(raw))
    capture(spark, tmp_path, store)
    store.add_samples(to_samples(raw).withColumn("id", F.col("id") + 10))
    assert sorted(r.id for r in store.samples("s").select("id").collect()) == [1, 1, 2, 2, 11, 12]
    store.add_samples(to_samples(raw).limit(1), 0, "s")  # batch 0 again, with less
    assert store.count("s") == 5
    store.add_samples(to_samples(raw).limit(0), 0, "s")
    assert store.count("s") == 4 and store.aggregate("s").first().sample_count == 4


def test_admission_is_exact_over_batches_and_replays(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    big = json.dumps({"x": "y" * (1 << 20)})
    for k in range(3):
        write(tmp_path / "in", f"{k}.json", [pair(10 * k + i) for i in range(4)] + [pair(10 * k + 9, body=big)])
    capture(spark, tmp_path, store, max_samples=6)
    assert store.count("s") == 6 and store.ledger("s") == (6, 3) and store.ledger("s", 1) == (4, 1)
    ids = sorted(r.id for r in store.samples("s").select("id").collect())
    # all batches again, as after a lost checkpoint: same rows, same counts
    start_capture(stream_pairs(spark, str(tmp_path / "in"), files_per_trigger=1), store, "s", str(tmp_path / "other"), max_samples=6).awaitTermination()
    assert sorted(r.id for r in store.samples("s").select("id").collect()) == ids and store.ledger("s") == (6, 3)
    none = Store(spark, str(tmp_path / "none"))
    capture(spark, tmp_path, none, "t", max_samples=0)
    assert none.ledger("t") == (0, 0)


def test_deleted_sessions_are_gone_everywhere(spark, tmp_path):
    root = str(tmp_path / "store")
    for s in ("one", "two"):
        write(tmp_path / s, "a.json", [pair(i, session=s) for i in range(2)])
        assert cli.run(spark, ["--store", root, "capture", str(tmp_path / s), "--session", s, "--max-samples", "9"]) == "2 samples"
    store = Store(spark, root)
    assert store.snapshot("two").first().version == 2
    reader = store.samples("two").collect()
    assert cli.run(spark, ["--store", root, "delete", "one"]) == "deleted one"
    assert [r.id for r in store.sessions().collect()] == ["two"] and store.samples("two").collect() == reader
    assert store.count("one") == 0 and store.schemas().where("session_id = 'one'").count() == 0 and store.ledger("one") == (0, 0)
    store.delete_session("one")  # again: nothing is left to do
    with pytest.raises(StoreError):
        store.resolve("one")
    with pytest.raises(StoreError):
        store.delete_session("missing")
    store.put_session("three")
    with pytest.raises(StoreError, match="in use"):
        store.delete_session("three")
    assert cli.run(spark, ["--store", root, "status"]) == "three: 0 samples"


READ = json.dumps({"id": 1, "name": "x", **{f"f{i}": i for i in range(8)}})


def test_agent_sessions_from_stored_schemas(spark, tmp_path):
    root = str(tmp_path / "store")
    calls = [pair(1, "POST", "/users", '{"id":1}', request='{"name":"x"}') | {"status_code": 201}, pair(2, "GET", "/users/5", READ), pair(3, "GET", "/users/6", READ),
             pair(4, "PUT", "/users/5", "[1]", request='{"name":"x"}'), pair(5, "POST", "/odd", '{"id":1}', request="{}") | {"status_code": 500}]
    write(tmp_path / "in", "a.json", calls)
    cli.run(spark, ["--store", root, "capture", str(tmp_path / "in"), "--session", "s", "--name", "N", "--consumer", "agent"])
    store = Store(spark, root)
    rows = store.snapshot("s")
    fields = {(r.http_method, r.normalized_path): r.fields for r in behaviour.endpoint_fields(rows).collect()}
    assert fields["POST", "/users"] == ["id"] and fields["PUT", "/users/{userId}"] == [] and fields["POST", "/odd"] is None
    assert fields["GET", "/users/{userId}"] == list(json.loads(READ))
    scored = behaviour.write_read_completeness(behaviour.endpoint_fields(rows))
    assert {(r.http_method, r.completeness) for r in scored.collect()} == {("POST", 0.1), ("PUT", 0.0)}
    assert behaviour.completeness_summary(scored).first() == (2, 0.05, 2)
    assert behaviour.completeness_summary(scored.limit(0)).first() == (0, 0.0, 0)
    assert [r.missing for r in reports.thin_text(scored).collect()][1] == "name, f0, f1, f2, f3, ... and 4 more"
    report = cli.run(spark, ["--store", root, "agent-report", "s"])
    assert report.startswith("Session N: 5 samples, 4 endpoints") and "avg_completeness=0.05" in report and "... and 4 more" in report
    doc = json.loads(cli.run(spark, ["--store", root, "export", "s", "--format", "json"]))
    ext = doc["paths"]["/users"]["post"]["x-quern-agent"]
    assert ext["responseCompleteness"] == 0.1 and len(ext["missingFields"]) == 9 and ext["commonNextSteps"] == ["GET /users/{userId}"]
    assert ext["verificationLoopDetected"] is True and ext["verificationLoopCount"] == 1
    assert "responseCompleteness" not in doc["paths"]["/users/{userId}"]["get"]["x-quern-agent"]


def test_json_rpc_by_the_request_alone(spark):
    def call(i, method, tool=None, result=None):
        request = {"jsonrpc": "2.0", "method": method} | ({"params": {"name": tool}} if tool else {})
        return (i, "s", "POST", "/mcp", "/mcp", 200, json.dumps(request), json.dumps(result or {"ok": 1}))

    rows = [call(1, "initialize"), call(2, "tools/call", "create_item", {"a.b": 1}), call(3, "tools/call", "get_item", {"z": 1, "a.b": 2}), call(4, "tools/call", "get_item", {"z": 1})]
    df = spark.createDataFrame(rows, "id long, session_id string, http_method string, path string, normalized_path string, status_code int, request_body string, response_body string")
    df = df.withColumns({"captured_at": F.timestamp_seconds("id"), "jsonrpc_method": F.lit(None).cast("string"), "jsonrpc_tool": F.lit(None).cast("string")})
    from quern.operators.facts import without_bodies

    stored = without_bodies(df)
    assert behaviour.session_kind(stored).first().is_jsonrpc
    assert not behaviour.session_kind(stored.drop("request_facts")).first().is_jsonrpc
    assert not behaviour.session_kind(without_bodies(df.withColumn("request_body", F.lit('[{"jsonrpc":1,"method":2}]')))).first().is_jsonrpc
    ops = {r.op: r.n for r in behaviour.tool_usage(behaviour.with_rpc(stored)).collect()}
    assert ops == {"initialize": 1, "tools/call:create_item": 1, "tools/call:get_item": 2}
    (row,) = behaviour.tool_completeness(behaviour.tool_fields(stored)).collect()
    assert (row.normalized_path, row.completeness, row.missing_fields) == ("tools/call:create_item", 0.5, ["z"])
    report = reports.session_report(stored, name="x")
    assert report.startswith("Session x: 4 samples, 3 tools") and "avg_completeness=0.5" in report
