"""States of parts of a session: they add up to that of the whole, and snapshots grow by them."""

import json
import random

from pyspark.sql import functions as F

from quern.operators import state
from quern.operators.facts import without_bodies
from quern.operators.pipeline import aggregate_session
from quern.sources.capture import RAW_PAIRS, to_samples
from quern.sources.scratch import written
from quern.sources.store import Store
from tests.test_sessions import pair

URLS = ["/users/{}?p={}", "/orders/{}/items", "/orders?page={}&q={}"]


def calls(n, seed=1):
    """Pairs with nested bodies, enumerations with few and many values, several statuses and a late clock."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = {"id": r.choice([i, i + 0.5]), "kind": r.choice("abc"), "name": f"n{i}", "a.b": [{"x": r.randint(0, 3)}, None][: r.randint(0, 2)]}
        if r.random() < 0.3:
            body["odd"] = r.choice([None, "2024-01-01", [1], {"y": True}])
        text = r.choice([json.dumps(body)] * 8 + ["", "{not json"])
        at = f"2024-01-01T00:{r.randint(0, 59):02d}:00Z"
        p = pair(i, r.choice(["GET", "patch", "POST"]), r.choice(URLS).format(i, i % 4), text, request=text, at=at)
        p["status_code"] = r.choice([200, 201, 404, None])
        p["request_headers"] = {f"X-{r.choice('AbaB')}": str(i), "Accept": "*/*"} if r.random() < 0.8 else {}
        out.append(p)
    return out


def raw(spark, pairs):
    return spark.createDataFrame([(json.dumps(p),) for p in pairs], "v string").select(F.from_json("v", RAW_PAIRS).alias("x")).select("x.*")


def rows_of(frame):
    kept = frame.drop("created_at", "snapshot", "version", "previous_session_id", "changes").orderBy("normalized_path", "http_method")
    return [r.asDict(recursive=True) for r in kept.collect()]


def test_states_of_parts_add_up(spark):
    samples = written(without_bodies(to_samples(raw(spark, calls(120)))), "samples")
    whole = written(state.state_of(samples), "whole")
    parts = [state.state_of(samples.where(F.col("id") % 3 == k)) for k in (2, 0, 1)]
    nested = written(state.union_states(written(state.union_states(*parts[:2]), "two"), parts[2]), "three")
    order = [c for c in whole.columns if c not in ("first", "example")]
    key = lambda df: sorted((json.dumps(r.asDict(recursive=True), default=str) for r in df.select(*order, "first", "example").collect()))
    assert key(nested) == key(whole)
    assert state.samples_in(nested) == 120 and state.samples_in(whole.limit(0)) == 0
    assert rows_of(state.endpoints_of(nested)) == rows_of(aggregate_session(to_samples(raw(spark, calls(120)))))
    # a path with more values than an enumeration may have keeps just enough of them
    kept = whole.where("kind = 'value' and key = '.name'").groupBy("http_method", "normalized_path", "side", "status_code").count()
    assert kept.agg(F.max("count")).first()[0] <= 11


def test_states_against_plain_counts(spark):
    pairs = calls(60, 7)
    rows = state.endpoints_of(written(state.state_of(without_bodies(to_samples(raw(spark, pairs)))), "state"))
    got = {(r.http_method, r.normalized_path): r for r in rows.collect()}
    plain = {}
    for p in pairs:
        path = p["url"].split("?")[0]
        template = "/users/{userId}" if path.startswith("/users") else "/orders" if path == "/orders" else "/orders/{orderId}/items"
        plain.setdefault((p["method"].upper(), template), []).append(p)
    assert got.keys() == plain.keys()
    for at, mine in plain.items():
        row = got[at]
        assert row.sample_count == len(mine)
        values = {v for p in mine for k, _, v in [x.partition("=") for x in p["url"].partition("?")[2].split("&") if x] if k == "q"}
        assert set((row.query_params or {}).get("q", [])) == values
        names = {k.lower() for p in mine for k in p["request_headers"]}
        assert {h.name.lower() for h in row.request_headers or []} == names
        for h in row.request_headers or []:
            first = next(p for p in mine if h.name.lower() in {k.lower() for k in p["request_headers"]})
            assert first["request_headers"][h.name] == h.example


def admit(store, spark, batches, every, session="a:b"):
    """What a stream does with each of its batches."""
    for i, batch in enumerate(batches):
        store.add_samples(to_samples(raw(spark, batch)), i, session)
        store.note_batch(session, i, len(batch), 0)
        store.add_parts(session, i, every)


def in_order(batches):
    return [p for b in batches for p in sorted(b, key=lambda p: (p["captured_at"], p["seq"]))]


def test_snapshots_grow_by_parts_alone(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    pairs = [p | {"session_id": "a:b"} for p in calls(38, 3)]
    batches = [pairs[:10], pairs[10:17], pairs[17:37], pairs[37:]]
    admit(store, spark, batches, 10)
    assert set(store._upto("parts", "a:b")) == {10, 20, 30, 40}
    monkeypatch.setattr(Store, "_first", lambda *_: 1 / 0)  # never back to the samples
    for snapshot in (1, 3):
        want = aggregate_session(to_samples(raw(spark, in_order(batches)[: 10 * snapshot])))
        assert rows_of(store.aggregate("a:b", snapshot, 10 * snapshot)) == rows_of(want)
    assert set(store._upto("states", "a:b")) == {10, 30}
    monkeypatch.undo()
    # from the samples, as where there are no parts
    kept = rows_of(store.snapshot("a:b", 3))
    for name in ("parts", "states"):
        store._remove(name)
    assert rows_of(store.aggregate("a:b", 3, 30)) == kept
    assert state.samples_in(store._state("a:b", 99)[1]) == 38
    assert set(store._upto("states", "a:b")) == {30}  # none for 99, which there are not yet


def test_a_batch_written_again_takes_its_states_along(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    pairs = [p | {"session_id": "a:b"} for p in calls(8, 5)]
    admit(store, spark, [pairs[:4], pairs[4:]], 3)
    assert state.samples_in(store._state("a:b", 3)[1]) == 3 and set(store._upto("states", "a:b")) == {3}
    store.add_samples(to_samples(raw(spark, [p | {"url": "/new"} for p in pairs[:4]])), 0, "a:b")
    assert not store._upto("states", "a:b")
    paths = store._state("a:b", 3)[1].select("normalized_path").distinct().collect()
    assert [r.normalized_path for r in paths] == ["/new"]
    for status in ("active", "aggregating", "completed"):
        store.put_session("a:b", status)
    store.delete_session("a:b")
    assert not store._found("*/session_id=a%3Ab")
