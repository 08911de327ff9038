"""Models that endpoints share, nodes of stored schemas, references in documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import diff, documents, facts, models
from quern.operators.pipeline import aggregate_session
from quern.sources.scratch import written

LEAF = st.sampled_from([1, "a", None, True, 2.5])
BODY = st.recursive(
    LEAF, lambda x: st.one_of(st.lists(x, max_size=2), st.dictionaries(st.sampled_from(["a", "b.c", "d[]", "e\\"]), x, max_size=3)), max_leaves=8
)


def rows_of(spark, calls):
    """Endpoint rows of calls (method, template, request, status, response)."""
    data = [("s", i, m, t, t, s, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for i, (m, t, a, s, b) in enumerate(calls)]
    df = spark.createDataFrame(data, "session_id string, id long, http_method string, path string, normalized_path string, status_code int, request_body string, response_body string")
    none = F.lit(None)
    headers = none.cast("array<struct<name:string,example:string>>")
    df = df.withColumns({"captured_at": F.timestamp_seconds("id"), "query_params": none.cast("map<string,string>"), "request_headers": headers, "response_headers": headers,
                         "jsonrpc_method": none.cast("string"), "jsonrpc_tool": none.cast("string")})
    return written(aggregate_session(df), "rows")


def subtrees(schema, path=""):
    """(path, fingerprint by the plain recursion) of every node of an inferred schema."""
    print_of = lambda s: (
        f"oneOf({'|'.join(sorted(map(print_of, s['oneOf'])))})" if "oneOf" in s
        else "{" + ",".join(f"{k}:{print_of(v)}" for k, v in sorted(s["properties"].items())) + "}" if s["type"] == "object"
        else f"[{print_of(s['items'])}]" if "items" in s else s["type"]
    )
    yield path, print_of(schema)
    for v in schema.get("oneOf", [schema]):
        for k, x in v.get("properties", {}).items():
            yield from subtrees(x, path + facts.segment(k))
        if "items" in v:
            yield from subtrees(v["items"], path + "[]")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(BODY, BODY), min_size=1, max_size=4))
def test_equal_keys_mean_equal_subtrees(spark, bodies):
    schemas = []
    for i, pair in enumerate(bodies):
        rows = [r for b in pair for r in [b]]
        df = spark.createDataFrame([("g", k, json.dumps(b)) for k, b in enumerate(rows)], "g string, id long, body string")
        totals = df.groupBy("g").agg(F.count("*").alias("total"))
        found = facts.infer_facts(df)
        stats = facts.field_stats(facts.merge_facts(found, ["g"]), totals, ["g"])
        schemas.append((i, facts.assemble(stats, facts.enums(found, totals, ["g"]), ["g"]).first().schema))
    nodes = models.schema_nodes(spark.createDataFrame(schemas, "i int, schema string"), ["i"])
    got = {(r.i, r.path): r.key for r in models.subtree_keys(nodes, ["i"]).collect()}
    want = {(i, p): f for i, text in schemas for p, f in subtrees(json.loads(text))}
    assert got.keys() == want.keys()
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[a] == want[b])


USER = {"id": 1, "name": "x", "address": {"street": "s", "zip": 1}}
CALLS = [
    ("GET", "/users", None, 200, [USER, USER]),
    ("GET", "/users/{userId}", None, 200, USER),
    ("POST", "/users", USER, 201, USER),
    ("GET", "/users/{userId}", None, 404, {"error": "no", "code": 1}),
    ("GET", "/teams/{teamId}", None, 404, {"error": "no", "code": 2}),
    ("GET", "/teams/{teamId}", None, 200, {"title": "t", "head": USER, "place": {"street": "s", "zip": 2}}),
    ("GET", "/lone", None, 200, {"only": 1}),
    ("GET", "/lone2", None, 200, {"only": 1}),
    ("GET", "/mixed", None, 200, USER),
    ("GET", "/mixed", None, 200, "text"),
]


def test_whole_schemas_and_items_are_shared(spark):
    doc = documents.document(rows_of(spark, CALLS))
    body = lambda p, m, s: doc["paths"][p][m]["responses"][s]["content"]["application/json"]["schema"]
    user = {"$ref": "#/components/schemas/User"}
    assert body("/users", "get", "200") == {"type": "array", "items": user}
    assert body("/users/{userId}", "get", "200") == body("/users", "post", "201") == user
    assert doc["paths"]["/users"]["post"]["requestBody"]["content"]["application/json"]["schema"] == user
    assert body("/users/{userId}", "get", "404") == body("/teams/{teamId}", "get", "404")
    schemas = doc["components"]["schemas"]
    assert schemas["User"]["properties"]["address"]["properties"]["street"] == {"type": "string"}
    # one property is no model; a union is none; objects within others stay, as asked
    assert body("/lone", "get", "200") != body("/lone2", "get", "200")
    assert "oneOf" in schemas[body("/mixed", "get", "200")["$ref"].rsplit("/", 1)[1]]
    team = schemas[body("/teams/{teamId}", "get", "200")["$ref"].rsplit("/", 1)[1]]
    assert "properties" in team["properties"]["head"]


def test_nested_models_refer_to_each_other(spark):
    rows = rows_of(spark, CALLS)
    doc = documents.document(rows, nested=True)
    schemas = doc["components"]["schemas"]
    team = schemas[doc["paths"]["/teams/{teamId}"]["get"]["responses"]["200"]["content"]["application/json"]["schema"]["$ref"].rsplit("/", 1)[1]]
    user = schemas[team["properties"]["head"]["$ref"].rsplit("/", 1)[1]]
    assert user["properties"]["address"] == team["properties"]["place"] and "$ref" in user["properties"]["address"]
    assert schemas[user["properties"]["address"]["$ref"].rsplit("/", 1)[1]]["properties"].keys() == {"street", "zip"}
    plain = documents.document(rows, share=False)
    assert not any(k in ("User", "Team") for k in plain["components"]["schemas"])


def test_no_schemas_no_models(spark):
    rows = rows_of(spark, [("GET", "/x", None, 204, None)])
    nodes = models.keyed_nodes(rows)
    assert nodes.count() == 0 and models.shared_models(nodes).count() == 0
    assert documents.document(rows)["paths"]["/x"]["get"]["responses"]["200"]
    assert documents.document(rows.limit(0))["paths"] == {}


def test_a_wide_object_stays_a_relation(spark):
    wide = {f"k{i}": {"a": 1, "b": "x"} for i in range(3000)}
    nodes = models.keyed_nodes(rows_of(spark, [("GET", "/wide", None, 200, wide), ("GET", "/p/{pId}", None, 200, {"a": 1, "b": "y"})]))
    found = {r.name: r.usages for r in models.shared_models(nodes, nested=True).collect()}
    assert found == {"P": 3001}


@pytest.mark.parametrize("fmt", ["raw"])
def test_raw_export_fields(spark, fmt):
    rows = rows_of(spark, CALLS[:2]).withColumns({"snapshot": F.lit(1), "version": F.lit(1), "changes": F.lit(None).cast("array<string>")})
    one = json.loads(documents.json_export(rows).first().value)
    fixed = {"id", "sessionId", "httpMethod", "path", "version", "sampleCount", "confidenceScore", "responseSchemas", "firstObserved", "lastObserved"}
    assert fixed <= one.keys() <= fixed | {"requestSchema", "requestHeaders", "responseHeaders", "breakingChanges"}
    assert isinstance(one["responseSchemas"]["200"], dict)


def inferred(body, optional):
    """A schema like those inferred, with some fields optional."""
    if isinstance(body, dict):
        return {"type": "object", "properties": {k: inferred(v, optional) for k, v in body.items()}, "required": sorted(k for k in body if k not in optional)}
    if isinstance(body, list):
        kinds = {facts.kind_of(x): x for x in body}
        if len(kinds) > 1:
            some = [inferred(x, optional) for x in kinds.values()]
            return {"type": "array", "items": {"type": some[0]["type"], "oneOf": some}}
        return {"type": "array"} | ({"items": inferred(body[0], optional)} if body else {})
    return {"type": facts.kind_of(body)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(BODY, BODY, st.sets(st.sampled_from(["a", "b.c"])), st.sets(st.sampled_from(["a", "d[]"]))), min_size=12, max_size=25))
def test_nested_changes_equal_the_recursion(spark, pairs):
    # bodies that differ in one place, beside wholly different ones
    pairs = pairs + [({"a": x, "b.c": {"a": [x, 1]}}, {"a": y, "b.c": {"a": [y, 1], "d[]": x}}, s, t) for x, y, s, t in pairs]
    both = [(inferred(x, s), inferred(y, t)) for x, y, s, t in pairs]
    sides = [models.schema_nodes(spark.createDataFrame([(i, json.dumps(p[k])) for i, p in enumerate(both)], "i int, schema string"), ["i"]) for k in (0, 1)]
    got = sorted((r.i, r.path, r.kind, r.breaking, r.detail) for r in diff.nested_changes(*sides, ["i"]).collect())
    want = sorted((i, c["path"], c["kind"], c["breaking"], c["detail"]) for i, p in enumerate(both) for c in diff.schema_changes(*p))
    assert got == want
