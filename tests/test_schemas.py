"""Merging by aggregation against a sequential fold, and the rules around it."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import documents, facts
from quern.operators.diff import schema_changes

LEAF = st.one_of(st.none(), st.booleans(), st.integers(-5, 2**33), st.floats(-5, 5), st.sampled_from(["a", "b", "2024-01-15"]))
BODY = st.recursive(
    LEAF, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "b.c", "d[]"]), x, max_size=3)), max_leaves=8
)


def fold(bodies):
    """Counts and formats of (path, type), one body after another."""
    out = {}
    for body in bodies:
        for path, kind, fmt, _ in facts.nodes(body):
            n, f = out.get((path, kind), (0, fmt))
            out[path, kind] = (n + 1, fmt if f == fmt else None)
    for path, kind in list(out):
        if kind == "integer" and (path, "number") in out:
            n, _ = out.pop((path, "integer"))
            out[path, "number"] = (out[path, "number"][0] + n, None)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BODY, min_size=1, max_size=6))
def test_aggregation_equals_fold(spark, bodies):
    df = spark.createDataFrame([("g", i, json.dumps(b)) for i, b in enumerate(bodies)], "g string, id long, body string")
    merged = facts.merge_facts(facts.infer_facts(df), ["g"]).collect()
    assert {(r.path, r.type): (r.n, r.format) for r in merged} == fold([json.loads(json.dumps(b)) for b in bodies])


def schema_of(spark, bodies, patch=False):
    df = spark.createDataFrame([("g", i, b) for i, b in enumerate(bodies)], "g string, id long, body string")
    totals = df.groupBy("g").agg(F.count("*").alias("total")).withColumn("patch", F.lit(patch))
    found = facts.infer_facts(df)
    merged = facts.merge_facts(found, ["g"])
    stats = facts.field_stats(merged, totals, ["g"], "patch")
    out = facts.assemble(stats, facts.enums(found, totals, ["g"]), ["g"]).collect()
    return json.loads(out[0].schema) if out else None


def test_required_counts_samples_without_body(spark):
    bodies = ['{"a":1,"n":{"x":1,"y":2}}', '{"a":2,"n":{"x":1}}']
    s = schema_of(spark, bodies)
    assert s["required"] == ["a", "n"] and s["properties"]["n"]["required"] == ["x"]
    assert schema_of(spark, [*bodies, None])["required"] == []
    assert schema_of(spark, bodies, patch=True)["required"] == []


def test_unions_arrays_and_formats(spark):
    s = schema_of(spark, ['{"v":"x","l":[{"k":1},{"k":2.5}],"u":"a@b.co"}', '{"v":1,"l":[],"u":"2024-01-15"}', "[bad", ""])
    v = s["properties"]["v"]
    assert [x["type"] for x in v["oneOf"]] == ["string", "integer"]
    item = s["properties"]["l"]["items"]
    assert item["properties"]["k"]["type"] == "number" and "format" not in s["properties"]["u"]
    assert schema_of(spark, ["", None]) is None


def test_enum(spark):
    few = [json.dumps({"s": "ab"[i % 2]}) for i in range(10)]
    assert schema_of(spark, few)["properties"]["s"]["enum"] == ["a", "b"]
    assert "enum" not in schema_of(spark, few[:9])["properties"]["s"]
    assert "enum" not in schema_of(spark, [json.dumps({"s": f"v{i}"}) for i in range(12)])["properties"]["s"]


def test_facts_add_up_whatever_the_order(spark):
    rows = [("g", 3, '{"b":1,"a":"x"}'), ("g", None, '{"a":"y"}'), ("h", 3, "[bad"), ("g", 1, '{"b":2.5,"a":null}'), (None, 2, '{"a":"z"}')]
    df = spark.createDataFrame(rows, "g string, id long, body string")
    parts = [facts.infer_facts(df.coalesce(1)), facts.infer_facts(df.repartition(4)), facts.infer_facts(df.orderBy(F.desc("id")))]
    got = [sorted(map(str, facts.merge_facts(x, ["g"]).collect())) for x in parts]
    assert got[0] == got[1] == got[2]
    merged = {(r.g, r.path, r.type): r for r in facts.merge_facts(parts[0], ["g"]).collect()}
    assert merged["g", ".a", "string"].n == 2 and merged["g", ".a", "string"].first == (None, 1)
    assert merged["g", ".b", "number"].n == 2 and merged["g", ".b", "number"].first == (1, 1)
    assert {k[0] for k in merged} == {"g", None}
    assert facts.infer_facts(df.limit(0)).count() == 0
    nested = facts.infer_facts(df.select("id", "body", F.col("g").alias("path"), F.col("id").alias("n"))).collect()
    assert {(r.keys.path, r.keys.n) for r in nested} == {("g", 3), ("g", None), ("g", 1), (None, 2)} and {r.path for r in nested} == {"", ".a", ".b"}


def test_stored_facts_equal_those_of_bodies(spark):
    bodies = [json.dumps({"s": f"v{i % 12}", "t": "ab"[i % 2], "l": [{"k": i}, {"k": i / 2}]}) for i in range(24)] + ["", "{", None]
    rows = [("g", i, None if i % 3 else "{}", b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "g string, id long, request_body string, response_body string")
    stored = facts.without_bodies(df)
    assert "request_body" not in stored.columns and "response_body" not in stored.columns
    kept = facts.merge_facts(facts.stored_facts(stored, "response", ["g"]), ["g"]).collect()
    read = facts.merge_facts(facts.infer_facts(df.select("g", "id", F.col("response_body").alias("body"))), ["g"]).collect()
    assert sorted(map(str, kept)) == sorted(map(str, read)) != []
    totals = df.groupBy("g").agg(F.count("*").alias("total"))
    found = facts.enums(facts.stored_facts(stored, "response", ["g"]), totals, ["g"]).collect()
    assert [(r.path, r.enum) for r in found] == [(".t", ["a", "b"])]
    shapes = {r.id: (r.request_shape, r.response_shape) for r in stored.collect()}
    assert shapes[3] == ("{}", "{l:[{k:number}],s:string,t:string}") and shapes[25] == ("<empty>", "<empty>")
    assert facts.without_bodies(stored).columns == stored.columns


def test_fingerprint():
    assert facts.fingerprint({"b": 1, "a": [{"x": 1}, {"x": 1.5}]}) == "{a:[{x:number}],b:integer}"
    assert facts.fingerprint([]) == "array" and facts.fingerprint({}) == "{}"
    assert facts.fingerprint(["a", 1]) == "[oneOf(integer|string)]"


def obj(required=(), **fields):
    return {"type": "object", "properties": {k: {"type": v} for k, v in fields.items()}, "required": list(required)}


def kinds(old, new):
    return [(c["kind"], c["path"], c["breaking"]) for c in schema_changes(old, new)]


def test_changes():
    base = obj(["id", "email"], id="integer", email="string", avatar="string")
    assert kinds(base, obj(["id"], id="number", avatar="string")) == [
        ("required_field_removed", "$.email", True),
        ("type_widened", "$.id", False),
    ]
    assert kinds(base, obj(["id", "email", "phone"], id="integer", email="string", avatar="string", phone="string")) == [
        ("required_field_added", "$.phone", True)
    ]
    assert kinds(base, obj(["id", "email", "avatar"], id="integer", email="integer", avatar="string")) == [
        ("field_became_required", "$.avatar", True),
        ("incompatible_type_change", "$.email", True),
    ]
    assert kinds(base, {"type": "array"}) == [("schema_type_changed", "$", True)]
    union = {"type": "string", "oneOf": [{"type": "string"}, {"type": "null"}]}
    assert kinds({"type": "string"}, union) == [("type_expanded", "$", False)]
    assert kinds(union, {"type": "string"}) == [("incompatible_type_change", "$", True)]
    assert kinds(union, union) == []


def test_openapi_schema_and_30():
    null = {"type": "null"}
    assert documents.to_openapi({"type": "object", "oneOf": [{"type": "object", "properties": {}}, null]}) == {"type": "object"}
    two = {"type": "string", "oneOf": [{"type": "string"}, {"type": "integer"}, null]}
    assert documents.to_openapi(two) == {"oneOf": [{"type": "string"}, {"type": "integer"}]}
    doc = {"openapi": "3.1.0", "paths": {"/x": {"schema": {"type": ["string", "null"], "properties": {"type": {"type": "string"}}}}}}
    assert documents.to_30(doc)["paths"]["/x"]["schema"]["nullable"] is True
    assert documents.to_30(doc)["openapi"] == "3.0.3"
    parts = documents.Components()
    assert parts.ref("User", {"a": 1}) == parts.ref("User", {"a": 1})
    assert parts.ref("User", {"a": 2}) == {"$ref": "#/components/schemas/User2"}
