"""API documents from aggregated endpoints: shared models in Spark, one small document on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.paths import model_name, operation_id, schema_name
from quern.functions.text import AUTH_HEADERS, TRANSPORT_HEADERS
from quern.operators.facts import segment
from quern.sources.scratch import written

#: What a status means in a document.
STATUS_TEXT = {
    201: "Created",
    204: "No Content",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    409: "Conflict",
    422: "Unprocessable Entity",
    429: "Too Many Requests",
    500: "Internal Server Error",
    502: "Bad Gateway",
    503: "Service Unavailable",
}
SCHEMES = {
    "bearerAuth": {"type": "http", "scheme": "bearer"},
    "basicAuth": {"type": "http", "scheme": "basic"},
    "apiKeyAuth": {"type": "apiKey", "in": "header", "name": "X-API-Key"},
}


def domain_models(bodies: DataFrame) -> DataFrame:
    """Shapes that at least two endpoints share: fingerprint, name, usages and endpoints.

    ``bodies``: http_method, normalized_path, ord, fingerprint, is_object, n_properties and is_item
    (the items of an array). Names come from a GET of one resource, else a GET of a list, else the
    first use; equal names are numbered by first use.
    """
    fit = bodies.where(F.col("is_object") & (F.col("n_properties") >= 2))
    single = (F.col("http_method") == "GET") & F.col("normalized_path").rlike(r"/\{[^}]+\}\z")
    listing = (F.col("http_method") == "GET") & F.col("is_item")
    rank = F.when(single, 0).when(listing, 1).otherwise(2)
    shared = (
        fit.groupBy("fingerprint")
        .agg(
            F.count_distinct("http_method", "normalized_path").alias("endpoints"),
            F.count("*").alias("usages"),
            F.min("ord").alias("first"),
            F.min_by("normalized_path", F.struct(rank, F.col("ord"))).alias("path"),
        )
        .where("endpoints >= 2")
        .withColumn("base", model_name(F.col("path")))
    )
    k = F.row_number().over(Window.partitionBy("base").orderBy("first", "fingerprint"))
    return shared.withColumn("k", k).select(
        "fingerprint",
        F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.col("k").cast("string"))).alias("name"),
        "usages",
        "endpoints",
    )


def operations(endpoints: DataFrame) -> DataFrame:
    """Adds operation_id, summary and the names of request and response schemas to endpoint rows."""
    method, path = F.col("http_method"), F.col("normalized_path")
    return endpoints.withColumns(
        {
            "operation_id": operation_id(method, path),
            "summary": F.concat_ws(" ", F.upper(method), path),
            "request_name": schema_name(method, path, F.lit("request"), F.lit(None).cast("string")),
            "response_name": schema_name(method, path, F.lit("response"), F.col("status_code").cast("string")),
        }
    )


def to_openapi(schema: dict, refs: dict[str, dict] | None = None, path: str = "") -> dict:
    """An inferred schema as an OpenAPI schema: no statistics; null variants are left out.

    ``refs`` has references by path: a node at such a path becomes the reference.
    """
    if refs and path in refs:
        return refs[path]
    if "oneOf" in schema:
        left = [to_openapi(v, refs, path) for v in schema["oneOf"] if v["type"] != "null"]
        return {"oneOf": left} if len(left) > 1 else (left[0] if left else {})
    if schema.get("type") in (None, "null"):
        return {}
    out = {k: schema[k] for k in ("type", "format", "enum") if schema.get(k)}
    if schema["type"] == "object":
        if schema.get("properties"):
            out["properties"] = {k: to_openapi(v, refs, path + segment(k)) for k, v in schema["properties"].items()}
        if schema.get("required"):
            out["required"] = schema["required"]
    elif "items" in schema:
        out["items"] = to_openapi(schema["items"], refs, path + "[]")
    return out


class Components:
    """Named schemas of a document; another schema of a taken name gets a number."""

    def __init__(self):
        self.schemas: dict[str, dict] = {}

    def ref(self, name: str, schema: dict) -> dict:
        k = 1
        while (key := name if k == 1 else f"{name}{k}") in self.schemas and self.schemas[key] != schema:
            k += 1
        self.schemas.setdefault(key, schema)
        return {"$ref": f"#/components/schemas/{key}"}


def _kind(values: list[str] | None) -> str:
    return "integer" if values and all(re.fullmatch("[0-9]+", v) for v in values) else "string"


class Models:
    """Shared models of a document: registered when first referred to, by (role, status) and path."""

    def __init__(self, parts: Components, models: dict[str, dict], uses: dict[tuple, dict[str, str]]):
        self.parts, self.models, self.uses, self.open = parts, models, uses, {}

    def _ref(self, name: str) -> dict:
        if name not in self.open:
            m = self.models[name]
            self.open[name] = {"$ref": f"#/components/schemas/{name}"}  # for a model that holds itself
            inside = self.uses.get((m["http_method"], m["normalized_path"], m["role"], m["status"]), {})
            below = {p[len(m["path"]) :]: n for p, n in inside.items() if p.startswith(m["path"]) and p != m["path"]}
            self.open[name] = self.parts.ref(name, self.schema(json.loads(m["node"]), below))
        return self.open[name]

    def schema(self, schema: dict, names: dict[str, str]) -> dict:
        """A schema whose nodes at some paths are models; the outermost counts."""
        out: dict[str, dict] = {}
        for path in sorted(names, key=len):
            if not any(path.startswith(p) and path[len(p)] in ".[" for p in out):
                out[path] = self._ref(names[path])
        return to_openapi(schema, out)

    def resolve(self, row: dict, role: str, status: int, schema: dict) -> dict | None:
        """The reference, or array of references, that stands for a whole schema; None for any other."""
        names = self.uses.get((row["http_method"], row["normalized_path"], role, status), {})
        if "" in names or ("[]" in names and schema.get("type") == "array"):
            return self.schema(schema, names)
        return None

    def inner(self, row: dict, role: str, status: int) -> dict[str, str]:
        return self.uses.get((row["http_method"], row["normalized_path"], role, status), {})


def operation(row: dict, parts: Components, shared: set[tuple[str, str]], prefix: str, metadata: bool, models: Models | None = None) -> dict:
    """One operation of a document from an endpoint row (see ``document``)."""

    def described(role: str, status: int, name: str, text: str) -> dict:
        schema = json.loads(text)
        if models is None:
            return parts.ref(name, to_openapi(schema))
        return models.resolve(row, role, status, schema) or parts.ref(name, models.schema(schema, models.inner(row, role, status)))

    known = row.get("path_param_values") or {}
    params = [
        {"name": n, "in": "path", "required": True, "schema": {"type": _kind(known.get(n))}}
        for n in re.findall(r"\{([^}]+)\}", row["normalized_path"])
    ]
    params += [
        {"name": n, "in": "query", "required": False, "schema": {"type": _kind(v)}}
        for n, v in (row.get("query_params") or {}).items()
    ]
    hidden = {*AUTH_HEADERS, *TRANSPORT_HEADERS, *(n for n, _ in shared)}
    params += [
        {"name": h["name"], "in": "header", "required": False, "schema": {"type": "string"}, "example": h["example"]}
        for h in row.get("request_headers") or []
        if h["name"].lower() not in hidden
    ]
    out: dict = {"operationId": row["operation_id"], "summary": row["summary"]}
    if params:
        out["parameters"] = params
    if row.get("request_schema"):
        ref = described("request", -1, row["request_name"], row["request_schema"])
        out["requestBody"] = {"content": {"application/json": {"schema": ref}}}
    responses = {}
    for status, schema in sorted((row.get("response_schemas") or {}).items(), key=lambda x: int(x[0])):
        text = STATUS_TEXT.get(int(status), f"Response with status {status}")
        responses[status] = {"description": text}
        if int(status) != 204:
            name = row["response_name"] + ("" if status == "200" else status)
            ref = described("response", int(status), name, schema)
            responses[status]["content"] = {"application/json": {"schema": ref}}
    out["responses"] = responses or {"200": {"description": "Response with status 200"}}
    if row.get("extension"):
        out[f"{prefix}-agent"] = json.loads(row["extension"])
    if metadata:
        out[f"{prefix}-sample-count"] = row["sample_count"]
        out[f"{prefix}-confidence"] = row["confidence_score"]
        if row.get("unique_response_shapes") is not None:
            out[f"{prefix}-unique-response-shapes"] = row["unique_response_shapes"]
    return out


def document(
    endpoints: DataFrame,
    global_headers: DataFrame | None = None,
    schemes: DataFrame | None = None,
    title: str = "API",
    version: str = "1.0.0",
    prefix: str = "x-quern",
    metadata: bool = False,
    limit: int = 20_000,
    share: bool = True,
    nested: bool = False,
) -> dict:
    """An OpenAPI 3.1 document of endpoint rows, as a dictionary.

    Rows: http_method, normalized_path, sample_count, confidence_score, request_schema,
    response_schemas (map by status), path_param_values, query_params, request_headers, and extension
    (JSON text) where an operation has one. Schemas that endpoints share become models that the others
    refer to (``share``), whole schemas and items of arrays, with ``nested`` also objects within them. A
    document is read by people and tools as one file; more than ``limit`` endpoints are refused.
    """
    from quern.operators import models as m

    rows = operations(endpoints.withColumn("status_code", F.lit(200))).orderBy("normalized_path", "http_method")
    rows = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} endpoints")
    shared = {(r["name"], r["example"]) for r in global_headers.collect()} if global_headers is not None else set()
    parts = Components()
    known = None
    if share:
        nodes = m.keyed_nodes(endpoints)
        found = written(m.shared_models(nodes, nested), "models")
        uses: dict[tuple, dict[str, str]] = {}
        for r in m.references(nodes, found, nested).collect():  # no more than the schemas of ``limit`` endpoints hold
            uses.setdefault((r.http_method, r.normalized_path, r.role, r.status), {})[r.path] = r.name
        known = Models(parts, {r.name: r.asDict() for r in found.collect()}, uses)
    paths: dict[str, dict] = {}
    for row in rows:
        paths.setdefault(row["normalized_path"], {})[row["http_method"].lower()] = operation(
            row, parts, shared, prefix, metadata, known
        )
    total = sum(r["sample_count"] for r in rows)
    text = f"Auto-generated from {total} traffic samples ({len(rows)} endpoints)"
    out = {"openapi": "3.1.0", "info": {"title": title, "version": version, "description": text}, "paths": paths}
    components = {}
    if schemes is not None and (found := [r["scheme"] for r in schemes.orderBy("scheme").collect()]):
        components["securitySchemes"] = {s: SCHEMES[s] for s in found}
        out["security"] = [{s: []} for s in found]
    if parts.schemas:
        components["schemas"] = parts.schemas
    if components:
        out["components"] = components
    if metadata and shared:
        out[f"{prefix}-global-headers"] = [{"name": n, "example": e} for n, e in sorted(shared)]
    return out


def to_30(node, inside: bool = False):
    """A 3.1 document as 3.0.3: lists of types become one type and ``nullable``, in schemas only."""
    if isinstance(node, list):
        return [to_30(x, inside) for x in node]
    if not isinstance(node, dict):
        return node
    out = {}
    for key, value in node.items():
        if inside and key == "type" and isinstance(value, list):
            rest = [t for t in value if t != "null"]
            if len(rest) < len(value):
                out["nullable"] = True
            out["type"] = rest[0] if rest else "string"
        elif inside and key in ("enum", "required"):
            out[key] = value
        elif key == "openapi" and not inside:
            out[key] = "3.0.3"
        else:
            out[key] = to_30(value, inside or key in ("schema", "schemas"))
    return out


def serialize(doc: dict, fmt: str = "yaml") -> str:
    """The document as JSON, or as YAML (keys and strings quoted as in JSON)."""
    if fmt == "json":
        return json.dumps(doc, indent=2, ensure_ascii=False)

    def lines(node, depth: int):
        pad = "  " * depth
        items = node.items() if isinstance(node, dict) else ((None, v) for v in node)
        for key, value in items:
            name = "-" if key is None else json.dumps(key, ensure_ascii=False) + ":"
            if isinstance(value, (dict, list)) and value:
                yield f"{pad}{name}"
                yield from lines(value, depth + 1)
            else:
                yield f"{pad}{name} {json.dumps(value, ensure_ascii=False)}"

    return "\n".join(lines(doc, 0)) + "\n"


def json_export(endpoints: DataFrame) -> DataFrame:
    """One JSON line per endpoint row, with the fields of a raw export; schemas are objects, not text.

    A row's id is made of its session, snapshot, method and path; columns beyond those fields are left out.
    """
    node = lambda c: F.parse_json(c)
    id = F.md5(F.to_json(F.struct("session_id", "snapshot", "http_method", "normalized_path")))
    return endpoints.select(
        F.to_json(
            F.struct(
                id.alias("id"),
                F.col("session_id").alias("sessionId"),
                F.col("http_method").alias("httpMethod"),
                F.col("normalized_path").alias("path"),
                "version",
                F.col("sample_count").alias("sampleCount"),
                F.col("confidence_score").alias("confidenceScore"),
                node(F.col("request_schema")).alias("requestSchema"),
                F.transform_values("response_schemas", lambda _, v: node(v)).alias("responseSchemas"),
                F.col("request_headers").alias("requestHeaders"),
                F.col("response_headers").alias("responseHeaders"),
                F.col("changes").alias("breakingChanges"),
                F.col("first_observed").alias("firstObserved"),
                F.col("last_observed").alias("lastObserved"),
            )
        ).alias("value")
    )
