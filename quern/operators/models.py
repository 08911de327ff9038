"""Stored schemas as a relation of nodes, the models that endpoints share, and where documents refer to them.

A stored schema is JSON text. It is opened level by level, each level a projection over the nodes of the
one before, until none holds anything. Properties are read into ordered maps (a VARIANT would sort them).

A node's key is a hash of all that stands below it: every node adds the hash of its path from there and
its type to each of its ancestors, so equal subtrees have equal keys wherever they stand. The sums are
combined before they are shuffled; neither a wide object nor a deep one is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.documents import domain_models
from quern.sources.scratch import written

ENDPOINT = ["http_method", "normalized_path"]
#: One stored schema of an endpoint: a request, or a response of a status.
SITE = [*ENDPOINT, "role", "status"]
_NODE = "type string, properties map<string,string>, required array<string>, items string, oneOf array<string>"
_TOKEN = r"(\.(?:[^.\[\\]|\\.)*|\[\])"


def read_node(schema):
    """A stored schema's own level: type, properties in order, required, items and variants as text."""
    return F.from_json(schema, _NODE)


def stored_schemas(endpoints: DataFrame) -> DataFrame:
    """One row per schema of endpoint rows: http_method, normalized_path, role, status (-1: request) and schema.

    Null schemas and endpoints without any give no rows.
    """
    asked = endpoints.select(*ENDPOINT, F.lit("request").alias("role"), F.lit(-1).alias("status"), F.col("request_schema").alias("schema"))
    got = endpoints.select(*ENDPOINT, F.explode("response_schemas").alias("code", "schema"))
    got = got.select(*ENDPOINT, F.lit("response").alias("role"), F.expr("try_cast(code AS int)").alias("status"), "schema")
    return asked.unionByName(got).where("schema is not null")


def schema_nodes(schemas: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """One row per (keys, path, variant): type, is_union, n_properties and node (the variant's text).

    Paths are those of facts: ``.name`` for a property, ``[]`` for items, dots and brackets escaped. The
    depth has no limit; the loop ends at the level that holds nothing.
    """
    level = written(schemas.select(*keys, F.lit("").alias("path"), F.col("schema").alias("text")), "schemas")
    out = None
    while True:
        read = level.withColumn("x", read_node(F.col("text")))
        read = read.withColumn("is_union", F.col("x.oneOf").isNotNull())
        read = read.select(*keys, "path", "is_union", F.explode(F.coalesce("x.oneOf", F.array("text"))).alias("node"))
        read = read.withColumn("x", read_node(F.col("node")))
        rows = read.select(*keys, "path", F.col("x.type").alias("type"), "is_union", F.coalesce(F.size("x.properties"), F.lit(0)).alias("n_properties"), "node")
        out = rows if out is None else out.unionByName(rows)
        name = F.regexp_replace("key", r"([.\[\\])", r"\\$1")
        inside = read.select(*keys, "path", F.explode("x.properties").alias("key", "text"))
        inside = inside.select(*keys, F.concat("path", F.lit("."), name).alias("path"), "text")
        items = read.where("x.items is not null").select(*keys, F.concat("path", F.lit("[]")).alias("path"), F.col("x.items").alias("text"))
        level = written(inside.unionByName(items), "level")
        if level.isEmpty():
            return out


def subtree_keys(nodes: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """(keys, path, key): equal keys mean equal names and types all the way down; statistics, formats,
    enumerations and what is required do not count."""
    tokens = F.regexp_extract_all("path", F.lit(_TOKEN))
    each = nodes.select(*keys, tokens.alias("t"), "type").select(
        *keys, "t", "type", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("k")
    )
    at, below = F.array_join(F.slice("t", 1, F.col("k")), ""), F.array_join(F.slice("t", F.col("k") + 1, F.size("t")), "")
    # two independent hashes of 64 bits and the number of nodes
    sums = each.select(*keys, at.alias("path"), *(F.xxhash64(F.lit(s), below, "type").cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2)))
    found = sums.groupBy(*keys, "path").agg(F.sum("h1").alias("a"), F.sum("h2").alias("b"), F.count("*").alias("n"))
    return found.select(*keys, "path", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"), "n").alias("key"))


def keyed_nodes(endpoints: DataFrame) -> DataFrame:
    """All nodes of the endpoints' stored schemas with their keys and an order: path, method, request first, status."""
    nodes = schema_nodes(stored_schemas(endpoints))
    keyed = written(nodes.join(subtree_keys(nodes), [*SITE, "path"]), "nodes")
    return keyed.withColumn("ord", F.struct("normalized_path", "http_method", F.col("role") == "response", "status", "path"))


def _sites(nodes: DataFrame, nested: bool) -> DataFrame:
    """Nodes that can be a model or stand for one: plain objects at the root or as the items of a root
    array, with ``nested`` anywhere."""
    plain = nodes.where((F.col("type") == "object") & ~F.col("is_union"))
    return plain if nested else plain.where("path in ('', '[]')")


def shared_models(nodes: DataFrame, nested: bool = False) -> DataFrame:
    """key, name, usages, endpoints, and the site (SITE and path) and node of the first use of each model:
    an object of at least two properties that two endpoints have alike.

    Below a root array only its own items count. Names come as ``documents.domain_models`` tells.
    """
    fit = _sites(nodes, nested).withColumns(
        {"fingerprint": F.col("key"), "is_object": F.lit(True), "is_item": F.endswith("path", F.lit("[]"))}
    )
    named = domain_models(fit)
    first = fit.groupBy("fingerprint").agg(F.min_by(F.struct(*SITE, "path", "node"), "ord").alias("first"))
    return named.join(first, "fingerprint").select(F.col("fingerprint").alias("key"), "name", "usages", "endpoints", "first.*")


def references(nodes: DataFrame, models: DataFrame, nested: bool = False) -> DataFrame:
    """SITE, path and name: nodes that a document replaces by a reference.

    A schema that is a model goes first; then the items of an array. With ``nested``, the outermost
    model on each path, and models below the root of another model's own schema, are all given; the
    document takes the outermost.
    """
    return _sites(nodes, nested).join(models.select("key", "name"), "key").select(*SITE, "path", "name")
