"""Formats of strings, tool names, headers and JSON-RPC bodies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in order of priority; each pattern holds for the whole string.
FORMATS = [
    ("uuid", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"),
    ("uri", r"^https?://.+"),
    (
        "date-time",
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2}|[+-][0-9]{4})?\z",
    ),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
    ("ipv4", r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z"),
]
_H = "[0-9a-fA-F]{1,4}"
#: Accepted shapes of an IPv6 address.
IPV6 = [
    rf"^(?:{_H}:){{7}}{_H}\z",
    rf"^::(?:{_H}:){{0,6}}{_H}\z",
    rf"^{_H}::(?:{_H}:){{0,5}}{_H}\z",
    rf"^(?:{_H}:){{1,6}}:{_H}\z",
    rf"^(?:{_H}:){{1,7}}:\z",
    rf"^:(?::{_H}){{1,7}}\z",
    r"^::\z",
]
FORMATS.append(("ipv6", "|".join(IPV6)))

#: Verbs that mark tools as writing or reading.
CHANGE_VERBS = "create|set|update|put|patch|add|insert|upsert"
WRITE_VERBS = CHANGE_VERBS + "|delete|remove"
READ_VERBS = "get|query|read|describe|list|fetch|show|find|lookup"

#: Headers that only concern a hop or the infrastructure, and secrets.
HOP_HEADERS = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
]
INFRASTRUCTURE_HEADERS = [
    "x-forwarded-for", "x-forwarded-proto", "x-forwarded-host", "x-forwarded-port", "via", "forwarded", "host",
]
#: Headers that documents leave out.
AUTH_HEADERS = ["authorization", "x-api-key", "x-auth-token", "cookie", "set-cookie", "proxy-authorization"]
TRANSPORT_HEADERS = ["accept", "accept-encoding", "user-agent", "content-length", "content-type", "host"]


def string_format(value: Column) -> Column:
    """The first format whose pattern holds, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in FORMATS:
        out = out.when(value.rlike(pattern), F.lit(name))
    return out


def is_write_tool(tool: Column) -> Column:
    """A writing verb stands in the name, after its start or a separator and before one."""
    return tool.rlike(rf"(?i)(?:^|[-_])({WRITE_VERBS})[-_]")


def is_read_tool(tool: Column) -> Column:
    """A reading verb stands in the name, after its start or a separator and before one."""
    return tool.rlike(rf"(?i)(?:^|[-_])({READ_VERBS})[-_]")


def tool_resource(tool: Column) -> Column:
    """What follows a tool's verb (the writing one first), else the whole name.

    The verb counts from the first place where its text stands in the name.
    """
    found = [
        F.nullif(F.regexp_extract(tool, rf"(?i)(?:^|[-_])({verbs})[-_]", 1), F.lit("")) for verbs in (WRITE_VERBS, READ_VERBS)
    ]
    verb = F.coalesce(*found)
    rest = F.substring(tool, F.instr(tool, verb) + F.char_length(verb), F.char_length(tool))
    return F.coalesce(F.regexp_replace(rest, "^[-_]", ""), tool)


def same_resource_key(resource: Column) -> Column:
    """A resource name lower-cased without its plural ending."""
    return F.regexp_replace(F.regexp_replace(F.lower(resource), r"ies\z", "y"), r"(?<=[sxz])es\z|(?<!s)s\z", "")


def redact_header(name: Column, value: Column) -> Column:
    """A header's value without secrets: the scheme of Authorization stays."""
    scheme = F.regexp_extract(value, r"^(\S+)\s", 1)
    return (
        F.when(
            F.lower(name) == "authorization",
            F.when(scheme != "", F.concat(scheme, F.lit(" ***"))).otherwise(F.lit("***")),
        )
        .when(F.lower(name).isin("cookie", "x-api-key"), F.lit("***"))
        .otherwise(value)
    )


def capture_headers(headers: Column) -> Column:
    """array<struct<name,example>> of a header map: no hop headers, no empty ones, redacted, by name; null if none."""
    kept = F.filter(
        F.map_entries(headers),
        lambda e: ~F.lower(e["key"]).isin(HOP_HEADERS + INFRASTRUCTURE_HEADERS) & (F.coalesce(e["value"], F.lit("")) != ""),
    )
    out = F.array_sort(
        F.transform(kept, lambda e: F.struct(e["key"].alias("name"), redact_header(e["key"], e["value"]).alias("example")))
    )
    return F.when(F.size(out) > 0, out)


def is_json_type(content_type: Column) -> Column:
    """The base type is application/json, exactly."""
    return F.lower(F.trim(F.substring_index(content_type, ";", 1))) == "application/json"


def json_text(body: Column, path: str) -> Column:
    """A JSON value of a body as text if it is a string there, else null."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(body), path, "string"))


def rpc_method(body: Column) -> Column:
    """The method of a JSON-RPC request body (version 2.0 or 1.0), else null."""
    return F.when(F.get_json_object(body, "$.jsonrpc").isin("2.0", "1.0"), json_text(body, "$.method"))


def rpc_tool(body: Column) -> Column:
    """The tool that a JSON-RPC tools/call names, else null."""
    return F.when(rpc_method(body) == "tools/call", json_text(body, "$.params.name"))


def operation_key(rpc: Column, tool: Column, method: Column, template: Column) -> Column:
    """``method:tool`` or ``method`` of a JSON-RPC call, else ``METHOD /template``."""
    return F.when(rpc.isNotNull(), F.concat_ws(":", rpc, tool)).otherwise(F.concat_ws(" ", method, template))


def unwrap_tool_response(body: Column) -> Column:
    """The JSON inside the first text content of a tool's JSON-RPC result; the body itself if there is none."""
    content = F.from_json(
        F.get_json_object(body, "$.result.content"), "array<struct<type:string,text:string>>"
    )
    first = F.get(F.filter(content, lambda c: (c["type"] == "text") & c["text"].isNotNull()), F.lit(0))["text"]
    good = (F.get_json_object(body, "$.jsonrpc") == "2.0") & F.try_parse_json(first).isNotNull()
    return F.when(good, first).otherwise(body)


def rest_pattern(from_method: Column, from_path: Column, to_method: Column, to_path: Column, delay: Column) -> Column:
    """Pattern of two REST calls in a row, by the mean delay in ms of such pairs."""
    from quern.functions.paths import is_param, resource_base, segments

    a, b = resource_base(from_path), resource_base(to_path)
    parts = segments(to_path)
    to_item = F.coalesce(is_param(F.get(parts, F.size(parts) - 1)), F.lit(False))
    written = from_method.isin("POST", "PUT", "PATCH") & (to_method == "GET")
    child = F.startswith(to_path, F.concat(from_path, F.lit("/"))) | F.startswith(to_path, F.concat(a, F.lit("/{")))
    return (
        F.when(written & ~to_item & ((from_path == to_path) | (a == to_path)), F.lit("list_after_create"))
        .when(written & ((a == b) | (from_path == b)) & (delay <= 2000), F.lit("verification_loop"))
        .when((from_method == "POST") & (to_method == "POST") & child, F.lit("create_chain"))
        .otherwise(F.lit("unknown"))
    )


def rpc_pattern(a: Column, b: Column) -> Column:
    """Pattern of two JSON-RPC operation keys, the second up to four calls after the first."""
    write, read = rf"(?i)^({CHANGE_VERBS})[-_]", rf"(?i)^({READ_VERBS})[-_]"
    tool_a, tool_b = (F.get(F.split(x, ":"), F.lit(1)) for x in (a, b))
    calls = a.startswith("tools/call:") & b.startswith("tools/call:")
    same = F.regexp_replace(tool_a, write, "") == F.regexp_replace(tool_b, read, "")
    return (
        F.when((a == b) & a.startswith("tools/call:"), F.lit("retry"))
        .when((a == "tools/list") & (b == "tools/list"), F.lit("redundant_list"))
        .when(calls & tool_a.rlike(write) & tool_b.rlike(read) & same, F.lit("verification_loop"))
        .otherwise(F.lit("unknown"))
    )
