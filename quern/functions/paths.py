"""URL paths and queries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that never count as dynamic.
LITERAL_SEGMENTS = [
    "api", "v1", "v2", "v3", "v4", "v5", "admin", "public", "private", "internal", "external",
    "health", "status", "metrics", "docs", "swagger", "openapi", "graphql", "rest", "rpc", "ws", "wss",
]
#: Plurals whose singular the rules below would get wrong.
IRREGULAR = {"branches": "branch", "releases": "release", "responses": "response"}

UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DIGITS = r"^[0-9]+\z"
CODE = r"^[a-zA-Z0-9](?:[a-zA-Z0-9_-]*[a-zA-Z0-9])?\z"


def path_only(url: Column) -> Column:
    """The url without its query."""
    return F.substring_index(url, "?", 1)


def segments(path: Column) -> Column:
    """Non-empty segments of a path (its query ignored)."""
    return F.filter(F.split(path_only(path), "/"), lambda s: s != "")


def singular(word: Column) -> Column:
    """A resource name's singular, lower-cased."""
    w = F.lower(word)
    out = F.regexp_replace(F.regexp_replace(w, r"(?<=.)ies\z", "y"), r"(?<=.s)es\z|(?<=..)s\z", "")
    for plural, one in IRREGULAR.items():
        out = F.when(w == plural, F.lit(one)).otherwise(out)
    return out


def is_param(segment: Column) -> Column:
    """The segment is a template parameter."""
    return segment.startswith("{") & segment.endswith("}")


def classify_segment(segment: Column, context: Column, after_dynamic: Column) -> Column:
    """The parameter that stands for a dynamic segment, or null for a literal one.

    ``context`` is the nearest literal segment before it (null: none); a number right after another
    dynamic segment is a bare id.
    """

    def named(suffix: str) -> Column:
        return F.when(context.isNull(), F.lit("{" + suffix.lower() + "}")).otherwise(
            F.concat(F.lit("{"), singular(context), F.lit(suffix + "}"))
        )

    digit = segment.rlike("[0-9]")
    literal = F.lower(segment).isin(LITERAL_SEGMENTS) | segment.rlike(r"^[a-zA-Z]+\z")
    return (
        F.when(is_param(segment), segment)
        .when(literal, F.lit(None).cast("string"))
        .when(segment.rlike(UUID), named("Id"))
        .when(segment.rlike(MOMENT), named("Timestamp"))
        .when(segment.rlike(DAY), named("Date"))
        .when(segment.rlike(DIGITS), F.when(after_dynamic, F.lit("{id}")).otherwise(named("Id")))
        .when(segment.rlike(CODE) & digit, named("Code"))
        .when(segment.rlike("[-_]") & digit, named("Id"))
    )


def normalize_path(path: Column) -> Column:
    """A path's template: dynamic segments named after the literal before them; ``/`` if there is none."""
    start = F.struct(
        F.array().cast("array<string>").alias("out"),
        F.lit(None).cast("string").alias("context"),
        F.lit(False).alias("dynamic"),
    )

    def step(acc: Column, segment: Column) -> Column:
        # the classification is computed once, in a one-element array
        param = F.array(classify_segment(segment, acc["context"], acc["dynamic"]))
        made = F.transform(
            param,
            lambda p: F.struct(
                F.concat(acc["out"], F.array(F.coalesce(p, segment))).alias("out"),
                F.when(p.isNull() & ~segment.startswith("{"), segment).otherwise(acc["context"]).alias("context"),
                p.isNotNull().alias("dynamic"),
            ),
        )
        return F.get(made, F.lit(0))

    joined = F.aggregate(segments(path), start, step, lambda acc: F.array_join(acc["out"], "/"))
    return F.concat(F.lit("/"), joined)


def query_params(url: Column) -> Column:
    """map<string,string> of a url's decoded query (the last of equal names wins); null without one."""
    text = F.regexp_extract(url, r"\?(.*)", 1)
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    # later pairs first, so that the first of a name is the last in the url
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("key"),
            decode(F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "=(.*)", 1)).otherwise(F.lit(""))).alias("value"),
        ),
    )
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: ~F.exists(
            F.slice(entries, x["i"] + 2, F.size(entries)), lambda later: later["key"] == x["e"]["key"]
        ),
    )
    made = F.map_from_entries(F.transform(last, lambda x: x["e"]))
    return F.when(F.size(pairs) > 0, made)


def path_params(path: Column, template: Column) -> Column:
    """array<struct<name,value>> of a template's parameters in a raw path of as many segments."""
    raw, named = segments(path), segments(template)
    zipped = F.zip_with(raw, named, lambda v, n: F.struct(n.alias("name"), v.alias("value")))
    found = F.filter(zipped, lambda z: is_param(z["name"]))
    cleaned = F.transform(
        found, lambda z: F.struct(F.regexp_replace(z["name"], r"^\{|\}\z", "").alias("name"), z["value"].alias("value"))
    )
    return F.when(F.size(raw) == F.size(named), cleaned).otherwise(F.array().cast(
        "array<struct<name:string,value:string>>"
    ))


def resource_base(template: Column) -> Column:
    """A template without its last segment if that is a parameter."""
    parts = segments(template)
    last = F.get(parts, F.size(parts) - 1)
    parent = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when(F.size(parts) == 0, F.lit("/")).when(is_param(last), parent).otherwise(template)


def _capital(word: Column) -> Column:
    """The word with an upper-case initial."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def pascal_segments(template: Column) -> Column:
    """Segments without braces, each with an upper-case initial, joined."""
    bare = F.transform(segments(template), lambda s: F.regexp_replace(s, r"^\{|\}\z", ""))
    return F.array_join(F.transform(bare, _capital), "")


def operation_id(method: Column, template: Column) -> Column:
    """camelCase id of an operation."""
    return F.concat(F.lower(method), pascal_segments(template))


def schema_name(method: Column, template: Column, role: Column, status: Column) -> Column:
    """PascalCase name of a body's schema; role is request or response, a status of 200 is left out."""
    word = _capital(F.lower(method))
    end = F.when((role == "response") & status.isNotNull() & (status != "200"), status).otherwise(F.lit(""))
    return F.concat(word, pascal_segments(template), F.initcap(role), end)


def model_name(template: Column) -> Column:
    """A domain model's name: the last literal segment, singular, with an upper-case initial."""
    literal = F.filter(segments(template), lambda s: ~s.startswith("{"))
    last = _capital(F.get(literal, F.size(literal) - 1))
    one = F.regexp_replace(F.regexp_replace(last, r"ies\z", "y"), r"(?<=[sxz])es\z|(?<!s)s\z", "")
    return F.coalesce(one, F.lit("Model"))
