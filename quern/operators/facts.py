"""JSON bodies as path facts, and schemas merged from them by ordinary aggregation.

A body becomes one fact per path and type of its JSON nodes: how many there are, their format, where
the first one stands and the distinct short plain strings among them. Facts add up, first within a task's
Arrow batch, then by a group-by on (group, path, type); nothing depends on the order of bodies but
the order of properties. Samples are stored with such facts, never with their bodies.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import FORMATS

#: Strings longer than this (UTF-16 units) are never enumerated.
TRACKED_LENGTH = 100
#: A path with more distinct values than an enumeration may have needs no more of them.
TRACKED_VALUES = 11
INT32 = (-(2**31), 2**31 - 1)
_CHECKS = [(name, re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII if name != "email" else 0)) for name, pattern in FORMATS]
_SPECIAL = re.compile(r"([.\[\\])")
#: Columns that all facts have.
_COUNTS = "path string, type string, n bigint, with_format bigint, lo string, hi string"
_KINDS = {type(None): "null", bool: "boolean", int: "integer", str: "string", dict: "object", list: "array"}
#: The facts of one body, as stored with its sample.
BODY_FACTS = (
    "array<struct<path:string,type:string,n:bigint,with_format:bigint,lo:string,hi:string,ord:int,values:array<string>>>"
)


@lru_cache(maxsize=1 << 16)
def segment(key: str) -> str:
    """A property as a path segment; dots, brackets and backslashes are escaped."""
    return "." + _SPECIAL.sub(r"\\\1", key)


def parse(body: str | None):
    """(True, value) of valid JSON, else (False, None). NaN and infinities are not JSON."""

    def reject(_):
        raise ValueError

    if not body:
        return False, None
    try:
        return True, json.loads(body, parse_constant=reject)
    except (ValueError, RecursionError):
        return False, None


def kind_of(value) -> str:
    """Type of a JSON value; a number without a fraction is an integer."""
    return _KINDS.get(type(value)) or ("integer" if value.is_integer() else "number")


def _string(value: str) -> tuple[str, str | None, str | None]:
    found = next((name for name, check in _CHECKS if check.search(value)), None)
    short = len(value.encode("utf-16-le", "surrogatepass")) <= 2 * TRACKED_LENGTH
    return "string", found, value if found is None and short else None


_short_string = lru_cache(maxsize=1 << 16)(_string)


def scalar(value) -> tuple[str, str | None, str | None]:
    """Type, format and tracked value of a JSON leaf (or the type alone of an object or array)."""
    kind = kind_of(value)
    if kind == "string":
        return (_short_string if len(value) <= TRACKED_LENGTH else _string)(value)
    if kind == "integer":
        return kind, "int32" if INT32[0] <= value <= INT32[1] else "int64", None
    return kind, "double" if kind == "number" else None, None


def nodes(value):
    """(path, type, format, tracked value) of every node of a JSON value, parents before children."""
    todo = [("", value)]
    while todo:
        path, x = todo.pop()
        yield path, *scalar(x)
        if isinstance(x, dict):
            todo += [(path + segment(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(path + "[]", v) for v in reversed(x)]


def tally(found: dict, value, at=0) -> None:
    """Adds a JSON value's nodes to ``found``: (path, type) to [n, with_format, lo, hi, (at, ord), values].

    Values are added by rising ``at``.
    """
    for k, (path, kind, fmt, text) in enumerate(nodes(value)):
        row = found.get((path, kind))
        if row is None:
            row = found[path, kind] = [0, 0, fmt, fmt, (at, k), {}]
        row[0] += 1
        if row[4][0] == at and k < row[4][1]:
            row[4] = (at, k)
        if fmt is not None:
            row[1] += 1
            row[2] = fmt if row[2] is None else min(row[2], fmt)
            row[3] = fmt if row[3] is None else max(row[3], fmt)
        if text is not None and len(row[5]) < TRACKED_VALUES:
            row[5][text] = None


def infer_facts(bodies: DataFrame, body: str = "body", ordinal: str = "id") -> DataFrame:
    """Facts of JSON bodies by the frame's other columns, added up within each Arrow batch.

    Beside those columns (all but ``ordinal``, of plain types): path, type, n, with_format, lo, hi, first
    (the least ordinal, nulls before others, and the node's place in that body) and at most
    TRACKED_VALUES values. Empty and invalid bodies give no rows. Columns named like one of these come
    together in the struct ``keys``.
    """
    keep = [c for c in bodies.columns if c not in (body, ordinal)]
    clash = [c for c in keep if c in ("path", "type", "n", "with_format", "lo", "hi", "first", "values")]
    if clash:
        bodies = bodies.select(*(c for c in bodies.columns if c not in clash), F.struct(*clash).alias("keys"))
        keep = [*(c for c in keep if c not in clash), "keys"]

    def run(batches):
        for batch in batches:
            ids = batch.column(len(keep)).to_pylist()
            lists = [[str(x) if isinstance(x, dict) else x for x in batch.column(i).to_pylist()] for i in range(len(keep))]
            keys = list(zip(*lists, strict=True)) or [()] * len(ids)
            texts = batch.column(len(keep) + 1).to_pylist()
            groups: dict[tuple, tuple[int, dict]] = {}
            by_ordinal: list[int] = []  # a row of each ordinal, in order
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])):
                if not by_ordinal or ids[i] != ids[by_ordinal[-1]]:
                    by_ordinal.append(i)
                good, value = parse(texts[i])
                if good:
                    tally(groups.setdefault(keys[i], (i, {}))[1], value, len(by_ordinal) - 1)
            at, rows, firsts, places = [], [], [], []
            for i, found in groups.values():
                for (path, kind), (n, with_format, lo, hi, first, values) in found.items():
                    at.append(i)
                    firsts.append(by_ordinal[first[0]])
                    places.append(first[1])
                    rows.append((path, kind, n, with_format, lo, hi, list(values)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            *cols, values = (pa.array(c, t) for c, t in zip(cols, kinds, strict=True))
            first = pa.StructArray.from_arrays(
                [batch.column(len(keep)).take(pa.array(firsts, pa.int64())), pa.array(places, pa.int32())], names=[ordinal, "ord"]
            )
            kept = batch.select(keep).take(pa.array(at, pa.int64()))
            names = [*keep, "path", "type", "n", "with_format", "lo", "hi", "first", "values"]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols, first, values], names=names)

    kind = {c: bodies.schema[c].dataType.simpleString() for c in [*keep, ordinal]}
    schema = [*(f"`{c}` {kind[c]}" for c in keep), _COUNTS, f"first struct<`{ordinal}`:{kind[ordinal]},ord:int>", "values array<string>"]
    return bodies.select(*keep, ordinal, body).mapInArrow(run, ", ".join(schema))


def _read_body(text: str | None) -> dict:
    good, value = parse(text)
    found: dict = {}
    if good:
        tally(found, value)
    names = ("path", "type", "n", "with_format", "lo", "hi")
    rows = [
        dict(zip(names, (path, kind, *row[:4]), strict=True)) | {"ord": row[4][1], "values": list(row[5])}
        for (path, kind), row in found.items()
    ]
    return {"shape": fingerprint(value) if good else EMPTY, "facts": rows}


def without_bodies(samples: DataFrame) -> DataFrame:
    """Samples with request_facts, request_shape, response_facts and response_shape instead of bodies.

    This is the form in which samples are stored: each body is read once, and no body is kept. A body
    that is missing, empty or invalid has no facts and the shape ``<empty>``. Samples that have no
    body columns come back as they are.
    """
    kind = pa.list_(
        pa.struct(
            [("path", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("with_format", pa.int64()), ("lo", pa.string())]
            + [("hi", pa.string()), ("ord", pa.int32()), ("values", pa.list_(pa.string()))]
        )
    )
    whole = pa.struct([("shape", pa.string()), ("facts", kind)])

    @F.arrow_udf(f"struct<shape:string,facts:{BODY_FACTS}>")
    def read(bodies: pa.Array) -> pa.Array:
        return pa.array([_read_body(text) for text in bodies.to_pylist()], whole)

    out = samples
    for side in ("request", "response"):
        if f"{side}_body" in samples.columns:
            out = out.withColumn(f"{side}_body", read(F.col(f"{side}_body")))
            out = out.withColumns({f"{side}_{part}": F.col(f"{side}_body.{part}") for part in ("shape", "facts")})
    return out.drop("request_body", "response_body")


def stored_facts(samples: DataFrame, side: str, group: list[str], ordinal: str = "id") -> DataFrame:
    """The facts that samples carry for one side (request or response), in the form of ``infer_facts``."""
    each = samples.select(*group, F.col(ordinal).alias("sample"), F.inline(f"{side}_facts"))
    counts = ("path", "type", "n", "with_format", "lo", "hi")
    return each.select(*group, *counts, F.struct(F.col("sample").alias(ordinal), "ord").alias("first"), "values")


def merge_facts(facts: DataFrame, group: list[str]) -> DataFrame:
    """One row per (group, path, type): n nodes, surviving format, and first place seen.

    Integers widen to numbers, and lose their format, where a number stands at the same path. A
    format survives if all nodes agree on it.
    """
    by_type = facts.groupBy(*group, "path", "type").agg(
        F.sum("n").alias("n"),
        F.sum("with_format").alias("with_format"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("first").alias("first"),
    )
    # at most seven types to a path
    one = by_type.groupBy(*group, "path").agg(
        F.max((F.col("type") == "number").cast("int")).alias("wide"),
        F.collect_list(F.struct("type", "n", "with_format", "lo", "hi", "first")).alias("types"),
    )
    each = one.select(*group, "path", "wide", F.explode("types").alias("t")).select(
        *group,
        "path",
        F.when((F.col("wide") == 1) & (F.col("t.type") == "integer"), F.lit("number"))
        .otherwise(F.col("t.type"))
        .alias("type"),
        "t.n",
        "t.with_format",
        "t.lo",
        "t.hi",
        "t.first",
    )
    merged = each.groupBy(*group, "path", "type").agg(
        F.sum("n").alias("n"),
        F.sum("with_format").alias("with_format"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("first").alias("first"),
    )
    whole = (F.col("with_format") == F.col("n")) & (F.col("lo") == F.col("hi"))
    return merged.select(*group, "path", "type", "n", F.when(whole, F.col("lo")).alias("format"), "first")


#: The last property or item of a path, and what an object inside array fields takes its total from.
_LAST = r"(?:\.(?:[^.\[\\]|\\.)*|\[\])\z"
_ITEMS = r"(?:\.(?:[^.\[\\]|\\.)*\[\])+\z"


def field_stats(merged: DataFrame, totals: DataFrame, group: list[str], patch: str | None = None) -> DataFrame:
    """Per (group, path): types, variants, presence, sample_count, confidence, required and stable.

    ``totals`` has the bodies or samples of each group (column ``total``). A property's sample_count
    is the group's total below a root object and the parent's count below other plain objects; below
    a union or an array's items it is the property's own count. Required means present as often as
    the enclosing object, where items of an array field take the object that encloses the array;
    never below a union or a root array, nor where the boolean column ``patch`` holds.

    A group's paths are looked at together (a schema's size, not the bodies'), so bodies are read once.
    """
    paths = merged.groupBy(*group, "path").agg(
        F.sum("n").alias("presence"),
        F.array_sort(F.collect_list("type")).alias("types"),
        F.array_sort(F.collect_list(F.struct("first", "type", "n", "format"))).alias("variants"),
    )
    whole = paths.groupBy(*group).agg(F.collect_list(F.struct("path", "presence", "types", "variants")).alias("all"))
    whole = whole.join(totals, group).withColumns(
        {
            "counts": F.map_from_entries(F.transform("all", lambda x: F.struct(x["path"], x["presence"]))),
            "unions": F.transform(F.filter("all", lambda x: F.size(x["types"]) > 1), lambda x: x["path"]),
        }
    )
    keep = [*group, "total", "counts", "unions", *([patch] if patch else [])]
    one = whole.select(*keep, F.inline("all"))
    parent = F.regexp_replace("path", _LAST, "")
    one = one.withColumns(
        {
            "parent": parent,
            "is_property": F.col("path").rlike(r"\.(?:[^.\[\\]|\\.)*\z"),
            # a union at a proper ancestor
            "below": F.exists(
                "unions",
                lambda u: F.startswith(F.col("path"), F.concat(u, F.lit("."))) | F.startswith(F.col("path"), F.concat(u, F.lit("["))),
            ),
        }
    )
    base = F.regexp_replace("parent", _ITEMS, "")
    under_items = F.col("parent").contains("[]") | F.col("below")
    sample_count = (
        F.when((F.col("parent") == "") & F.col("is_property") & ~F.col("below"), F.col("total"))
        .when(F.col("is_property") & ~under_items, F.element_at("counts", F.col("parent")))
        .otherwise(F.col("presence"))
    )
    enclosing = F.when(base == "", F.col("total")).otherwise(F.element_at("counts", base))
    may = (
        F.col("is_property")
        & ~F.col("below")
        & ~F.startswith("path", F.lit("[]"))
        & ~F.col("parent").contains("[][]")
    )
    if patch:
        may = may & ~F.col(patch)
    return one.select(
        *group,
        "path",
        "types",
        "variants",
        "presence",
        sample_count.alias("sample_count"),
        (F.col("presence") / sample_count).alias("confidence"),
        (may & F.coalesce(F.col("presence") == enclosing, F.lit(False))).alias("required"),
        (F.size("types") == 1).alias("stable"),
    )


def enums(facts: DataFrame, totals: DataFrame, group: list[str], least: int = 10, most: int = 10) -> DataFrame:
    """Sorted distinct tracked values of string paths that have few: at least ``least`` bodies, at most ``most`` values.

    Facts with TRACKED_VALUES values may have lost others, so ``most`` must be less.
    """
    if most >= TRACKED_VALUES:
        raise ValueError(f"an enumeration has fewer than {TRACKED_VALUES} values")
    values = facts.select(*group, "path", F.explode("values").alias("value")).distinct()
    # one more than may be: each task passes on no more of a path
    k = F.row_number().over(Window.partitionBy(*group, "path").orderBy("value"))
    first = values.withColumn("k", k).where(F.col("k") <= most + 1)
    kept = first.groupBy(*group, "path").agg(F.array_sort(F.collect_list("value")).alias("enum")).where(F.size("enum") <= most)
    return kept.join(totals.where(F.col("total") >= least).select(*group), group, "left_semi")


def top_confidence(stats: DataFrame, group: list[str]) -> DataFrame:
    """required, total and stable counts of the properties of each group's root object."""
    top = stats.where(F.col("path").rlike(r"^\.(?:[^.\[\\]|\\.)*\z"))
    return top.groupBy(*group).agg(
        F.count("*").alias("fields"),
        F.sum(F.col("required").cast("int")).alias("required"),
        F.sum(F.col("stable").cast("int")).alias("stable"),
    )


def confidence(n, required, fields, stable):
    """0.4 log-scaled sample size (100 samples: 1) + 0.4 share of required + 0.2 share of stable fields."""
    size = F.least(F.greatest(F.ln(n) / F.ln(F.lit(100.0)), F.lit(0.0)), F.lit(1.0))
    share = lambda x: F.when(F.coalesce(fields, F.lit(0)) == 0, F.lit(1.0)).otherwise(x / fields)
    return size * 0.4 + share(required) * 0.4 + share(stable) * 0.2


def assemble(stats: DataFrame, enum: DataFrame, group: list[str]) -> DataFrame:
    """(group, schema): the nested schema of each group as JSON, from its reduced rows.

    A node has type, format, enum, properties, required, items, oneOf and stats, where they apply.
    """
    each = stats.select(*group, "path", "required", "sample_count", F.inline("variants"))
    rows = each.withColumnRenamed("first", "seen").join(enum, [*group, "path"], "left")
    rows = rows.withColumn("enum", F.to_json("enum"))
    packed = F.to_json(F.array_sort(F.collect_list(F.struct("seen", "path", "type", "n", "format", "required", "sample_count", "enum"))))
    reduced = rows.groupBy(*group).agg(packed.alias("rows"))

    build = F.pandas_udf(_nest_column, "string")
    return reduced.select(*group, build("rows").alias("schema"))


def _nest_column(column: pd.Series) -> pd.Series:
    return column.map(lambda text: json.dumps(nest(json.loads(text))))


_TOKEN = re.compile(r"\.(?:[^.\[\\]|\\.)*|\[\]")


def nest(rows: list[dict]) -> dict:
    """Flat (path, type) rows as one nested schema."""
    at: dict[str, list[dict]] = {}
    for r in rows:
        at.setdefault(r["path"], []).append(r)
    children: dict[str, list[str]] = {}
    for path in at:
        if path:
            last = _TOKEN.findall(path)[-1]
            children.setdefault(path[: -len(last)], []).append(last)

    def node(path: str) -> dict:
        variants = []
        for r in at[path]:
            out: dict = {"type": r["type"]}
            if r.get("format"):
                out["format"] = r["format"]
            if r["type"] == "string" and r.get("enum"):
                out["enum"] = json.loads(r["enum"])
            count = r["n"] if len(at[path]) > 1 else r["sample_count"]
            out["stats"] = {"sampleCount": count, "presenceCount": r["n"], "confidence": r["n"] / count if count else 0}
            inside = children.get(path, [])
            if r["type"] == "object":
                names = [s for s in inside if s != "[]"]
                out["properties"] = {re.sub(r"\\(.)", r"\1", s[1:]): node(path + s) for s in names}
                out["required"] = sorted(re.sub(r"\\(.)", r"\1", s[1:]) for s in names if at[path + s][0]["required"])
            elif r["type"] == "array" and "[]" in inside:
                out["items"] = node(path + "[]")
            variants.append(out)
        if len(variants) == 1:
            return variants[0]
        total = sum(v["stats"]["presenceCount"] for v in variants)
        return {
            "type": variants[0]["type"],
            "oneOf": variants,
            "stats": {"sampleCount": total, "presenceCount": total, "confidence": 1},
        }

    return node("") if "" in at else {}


#: The shape of a missing, empty or invalid body.
EMPTY = "<empty>"


def fingerprint(*values) -> str:
    """The shape of the values at one path: sorted keys and types, ignoring values; array items merge."""
    kinds = {kind_of(x) for x in values}
    if "number" in kinds:
        kinds.discard("integer")
    parts = []
    for kind in kinds:
        if kind == "object":
            at: dict[str, list] = {}
            for x in values:
                if isinstance(x, dict):
                    for k, v in x.items():
                        at.setdefault(k, []).append(v)
            parts.append("{" + ",".join(f"{k}:{fingerprint(*at[k])}" for k in sorted(at, key=segment)) + "}")
        elif kind == "array":
            items = [v for x in values if isinstance(x, list) for v in x]
            parts.append(f"[{fingerprint(*items)}]" if items else "array")
        else:
            parts.append(kind)
    return parts[0] if len(parts) == 1 else f"oneOf({'|'.join(sorted(parts))})"


def _shape(text: str | None) -> str:
    good, value = parse(text)
    return fingerprint(value) if good else EMPTY


def _shape_column(body: pd.Series) -> pd.Series:
    return body.map(_shape)


def fingerprint_of(body: Column) -> Column:
    """Fingerprints of JSON bodies; ``<empty>`` for none or an invalid one."""
    return F.pandas_udf(_shape_column, "string")(body)
