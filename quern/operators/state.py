"""What a snapshot of a session needs, as rows that add up: states of parts of a session merge into its state.

A state has one row per session, endpoint and thing seen; what a row means depends on its kind:

==============  =================  ============  ===============================================
kind            key                value         measures
==============  =================  ============  ===============================================
``sample``                                       n, since and until (times of capture)
``shape``                          shape         n
``path_param``  name               value         n
``query_param`` name               value         n
``header``      lower-case name                  example, the one of the least ``first``
``fact``        JSON path          type          n, with_format, lo, hi, first
``value``       JSON path          string        n; at most TRACKED_VALUES of them to a path
==============  =================  ============  ===============================================

``side`` tells request from response for headers, facts and values; ``status_code`` stands with samples
and with facts and values of responses. A state grows with what an API looks like and with distinct
parameters, not with the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.paths import path_params
from quern.operators import facts
from quern.operators.aggregate import ENDPOINT

_KEYS = {"kind": "string", "side": "string", "status_code": "int", "key": "string", "value": "string"}
_MEASURES = {
    "n": "bigint",
    "with_format": "bigint",
    "lo": "string",
    "hi": "string",
    "first": "struct<id:bigint,ord:int>",
    "example": "struct<name:string,example:string>",
    "since": "timestamp",
    "until": "timestamp",
}
#: Columns of a stored state.
STATE = ", ".join(
    f"{name} {kind}"
    for name, kind in ({"session_id": "string"} | dict.fromkeys(ENDPOINT, "string") | _KEYS | _MEASURES).items()
)


def _row(**given) -> Column:
    return F.struct(*(F.lit(given.get(c)).cast(kind).alias(c) for c, kind in (_KEYS | _MEASURES).items()))


def _none() -> Column:
    fields = ",".join(f"{c}:{kind}" for c, kind in (_KEYS | _MEASURES).items())
    return F.array().cast(f"array<struct<{fields}>>")


def _each(items: Column, row) -> Column:
    return F.coalesce(F.transform(items, row), _none())


def _side(side: str, status: Column | None, sample: Column) -> list[Column]:
    """Arrays of rows for the headers, facts and values of one side."""

    def header(h, at):
        return _row(kind="header", side=side, key=F.lower(h["name"]), n=1, first=F.struct(sample, at), example=h)

    def fact(f):
        counts = {c: f[c] for c in ("n", "with_format", "lo", "hi")}
        first = F.struct(sample, f["ord"])
        return _row(kind="fact", side=side, status_code=status, key=f["path"], value=f["type"], first=first, **counts)

    def values(f):
        return F.transform(f["values"], lambda v: _row(kind="value", side=side, status_code=status, key=f["path"], value=v, n=1))

    found = F.col(f"{side}_facts")
    tracked = F.flatten(F.transform(F.filter(found, lambda f: F.size(f["values"]) > 0), values))
    return [_each(F.col(f"{side}_headers"), header), _each(found, fact), F.coalesce(tracked, _none())]


def state_of(samples: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The state of samples that carry facts, by session and the columns ``within``; one scan and no Python.

    Null statuses count as 0 and methods are upper-cased. A sample without facts, headers or parameters
    adds what it has. No samples give no rows.
    """
    status, sample = F.coalesce("status_code", F.lit(0)), F.col("id").cast("long")
    rows = [
        F.array(
            _row(kind="sample", status_code=status, n=1, since=F.col("captured_at"), until=F.col("captured_at")),
            _row(kind="shape", value=F.col("response_shape"), n=1),
        ),
        _each(
            path_params(F.col("path"), F.col("normalized_path")),
            lambda p: _row(kind="path_param", key=p["name"], value=p["value"], n=1),
        ),
        _each(F.map_entries("query_params"), lambda p: _row(kind="query_param", key=p["key"], value=p["value"], n=1)),
    ]
    rows += _side("request", None, sample) + _side("response", status, sample)
    own = samples.select("session_id", F.upper("http_method").alias("http_method"), "normalized_path", *within, F.inline(F.concat(*rows)))
    return merge_states(own, within)


def merge_states(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Rows of states added up. The order in which states are merged does not matter."""
    thing = ["session_id", *within, *ENDPOINT, *(c for c in _KEYS if c != "value")]
    summed = rows.groupBy(*thing, "value").agg(
        F.sum("n").alias("n"),
        F.sum("with_format").alias("with_format"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("first").alias("first"),
        F.min_by("example", "first").alias("example"),
        F.min("since").alias("since"),
        F.max("until").alias("until"),
    )
    # rows of other kinds stand alone; each task passes on no more values of a path than are tracked
    alone = F.when(F.col("kind") != "value", F.col("value"))
    place = F.row_number().over(Window.partitionBy(*thing, alone).orderBy("value"))
    return summed.withColumn("place", place).where(F.col("place") <= facts.TRACKED_VALUES).drop("place")


def union_states(*states: DataFrame) -> DataFrame:
    """Several states as one."""
    return merge_states(reduce(DataFrame.unionByName, states))


def samples_in(state: DataFrame) -> int:
    """How many samples a state covers."""
    return state.where("kind = 'sample'").agg(F.sum("n")).first()[0] or 0


def _of(state: DataFrame, kind: str, side: str | None = None) -> DataFrame:
    rows = state.where(F.col("kind") == kind)
    return rows if side is None else rows.where(F.col("side") == side)


def _schemas(state: DataFrame, side: str, group: list[str], patch: bool) -> tuple[DataFrame, DataFrame]:
    """(group, schema) and (group, path statistics) of the bodies of one side."""
    named = [*group, F.col("key").alias("path")]
    found = _of(state, "fact", side).select(*named, F.col("value").alias("type"), "n", "with_format", "lo", "hi", "first")
    values = _of(state, "value", side).select(*named, F.array("value").alias("values"))
    totals = _of(state, "sample").groupBy(*group).agg(F.sum("n").alias("total"))
    if patch:
        totals = totals.withColumn("is_patch", F.col("http_method") == "PATCH")
    stats = facts.field_stats(facts.merge_facts(found, group), totals, group, "is_patch" if patch else None)
    return facts.assemble(stats, facts.enums(values, totals, group), group), stats


def _by_name(state: DataFrame, kind: str, key: list[str], name: str) -> DataFrame:
    values = _of(state, kind).groupBy(*key, "key").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias(name))


def _headers(state: DataFrame, side: str, key: list[str]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("key", "example")))
    return _of(state, "header", side).groupBy(*key).agg(F.transform(listed, lambda x: x["example"]).alias(f"{side}_headers"))


def endpoints_of(state: DataFrame) -> DataFrame:
    """One row per (session, method, template) of a state: merged schemas and all that documents need.

    Several branches read the state, so give one that is written.
    """
    key = ["session_id", *ENDPOINT]
    per_status, stats = _schemas(state, "response", [*key, "status_code"], False)
    requests, _ = _schemas(state, "request", key, True)
    base = _of(state, "sample").groupBy(*key).agg(
        F.sum("n").alias("sample_count"), F.min("since").alias("first_observed"), F.max("until").alias("last_observed")
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("status_code").cast("string"), "schema")))
    responses = per_status.groupBy(*key).agg(
        F.map_from_entries(listed).alias("response_schemas"),
        F.min_by("schema", "status_code").alias("primary_schema"),
        F.min("status_code").alias("primary_status"),
    )
    top = facts.top_confidence(stats, [*key, "status_code"]).withColumnRenamed("status_code", "primary_status")
    shapes = _of(state, "shape").groupBy(*key).agg(F.count("*").alias("unique_response_shapes"))
    out = base.join(responses, key, "left").join(top, [*key, "primary_status"], "left")
    for part in (
        requests.withColumnRenamed("schema", "request_schema"),
        shapes,
        _by_name(state, "path_param", key, "path_param_values"),
        _by_name(state, "query_param", key, "query_params"),
        _headers(state, "request", key),
        _headers(state, "response", key),
    ):
        out = out.join(part, key, "left")
    score = facts.confidence(F.col("sample_count"), F.col("required"), F.col("fields"), F.col("stable"))
    any_schema = F.col("primary_schema").isNotNull()
    return out.withColumn("confidence_score", F.when(any_schema, score).otherwise(F.lit(0.0))).drop(
        "fields", "required", "stable", "primary_status"
    )
