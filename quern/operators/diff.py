"""Differences between two versions of a schema, and between the endpoints of two runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = "array<struct<breaking:boolean,kind:string,path:string,detail:string>>"


def compatible(old: str, new: str) -> bool:
    """A type may stay or widen from integer to number."""
    return old == new or (old, new) == ("integer", "number")


def schema_changes(old: dict, new: dict, path: str = "$") -> list[dict]:
    """Changes from one schema to another, outside in; formats and enumerations are not compared."""

    def change(breaking: bool, kind: str, where: str, detail: str) -> dict:
        return {"breaking": breaking, "kind": kind, "path": where, "detail": detail}

    was, now = old.get("oneOf"), new.get("oneOf")
    a, b = old["type"], new["type"]
    if was and now:
        return []
    if was:
        return [change(True, "incompatible_type_change", path, f"union narrowed to {b}")]
    if now:
        if any(compatible(a, v["type"]) for v in now):
            return [change(False, "type_expanded", path, f"{a} expanded to a union")]
        return [change(True, "incompatible_type_change", path, f"{a} is not in the new union")]
    out = []
    if a != b:
        if not compatible(a, b):
            nested = {a, b} <= {"object", "array"}
            return [change(True, "schema_type_changed" if nested else "incompatible_type_change", path, f"{a} to {b}")]
        out.append(change(False, "type_widened", path, f"{a} to {b}"))
    if a == b == "array":
        if "items" in old and "items" in new:
            out += schema_changes(old["items"], new["items"], f"{path}[]")
    elif a == b == "object":
        before, after = old.get("properties", {}), new.get("properties", {})
        must, must_now = set(old.get("required", [])), set(new.get("required", []))
        kinds = [
            (True, "required_field_removed", sorted(must - after.keys())),
            (True, "required_field_added", sorted(must_now - before.keys())),
            (True, "field_became_required", sorted(f for f in must_now - must if f in before)),
            (False, "field_became_optional", sorted(f for f in must - must_now if f in after)),
            (False, "optional_field_added", [f for f in after if f not in before and f not in must_now]),
            (False, "optional_field_removed", [f for f in before if f not in after and f not in must]),
        ]
        out += [change(hard, kind, f"{path}.{f}", f) for hard, kind, names in kinds for f in names]
        for f in before:
            if f in after:
                out += schema_changes(before[f], after[f], f"{path}.{f}")
    return out


def _changes_column(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(
        [schema_changes(json.loads(a), json.loads(b)) if a and b else None for a, b in zip(old, new, strict=True)]
    )


def changes_of(old: Column, new: Column) -> Column:
    """Changes between two columns of schemas as JSON; null where either is missing."""
    return F.pandas_udf(_changes_column, CHANGES)(old, new)


def diff_endpoints(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """NEW, REMOVED and COMMON endpoints of two runs."""
    a = old.select(*keys).distinct().withColumn("in_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("in_new", F.lit(True))
    state = F.when(F.col("in_old").isNull(), "NEW").when(F.col("in_new").isNull(), "REMOVED").otherwise("COMMON")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def diff_fields(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of fields between two runs, as rows: keys, path, kind and breaking.

    ``old`` and ``new``: keys, path, type (null for a union) and required. Fields are compared on
    their own, so this fits flat objects; nested schemas take ``changes_of``.
    """
    a = old.select(*keys, "path", F.col("type").alias("a"), F.col("required").alias("ra"), F.lit(True).alias("in_a"))
    b = new.select(*keys, "path", F.col("type").alias("b"), F.col("required").alias("rb"), F.lit(True).alias("in_b"))
    j = a.join(b, [*keys, "path"], "full_outer")
    gone, came = F.col("in_b").isNull(), F.col("in_a").isNull()
    same_kind = F.col("a").eqNullSafe(F.col("b")) | ((F.col("a") == "integer") & (F.col("b") == "number"))
    presence = (
        F.when(gone & F.col("ra"), "required_field_removed")
        .when(gone, "optional_field_removed")
        .when(came & F.col("rb"), "required_field_added")
        .when(came, "optional_field_added")
        .when(F.col("rb") & ~F.col("ra"), "field_became_required")
        .when(F.col("ra") & ~F.col("rb"), "field_became_optional")
    )
    typed = F.when(gone | came, F.lit(None)).when(~F.coalesce(same_kind, F.lit(False)), "incompatible_type_change").when(
        ~F.col("a").eqNullSafe(F.col("b")), "type_widened"
    )
    rows = j.select(*keys, "path", F.explode(F.array_compact(F.array(presence, typed))).alias("kind"))
    hard = ["required_field_removed", "required_field_added", "field_became_required", "incompatible_type_change"]
    return rows.withColumn("breaking", F.col("kind").isin(hard))


_TOKEN = r"(\.(?:[^.\[\\]|\\.)*|\[\])"


def _side(nodes: DataFrame, keys: list[str], s: str) -> DataFrame:
    """One row per (keys, path): the plain type (null for a union), the union's types, and whether it is required."""
    kinds = nodes.groupBy(*keys, "path").agg(F.collect_set("type").alias("types"), F.max("is_union").alias("u"))  # seven types at most
    name = F.regexp_replace("name", r"([.\[\\])", r"\\$1")
    must = nodes.where("type = 'object' and not is_union")
    must = must.select(*keys, "path", F.explode(F.from_json("node", "required array<string>")["required"]).alias("name"))
    must = must.select(*keys, F.concat("path", F.lit("."), name).alias("path"), F.lit(True).alias("r"))
    return kinds.join(must, [*keys, "path"], "left").select(
        *keys,
        "path",
        F.when(~F.col("u"), F.get("types", F.lit(0))).alias(f"type_{s}"),
        F.when(F.col("u"), F.col("types")).alias(f"union_{s}"),
        F.coalesce("r", F.lit(False)).alias(f"must_{s}"),
        F.lit(True).alias(f"in_{s}"),
    )


def nested_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between nested schemas as rows: keys, path, kind, breaking and detail, as ``schema_changes`` finds them.

    ``old`` and ``new`` are nodes of schemas (``models.schema_nodes``). Both are joined on the path. A path
    is open where both sides have the same plain object or array; what is found at a path counts if all
    paths above it are open, so nothing below an incompatible change, a union or a one-sided field is
    reported. Schemas that one side lacks have no changes.
    """
    both = _side(old, keys, "a").join(_side(new, keys, "b"), [*keys, "path"], "full_outer")
    tokens = F.regexp_extract_all("path", F.lit(_TOKEN))
    a, b = F.col("type_a"), F.col("type_b")
    here = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    both = both.withColumns({"depth": F.size(tokens), "open": F.coalesce(here & (a == b) & a.isin("object", "array"), F.lit(False))})
    above = both.select(*keys, "path", tokens.alias("t"), "depth").where("depth > 0")
    above = above.select(*keys, "path", "depth", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("k"), "t")
    above = above.select(*keys, "path", "depth", F.array_join(F.slice("t", 1, F.col("k")), "").alias("over"))
    open_ = both.where("open").select(*keys, F.col("path").alias("over"))
    reached = above.join(open_, [*keys, "over"]).groupBy(*keys, "path").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    reached = reached.where("n = depth").select(*keys, "path", F.lit(True).alias("reached"))
    rows = both.join(reached, [*keys, "path"], "left").where("depth = 0 or reached")

    was, now = F.col("union_a").isNotNull(), F.col("union_b").isNotNull()
    gone, came = F.col("in_b").isNull(), F.col("in_a").isNull()
    is_property = F.col("path").rlike(r"\.(?:[^.\[\\]|\\.)*\z")
    fits = F.array_contains("union_b", a) | ((a == "integer") & F.array_contains("union_b", "number"))
    widened = (a == "integer") & (b == "number")

    def change(breaking: bool, kind: str, detail: Column) -> Column:
        return F.struct(F.lit(breaking).alias("breaking"), F.lit(kind).alias("kind"), detail.alias("detail"))

    to = F.concat(a, F.lit(" to "), b)
    typed = (
        F.when(~here | (was & now), F.lit(None))
        .when(was, change(True, "incompatible_type_change", F.concat(F.lit("union narrowed to "), b)))
        .when(now & fits, change(False, "type_expanded", F.concat(a, F.lit(" expanded to a union"))))
        .when(now, change(True, "incompatible_type_change", F.concat(a, F.lit(" is not in the new union"))))
        .when(a == b, F.lit(None))
        .when(widened, change(False, "type_widened", to))
        .when(a.isin("object", "array") & b.isin("object", "array"), change(True, "schema_type_changed", to))
        .otherwise(change(True, "incompatible_type_change", to))
    )
    field = F.regexp_replace(F.regexp_extract("path", r"\.((?:[^.\[\\]|\\.)*)\z", 1), r"\\(.)", "$1")
    must, must_now = F.col("must_a"), F.col("must_b")
    presence = (
        F.when(~is_property, F.lit(None))
        .when(gone & must, change(True, "required_field_removed", field))
        .when(gone, change(False, "optional_field_removed", field))
        .when(came & must_now, change(True, "required_field_added", field))
        .when(came, change(False, "optional_field_added", field))
        .when(must_now & ~must, change(True, "field_became_required", field))
        .when(must & ~must_now, change(False, "field_became_optional", field))
    )
    where = F.concat(F.lit("$"), F.regexp_replace("path", r"\\(.)", "$1"))
    return rows.select(*keys, where.alias("path"), F.explode(F.array_compact(F.array(presence, typed))).alias("x")).select(*keys, "path", "x.*")
