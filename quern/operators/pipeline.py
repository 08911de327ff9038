"""From samples to stored endpoint schemas: merge, score, version and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import aggregate, facts
from quern.operators.diff import changes_of
from quern.sources.scratch import written

ENDPOINT = aggregate.ENDPOINT


def _schemas(samples: DataFrame, side: str, group: list[str], patch: bool) -> tuple[DataFrame, DataFrame]:
    """(group, schema) and (group, path statistics) of the bodies of one side."""
    found = facts.stored_facts(samples, side, group)
    totals = samples.groupBy(*group).agg(F.count("*").alias("total"))
    merged = facts.merge_facts(found, group)
    if patch:
        totals = totals.withColumn("is_patch", F.col("http_method") == "PATCH")
    stats = facts.field_stats(merged, totals, group, "is_patch" if patch else None)
    return facts.assemble(stats, facts.enums(found, totals, group), group), stats


def aggregate_session(samples: DataFrame) -> DataFrame:
    """One row per (session, method, template) with merged schemas and all that documents need.

    Samples carry facts as they are stored; of those that still have bodies, the facts are written
    once, and all that follows reads them there.
    """
    s = facts.without_bodies(samples)
    if {"request_body", "response_body"} & set(samples.columns):
        s = written(s, "samples")
    s = s.withColumns(
        {"http_method": F.upper("http_method"), "status_code": F.coalesce("status_code", F.lit(0))}
    )
    key = ["session_id", *ENDPOINT]
    per_status, stats = _schemas(s, "response", [*key, "status_code"], False)
    requests, _ = _schemas(s, "request", key, True)
    base = s.groupBy(*key).agg(
        F.count("*").alias("sample_count"),
        F.min("captured_at").alias("first_observed"),
        F.max("captured_at").alias("last_observed"),
    )
    responses = per_status.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("status_code").cast("string"), "schema")))).alias(
            "response_schemas"
        ),
        F.min_by("schema", "status_code").alias("primary_schema"),
        F.min("status_code").alias("primary_status"),
    )
    top = facts.top_confidence(stats, [*key, "status_code"]).withColumnRenamed("status_code", "primary_status")
    shapes = s.select(*key, F.col("response_shape").alias("shape")).distinct()
    shapes = shapes.groupBy(*key).agg(F.count("*").alias("unique_response_shapes"))
    values = aggregate.path_param_values(s, key).groupBy(*key, "name").agg(F.array_sort(F.collect_list("value")).alias("v"))
    values = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("path_param_values"))
    query = aggregate.query_param_values(s, "query_params", key)
    query = query.groupBy(*key, "name").agg(F.array_sort(F.collect_list("value")).alias("v"))
    query = query.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("query_params"))
    sent = aggregate.merge_headers(s, "request_headers", key).withColumnRenamed("headers", "request_headers")
    got = aggregate.merge_headers(s, "response_headers", key).withColumnRenamed("headers", "response_headers")
    out = base.join(responses, key, "left").join(top, [*key, "primary_status"], "left")
    for part in (requests.withColumnRenamed("schema", "request_schema"), shapes, values, query, sent, got):
        out = out.join(part, key, "left")
    score = facts.confidence(F.col("sample_count"), F.col("required"), F.col("fields"), F.col("stable"))
    any_schema = F.col("primary_schema").isNotNull()
    return out.withColumn("confidence_score", F.when(any_schema, score).otherwise(F.lit(0.0))).drop(
        "fields", "required", "stable", "primary_status"
    )


def with_versions(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Adds version, previous_session_id and changes against the latest stored row of each endpoint.

    A stored row of the same session is no earlier version. ``stored`` has created_at and id beside
    the columns of ``rows``.
    """
    if stored is None:
        return rows.withColumns(
            {
                "version": F.lit(1),
                "previous_session_id": F.lit(None).cast("string"),
                "changes": changes_of(F.col("primary_schema"), F.lit(None).cast("string")),
            }
        )
    latest = stored.groupBy(*ENDPOINT).agg(
        F.max_by(
            F.struct(
                F.col("session_id").alias("old_session"),
                F.col("version").alias("old_version"),
                F.col("primary_schema").alias("old_schema"),
            ),
            F.struct("created_at", "snapshot"),
        ).alias("old")
    )
    other = F.coalesce(F.col("old.old_session") != F.col("session_id"), F.lit(False))
    return (
        rows.join(latest, ENDPOINT, "left")
        .withColumns(
            {
                "version": F.when(other, F.col("old.old_version") + 1).otherwise(1),
                "previous_session_id": F.when(other, F.col("old.old_session")),
                "changes": changes_of(F.when(other, F.col("old.old_schema")), F.col("primary_schema")),
            }
        )
        .drop("old")
    )
