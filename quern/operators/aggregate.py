"""Endpoint aggregation: groups, profiles, headers, parameters, shapes, snapshots, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.paths import path_params
from quern.functions.text import AUTH_HEADERS, TRANSPORT_HEADERS
from quern.operators.facts import confidence, field_stats, infer_facts, merge_facts, top_confidence

ENDPOINT = ["http_method", "normalized_path"]


def endpoint_groups(samples: DataFrame) -> DataFrame:
    """Samples per method (upper-case), template and status (null: 0)."""
    return samples.groupBy(
        F.upper("http_method").alias("http_method"),
        "normalized_path",
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
    ).agg(F.count("*").alias("n"))


def groups_by_raw_status(samples: DataFrame) -> DataFrame:
    """The same with methods as they are and ``unknown`` for a null status."""
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("unknown")).alias("status")
    return samples.groupBy("http_method", "normalized_path", status).agg(F.count("*").alias("n"))


def endpoint_profile(samples: DataFrame) -> DataFrame:
    """One row per endpoint: samples, statuses, first and last sight (ms), primary status and confidence.

    The primary response is that of the lowest status with a body; its root fields give consistency
    and stability, all samples of the endpoint the sample size. Without any schema it is 0.
    """
    shape = samples.select(
        F.upper("http_method").alias("http_method"),
        "normalized_path",
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        "captured_at",
        F.col("response_body").alias("body"),
        "id",
    )
    counted = shape.groupBy(*ENDPOINT).agg(
        F.count("*").alias("n"),
        F.count_distinct("status_code").alias("n_status"),
        F.unix_millis(F.min("captured_at")).alias("first_ms"),
        F.unix_millis(F.max("captured_at")).alias("last_ms"),
        F.min("status_code").alias("primary_status"),
    )
    group = [*ENDPOINT, "status_code"]
    facts = infer_facts(shape.select(*group, "id", "body"))
    merged = merge_facts(facts, group)
    totals = shape.groupBy(*group).agg(F.count("*").alias("total"))
    per_status = top_confidence(field_stats(merged, totals, group), group)
    with_schema = merged.where("path = ''").groupBy(*group).agg(F.lit(True).alias("has_schema"))
    best = (
        with_schema.join(per_status, group, "left")
        .groupBy(*ENDPOINT)
        .agg(F.min_by(F.struct("fields", "required", "stable"), "status_code").alias("s"), F.lit(True).alias("has"))
    )
    score = F.when(
        F.col("has"), confidence(F.col("n"), F.col("s.required"), F.col("s.fields"), F.col("s.stable"))
    ).otherwise(F.lit(0.0))
    return counted.join(best, ENDPOINT, "left").select(
        *ENDPOINT, "n", "n_status", "first_ms", "last_ms", "primary_status", F.round(score, 6).alias("confidence_score")
    )


def merge_headers(samples: DataFrame, headers: str, group: list[str]) -> DataFrame:
    """First example of each header (names compared lower-cased), sorted by name."""
    each = samples.select(*group, "id", F.posexplode(headers).alias("pos", "h"))
    first = each.groupBy(*group, F.lower("h.name").alias("name_key")).agg(
        F.min_by(F.col("h"), F.struct("id", "pos")).alias("h")
    )
    return first.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name_key", "h"))), lambda x: x["h"]).alias("headers")
    )


def query_param_values(samples: DataFrame, params: str, group: list[str]) -> DataFrame:
    """Distinct values of each query parameter: one row per (group, name, value)."""
    return samples.select(*group, F.explode(params).alias("name", "value")).distinct()


def path_param_values(samples: DataFrame, group: list[str]) -> DataFrame:
    """Distinct values of each template parameter: one row per (group, name, value)."""
    each = samples.select(*group, F.explode(path_params(F.col("path"), F.col("normalized_path"))).alias("p"))
    return each.select(*group, "p.name", "p.value").distinct()


def visible_header(name: Column) -> Column:
    """Headers that documents show."""
    return ~F.lower(name).isin(AUTH_HEADERS + TRANSPORT_HEADERS)


def global_headers(endpoints: DataFrame, group: list[str]) -> DataFrame:
    """(name, example) of visible request headers that every endpoint has alike; none for fewer than two endpoints."""
    n = endpoints.agg(F.count("*").alias("n_endpoints"))
    each = endpoints.select(*group, F.explode("headers").alias("h")).where(visible_header(F.col("h.name")))
    spread = each.groupBy(F.lower("h.name").alias("name"), F.col("h.example").alias("example")).agg(
        F.count_distinct(*group).alias("n")
    )
    # one row, so a broadcast of one number
    return spread.join(F.broadcast(n), (F.col("n") == F.col("n_endpoints")) & (F.col("n_endpoints") >= 2)).select(
        "name", "example"
    )


def security_schemes(endpoints: DataFrame) -> DataFrame:
    """Security schemes that request headers show: bearerAuth, basicAuth, apiKeyAuth."""
    h = endpoints.select(F.explode("headers").alias("h")).select(
        F.lower("h.name").alias("name"), F.lower("h.example").alias("example")
    )
    scheme = (
        F.when((F.col("name") == "authorization") & F.col("example").startswith("bearer"), "bearerAuth")
        .when((F.col("name") == "authorization") & F.col("example").startswith("basic"), "basicAuth")
        .when(F.col("name") == "x-api-key", "apiKeyAuth")
    )
    return h.select(scheme.alias("scheme")).where("scheme is not null").distinct()


def numbered(samples: DataFrame) -> DataFrame:
    """Samples with their number (from 1) in their session, by time and id."""
    w = Window.partitionBy("session_id").orderBy("captured_at", "id")
    return samples.withColumn("seq", F.row_number().over(w))


def cumulative_snapshots(samples: DataFrame, every: int) -> DataFrame:
    """Snapshot k of a session covers its first k * every samples; the last one covers them all.

    One row per (session, snapshot, endpoint) with the cumulative number of samples. Counts per
    (endpoint, snapshot it joins at) are summed, so no sample is repeated.
    """
    at = numbered(samples).withColumn("joins", F.ceil(F.col("seq") / every).cast("int"))
    counted = at.groupBy("session_id", *ENDPOINT, "joins").agg(F.count("*").alias("n"))
    last = counted.groupBy("session_id").agg(F.max("joins").alias("snapshots"))
    grid = (
        counted.groupBy("session_id", *ENDPOINT)
        .agg(F.min("joins").alias("since"))
        .join(last, "session_id")
        .select("session_id", *ENDPOINT, F.explode(F.sequence("since", "snapshots")).alias("snapshot"))
    )
    w = Window.partitionBy("session_id", *ENDPOINT).orderBy("snapshot").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(
        counted.withColumnRenamed("joins", "snapshot"), ["session_id", *ENDPOINT, "snapshot"], "left"
    )
    return joined.select(
        "session_id", *ENDPOINT, "snapshot", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("sample_count")
    )


def snapshot_summary(rows: DataFrame) -> DataFrame:
    """Per (session, snapshot): endpoints and samples."""
    return rows.groupBy("session_id", "snapshot").agg(
        F.count("*").alias("endpoints"), F.sum("sample_count").alias("samples")
    )


def version_chain(rows: DataFrame) -> DataFrame:
    """Version of each endpoint row (session_id, method, path, created_at, id): one more than the row before
    it of the same endpoint if that belongs to another session, else 1."""
    w = Window.partitionBy(*ENDPOINT).orderBy("created_at", "id")
    other = F.coalesce(F.lag("session_id").over(w) != F.col("session_id"), F.lit(False))
    marked = rows.withColumn("previous_session_id", F.when(other, F.lag("session_id").over(w))).withColumn(
        "run", F.sum(F.when(other, 0).otherwise(1)).over(w)
    )
    inside = Window.partitionBy(*ENDPOINT, "run").orderBy("created_at", "id")
    return marked.withColumn("version", F.row_number().over(inside)).drop("run")
