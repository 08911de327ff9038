"""Captured request/response pairs as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.paths import normalize_path, path_only, query_params
from quern.functions.text import capture_headers, is_json_type, rpc_method, rpc_tool, unwrap_tool_response

#: A body of more bytes is never kept, not even in part.
BODY_LIMIT = 1_048_576
RAW_PAIRS = (
    "seq BIGINT, session_id STRING, method STRING, url STRING, status_code INT, request_content_type STRING, "
    "response_content_type STRING, request_headers MAP<STRING,STRING>, response_headers MAP<STRING,STRING>, "
    "request_body STRING, response_body STRING, captured_at TIMESTAMP"
)


def read_pairs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw pairs of a log in JSON lines or Parquet."""
    return spark.read.schema(RAW_PAIRS).format(fmt).load(path)


def keep_pairs(pairs: DataFrame, limit: int = BODY_LIMIT) -> DataFrame:
    """Adds ``skipped`` and clears bodies that are not kept.

    Only POST, PUT and PATCH have request bodies; an oversize one is skipped whatever its type. A
    response body is looked at only if it is JSON, so an oversize one of another type is not skipped.
    """
    sends = F.col("method").isin("POST", "PUT", "PATCH")
    request_big = sends & (F.octet_length("request_body") > limit)
    json_response = is_json_type(F.col("response_content_type"))
    response_big = json_response & (F.octet_length("response_body") > limit)
    skipped = F.coalesce(request_big, F.lit(False)) | F.coalesce(response_big, F.lit(False))
    return pairs.withColumns(
        {
            "skipped": skipped,
            "request_body": F.when(sends & is_json_type(F.col("request_content_type")), F.col("request_body")),
            "response_body": F.when(json_response, F.col("response_body")),
        }
    )


def to_samples(pairs: DataFrame, limit: int = BODY_LIMIT) -> DataFrame:
    """Kept pairs as samples, with the bodies beside them for inference (they are not stored)."""
    kept = keep_pairs(pairs, limit).where(~F.col("skipped"))
    rpc, tool = rpc_method(F.col("request_body")), rpc_tool(F.col("request_body"))
    body = F.when(F.startswith(rpc, F.lit("tools/")), unwrap_tool_response(F.col("response_body"))).otherwise(
        F.col("response_body")
    )
    return kept.select(
        F.col("seq").alias("id"),
        "session_id",
        F.col("method").alias("http_method"),
        path_only(F.col("url")).alias("path"),
        normalize_path(F.col("url")).alias("normalized_path"),
        "status_code",
        query_params(F.col("url")).alias("query_params"),
        capture_headers(F.col("request_headers")).alias("request_headers"),
        capture_headers(F.col("response_headers")).alias("response_headers"),
        "captured_at",
        rpc.alias("jsonrpc_method"),
        tool.alias("jsonrpc_tool"),
        "request_body",
        body.alias("response_body"),
    )
