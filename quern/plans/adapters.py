"""The given tables read as traffic: DataFrames for the queries, and the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.paths import normalize_path, query_params
from quern.functions.text import rpc_method, rpc_tool


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a session (the user): method, url, status and JSON body, templated."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    url = (
        F.when(kind == "view", F.concat(F.lit("/orders/"), k))
        .when(kind == "click", F.concat(F.lit("/orders?page="), k))
        .when(kind == "purchase", F.lit("/orders"))
        .when(kind == "signup", F.lit("/users"))
        .otherwise(F.concat(F.lit("/users/"), k))
    )
    method = F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET")
    status = F.when(kind.isin("purchase", "signup"), 201).when(kind.isin("view", "click"), 200).otherwise(500)
    out = e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        method.alias("http_method"),
        url.alias("url"),
        status.alias("status_code"),
        F.col("props").alias("response_body"),
        F.col("ts").cast("timestamp").alias("captured_at"),
    )
    return out.select(
        "*",
        F.substring_index("url", "?", 1).alias("path"),
        normalize_path(F.col("url")).alias("normalized_path"),
        query_params(F.col("url")).alias("query_params"),
        F.lit(None).cast("string").alias("jsonrpc_method"),
        F.lit(None).cast("string").alias("jsonrpc_tool"),
    )


#: The same calls in SQL; templates written out for the three shapes of path that occur.
EVENT_SAMPLES = """
samples AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method,
    CASE event_type WHEN 'view' THEN '/orders/{orderId}' WHEN 'click' THEN '/orders' WHEN 'purchase' THEN '/orders'
      WHEN 'signup' THEN '/users' ELSE '/users/{userId}' END AS normalized_path,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 201 WHEN event_type IN ('view', 'click') THEN 200 ELSE 500 END AS status_code,
    event_type, json_extract_string(props, '$.k') AS k, epoch_us(ts) // 1000 AS ms, ts
  FROM events)
"""


def rpc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON-RPC calls: one session each, 700 ms apart, the tool by the text's length."""
    c = table(spark, sf_dir, "conversations")
    r = (F.length("text") % 3).cast("string")
    listing = (F.col("role") == "user") & (r == "0")
    call = F.when(F.col("role") == "user", F.concat(F.lit("create_r"), r)).when(
        F.col("role") != "system", F.concat(F.lit("get_r"), r)
    )
    method = F.when(F.col("role") == "system", "initialize").when(listing, "tools/list").otherwise("tools/call")
    body = F.to_json(
        F.struct(
            F.lit("2.0").alias("jsonrpc"),
            method.alias("method"),
            F.when(method == "tools/call", F.struct(call.alias("name"))).alias("params"),
        )
    )
    rows = c.select(
        F.col("turn").alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit("POST").alias("http_method"),
        F.lit("/mcp").alias("normalized_path"),
        F.lit(200).alias("status_code"),
        F.timestamp_millis(F.col("turn") * 700).alias("captured_at"),
        body.alias("request_body"),
        F.length("text").alias("size"),
    )
    return rows.select(
        "*", rpc_method(F.col("request_body")).alias("jsonrpc_method"), rpc_tool(F.col("request_body")).alias("jsonrpc_tool")
    )


RPC_SAMPLES = """
rpc AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, turn * 700 AS ms, length(text) AS size,
    CASE WHEN role = 'system' THEN 'initialize' WHEN role = 'user' AND length(text) % 3 = 0 THEN 'tools/list'
      WHEN role = 'user' THEN 'tools/call:create_r' || (length(text) % 3) ELSE 'tools/call:get_r' || (length(text) % 3) END AS op
  FROM conversations)
"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls without scheme, host and fragment."""
    url = F.regexp_replace(F.regexp_replace("url", "#.*", ""), "^[^:]*://[^/?]*", "")
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


PAGE_URLS = "urls AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*', ''), '^[^:]*://[^/?]*', '') AS url FROM pages)"


def spread(df: DataFrame) -> DataFrame:
    """Rows that a few tasks would read, dealt to all cores: a table of one row group is one task otherwise.

    Larger inputs have tasks enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 8 * cores else df


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of customer, orders, part and lineitem as JSON response bodies of GET /<table>/{id}.

    A negative balance is left out, so that one field is optional.
    """
    c, o, p = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    item = table(spark, sf_dir, "lineitem")
    bodies = [
        (
            "customers",
            c.select(
                F.col("c_custkey").alias("id"),
                F.to_json(
                    F.struct(
                        F.col("c_custkey").alias("id"),
                        F.col("c_name").alias("name"),
                        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
                        F.col("c_mktsegment").alias("segment"),
                    )
                ).alias("body"),
            ),
        ),
        (
            "orders",
            o.select(
                F.col("o_orderkey").alias("id"),
                F.to_json(
                    F.struct(
                        F.col("o_orderkey").alias("id"),
                        F.col("o_orderstatus").alias("status"),
                        F.col("o_totalprice").alias("total"),
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                        F.col("o_orderpriority").alias("priority"),
                    )
                ).alias("body"),
            ),
        ),
        (
            "parts",
            p.select(
                F.col("p_partkey").alias("id"),
                F.to_json(
                    F.struct(
                        F.col("p_partkey").alias("id"),
                        F.col("p_brand").alias("brand"),
                        F.col("p_type").alias("type"),
                        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5).alias("size"),
                    )
                ).alias("body"),
            ),
        ),
        (
            "lines",
            item.select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                F.to_json(
                    F.struct(
                        F.col("l_quantity").alias("quantity"),
                        F.col("l_returnflag").alias("flag"),
                        F.col("l_linestatus").alias("line"),
                    )
                ).alias("body"),
            ),
        ),
    ]
    out = None
    for name, df in bodies:
        part = df.select(F.lit(name).alias("resource"), "id", "body")
        out = part if out is None else out.union(part)
    return spread(out)


#: Facts about the same bodies in SQL: resource, field, type of the merged field, presence and values.
JSON_FIELDS = """
fields AS (
  SELECT 'customers' AS resource, 'id' AS field, 'integer' AS type, count(*) AS presence, 0 AS distinct_values FROM customer
  UNION ALL SELECT 'customers', 'name', 'string', count(*), count(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'customers', 'balance', CASE WHEN count(*) FILTER (WHERE c_acctbal <> floor(c_acctbal)) > 0 THEN 'number' ELSE 'integer' END, count(*), 0 FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'customers', 'segment', 'string', count(*), count(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'orders', 'id', 'integer', count(*), 0 FROM orders
  UNION ALL SELECT 'orders', 'status', 'string', count(*), count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'orders', 'total', CASE WHEN count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) > 0 THEN 'number' ELSE 'integer' END, count(*), 0 FROM orders
  UNION ALL SELECT 'orders', 'date', 'string', count(*), 0 FROM orders
  UNION ALL SELECT 'orders', 'priority', 'string', count(*), count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'parts', 'id', 'integer', count(*), 0 FROM part
  UNION ALL SELECT 'parts', 'brand', 'string', count(*), count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'parts', 'type', 'string', count(*), count(DISTINCT p_type) FROM part
  UNION ALL SELECT 'parts', 'size', CASE WHEN count(*) FILTER (WHERE p_size % 2 <> 0) > 0 THEN 'number' ELSE 'integer' END, count(*), 0 FROM part
  UNION ALL SELECT 'lines', 'quantity', CASE WHEN count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) > 0 THEN 'number' ELSE 'integer' END, count(*), 0 FROM lineitem
  UNION ALL SELECT 'lines', 'flag', 'string', count(*), count(DISTINCT l_returnflag) FROM lineitem
  UNION ALL SELECT 'lines', 'line', 'string', count(*), count(DISTINCT l_linestatus) FROM lineitem),
totals AS (SELECT resource, max(presence) AS total FROM fields GROUP BY resource)
"""


def header_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls with request headers: a bearer token for some, an API key for others."""
    c = table(spark, sf_dir, "customer")
    headers = F.create_map(
        F.lit("X-Client"),
        F.lit("web"),
        F.lit("X-Segment"),
        F.col("c_mktsegment"),
        F.lit("Host"),
        F.lit("example.com"),
        F.lit("Connection"),
        F.lit("close"),
        F.when(F.col("c_custkey") % 2 == 0, "Authorization").otherwise("X-API-Key"),
        F.concat(F.lit("Bearer t"), F.col("c_custkey").cast("string")),
    )
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")).alias("endpoint"),
        headers.alias("request_headers"),
    )
