"""The registered queries of the traffic operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import paths, text
from quern.operators import aggregate, behaviour, diff, documents, facts, models
from quern.operators.pipeline import aggregate_session
from quern.plans import adapters as ad
from quern.sources.capture import keep_pairs
from quern.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Gaps of the events table are hours, so its phases and restarts take longer limits.
PHASE_MS, RESTART_MS, LOOP_MS = 6 * 3_600_000, 24 * 3_600_000, 12 * 3_600_000


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CONFIDENCE = "0.4 * least(greatest(ln(n) / ln(100), 0), 1) + 0.4 * required / fields + 0.2 * stable / fields"


@query(f"WITH {ad.EVENT_SAMPLES} SELECT http_method, normalized_path, status_code, count(*) AS n FROM samples GROUP BY ALL")
def endpoint_groups(spark, sf):
    return aggregate.endpoint_groups(ad.event_samples(spark, sf))


@query(
    f"WITH {ad.EVENT_SAMPLES}, e AS (SELECT http_method, normalized_path, count(*) AS n, count(DISTINCT status_code) AS n_status, "
    "min(ms) AS first_ms, max(ms) AS last_ms, min(status_code) AS primary_status, 1 AS required, 1 AS fields, 1 AS stable "
    f"FROM samples GROUP BY 1, 2) SELECT http_method, normalized_path, n, n_status, first_ms, last_ms, primary_status, "
    f"round({CONFIDENCE}, 6) AS confidence_score FROM e"
)
def endpoint_profile(spark, sf):
    return aggregate.endpoint_profile(ad.event_samples(spark, sf))


_TEMPLATE = """
  CASE WHEN len(s) = 0 THEN '/' ELSE '/' || array_to_string(
    CASE WHEN len(s) = 2 AND regexp_full_match(s[2], '[0-9]+') THEN [s[1], '{' || s[1] || 'Id}'] ELSE s END, '/') END"""
_SEGMENTS = "list_filter(string_split(split_part(url, '?', 1), '/'), lambda x: x <> '')"


@query(f"WITH {ad.PAGE_URLS}, p AS (SELECT {_SEGMENTS} AS s FROM urls) SELECT {_TEMPLATE} AS template, count(*) AS n FROM p GROUP BY 1")
def normalize_paths(spark, sf):
    return ad.page_urls(spark, sf).groupBy(paths.normalize_path(F.col("url")).alias("template")).agg(F.count("*").alias("n"))


@query(
    f"WITH {ad.PAGE_URLS}, q AS (SELECT unnest(string_split(split_part(url, '?', 2), '&')) AS p FROM urls WHERE contains(url, '?')) "
    "SELECT split_part(p, '=', 1) AS name, split_part(p, '=', 2) AS value, count(*) AS n FROM q GROUP BY ALL"
)
def query_params(spark, sf):
    params = ad.page_urls(spark, sf).select(F.explode(paths.query_params(F.col("url"))).alias("name", "value"))
    return params.groupBy("name", "value").agg(F.count("*").alias("n"))


@query(
    f"WITH {ad.EVENT_SAMPLES} SELECT http_method, normalized_path, CASE WHEN event_type = 'view' THEN 'orderId' ELSE 'userId' END AS name, "
    "count(DISTINCT k) AS n_values, min(k) AS low, max(k) AS high FROM samples WHERE event_type IN ('view', 'error') OR event_type NOT IN "
    "('click', 'purchase', 'signup') GROUP BY ALL"
)
def path_param_values(spark, sf):
    values = aggregate.path_param_values(ad.event_samples(spark, sf), aggregate.ENDPOINT)
    return values.groupBy(*aggregate.ENDPOINT, "name").agg(
        F.count("*").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query(r"""
WITH w AS (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS t FROM documents)
SELECT CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN 'uuid'
  WHEN regexp_full_match(t, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'email'
  WHEN regexp_matches(t, '^https?://.+') THEN 'uri'
  WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
  WHEN regexp_full_match(t, '([0-9]{1,3}\.){3}[0-9]{1,3}') THEN 'ipv4'
  WHEN regexp_full_match(t, '([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}') THEN 'ipv6' END AS format, count(*) AS n
FROM w WHERE t <> '' GROUP BY 1""")
def string_formats(spark, sf):
    words = ad.table(spark, sf, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("t")).where("t != ''")
    return words.groupBy(text.string_format(F.col("t")).alias("format")).agg(F.count("*").alias("n"))


def _merged(spark, sf):
    rows = ad.json_rows(spark, sf)
    found = facts.infer_facts(rows)
    totals = rows.groupBy("resource").agg(F.count("*").alias("total"))
    merged = facts.merge_facts(found, ["resource"])
    return found, merged, totals, facts.field_stats(merged, totals, ["resource"])


def _field():
    return F.substr("path", F.lit(2)).alias("field")


@query(
    f"WITH {ad.JSON_FIELDS} SELECT resource, field, presence, total AS sample_count, round(presence / total, 6) AS confidence "
    "FROM fields JOIN totals USING (resource)"
)
def schema_field_presence(spark, sf):
    stats = _merged(spark, sf)[3].where("path != ''")
    return stats.select("resource", _field(), "presence", "sample_count", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {ad.JSON_FIELDS} SELECT resource, field FROM fields JOIN totals USING (resource) WHERE presence = total")
def required_fields(spark, sf):
    return _merged(spark, sf)[3].where("required").select("resource", _field())


@query(f"WITH {ad.JSON_FIELDS} SELECT resource, field, type, presence AS n FROM fields")
def field_types_merged(spark, sf):
    return _merged(spark, sf)[1].where("path != ''").select("resource", _field(), "type", "n")


@query(
    f"WITH {ad.JSON_FIELDS}, c AS (SELECT resource, max(total) AS n, count(*) AS fields, count(*) FILTER (WHERE presence = total) AS required, "
    f"count(*) AS stable FROM fields JOIN totals USING (resource) GROUP BY 1) SELECT resource, n, fields, required, round({CONFIDENCE}, 6) AS confidence_score FROM c"
)
def confidence_scores(spark, sf):
    _, _, totals, stats = _merged(spark, sf)
    top = facts.top_confidence(stats, ["resource"]).join(totals, "resource")
    score = facts.confidence(F.col("total"), F.col("required"), F.col("fields"), F.col("stable"))
    return top.select("resource", F.col("total").alias("n"), "fields", "required", F.round(score, 6).alias("confidence_score"))


_ENUMS = """
enums AS (SELECT 'customers' AS resource, 'segment' AS field, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS enum FROM customer
  UNION ALL SELECT 'orders', 'status', string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM orders
  UNION ALL SELECT 'orders', 'priority', string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders
  UNION ALL SELECT 'parts', 'brand', string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FROM part
  UNION ALL SELECT 'parts', 'type', string_agg(DISTINCT p_type, '|' ORDER BY p_type) FROM part
  UNION ALL SELECT 'lines', 'flag', string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) FROM lineitem
  UNION ALL SELECT 'lines', 'line', string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) FROM lineitem)"""


@query(
    f"WITH {ad.JSON_FIELDS}, {_ENUMS} SELECT resource, '.' || field AS path, type, presence = total AS required, presence AS n, "
    "CASE WHEN type = 'string' AND field <> 'date' AND distinct_values <= 10 AND total >= 10 THEN enum END AS enum FROM fields JOIN totals USING (resource) LEFT JOIN enums USING (resource, field) "
    "UNION ALL SELECT resource, '', 'object', false, total, NULL FROM totals"
)
def merged_schemas(spark, sf):
    """The nested schemas, opened again node by node."""
    rows = ad.json_rows(spark, sf)
    found = written(facts.infer_facts(rows), "facts")  # statistics and enumerations both read them
    totals = rows.groupBy("resource").agg(F.count("*").alias("total"))
    stats = facts.field_stats(facts.merge_facts(found, ["resource"]), totals, ["resource"])
    schemas = facts.assemble(stats, facts.enums(found, totals, ["resource"]), ["resource"])
    nodes = models.schema_nodes(schemas, ["resource"])
    x = F.from_json("node", "enum array<string>, required array<string>, stats struct<presenceCount:bigint>")
    nodes = nodes.select("resource", "path", "type", x.alias("x"))
    must = nodes.where("path = ''").select("resource", F.col("x.required").alias("must"))
    required = F.array_contains("must", F.substr("path", F.lit(2)))
    return nodes.join(must, "resource").select(
        "resource", "path", "type", required.alias("required"), F.col("x.stats.presenceCount").alias("n"), F.array_join("x.enum", "|").alias("enum")
    )


@query(
    f"WITH {ad.JSON_FIELDS}, {_ENUMS} SELECT resource, field, distinct_values, enum FROM fields JOIN totals USING (resource) JOIN enums USING (resource, field) "
    "WHERE type = 'string' AND field <> 'date' AND distinct_values <= 10 AND total >= 10"
)
def enum_inference(spark, sf):
    found, _, totals, _ = _merged(spark, sf)
    return facts.enums(found, totals, ["resource"]).select(
        "resource", _field(), F.size("enum").cast("long").alias("distinct_values"), F.array_join("enum", "|").alias("enum")
    )


@query(
    "SELECT 'customers' AS resource, count(DISTINCT c_acctbal >= 0 AND c_acctbal = floor(c_acctbal)) FILTER (WHERE c_acctbal >= 0) + "
    "max(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS shapes FROM customer UNION ALL SELECT 'orders', count(DISTINCT o_totalprice = floor(o_totalprice)) "
    "FROM orders UNION ALL SELECT 'parts', count(DISTINCT p_size % 2 = 0) FROM part UNION ALL SELECT 'lines', count(DISTINCT l_quantity = floor(l_quantity)) FROM lineitem"
)
def response_shapes(spark, sf):
    shapes = ad.json_rows(spark, sf).select("resource", facts.fingerprint_of(F.col("body")).alias("shape")).distinct()
    return shapes.groupBy("resource").agg(F.count("*").alias("shapes"))


_HEADERS = """
h AS (
  SELECT c_custkey AS id, '/n/' || c_nationkey AS endpoint, unnest([
    {'name': 'X-Client', 'example': 'web'}, {'name': 'X-Segment', 'example': c_mktsegment},
    CASE WHEN c_custkey % 2 = 0 THEN {'name': 'Authorization', 'example': 'Bearer ***'} ELSE {'name': 'X-API-Key', 'example': '***'} END]) AS h
  FROM customer),
merged AS (SELECT endpoint, h.name AS name, min_by(h.example, id) AS example FROM h GROUP BY 1, 2)"""


def _headers(spark, sf):
    rows = ad.header_samples(spark, sf)
    captured = rows.select("id", "endpoint", text.capture_headers(F.col("request_headers")).alias("headers"))
    return aggregate.merge_headers(captured, "headers", ["endpoint"])


@query(f"WITH {_HEADERS} SELECT * FROM merged")
def header_merge(spark, sf):
    return _headers(spark, sf).select("endpoint", F.inline("headers"))


@query(
    f"WITH {_HEADERS} SELECT lower(name) AS name, example FROM merged WHERE name IN ('X-Client', 'X-Segment') "
    "GROUP BY 1, 2 HAVING count(DISTINCT endpoint) = (SELECT count(DISTINCT endpoint) FROM merged)"
)
def global_headers(spark, sf):
    return aggregate.global_headers(_headers(spark, sf), ["endpoint"])


@query(
    f"WITH {_HEADERS} SELECT DISTINCT CASE name WHEN 'Authorization' THEN 'bearerAuth' ELSE 'apiKeyAuth' END AS scheme FROM merged "
    "WHERE name IN ('Authorization', 'X-API-Key')"
)
def security_schemes(spark, sf):
    return aggregate.security_schemes(_headers(spark, sf))


@query(
    f"WITH {ad.EVENT_SAMPLES}, n AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY session_id ORDER BY ts, id) / 20) AS INT) AS joins FROM samples), "
    "k AS (SELECT DISTINCT session_id, joins AS snapshot FROM n), "
    "r AS (SELECT k.session_id, k.snapshot, n.http_method, n.normalized_path, count(*) AS c FROM k JOIN n ON n.session_id = k.session_id AND n.joins <= k.snapshot GROUP BY ALL) "
    "SELECT session_id, snapshot, count(*) AS endpoints, CAST(sum(c) AS BIGINT) AS samples FROM r GROUP BY 1, 2"
)
def snapshots_cumulative(spark, sf):
    return aggregate.snapshot_summary(aggregate.cumulative_snapshots(ad.event_samples(spark, sf), 20))


_HALVES = "h AS (SELECT *, ts < (SELECT min(ts) + (max(ts) - min(ts)) / 50 FROM events) AS early FROM samples)"


@query(
    f"WITH {ad.EVENT_SAMPLES}, {_HALVES}, a AS (SELECT DISTINCT session_id, http_method, normalized_path FROM h WHERE early), "
    "b AS (SELECT DISTINCT session_id, http_method, normalized_path FROM h WHERE NOT early) "
    "SELECT session_id, http_method, normalized_path, CASE WHEN a.session_id IS NULL THEN 'NEW' WHEN b.session_id IS NULL THEN 'REMOVED' ELSE 'COMMON' END AS state "
    "FROM (SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS x FROM b) b USING (session_id, http_method, normalized_path)".replace(
        "WHEN a.session_id IS NULL", "WHEN a.x IS NULL"
    ).replace("WHEN b.session_id IS NULL", "WHEN b.x IS NULL")
)
def schema_diff_endpoints(spark, sf):
    s = ad.event_samples(spark, sf)
    span = s.agg(F.min(F.unix_micros("captured_at")).alias("lo"), F.max(F.unix_micros("captured_at")).alias("hi"))
    s = s.join(F.broadcast(span))  # one row
    early = F.unix_micros("captured_at") < F.col("lo") + (F.col("hi") - F.col("lo")) / 50
    return diff.diff_endpoints(s.where(early), s.where(~early), ["session_id", *aggregate.ENDPOINT])


@query("""
WITH a AS (SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE p_size < 40) AS k, count(*) FILTER (WHERE p_retailprice <> floor(p_retailprice)) AS f FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
b AS (SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE p_size < 25) AS k FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
x AS (SELECT a.brand, a.n AS an, a.k AS ak, b.n AS bn, b.k AS bk FROM a JOIN b USING (brand))
SELECT brand, '.size' AS path, CASE WHEN bk = bn THEN 'field_became_required' ELSE 'field_became_optional' END AS kind, bk = bn AS breaking FROM x WHERE ak > 0 AND bk > 0 AND (ak = an) <> (bk = bn)
UNION ALL SELECT brand, '.size', CASE WHEN ak = an THEN 'required_field_removed' ELSE 'optional_field_removed' END, ak = an FROM x WHERE ak > 0 AND bk = 0
UNION ALL SELECT brand, '.size', CASE WHEN bk = bn THEN 'required_field_added' ELSE 'optional_field_added' END, bk = bn FROM x WHERE ak = 0 AND bk > 0
UNION ALL SELECT brand, '.price', 'incompatible_type_change', true FROM x""")
def schema_diff_fields(spark, sf):
    p = ad.table(spark, sf, "part")
    old_body = F.struct(F.when(F.col("p_size") < 40, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    new_body = F.struct(
        F.when(F.col("p_size") < 25, F.col("p_size")).alias("size"), F.col("p_retailprice").cast("string").alias("price")
    )

    def version(rest, body):
        rows = p.where(F.col("p_partkey") % 2 == rest).select(
            F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.to_json(body).alias("body")
        )
        totals = rows.groupBy("brand").agg(F.count("*").alias("total"))
        stats = facts.field_stats(facts.merge_facts(facts.infer_facts(rows), ["brand"]), totals, ["brand"])
        one = F.when(F.size("types") == 1, F.get("types", F.lit(0)))
        return stats.where("path != ''").select("brand", "path", one.alias("type"), "required")

    return diff.diff_fields(version(0, old_body), version(1, new_body), ["brand"])


@query(
    f"WITH {ad.EVENT_SAMPLES}, r AS (SELECT session_id, http_method, normalized_path, max(ts) AS created_at, max(id) AS id FROM samples GROUP BY 1, 2, 3), "
    "d AS (SELECT CAST(CAST(session_id AS BIGINT) % 7 AS VARCHAR) AS session_id, http_method, normalized_path, created_at, id FROM r), "
    "p AS (SELECT *, lag(session_id) OVER w AS prev FROM d WINDOW w AS (PARTITION BY http_method, normalized_path ORDER BY created_at, id)), "
    "g AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND prev <> session_id THEN 0 ELSE 1 END) OVER (PARTITION BY http_method, normalized_path ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM p) "
    "SELECT session_id, http_method, normalized_path, id, CASE WHEN prev <> session_id THEN prev END AS previous_session_id, "
    "CAST(row_number() OVER (PARTITION BY http_method, normalized_path, run ORDER BY created_at, id) AS INT) AS version FROM g"
)
def version_chain(spark, sf):
    s = ad.event_samples(spark, sf).groupBy("session_id", *aggregate.ENDPOINT)
    rows = s.agg(F.max("captured_at").alias("created_at"), F.max("id").alias("id"))
    rows = rows.withColumn("session_id", (F.col("session_id").cast("long") % 7).cast("string"))
    return aggregate.version_chain(rows).drop("created_at")


@query(
    f"WITH {ad.RPC_SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ms, id) - 1 AS place FROM rpc) "
    "SELECT session_id, op, count(*) AS n, CAST(min(place) AS INT) AS first_place FROM p GROUP BY 1, 2"
)
def tool_usage(spark, sf):
    return behaviour.tool_usage(ad.rpc_samples(spark, sf))


@query(
    f"WITH {ad.RPC_SAMPLES} SELECT session_id, op, count(*) AS n, 1 AS expected FROM rpc WHERE op IN ('initialize', 'tools/list') GROUP BY 1, 2 HAVING count(*) > 1"
)
def redundant_calls(spark, sf):
    return behaviour.redundant_calls(behaviour.tool_usage(ad.rpc_samples(spark, sf)))


@query(f"""
WITH {ad.EVENT_SAMPLES}, p AS (
  SELECT session_id, http_method AS fm, normalized_path AS fp, lead(http_method) OVER w AS tm, lead(normalized_path) OVER w AS tp, lead(ms) OVER w - ms AS d
  FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
g AS (SELECT session_id, fm, fp, tm, tp, count(*) AS n, avg(d) AS m FROM p WHERE tm IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT session_id, fm AS from_method, fp AS from_path, tm AS to_method, tp AS to_path, n, CAST(floor(m + 0.5) AS BIGINT) AS avg_delay,
  CASE WHEN fm = 'POST' AND tm = 'GET' AND fp = tp THEN 'list_after_create'
    WHEN fm = 'POST' AND tm = 'GET' AND starts_with(tp, fp || '/') AND m <= {LOOP_MS} THEN 'verification_loop' ELSE 'unknown' END AS pattern
FROM g""")
def rest_sequences(spark, sf):
    return behaviour.rest_sequences(ad.event_samples(spark, sf), LOOP_MS)


@query(ORACLE["rest_sequences"])
def rest_sequences_by_range(spark, sf):
    return behaviour.rest_sequences_by_range(ad.event_samples(spark, sf), LOOP_MS)


_RPC_PAIRS = """
w AS (SELECT session_id, op, ms, row_number() OVER (PARTITION BY session_id ORDER BY ms, id) AS r FROM rpc),
p AS (SELECT a.session_id, a.op AS from_op, b.op AS to_op, b.ms - a.ms AS d FROM w a JOIN w b ON a.session_id = b.session_id AND b.r BETWEEN a.r + 1 AND a.r + 4),
c AS (SELECT *, CASE WHEN from_op = to_op AND starts_with(from_op, 'tools/call:') THEN 'retry'
    WHEN from_op = 'tools/list' AND to_op = 'tools/list' THEN 'redundant_list'
    WHEN starts_with(from_op, 'tools/call:create_') AND starts_with(to_op, 'tools/call:get_') AND right(from_op, 2) = right(to_op, 2) THEN 'verification_loop'
    ELSE 'unknown' END AS pattern FROM p),
s AS (SELECT session_id, from_op, to_op, pattern, count(*) AS n, CAST(floor(avg(d) + 0.5) AS BIGINT) AS avg_delay FROM c WHERE pattern <> 'unknown' GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {ad.RPC_SAMPLES}, {_RPC_PAIRS} SELECT * FROM s")
def rpc_sequences(spark, sf):
    return behaviour.rpc_sequences(ad.rpc_samples(spark, sf))


@query(
    f"WITH {ad.RPC_SAMPLES}, {_RPC_PAIRS}, u AS (SELECT session_id, n FROM s UNION ALL SELECT session_id, count(*) - 1 FROM rpc "
    "WHERE op IN ('initialize', 'tools/list') GROUP BY session_id, op HAVING count(*) > 1) SELECT session_id, CAST(sum(n) AS BIGINT) AS wasted FROM u GROUP BY 1"
)
def wasted_requests(spark, sf):
    s = ad.rpc_samples(spark, sf)
    return behaviour.wasted_requests(behaviour.rpc_sequences(s), behaviour.redundant_calls(behaviour.tool_usage(s)))


@query(
    f"WITH {ad.EVENT_SAMPLES}, {ad.RPC_SAMPLES} SELECT DISTINCT 'e' || session_id AS session_id, false AS is_jsonrpc FROM samples "
    "UNION ALL SELECT DISTINCT 'c' || session_id, true FROM rpc"
)
def session_kind(spark, sf):
    cols = ["id", "http_method", "jsonrpc_method"]
    a = ad.event_samples(spark, sf).select(F.concat(F.lit("e"), "session_id").alias("session_id"), *cols)
    b = ad.rpc_samples(spark, sf).select(F.concat(F.lit("c"), "session_id").alias("session_id"), *cols)
    return behaviour.session_kind(a.union(b))


_PHASES = f"""
o AS (SELECT *, http_method || ' ' || normalized_path AS op, row_number() OVER w - 1 AS place, ms - lag(ms) OVER w AS gap FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
r AS (SELECT *, sum(CASE WHEN gap > {PHASE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS phase FROM o),
f AS (SELECT session_id, phase, count(*) AS n, max(CASE WHEN http_method = 'POST' THEN 1 ELSE 0 END) AS w, min(place) AS start_index, max(place) AS end_index, max(ms) - min(ms) AS duration FROM r GROUP BY 1, 2),
named AS (SELECT session_id, CAST(phase AS BIGINT) AS phase, n, CAST(start_index AS INT) AS start_index, CAST(end_index AS INT) AS end_index, duration, CASE WHEN w = 1 THEN 'creation'
  WHEN max(w) OVER (PARTITION BY session_id ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'verification' ELSE 'discovery' END AS name FROM f)"""


@query(f"WITH {ad.EVENT_SAMPLES}, {_PHASES} SELECT * FROM named")
def phases(spark, sf):
    return behaviour.phases(behaviour.phase_rows(ad.event_samples(spark, sf), PHASE_MS))


@query(ORACLE["phases"])
def phases_by_range(spark, sf):
    return behaviour.phases(behaviour.phase_rows_by_range(ad.event_samples(spark, sf), PHASE_MS))


@query(
    f"WITH {ad.EVENT_SAMPLES}, {_PHASES}, t AS (SELECT r.session_id, op AS tool, name, min(place) AS seen FROM r JOIN named USING (session_id, phase) GROUP BY 1, 2, 3) "
    "SELECT session_id, tool, string_agg(name, ',' ORDER BY seen) AS phases FROM t GROUP BY 1, 2"
)
def phase_tools(spark, sf):
    rows = behaviour.phase_rows(ad.event_samples(spark, sf), PHASE_MS)
    tools = behaviour.phase_tools(rows, behaviour.phases(rows))
    return tools.select("session_id", "tool", F.array_join("phases", ",").alias("phases"))


_CAUSES = f"""
q AS (SELECT r.*, name, k AS shape FROM r JOIN named USING (session_id, phase)),
pairs AS (SELECT session_id, op, place AS from_index, lead(place) OVER w AS to_index, lead(ms) OVER w - ms AS delta_ms,
    CASE WHEN status_code >= 400 THEN 'retry_after_error' WHEN lead(ms) OVER w - ms > {RESTART_MS} THEN 'session_restart'
      WHEN lead(name) OVER w <> name THEN 'different_phase' WHEN lead(CAST(k AS INT) % 3) OVER w <> CAST(k AS INT) % 3 THEN 'different_response' ELSE 'identical_response' END AS cause
  FROM q WINDOW w AS (PARTITION BY session_id, op ORDER BY place))"""


def _pairs(spark, sf):
    s = ad.event_samples(spark, sf)
    shape = (F.get_json_object("response_body", "$.k").cast("int") % 3).cast("string")
    s = s.withColumns({"request_shape": F.lit(None).cast("string"), "response_shape": shape})
    rows = behaviour.phase_rows(s, PHASE_MS)
    return rows, behaviour.call_pairs(rows, behaviour.phases(rows), RESTART_MS)


@query(
    f"WITH {ad.EVENT_SAMPLES}, {_PHASES}, {_CAUSES} SELECT session_id, op, CAST(from_index AS INT) AS from_index, CAST(to_index AS INT) AS to_index, delta_ms, cause FROM pairs WHERE to_index IS NOT NULL"
)
def call_pairs_causes(spark, sf):
    return _pairs(spark, sf)[1].select("session_id", "op", "from_index", "to_index", "delta_ms", "cause")


@query(
    f"WITH {ad.EVENT_SAMPLES}, {_PHASES}, {_CAUSES}, c AS (SELECT session_id, op, cause, count(*) AS n, min(from_index) AS f FROM pairs WHERE to_index IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT session_id, op, CAST(sum(n) AS BIGINT) AS pairs, first(cause ORDER BY n DESC, f) AS primary_cause FROM c GROUP BY 1, 2"
)
def primary_cause(spark, sf):
    return behaviour.primary_causes(_pairs(spark, sf)[1])


@query(
    f"WITH {ad.EVENT_SAMPLES}, {_PHASES}, {_CAUSES} SELECT p.session_id, p.op, CAST(p.from_index AS INT) AS from_index, string_agg(o.op, '|' ORDER BY o.place) AS between_ops "
    "FROM pairs p JOIN o ON o.session_id = p.session_id AND o.place > p.from_index AND o.place < p.to_index WHERE p.to_index IS NOT NULL GROUP BY 1, 2, 3"
)
def intervening_operations(spark, sf):
    rows, pairs = _pairs(spark, sf)
    out = behaviour.intervening(rows, pairs).where("intervening is not null")
    return out.select("session_id", "op", "from_index", F.array_join("intervening", "|").alias("between_ops"))


def _merged_schemas(bodies, group):
    """(group, schema): the schemas of bodies (group columns, id, body), as they are stored."""
    rows = bodies.select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), "id", "body")
    keys = [f"g{i}" for i in range(len(group))]
    found = facts.infer_facts(rows)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    stats = facts.field_stats(facts.merge_facts(found, keys), totals, keys)
    return facts.assemble(stats, facts.enums(found, totals, keys), keys).toDF(*group, "schema")


def _endpoint_rows(schemas, status):
    """Endpoint rows with one response schema each, as a snapshot has them."""
    return schemas.select(*aggregate.ENDPOINT, F.lit(None).cast("string").alias("request_schema"), F.create_map(status, F.col("schema")).alias("response_schemas"))


_SLUG = "lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || CAST(o_custkey % 10 AS VARCHAR)"
_STORED = f"""
o AS (SELECT *, '/' || {_SLUG} AS p FROM orders),
c AS (SELECT p, count(*) FILTER (WHERE o_orderkey % 499 = 0) > 0 AS w_total, count(*) FILTER (WHERE o_orderkey % 197 = 0) > 0 AS r_status,
  count(*) FILTER (WHERE o_orderkey % 211 = 0) > 0 AS r_total FROM o GROUP BY p),
m AS (SELECT p AS normalized_path, 1 + CAST(w_total AS INT) AS write_field_count, 2 + CAST(r_status AS INT) + CAST(r_total AS INT) AS read_field_count,
  concat_ws(',', CASE WHEN r_status THEN 'status' END, CASE WHEN r_total AND NOT w_total THEN 'total' END, 'priority') AS missing FROM c)"""


def _stored_completeness(spark, sf):
    """POST /<slug> against GET /<slug>/{id}, from the stored schemas of order rows as bodies; some fields are in some bodies only."""
    o = ad.table(spark, sf, "orders")
    slug = F.concat(F.lit("/"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")), (F.col("o_custkey") % 10).cast("string"))
    total = lambda one_in: F.when(F.col("o_orderkey") % one_in == 0, F.col("o_totalprice")).alias("total")
    id = F.col("o_orderkey").alias("id")
    post = F.struct(F.lit("POST").alias("http_method"), slug.alias("normalized_path"), F.to_json(F.struct(id, total(499))).alias("body"))
    status = F.when(F.col("o_orderkey") % 197 == 0, F.col("o_orderstatus")).alias("status")
    read = F.to_json(F.struct(id, status, total(211), F.col("o_orderpriority").alias("priority")))
    get = F.struct(F.lit("GET").alias("http_method"), F.concat(slug, F.lit("/{id}")).alias("normalized_path"), read.alias("body"))
    bodies = o.select(id, F.inline(F.array(post, get)))
    status = F.when(F.col("http_method") == "POST", "201").otherwise("200")
    rows = _endpoint_rows(_merged_schemas(bodies, aggregate.ENDPOINT), status)
    return behaviour.write_read_completeness(behaviour.endpoint_fields(rows))


@query(
    f"WITH {_STORED} SELECT 'POST' AS http_method, normalized_path, CAST(write_field_count AS INT) AS write_field_count, CAST(read_field_count AS INT) AS read_field_count, "
    "least(write_field_count / read_field_count, 1.0) AS completeness, missing FROM m"
)
def write_read_completeness(spark, sf):
    out = _stored_completeness(spark, sf)
    # a set, as the order of optional fields is that of the bodies; named in the order of the oracle
    order = F.array(*(F.lit(x) for x in ("status", "total", "priority")))
    return out.withColumn("missing", F.array_join(F.array_intersect(order, "missing_fields"), ",")).drop("missing_fields")


@query(f"WITH {_STORED} SELECT normalized_path, least(write_field_count / read_field_count, 1.0) AS completeness FROM m WHERE write_field_count / read_field_count < 0.5")
def thin_responses(spark, sf):
    return behaviour.thin_responses(_stored_completeness(spark, sf)).select("normalized_path", "completeness")


@query(
    f"WITH {_STORED} SELECT count(*) AS endpoints, round(avg(least(write_field_count / read_field_count, 1.0)), 9) AS avg_completeness, "
    "count(*) FILTER (WHERE write_field_count / read_field_count < 0.5) AS thin FROM m"
)
def completeness_summary(spark, sf):
    out = behaviour.completeness_summary(_stored_completeness(spark, sf))
    return out.withColumn("avg_completeness", F.round("avg_completeness", 9))


@query(
    f"WITH {ad.RPC_SAMPLES}, t AS (SELECT DISTINCT split_part(op, ':', 2) AS tool, size % 5 AS extra FROM rpc WHERE starts_with(op, 'tools/call:')), "
    "m AS (SELECT tool, max(extra) + 1 AS k FROM t GROUP BY 1) SELECT 'tools/call:' || a.tool AS normalized_path, CAST(a.k AS INT) AS write_field_count, "
    "CAST(b.k AS INT) AS read_field_count, least(a.k / b.k, 1.0) AS completeness FROM m a JOIN m b ON starts_with(a.tool, 'create_') AND b.tool = 'get_' || right(a.tool, 2)"
)
def tool_completeness(spark, sf):
    s = ad.rpc_samples(spark, sf).where("jsonrpc_tool is not null")
    names = F.transform(F.sequence(F.lit(0), F.col("size") % 5), lambda i: F.concat(F.lit("f"), i.cast("string")))
    fields = s.select(F.col("jsonrpc_tool").alias("tool"), names.alias("fields"), (F.col("session_id").cast("long") * 1000 + F.col("id")).alias("ord"))
    return behaviour.tool_completeness(fields).select(
        "normalized_path", "write_field_count", "read_field_count", "completeness"
    )


_EXTENDED = f"""
WITH {ad.EVENT_SAMPLES}, p AS (SELECT session_id, http_method || ' ' || normalized_path AS a, lead(http_method || ' ' || normalized_path) OVER w AS b
  FROM samples WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
s AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2),
steps AS (SELECT a AS key, string_agg(b, '|' ORDER BY n DESC, b) AS next_steps FROM s GROUP BY 1),
l AS (SELECT a AS key, n FROM s WHERE (a = 'POST /orders' AND b = 'GET /orders/{{orderId}}') OR (a = 'POST /users' AND b = 'GET /users/{{userId}}')),
e AS (SELECT http_method AS m, normalized_path AS p, CASE WHEN event_type = 'purchase' AND CAST(k AS INT) % 50 = 0 THEN 3 WHEN event_type = 'purchase' THEN 1
  WHEN event_type = 'view' AND CAST(k AS INT) % 7 = 0 THEN 4 ELSE 2 END AS f FROM samples WHERE event_type IN ('purchase', 'view')),
c AS (SELECT 'POST /orders' AS key, max(CASE WHEN m = 'POST' THEN f END) AS w, max(CASE WHEN m = 'GET' THEN f END) AS r FROM e)
SELECT key, next_steps, l.n AS loop_count, CASE WHEN w IS NOT NULL THEN floor(least(w / r, 1.0) * 100 + 0.5) / 100 END AS completeness
FROM steps LEFT JOIN l USING (key) LEFT JOIN c USING (key)"""


@query(_EXTENDED)
def agent_extensions(spark, sf):
    """Extensions of all events as one session; fields of orders' bodies depend on k."""
    events = ad.event_samples(spark, sf)
    s = behaviour.rest_sequences(events)
    key = lambda side: F.concat_ws(" ", f"{side}_method", f"{side}_path")
    total = s.groupBy(key("from").alias("from_key"), key("to").alias("to_key"), "from_method", "from_path", "to_method", "to_path").agg(F.sum("n").alias("n"))
    pattern = text.rest_pattern(F.col("from_method"), F.col("from_path"), F.col("to_method"), F.col("to_path"), F.lit(0.0))
    seqs = total.select("from_key", "to_key", "n", pattern.alias("pattern"), F.struct(-F.col("n"), "to_key").alias("ord"))
    k = F.get_json_object("response_body", "$.k").cast("int")
    write = F.when(k % 50 == 0, 3).otherwise(1)
    read = F.when(k % 7 == 0, 4).otherwise(2)
    size = F.when(F.col("http_method") == "POST", write).otherwise(read)
    body = F.to_json(F.map_from_entries(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")), i))))
    kept = events.where("(http_method = 'POST' AND normalized_path = '/orders') OR normalized_path = '/orders/{orderId}'")
    schemas = _merged_schemas(kept.select(*aggregate.ENDPOINT, "id", body.alias("body")), aggregate.ENDPOINT)
    fields = behaviour.endpoint_fields(_endpoint_rows(schemas, F.lit("200")))
    scored = behaviour.write_read_completeness(fields).withColumn("key", F.concat_ws(" ", *aggregate.ENDPOINT))
    out = behaviour.agent_extensions(seqs, scored)
    return out.select("key", F.array_join("next_steps", "|").alias("next_steps"), "loop_count", "completeness")


@query(
    "WITH s AS (SELECT user_id % 20 AS project, user_id, min(ts) AS created_at, count(*) AS n FROM events GROUP BY 1, 2) "
    "SELECT project, user_id AS session, n FROM s QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, user_id DESC) = 1"
)
def sessions_latest(spark, sf):
    s = ad.table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("project"), "user_id")
    s = s.agg(F.min("ts").alias("created_at"), F.count("*").alias("n"))
    return s.groupBy("project").agg(F.max_by(F.struct("user_id", "n"), F.struct("created_at", "user_id")).alias("x")).select(
        "project", F.col("x.user_id").alias("session"), F.col("x.n").alias("n")
    )


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS size, doc_id % 3 AS kind FROM documents)
SELECT CASE kind WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/plain' ELSE 'APPLICATION/JSON' END AS content_type,
  count(*) FILTER (WHERE kind <> 1 AND size > 2000) AS skipped, count(*) FILTER (WHERE NOT (kind <> 1 AND size > 2000)) AS kept,
  count(*) FILTER (WHERE kind <> 1 AND size <= 2000) AS with_body FROM d GROUP BY 1""")
def capture_filter(spark, sf):
    kind = F.col("doc_id") % 3
    content = F.when(kind == 0, "application/json; charset=utf-8").when(kind == 1, "text/plain").otherwise("APPLICATION/JSON")
    pairs = ad.table(spark, sf, "documents").select(
        F.lit("GET").alias("method"),
        F.lit(None).cast("string").alias("request_content_type"),
        F.lit(None).cast("string").alias("request_body"),
        content.alias("response_content_type"),
        F.col("text").alias("response_body"),
    )
    out = keep_pairs(pairs, 2000)
    return out.groupBy(F.col("response_content_type").alias("content_type")).agg(
        F.count_if("skipped").alias("skipped"),
        F.count_if(~F.col("skipped")).alias("kept"),
        F.count_if(F.col("response_body").isNotNull() & ~F.col("skipped")).alias("with_body"),
    )


_SPEC = """
WITH p AS (SELECT p_brand AS brand, p_partkey % 2 AS side, p_size, p_partkey, CAST(p_size % 10 AS INT) AS d, p_partkey % 100 = 0 AS odd FROM part),
g AS (SELECT brand, side, count(*) AS n, count(*) FILTER (WHERE NOT odd) AS plain, count(*) FILTER (WHERE p_partkey % 30 = 0 AND NOT odd) AS t,
  count(*) FILTER (WHERE d > 0 AND NOT odd) AS w FROM p GROUP BY 1, 2),
x AS (SELECT a.brand, a.n > a.plain AS ua, b.n > b.plain AS ub, a.plain AS ap, b.plain AS bp, a.t AS ta, b.t AS tb, a.w AS aw, b.w AS bw FROM g a JOIN g b ON a.brand = b.brand AND a.side = 0 AND b.side = 1),
y AS (SELECT * FROM x WHERE NOT ua AND NOT ub)"""


@query(f"""{_SPEC}
SELECT brand, '$.spec' AS path, 'incompatible_type_change' AS kind, true AS breaking FROM x WHERE ua AND NOT ub
UNION ALL SELECT brand, '$.spec', 'type_expanded', false FROM x WHERE ub AND NOT ua
UNION ALL SELECT brand, '$.spec.tag', CASE WHEN tb = 0 THEN CASE WHEN ta = ap THEN 'required_field_removed' ELSE 'optional_field_removed' END
  ELSE CASE WHEN tb = bp THEN 'required_field_added' ELSE 'optional_field_added' END END, CASE WHEN tb = 0 THEN ta = ap ELSE tb = bp END FROM y WHERE (ta > 0) <> (tb > 0)
UNION ALL SELECT brand, '$.spec.deep.w', CASE WHEN bw = bp THEN 'field_became_required' ELSE 'field_became_optional' END, bw = bp FROM y
  WHERE aw > 0 AND bw > 0 AND (aw = ap) <> (bw = bp)
UNION ALL SELECT brand, '$.spec.deep.w', CASE WHEN bw = 0 THEN CASE WHEN aw = ap THEN 'required_field_removed' ELSE 'optional_field_removed' END
  ELSE CASE WHEN bw = bp THEN 'required_field_added' ELSE 'optional_field_added' END END, CASE WHEN bw = 0 THEN aw = ap ELSE bw = bp END FROM y WHERE (aw > 0) <> (bw > 0)""")
def schema_diff_nested(spark, sf):
    """Changes of nested schemas between the parts of even and odd keys, per brand; a rare text makes spec a union."""
    p = ad.table(spark, sf, "part")
    key, d = F.col("p_partkey"), F.col("p_size") % 10
    deep = F.struct(F.when(d > 0, d).alias("w"), F.lit(1).alias("z"))
    spec = F.to_json(F.struct(F.when(key % 30 == 0, F.lit("t")).alias("tag"), deep.alias("deep")))
    body = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"spec":'), F.when(key % 100 == 0, F.lit('"none"')).otherwise(spec), F.lit("}"))
    rows = p.select(F.col("p_brand").alias("brand"), (key % 2).alias("side"), key.alias("id"), body.alias("body"))
    nodes = written(models.schema_nodes(_merged_schemas(rows, ["brand", "side"]), ["brand", "side"]), "nodes")
    sides = (nodes.where(F.col("side") == s).drop("side") for s in (0, 1))
    return diff.nested_changes(*sides, ["brand"]).select("brand", "path", "kind", "breaking")


_MODELS = """
WITH b AS (SELECT '/' || lower(replace(p_brand, '#', '')) || '/' || 'k' || CAST(p_partkey % 40 AS VARCHAR) || '/items/{id}' AS path, *, p_size % 10 <> 0 AND p_brand <> 'Brand#11' AS priced FROM part),
e AS (SELECT path, count(*) FILTER (WHERE priced) > 0 AS has_price, count(*) FILTER (WHERE priced AND p_retailprice <> floor(p_retailprice)) > 0 AS is_number,
  count(*) FILTER (WHERE p_size > 45) > 0 AS has_size, count(*) FILTER (WHERE p_type = 'ECONOMY') > 0 AS has_inner FROM b GROUP BY path),
s AS (SELECT path, concat_ws(',', has_price, has_price AND is_number, has_size, has_inner) AS shape, 1 + CAST(has_price AS INT) + CAST(has_size AS INT) + CAST(has_inner AS INT) AS n FROM e)"""


@query(
    f"{_MODELS}, g AS (SELECT shape, count(*) AS endpoints, min(path) AS first FROM s WHERE n >= 2 GROUP BY shape HAVING count(*) >= 2), "
    "k AS (SELECT *, row_number() OVER (ORDER BY first) AS i FROM g) SELECT 'Item' || CASE WHEN i = 1 THEN '' ELSE CAST(i AS VARCHAR) END AS name, endpoints, first FROM k"
)
def domain_models(spark, sf):
    """Models that the items of a thousand endpoints share: which fields their bodies hold depends on the parts."""
    nodes = models.keyed_nodes(_part_endpoints(spark, sf))
    return models.shared_models(nodes).select("name", "endpoints", F.col("normalized_path").alias("first"))


@query(
    f"{_MODELS}, g AS (SELECT shape FROM s WHERE n >= 2 GROUP BY shape HAVING count(*) >= 2), i AS (SELECT count(*) AS inner_uses FROM e WHERE has_inner) "
    "SELECT path, n >= 2 AND shape IN (FROM g) AS whole, has_inner AND inner_uses >= 2 AS inside FROM s JOIN e USING (path), i"
)
def model_references(spark, sf):
    """Which endpoints refer to a model with their whole response, and which hold one inside."""
    nodes = models.keyed_nodes(_part_endpoints(spark, sf))
    found = models.references(nodes, models.shared_models(nodes, nested=True), nested=True)
    used = found.groupBy(F.col("normalized_path").alias("path")).agg(F.count_if(F.col("path") == "").alias("w"), F.count_if(F.col("path") == ".spec").alias("i"))
    every = nodes.select(F.col("normalized_path").alias("path")).distinct()
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return every.join(used, "path", "left").select("path", has("w").alias("whole"), has("i").alias("inside"))


def _part_endpoints(spark, sf):
    p = ad.table(spark, sf, "part")
    path = F.concat(F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/k"), (F.col("p_partkey") % 40).cast("string"), F.lit("/items/{id}"))
    body = F.struct(
        F.col("p_partkey").alias("id"),
        F.when((F.col("p_size") % 10 != 0) & (F.col("p_brand") != "Brand#11"), F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_size") > 45, F.col("p_size")).alias("size"),
        F.when(F.col("p_type") == "ECONOMY", F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("n"))).alias("spec"),
    )
    rows = p.select(F.lit("GET").alias("http_method"), path.alias("normalized_path"), F.col("p_partkey").alias("id"), F.to_json(body).alias("body"))
    return _endpoint_rows(_merged_schemas(rows, aggregate.ENDPOINT), F.lit("200"))


@query(
    f"WITH {ad.EVENT_SAMPLES} SELECT http_method, normalized_path, CASE normalized_path WHEN '/orders/{{orderId}}' THEN 'getOrdersOrderId' "
    "WHEN '/users/{userId}' THEN 'getUsersUserId' WHEN '/users' THEN 'postUsers' ELSE lower(http_method) || 'Orders' END AS operation_id, "
    "CAST(CASE WHEN contains(normalized_path, '{') OR (http_method = 'GET' AND normalized_path = '/orders') THEN 1 ELSE 0 END AS INT) AS n_params, "
    "CAST(count(DISTINCT status_code) AS INT) AS n_responses, count(*) AS sample_count FROM samples GROUP BY 1, 2"
)
def openapi_document(spark, sf):
    none = F.lit(None)
    headers = none.cast("array<struct<name:string,example:string>>")
    s = ad.event_samples(spark, sf).withColumns(
        {"session_id": F.lit("all"), "request_body": none.cast("string"), "request_headers": headers, "response_headers": headers}
    )
    doc = documents.document(aggregate_session(s), metadata=True)
    rows = [
        (method.upper(), path, op["operationId"], len(op.get("parameters", [])), len(op["responses"]), op["x-quern-sample-count"])
        for path, item in doc["paths"].items()
        for method, op in item.items()
    ]
    return spark.createDataFrame(
        rows, "http_method string, normalized_path string, operation_id string, n_params int, n_responses int, sample_count long"
    )
