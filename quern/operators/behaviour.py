"""Client behaviour: call pairs, phases, repeated calls and their causes, thin write responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import (
    is_read_tool,
    is_write_tool,
    operation_key,
    rest_pattern,
    rpc_pattern,
    same_resource_key,
    tool_resource,
)
from quern.operators.ordered import ranged, running_sum, with_previous

#: Operations that a session needs once.
ONCE = ["initialize", "tools/list", "notifications/initialized"]


def _session():
    """Calls of a session in time; ids break ties."""
    return Window.partitionBy("session_id").orderBy("captured_at", "id")


def with_operation(samples: DataFrame) -> DataFrame:
    """Adds op (operation key) and ms (time) to samples."""
    key = operation_key(
        F.col("jsonrpc_method"), F.col("jsonrpc_tool"), F.col("http_method"), F.col("normalized_path")
    )
    return samples.withColumns({"op": key, "ms": F.unix_millis("captured_at")})


def _sent(path: str) -> Column:
    """The facts of one path of a sample's request."""
    return F.filter("request_facts", lambda f: f["path"] == path)


def rpc_shaped(samples: DataFrame) -> Column:
    """Whether a sample's request is an object with ``jsonrpc`` and ``method``, by its stored facts."""
    if "request_facts" not in samples.columns:
        return F.lit(False)
    both = F.forall(F.array(F.lit(".jsonrpc"), F.lit(".method")), lambda p: F.exists("request_facts", lambda f: f["path"] == p))
    return F.coalesce(both, F.lit(False))


def with_rpc(samples: DataFrame) -> DataFrame:
    """Samples whose JSON-RPC method and tool, where not stored, come from the strings among their request's facts."""
    if "request_facts" not in samples.columns:
        return samples
    text = lambda path: F.get(F.get(_sent(path), F.lit(0))["values"], F.lit(0))
    found = F.when(rpc_shaped(samples), text(".method"))
    method = F.coalesce(F.col("jsonrpc_method"), found)
    tool = F.when(F.col("jsonrpc_method").isNull() & (found == "tools/call"), text(".params.name"))
    return samples.withColumns({"jsonrpc_method": method, "jsonrpc_tool": F.coalesce(F.col("jsonrpc_tool"), tool)})


def session_kind(samples: DataFrame, share: float = 0.8) -> DataFrame:
    """session_id and is_jsonrpc: more than ``share`` of its samples are POSTs with a JSON-RPC method or request."""
    rpc = (F.col("http_method") == "POST") & (F.col("jsonrpc_method").isNotNull() | rpc_shaped(samples))
    return samples.groupBy("session_id").agg((F.avg(rpc.cast("int")) > share).alias("is_jsonrpc"))


def rest_sequences(samples: DataFrame, loop_ms: float = 2000) -> DataFrame:
    """Pairs of calls in a row per session: count, mean delay (rounded half up) and pattern."""
    ms = F.unix_millis("captured_at")
    pair = samples.select(
        "session_id",
        F.col("http_method").alias("from_method"),
        F.col("normalized_path").alias("from_path"),
        F.lead("http_method").over(_session()).alias("to_method"),
        F.lead("normalized_path").over(_session()).alias("to_path"),
        (F.lead(ms).over(_session()) - ms).alias("delay"),
    ).where(F.col("to_method").isNotNull())
    return _rest_patterns(pair, loop_ms)


def rest_sequences_by_range(samples: DataFrame, loop_ms: float = 2000, partitions: int | None = None) -> DataFrame:
    """The same where one session may hold much of all calls: by ranges instead of a window over a session."""
    calls = samples.select(
        "session_id", "captured_at", "id", "http_method", "normalized_path", F.unix_millis("captured_at").alias("ms")
    )
    seen = with_previous(ranged(calls, partitions), ["http_method", "normalized_path", "ms"])
    pair = seen.where("before is not null and http_method is not null").select(
        "session_id",
        F.col("before.http_method").alias("from_method"),
        F.col("before.normalized_path").alias("from_path"),
        F.col("http_method").alias("to_method"),
        F.col("normalized_path").alias("to_path"),
        (F.col("ms") - F.col("before.ms")).alias("delay"),
    )
    return _rest_patterns(pair, loop_ms)


def _rest_patterns(pair: DataFrame, loop_ms: float) -> DataFrame:
    keys = ["session_id", "from_method", "from_path", "to_method", "to_path"]
    grouped = pair.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delay").alias("mean_delay"))
    scaled = F.col("mean_delay") * (2000.0 / loop_ms)
    return grouped.select(
        *keys,
        "n",
        F.floor(F.col("mean_delay") + 0.5).cast("long").alias("avg_delay"),
        rest_pattern(*(F.col(k) for k in keys[1:]), scaled).alias("pattern"),
    )


def rpc_sequences(samples: DataFrame, window: int = 5) -> DataFrame:
    """Known patterns between a JSON-RPC call and the following ``window`` - 1 ones of its session."""
    ops = with_operation(samples)
    ahead = [
        F.struct(F.lead("op", k).over(_session()).alias("to_op"), (F.lead("ms", k).over(_session()) - F.col("ms")).alias("delay"))
        for k in range(1, window)
    ]
    wide = ops.select("session_id", F.col("op").alias("from_op"), F.array(*ahead).alias("ahead"))
    pairs = wide.select("session_id", "from_op", F.inline("ahead")).where("to_op is not null")
    pairs = pairs.withColumn("pattern", rpc_pattern(F.col("from_op"), F.col("to_op"))).where("pattern != 'unknown'")
    return pairs.groupBy("session_id", "from_op", "to_op", "pattern").agg(
        F.count("*").alias("n"), F.floor(F.avg("delay") + 0.5).cast("long").alias("avg_delay")
    )


def tool_usage(samples: DataFrame) -> DataFrame:
    """Calls of each operation of a session and the place of the first one."""
    ops = with_operation(samples).withColumn("place", F.row_number().over(_session()) - 1)
    return ops.groupBy("session_id", "op").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def redundant_calls(usage: DataFrame) -> DataFrame:
    """Operations that a session needs once and called more often."""
    return usage.where(F.col("op").isin(ONCE) & (F.col("n") > 1)).select("session_id", "op", "n", F.lit(1).alias("expected"))


def wasted_requests(sequences: DataFrame, redundant: DataFrame) -> DataFrame:
    """Per session: calls in loops, repeated lists and retries, and repeats of once-only operations."""
    looped = sequences.where(F.col("pattern").isin("verification_loop", "redundant_list", "retry"))
    both = looped.select("session_id", "n").union(redundant.select("session_id", (F.col("n") - 1).alias("n")))
    return both.groupBy("session_id").agg(F.sum("n").alias("wasted"))


def phase_rows(samples: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Samples with op, ms, place and phase (from 0): a gap of more than ``gap_ms`` starts a phase."""
    ops = with_operation(samples).withColumn("place", F.row_number().over(_session()) - 1)
    gap = (F.col("ms") - F.lag("ms").over(_session()) > gap_ms).cast("int")
    running = _session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ops.withColumn("new", F.coalesce(gap, F.lit(0))).withColumn("phase", F.sum("new").over(running)).drop("new")


def phase_rows_by_range(samples: DataFrame, gap_ms: int = 2000, partitions: int | None = None) -> DataFrame:
    """The same where one session may hold much of all calls: by ranges instead of windows over a session."""
    seen = with_previous(ranged(with_operation(samples), partitions), ["ms"])
    gap = (F.col("ms") - F.col("before.ms") > gap_ms).cast("int")
    marked = seen.withColumn("new", F.coalesce(gap, F.lit(0)))
    return running_sum(marked, "new", "phase").drop("new", "before", "part")


def writes_reads(rows: DataFrame) -> tuple[Column, Column]:
    """Whether a call with its op writes, and whether it reads."""
    rpc = F.col("jsonrpc_method").isNotNull()
    tool, method = F.col("jsonrpc_tool"), F.col("http_method")
    write_tool, read_tool = F.coalesce(is_write_tool(tool), F.lit(False)), F.coalesce(is_read_tool(tool), F.lit(False))
    write = F.when(rpc, write_tool).otherwise(method.isin("POST", "PUT", "PATCH", "DELETE"))
    listing = tool.isNull() & F.col("op").isin("tools/list", "initialize")
    read = F.when(rpc, read_tool & ~write_tool | listing).otherwise(method.isin("GET", "HEAD", "OPTIONS"))
    return write, read


def phases(rows: DataFrame) -> DataFrame:
    """Named phases: any write makes creation; reads alone are verification after a creation, else discovery."""
    write, read = writes_reads(rows)
    each = rows.groupBy("session_id", "phase").agg(
        F.count("*").alias("n"),
        F.max(write.cast("int")).alias("w"),
        F.max(read.cast("int")).alias("r"),
        F.min("place").alias("start_index"),
        F.max("place").alias("end_index"),
        (F.max("ms") - F.min("ms")).alias("duration"),
    )
    return named_phases(each)


def named_phases(each: DataFrame) -> DataFrame:
    """Names for rows of phases (session_id, phase, ...) with w and r: any write, any read."""
    before = Window.partitionBy("session_id").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    name = (
        F.when(F.col("w") == 1, "creation")
        .when((F.col("r") == 1) & (F.coalesce(F.max("w").over(before), F.lit(0)) == 1), "verification")
        .when(F.col("r") == 1, "discovery")
        .otherwise("operation")
    )
    return each.withColumn("name", name).drop("w", "r")


def phase_tools(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Distinct phase names of each tool (or operation) of a session, in order of first sight."""
    tool = F.coalesce("jsonrpc_tool", "op").alias("tool")
    seen = rows.join(named.select("session_id", "phase", "name"), ["session_id", "phase"])
    first = seen.groupBy("session_id", tool, "name").agg(F.min("place").alias("at"))
    return first.groupBy("session_id", "tool").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("phases")
    )


def call_pairs(rows: DataFrame, named: DataFrame, restart_ms: int = 30000) -> DataFrame:
    """Two calls of one operation in a row: delay, what lies between, and the cause of the repeat.

    ``rows`` are phase rows with request_shape and response_shape (null-safe compared fingerprints).
    """
    seen = rows.join(named.select("session_id", "phase", F.col("name").alias("phase_name")), ["session_id", "phase"])
    w = Window.partitionBy("session_id", "op").orderBy("place")
    nxt = lambda c: F.lead(c).over(w)
    out = seen.select(
        "session_id",
        "op",
        F.col("place").alias("from_index"),
        nxt("place").alias("to_index"),
        (nxt("ms") - F.col("ms")).alias("delta_ms"),
        F.col("status_code").alias("from_status"),
        (nxt("phase_name") != F.col("phase_name")).alias("cross_phase"),
        F.col("request_shape").eqNullSafe(nxt("request_shape")).alias("same_request"),
        F.col("response_shape").eqNullSafe(nxt("response_shape")).alias("same_response"),
    ).where("to_index is not null")
    cause = (
        F.when(F.coalesce(F.col("from_status") >= 400, F.lit(False)), "retry_after_error")
        .when(~F.col("same_request"), "different_params")
        .when(F.col("delta_ms") > restart_ms, "session_restart")
        .when(F.col("cross_phase"), "different_phase")
        .when(~F.col("same_response"), "different_response")
        .otherwise("identical_response")
    )
    return out.withColumn("cause", cause)


def intervening(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the operations between their two calls, in order (bounded by the pair's own span)."""
    between = pairs.where("to_index - from_index > 1").select(
        "session_id", "op", "from_index", F.explode(F.sequence(F.col("from_index") + 1, F.col("to_index") - 1)).alias("place")
    )
    ops = rows.select("session_id", "place", F.col("op").alias("between_op"))
    listed = (
        between.join(ops, ["session_id", "place"])
        .groupBy("session_id", "op", "from_index")
        .agg(F.array_sort(F.collect_list(F.struct("place", "between_op"))).alias("x"))
        .select("session_id", "op", "from_index", F.col("x.between_op").alias("intervening"))
    )
    return pairs.join(listed, ["session_id", "op", "from_index"], "left")


def primary_causes(pairs: DataFrame) -> DataFrame:
    """The most frequent cause of each operation's repeats; among equals the one seen first."""
    counted = pairs.groupBy("session_id", "op", "cause").agg(F.count("*").alias("n"), F.min("from_index").alias("first"))
    return counted.groupBy("session_id", "op").agg(
        F.sum("n").alias("pairs"), F.max_by("cause", F.struct("n", -F.col("first"))).alias("primary_cause")
    )


def write_read_completeness(fields: DataFrame) -> DataFrame:
    """Write responses against what the matching GET returns.

    ``fields``: http_method, normalized_path, ord (input order) and fields (top-level names of the
    success response, in order; null without one). PUT and PATCH match a GET of their own path first;
    else a GET with one parameter more, the first in order.
    """
    gets = fields.where("http_method = 'GET'").select(
        F.col("normalized_path").alias("get_path"),
        F.col("ord").alias("get_ord"),
        F.col("fields").alias("read_fields"),
    )
    parent = F.when(
        F.col("get_path").rlike(r"/\{[^/]*\}\z"),
        F.coalesce(F.nullif(F.regexp_replace("get_path", r"/\{[^/]*\}\z", ""), F.lit("")), F.lit("/")),
    )
    writes = fields.where(F.col("http_method").isin("POST", "PUT", "PATCH"))
    same = gets.select(F.col("get_path").alias("normalized_path"), "get_path", "get_ord", "read_fields", F.lit(0).alias("rank"))
    item = gets.select(parent.alias("normalized_path"), "get_path", "get_ord", "read_fields", F.lit(1).alias("rank"))
    matches = writes.join(same.union(item), "normalized_path").where("rank = 1 or http_method != 'POST'")
    best = matches.groupBy("http_method", "normalized_path").agg(
        F.min_by(F.struct("get_path", "read_fields", F.col("fields").alias("write_fields")), F.struct("rank", "get_ord")).alias("m")
    )
    return _completeness(best.select("http_method", "normalized_path", "m.*"))


def _completeness(rows: DataFrame) -> DataFrame:
    w, r = F.size("write_fields"), F.size("read_fields")
    kept = rows.where(F.col("write_fields").isNotNull() & (r > 0))
    return kept.select(
        "http_method",
        "normalized_path",
        w.alias("write_field_count"),
        r.alias("read_field_count"),
        F.least(w / r, F.lit(1.0)).alias("completeness"),
        F.array_except("read_fields", "write_fields").alias("missing_fields"),
    )


def tool_completeness(fields: DataFrame) -> DataFrame:
    """The same for tools (tool, ord, fields): a read tool of the same resource, else of its plural or singular.

    Of a tool's responses the one with most fields counts, the first among equals.
    """
    size = F.size(F.coalesce("fields", F.array().cast("array<string>")))
    richest = fields.groupBy("tool").agg(
        F.max_by("fields", F.struct(size, -F.col("ord"))).alias("fields"), F.min("ord").alias("ord")
    )
    richest = richest.withColumns({"resource": tool_resource(F.col("tool"))})
    richest = richest.withColumn("key", same_resource_key(F.col("resource")))
    reads = richest.where(is_read_tool(F.col("tool"))).select(
        "key", F.col("resource").alias("read_resource"), F.col("fields").alias("read_fields"), F.col("ord").alias("read_ord")
    )
    writes = richest.where(is_write_tool(F.col("tool")))
    inexact = (F.col("resource") != F.col("read_resource")).cast("int")
    best = (
        writes.join(reads, "key")
        .groupBy("tool")
        .agg(
            F.min_by(
                F.struct("read_fields", F.col("fields").alias("write_fields")), F.struct(inexact, F.col("read_ord"))
            ).alias("m")
        )
    )
    return _completeness(
        best.select(F.lit("tools/call").alias("http_method"), F.concat(F.lit("tools/call:"), "tool").alias("normalized_path"), "m.*")
    )


def thin_responses(completeness: DataFrame, below: float = 0.5) -> DataFrame:
    """Write responses that return too little."""
    return completeness.where(F.col("completeness") < below)


def completeness_summary(completeness: DataFrame, below: float = 0.5) -> DataFrame:
    """One row: how many writes were compared, their mean completeness (0 for none) and how many are thin."""
    return completeness.agg(
        F.count("*").alias("endpoints"),
        F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("avg_completeness"),
        F.count_if(F.col("completeness") < below).alias("thin"),
    )


def endpoint_fields(endpoints: DataFrame) -> DataFrame:
    """http_method, normalized_path, ord and fields: the top-level names, in order, of each endpoint's stored success response.

    That is the response of status 200, else 201, else the first of 2xx; without one fields is null. A
    response that is no plain object has no fields.
    """
    other = F.get(F.array_sort(F.filter(F.map_keys("response_schemas"), lambda c: c.startswith("2"))), F.lit(0))
    schema = F.coalesce(*(F.try_element_at("response_schemas", c) for c in (F.lit("200"), F.lit("201"), other)))
    read = F.from_json(schema, "type string, properties map<string,string>, oneOf array<string>")
    plain = (read["type"] == "object") & read["oneOf"].isNull() & read["properties"].isNotNull()
    names = F.when(plain, F.map_keys(read["properties"])).otherwise(F.array().cast("array<string>"))
    return endpoints.select("http_method", "normalized_path", F.col("normalized_path").alias("ord"), F.when(schema.isNotNull(), names).alias("fields"))


def tool_fields(samples: DataFrame) -> DataFrame:
    """tool, ord and fields of each response to a tool's call, from its stored facts: names as they stand in the body."""
    top = F.filter("response_facts", lambda f: f["path"].rlike(r"^\.(?:[^.\[\\]|\\.)*\z"))
    names = F.transform(
        F.array_sort(F.transform(top, lambda f: F.struct(f["ord"], f["path"]))),
        lambda f: F.regexp_replace(F.substr(f["path"], F.lit(2)), r"\\(.)", "$1"),
    )
    kept = with_rpc(samples).where("jsonrpc_tool is not null and size(response_facts) > 0")
    return kept.select(F.col("jsonrpc_tool").alias("tool"), F.unix_micros("captured_at").alias("ord"), names.alias("fields"))


def session_extensions(samples: DataFrame, endpoints: DataFrame) -> DataFrame:
    """key and extension (JSON text) of one session: ``METHOD /template`` or JSON-RPC operation, with what is known of it.

    Steps come by falling number of calls, then by name.
    """
    found = session_kind(samples).first()
    rpc = bool(found and found["is_jsonrpc"])
    if rpc:
        seqs = rpc_sequences(with_rpc(samples)).select(F.col("from_op").alias("from_key"), F.col("to_op").alias("to_key"), "pattern", "n")
        scored = tool_completeness(tool_fields(samples)).withColumn("key", F.col("normalized_path"))
    else:
        key = lambda side: F.concat_ws(" ", f"{side}_method", f"{side}_path")
        seqs = rest_sequences(samples).select(key("from").alias("from_key"), key("to").alias("to_key"), "pattern", "n")
        scored = write_read_completeness(endpoint_fields(endpoints)).withColumn("key", F.concat_ws(" ", "http_method", "normalized_path"))
    out = agent_extensions(seqs.withColumn("ord", F.struct(-F.col("n"), "to_key")), scored)
    return out.select(
        "key",
        F.to_json(
            F.struct(
                F.col("completeness").alias("responseCompleteness"),
                F.when(F.size("missing_fields") > 0, F.col("missing_fields")).alias("missingFields"),
                F.when(F.col("loop_count").isNotNull(), F.lit(True)).alias("verificationLoopDetected"),
                F.col("loop_count").alias("verificationLoopCount"),
                F.col("next_steps").alias("commonNextSteps"),
            )
        ).alias("extension"),
    )


def attach_extensions(endpoints: DataFrame, extensions: DataFrame) -> DataFrame:
    """Endpoint rows with the extension of their ``METHOD /template``; the others have none."""
    key = F.concat_ws(" ", "http_method", "normalized_path")
    return endpoints.withColumn("key", key).join(extensions, "key", "left").drop("key")


def agent_extensions(sequences: DataFrame, completeness: DataFrame) -> DataFrame:
    """One row per endpoint key: response completeness, loop count of the last loop, and next steps in order.

    ``sequences``: from_key, to_key, pattern, n, ord. ``completeness``: key, completeness, missing_fields.
    """
    loops = sequences.where("pattern = 'verification_loop'").groupBy(F.col("from_key").alias("key")).agg(
        F.max_by("n", "ord").alias("loop_count")
    )
    steps = sequences.groupBy(F.col("from_key").alias("key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "to_key"))), lambda x: x["to_key"]).alias("next_steps")
    )
    scored = completeness.select("key", F.round("completeness", 2).alias("completeness"), "missing_fields")
    return steps.join(loops, "key", "full_outer").join(scored, "key", "full_outer")
