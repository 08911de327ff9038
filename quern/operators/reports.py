"""Texts for people: explanations of repeated calls, reports of a session, and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in an operation that suggest a change of state.
CHANGE = "(?i)create|update|set|put|patch|add|insert|delete|remove|register|configure"


def explanation(cause: Column, between: Column, mean_delta: Column, status: Column, max_gap: Column, phases: Column) -> Column:
    """Why an operation was called again, from its most frequent cause.

    ``between``: distinct operations between the calls; ``phases``: names of the phases it was called in.
    """
    writes = F.filter(between, lambda o: o.rlike(CHANGE))
    bare = F.transform(writes, lambda o: F.regexp_replace(o, "^tools/call:", ""))
    identical = (
        F.when((F.size(between) == 0) & (mean_delta < 1000), "called back to back with nothing in between, as by a framework")
        .when(F.size(between) == 0, "called again with nothing in between: the client does not cache it")
        .when(
            F.size(writes) > 0,
            F.concat(F.lit("fetched again after writes ("), F.array_join(bare, ", "), F.lit(") but nothing had changed")),
        )
        .otherwise(F.concat(F.lit("fetched again after "), F.size(between).cast("string"), F.lit(" other operations, unchanged")))
    )
    return (
        F.when(cause == "identical_response", identical)
        .when(cause == "retry_after_error", F.concat(F.lit("the call before returned "), status.cast("string")))
        .when(cause == "different_params", "the requests differ, so the calls are distinct")
        .when(
            cause == "session_restart",
            F.concat(F.floor(max_gap / 1000 + 0.5).cast("string"), F.lit(" s passed between calls, as after a restart")),
        )
        .when(cause == "different_phase", F.concat(F.lit("called once per phase: "), F.array_join(phases, ", ")))
        .when(cause == "different_response", "the response had changed in between")
        .otherwise("no cause could be told")
    )


def recommendation(cause: Column, after_writes: Column) -> Column:
    """What to do about one cause."""
    return (
        F.when((cause == "identical_response") & after_writes, "cache it until a write that concerns it")
        .when(cause == "identical_response", "cache the first response for the session")
        .when(cause == "retry_after_error", "retrying is right; wait longer each time")
        .when(cause == "different_params", "nothing to do")
        .when(cause == "session_restart", "find out why the session restarted; let the cache outlive it")
        .when(cause == "different_phase", "cache it within a phase")
        .when(cause == "different_response", "fetching again was right; a subscription may replace polling")
        .otherwise("look at the calls")
    )


def investigations(rows: DataFrame, named: DataFrame, pairs: DataFrame, causes: DataFrame) -> DataFrame:
    """session_id, op, pairs, primary_cause, explanation and recommendations (one per distinct cause, as first seen).

    ``pairs`` carry ``intervening``. Distinct names are collected, never the calls themselves.
    """
    key = ["session_id", "op"]
    seen = pairs.groupBy(*key).agg(
        F.avg("delta_ms").alias("mean_delta"),
        F.max("delta_ms").alias("max_gap"),
        F.min_by("from_status", F.when(F.col("from_status") >= 400, F.col("from_index"))).alias("status"),
    )
    between = pairs.select(*key, F.explode("intervening").alias("o")).distinct()
    between = between.groupBy(*key).agg(F.array_sort(F.collect_list("o")).alias("between"))
    phase = rows.join(named.select("session_id", "phase", "name"), ["session_id", "phase"])
    phase = phase.groupBy(*key, "name").agg(F.min("place").alias("at"))
    phase = phase.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("p"))
    wrote = F.exists(F.coalesce("intervening", F.array().cast("array<string>")), lambda o: o.rlike(CHANGE))
    each = pairs.groupBy(*key, "cause").agg(F.min("from_index").alias("at"), F.max(wrote).alias("wrote"))
    advice = each.groupBy(*key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", recommendation(F.col("cause"), F.col("wrote")).alias("text")))),
                lambda x: x["text"],
            ),
            "; ",
        ).alias("recommendations")
    )
    out = causes.join(seen, key).join(advice, key).join(between, key, "left").join(phase, key, "left")
    text = explanation(
        F.col("primary_cause"),
        F.coalesce("between", F.array().cast("array<string>")),
        F.col("mean_delta"),
        F.col("status"),
        F.col("max_gap"),
        F.col("p.name"),
    )
    return out.select(*key, "pairs", "primary_cause", text.alias("explanation"), "recommendations")


def lines(df: DataFrame, most: int = 50) -> str:
    """The first rows of a report frame as text, and how many more there are."""
    rows = df.limit(most + 1).collect()
    out = ["  " + "  ".join(f"{k}={v}" for k, v in r.asDict(recursive=True).items()) for r in rows[:most]]
    if len(rows) > most:
        out.append(f"  ... and {df.count() - most} more")
    return "\n".join(out) or "  none"


def investigate(samples: DataFrame) -> DataFrame:
    """Repeated calls of stored samples with their causes, the most frequent first."""
    from quern.operators import behaviour as b

    rows = b.phase_rows(samples)
    named = b.phases(rows)
    pairs = b.intervening(rows, b.call_pairs(rows, named))
    return investigations(rows, named, pairs, b.primary_causes(pairs)).orderBy(F.desc("pairs"), "session_id", "op")


#: Missing fields that a report names before it counts the rest.
SHOWN_FIELDS = 5


def missing_text(fields: Column, most: int = SHOWN_FIELDS) -> Column:
    """The first missing fields, and how many more there are."""
    shown = F.array_join(F.slice(fields, 1, most), ", ")
    more = F.size(fields) - most
    return F.when(more > 0, F.concat(shown, F.lit(", ... and "), more.cast("string"), F.lit(" more"))).otherwise(shown)


def thin_text(completeness: DataFrame) -> DataFrame:
    """Thin write responses, the thinnest first: what they return, of what a read returns, and what is missing."""
    from quern.operators import behaviour as b

    thin = b.thin_responses(completeness).orderBy("completeness", "normalized_path", "http_method")
    percent = F.floor(F.col("completeness") * 100 + 0.5).cast("int")
    return thin.select(
        "http_method", "normalized_path", percent.alias("percent"), "write_field_count", "read_field_count", missing_text(F.col("missing_fields")).alias("missing")
    )


def session_report(samples: DataFrame, endpoints: DataFrame | None = None, name: str = "") -> str:
    """An agent session as text: use of tools, patterns, wasted calls, phases, causes of repeats, and thin responses.

    ``endpoints``: the session's stored rows; without them a REST session has no completeness.
    """
    from quern.operators import behaviour as b

    samples = b.with_rpc(samples)
    rpc = b.session_kind(samples).first()
    rpc = bool(rpc and rpc["is_jsonrpc"])
    sequences = b.rpc_sequences(samples) if rpc else b.rest_sequences(samples)
    usage = b.tool_usage(samples)
    redundant = b.redundant_calls(usage)
    rows = b.phase_rows(samples)
    named = b.phases(rows)
    parts = [
        ("Operations", usage.orderBy(F.desc("n"), "first_place")),
        ("Patterns", sequences.where("pattern != 'unknown'").orderBy(F.desc("n"))),
        ("Redundant", redundant),
        ("Wasted", b.wasted_requests(sequences, redundant)),
        ("Phases", named.orderBy("phase")),
    ]
    if {"request_shape", "response_shape"} <= set(samples.columns):
        parts.append(("Repeats", investigate(samples)))
    scored = None
    if rpc and "response_facts" in samples.columns:
        scored = b.tool_completeness(b.tool_fields(samples))
    elif not rpc and endpoints is not None:
        scored = b.write_read_completeness(b.endpoint_fields(endpoints))
    if scored is not None:
        parts += [("Completeness", b.completeness_summary(scored)), ("Thin responses", thin_text(scored))]
    calls = usage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("op").alias("ops")).first()
    head = f"Session {name}: {calls.n} samples, {calls.ops} {'tools' if rpc else 'endpoints'}"
    return "\n".join([head, *(f"{title}\n{lines(df)}" for title, df in parts)])
