"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only lengths decide a packing, and a length is an integer up to the capacity. So the plan is made
from the histogram of lengths (at most ``capacity`` rows, whatever the corpus), and each piece finds
its place by its rank among the pieces of its length. Ranks come from counts per (task, length), so
neither one common length nor one large group of copies meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, materialize, small_batches
from quern.llm.tokens import KEEP, encoder


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last rank, sequence of the first, offset) runs of a packing.

    Lengths above a third of the capacity are matched greedily, the longest first, each with the
    longest partner that still fits: never more than two share a sequence. Shorter lengths then go,
    the longest first, to the tightest gap that holds them, and open sequences only when none does.
    All sequences of a run have the same gap, so the plan's size depends on the capacity alone.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, number)
    gaps: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs or not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted((k for k in counts if k > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(at)
                used = min(n, left)
                put(gap, first + used, n - used)
            else:
                gap, first = capacity, made
                used = n = -(-left // (capacity // length))
                made += n
            out.append((length, rank, rank + used, first, capacity - gap))
            put(gap - length, first, used)
            rank, left = rank + used, left - used
    return out


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full, but the first may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, keep: int = KEEP
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, task,
    task_rank (its number among the task's pieces of its length) and, if asked for, the ids.

    ``keep`` distinct chunks are remembered by a worker, and texts taken in parts of six bytes for each: it
    bounds memory and changes no result. A null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, task_rank long"
    schema += ", ids binary" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, task, seen = encoder(tokenizer_path, True, keep), TaskContext.get().partitionId(), Counter()
        for ids, texts in doc_chunks(batches, 6 * keep):
            rows = []
            flat, bounds = enc.encode(texts)
            raw = flat.astype("<u4").tobytes()
            for i, lo, hi in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                got = raw[4 * lo : 4 * hi] + end
                at = 0
                for k, n in enumerate(cut_lengths(len(got) // 4, capacity)):
                    part = got[4 * at : 4 * (at + n)]
                    rows.append((i, k, at, n, zlib.crc32(part), task, seen[n], *[part] * with_ids))
                    seen[n] += 1
                    at += n
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that were written once (task and task_rank must stay)."""
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(plan_bins(counts, capacity))
    #: One number for (length, rank), so that a single search finds the run.
    lengths, lows, _, firsts, offsets = np.array(plan, dtype=np.int64).reshape(-1, 5).T.copy()
    of_length = np.searchsorted(lengths, np.arange(capacity + 2))
    tables = docs_broadcast(pieces, (of_length, lows, firsts, offsets))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = pieces.join(bases.select("task", "length", "base"), ["task", "length"])
    ranked = ranked.select(
        *(c for c in pieces.columns if c not in ("task", "task_rank")),
        (F.col("base") + F.col("task_rank")).alias("rank"),
    )
    keep = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in keep)

    def place(batches):
        of_length, lows, firsts, offsets = tables.value
        for b in batches:
            n = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            run = np.empty(len(n), dtype=np.int64)
            for x in np.unique(n):
                mine, lo, hi = n == x, of_length[x], of_length[x + 1]
                run[mine] = lo + np.searchsorted(lows[lo:hi], rank[mine], side="right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            cols += [pa.array(firsts[run] + rank - lows[run]), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def docs_broadcast(df: DataFrame, value):
    """A broadcast variable of the frame's session; its size here depends on the capacity alone."""
    return df.sparkSession.sparkContext.broadcast(value)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, keep: int = KEEP
) -> DataFrame:
    """Packs whole documents: one row per piece with its ids (if asked for), sequence_id and offset.

    Tokenises once; the pieces are written to the shared folder, so a lost executor costs one task.
    An empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids, keep), "pieces")
    return assign(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, from pieces that carry their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("x")).select("sequence_id", F.col("x.ids").alias("ids"))
