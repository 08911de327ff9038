"""MinHash near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates.

Texts with the same shingle set form one class first, however many copies there are. Each class is
sketched by one permutation (the hash range cut into bins, the least value of each bin), empty bins
borrow by optimal densification, and bands of bins name buckets. Within a bucket a centre is compared
with all members, so candidates are stars, confirmed on the full shingle sets. Where a bucket's
members then lie in several components, those that share enough shingles with others are compared in
blocks, also on the full sets: links that no star's centre reaches are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_chunks, kept_in_worker, materialize, mix64, only_kept, segment_ids, small_batches, word_hashes

#: Bands and bins per band: two sets of similarity 0.75 miss all 60 buckets with probability 8e-6.
BANDS, ROWS = 60, 6
WORDS = 5
#: Texts that are sketched at once: a sketch takes as much memory for a short text as for a long one.
TEXTS = 1024
_MULT = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and the texts' bounds.

    A text with fewer words is one shingle; without words its set is empty.
    """
    h, bounds = word_hashes(texts)
    n = len(h)
    count = np.diff(bounds)
    owner = segment_ids(bounds)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        part = mix64(h + _MULT[k])
        part *= _MULT[k]
        m = n - k
        if m > 0:
            inside = owner[k:] == owner[:m]
            total[:m] += np.where(inside, part[k:], np.uint64(0))
    total = mix64(total)
    # a shingle starts at each word that has enough followers, or at the first of a short text
    place = np.arange(n) - bounds[owner]
    starts = (place <= count[owner] - words) | ((place == 0) & (count[owner] < words))
    total, owner = total[starts], owner[starts]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    if len(total):
        new = np.ones(len(total), dtype=bool)
        new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
        total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(texts) + 1))


_tries: dict[int, np.ndarray] = {}


def _donors(bins: int, attempts: int) -> np.ndarray:
    """The bin that an empty bin asks at each attempt: [attempts, bins], the same everywhere."""
    if bins not in _tries or len(_tries[bins]) < attempts:
        x = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(bins, dtype=np.uint64)
        _tries[bins] = (mix64(x + np.uint64(77)) % np.uint64(bins)).astype(np.int64)
    return _tries[bins]


def sketch(shingles: np.ndarray, bounds: np.ndarray, bins: int, attempts: int = 1024) -> np.ndarray:
    """One-permutation sketches [texts, bins] of non-empty sets, empty bins filled by densification."""
    texts = len(bounds) - 1
    owner = segment_ids(bounds)
    slot = owner * bins + ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]  # sorted within each text, so the first of a bin is its least
    flat = np.zeros(texts * bins, dtype=np.uint64)
    full = np.zeros(texts * bins, dtype=bool)
    flat[slot[first]] = shingles[first]
    full[slot[first]] = True
    empty = np.flatnonzero(~full & np.repeat(np.diff(bounds) > 0, bins))
    out = flat.copy()
    donors = _donors(bins, attempts)
    for t in range(attempts):
        if not len(empty):
            break
        row = empty // bins
        ask = row * bins + donors[t][empty - row * bins]
        got = full[ask]
        out[empty[got]] = flat[ask[got]]
        empty = empty[~got]
    if len(empty):  # hardly ever: the text's least shingle
        out[empty] = shingles[bounds[empty // bins]]
    return out.reshape(texts, bins)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key for each band of a sketch [texts, bands]."""
    texts, bins = signature.shape
    parts = signature.reshape(texts, bins // rows, rows)
    keys = np.arange(1, bins // rows + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    keys = np.repeat(keys, texts, axis=0)
    for k in range(rows):
        keys = mix64(keys ^ parts[:, :, k]) + np.uint64(k)
    return keys


def _text_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a digest of the set) and bands (the bucket keys) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        kept_in_worker("near duplicates")
        for ids, texts in doc_chunks(batches, 1 << 19, TEXTS):
            shingles, bounds = shingle_sets(texts, words)
            raw = [
                hashlib.blake2b(shingles[a:b].tobytes(), digest_size=16).digest()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            digest = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
            keys = band_keys(sketch(shingles, bounds, bands * rows), rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.array(digest[:, 0].copy()),
                    pa.array(digest[:, 1].copy()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(ids) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
                    ),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return _text_columns(docs).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<bigint>"
    )


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its whole set as sorted 64-bit hashes (binary)."""

    def run(batches):
        for ids, texts in doc_chunks(batches, 1 << 19):
            shingles, bounds = shingle_sets(texts, words)
            blobs = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["cls", "shingles"]
            )

    return _text_columns(docs).mapInArrow(run, "cls long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least ``percent`` of their union."""
    left = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            last, sa = None, None
            for x, y, z in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if x != last:
                    last, sa = x, np.frombuffer(y.as_buffer(), dtype=np.uint64)
                sb = np.frombuffer(z.as_buffer(), dtype=np.uint64)
                if 100 * min(len(sa), len(sb)) < percent * max(len(sa), len(sb)):
                    keep.append(False)
                    continue
                merged = np.sort(np.concatenate([sa, sb]), kind="stable")
                inter = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * inter >= percent * (len(merged) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return both.mapInArrow(run, "a long, b long")


def shared_counts(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and s: how many of its shingles stand in another of the wanted classes too."""
    mine = materialize(sets.join(wanted, "cls", "left_semi"), "wanted-sets")

    def run(batches):
        for batch in batches:
            blobs = [np.frombuffer(x.as_buffer(), dtype="<i8") for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(b) for b in blobs])
            flat = np.concatenate(blobs) if blobs else np.empty(0, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(flat)], names=["cls", "h"])

    each = mine.select("cls", "shingles").mapInArrow(run, "cls long, h long")
    common = materialize(each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "shared-shingles")
    return materialize(each.join(common, "h").groupBy("cls").agg(F.count("*").alias("s")), "shared-counts")


def _mixed(members: DataFrame, name: str) -> DataFrame:
    """Buckets that hold several components."""
    return materialize(
        members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"),
        f"{name}-mixed",
    )


def compare_groups(open_: DataFrame, sets: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """Links (a, b) between different components of classes that buckets (bucket, cls, comp) tie together.

    Components tied by buckets, over any number of steps, are a group, dealt to blocks; two blocks at a time are
    compared on the full sets by one product of incidence matrices. Only links come out, no pairs.
    """
    stars = materialize(open_.groupBy("bucket").agg(F.min("comp").alias("a")), "ties")
    ties = open_.join(stars, "bucket").where("comp != a").select("a", F.col("comp").alias("b")).distinct()
    groups = components(materialize(ties, "tied"), "groups").select(F.col("id").alias("comp"), F.col("comp").alias("grp"))
    each = materialize(open_.groupBy("cls").agg(F.min("comp").alias("comp")), "open-classes")
    each = materialize(each.join(groups, "comp"), "grouped")
    sizes = materialize(each.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "group-sizes")
    dealt = (
        each.join(sizes, "grp")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .join(sets, "cls")
    )
    packed = dealt.groupBy("grp", "block").agg(
        F.first("blocks").alias("blocks"), F.collect_list(F.struct("cls", "comp", "shingles")).alias("members")
    )
    packed = materialize(packed, "blocks")
    other = packed.select("grp", F.col("block").alias("with"), F.col("members").alias("others"))
    both = packed.select("grp", "members", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("with"))
    both = both.join(other, ["grp", "with"]).select("members", "others", (F.col("block") == F.col("with")).alias("same"))

    def read(cell) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = cell.values
        ids, comp = (rows.field(n).to_numpy() for n in ("cls", "comp"))
        return ids, comp, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.field("shingles")]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, comp, left = read(batch.column(0)[r])
                ids2, comp2, right = read(batch.column(1)[r])
                n, m = len(left), len(right)
                sizes = np.array([len(x) for x in left + right])
                _, col = np.unique(np.concatenate(left + right), return_inverse=True)
                row = np.repeat(np.arange(n + m), sizes)
                inter = np.zeros((n, m), dtype=np.float32)
                order = np.argsort(col, kind="stable")
                col, row = col[order], row[order]
                wide = 1 << 14
                for lo in range(0, int(col[-1]) + 1, wide):  # some columns of the incidence matrices at a time
                    a, b = np.searchsorted(col, [lo, lo + wide])
                    part = np.zeros((n + m, wide), dtype=np.float32)
                    part[row[a:b], col[a:b] - lo] = 1
                    inter += part[:n] @ part[n:].T
                inter = inter.astype(np.int64)  # a set has far fewer than 2**24 shingles, so sums were exact
                union = sizes[:n, None] + sizes[None, n:] - inter
                hit = (100 * inter >= percent * union) & (comp[:, None] != comp2[None, :])
                x, y = np.nonzero(hit)
                x, y = ids[x], ids2[y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
                )

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id and comp (the least id reachable) of every end of the links (a, b): least labels, with jumps."""
    arcs = materialize(
        links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct(),
        f"{name}-arcs",
    )
    state = materialize(
        arcs.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("comp")), f"{name}-0"
    )
    total = None
    step = 0
    while True:
        now = state.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return state
        total, step = now, step + 1
        heard = (
            arcs.join(state.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.min("comp").alias("heard"))
        )
        lower = materialize(
            state.join(heard, "id").select("id", F.least("comp", "heard").alias("comp")), f"{name}-{step}"
        )
        jump = lower.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        state = materialize(
            lower.join(jump, "comp").select("id", F.least("comp", "root").alias("comp")), f"{name}-{step}j"
        )


def near_duplicates(
    docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS, words: int = WORDS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    component_id is the least doc_id that links reach; a document without words is linked with
    nothing. Rows that share a doc_id are one document and so in one component, also where their
    texts differ; but a row without words stays by itself (component_id is its doc_id), also where other
    rows of its doc_id have words. A row without doc_id takes no part: its component_id is null and it is
    kept. Extra columns are ignored; an empty table gives no rows. The result is a written table; all
    other scratch tables are gone when it is returned.
    """
    with only_kept(docs.sparkSession) as kept:
        kept.append(materialize(_documents(docs, percent, bands, rows, words), "near-duplicates"))
    return kept[0]


def _documents(docs: DataFrame, percent: int, bands: int, rows: int, words: int) -> DataFrame:
    """near_duplicates, over scratch tables."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    each = texts.where("doc_id is not null").groupBy("doc_id")
    several = each.agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("lo < hi")
    several = materialize(several.select("doc_id"), "several-texts")
    if several.isEmpty():
        return _near_duplicates(texts, percent, bands, rows, words)
    # a doc_id with several texts: each text goes by a number of its own, and they are tied afterwards
    own = texts.join(several.withColumn("many", F.lit(True)), "doc_id", "left").select(
        F.when(F.col("many"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("own"), "doc_id", "text"
    )
    names = materialize(own.where("own is not null").select("own", "doc_id").distinct(), "own-numbers")
    found = _near_duplicates(own.select(F.col("own").alias("doc_id"), "text"), percent, bands, rows, words)
    found = materialize(found.withColumnRenamed("doc_id", "own"), "found").join(names, "own", "left")
    linked = materialize(found.where("n_shingles > 0 and doc_id is not null"), "linked")
    least = linked.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    ties = linked.join(least, "doc_id").select("a", F.col("component_id").alias("b")).where("a < b").distinct()
    joined = components(materialize(ties, "ties-of-texts"), "ties-of-texts").withColumnRenamed("comp", "whole")
    linked = linked.join(joined, linked["component_id"] == joined["id"], "left")
    linked = materialize(linked.select("own", "doc_id", F.coalesce("whole", "component_id").alias("whole")), "whole")
    first = linked.groupBy("whole").agg(F.min("doc_id").alias("component"))
    final = linked.select("own", "whole").distinct().join(first, "whole").select("own", "component")
    out = found.join(final, "own", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _near_duplicates(docs: DataFrame, percent: int, bands: int, rows: int, words: int) -> DataFrame:
    """near_duplicates of rows where each doc_id has one text."""
    sketched = materialize(sketches(docs, bands, rows, words), "sketches")
    real = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        real.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("cls")), "classes"
    )
    # one row per class and band, of the class's first document
    heads = real.join(classes.select("d1", "d2", "cls"), ["d1", "d2"]).where(F.col("doc_id") == F.col("cls"))
    banded = materialize(heads.select("cls", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "bands")
    shared = materialize(
        banded.groupBy("bucket")
        .agg(F.min("cls").alias("centre"), F.max("cls").alias("last"))
        .where("centre < last")
        .select("bucket", "centre"),
        "buckets",
    )
    members = materialize(banded.join(shared, "bucket").select("bucket", "cls", "n", "centre"), "members")
    wanted = materialize(members.groupBy(F.col("cls").alias("doc_id")).agg(F.count("*").alias("k")), "candidates")
    once = docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = materialize(full_sets(once, words).dropDuplicates(["cls"]), "sets")

    first = members.where("cls != centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    links = materialize(confirm(materialize(first, "pairs-0"), sets, percent), "links-0")
    labels = components(links, "round-0")
    # buckets whose members lie in several components: what the stars may have missed
    left = materialize(
        members.where("cls != centre")
        .select("bucket", "cls", "n")
        .join(labels.select(F.col("id").alias("cls"), "comp"), "cls", "left")
        .select("bucket", "cls", "n", F.coalesce("comp", "cls").alias("comp")),
        "left",
    )
    few = materialize(left.join(_mixed(left, "left"), "bucket"), "few")
    # a class links only with classes that share enough of its shingles; many share too few with all
    counts = shared_counts(sets, few.select("cls").distinct())
    able = materialize(few.join(counts, "cls").where(100 * F.col("s") >= percent * F.col("n")), "able")
    able = materialize(able.join(_mixed(able, "able"), "bucket"), "open")
    if not able.isEmpty():
        found = materialize(compare_groups(able, sets, percent), "links-1")
        if not found.isEmpty():
            labels = components(links.union(found), "round-1")

    named = materialize(
        classes.join(labels.select(F.col("id").alias("cls"), "comp"), "cls", "left").select(
            "d1", "d2", F.coalesce("comp", "cls").alias("component")
        ),
        "named",
    )
    out = sketched.join(named, ["d1", "d2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None))
        .when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.col("component"))
        .alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
