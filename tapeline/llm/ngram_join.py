"""Set-similarity self-join on word shingles by vertical partitioning.

The global order of shingles (rarest first) is cut into fragments. A pair of sets is compared fragment by fragment;
the partial overlaps are summed per pair. Candidates share a shingle of their prefixes (exact for the threshold).
Equal sets are one node. Pairs inside one component are not compared again: first every node meets the node of each
prefix list that has the least unshared matter before the shared shingle, then only pairs across components are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut
from tapeline.llm.components import labels
from tapeline.llm.shingles import set_name, shingle_sets

#: Counters for the global order; how many shingles share one only changes how rare-first the order is.
BUCKETS, BLOCK = 1 << 20, 4096
FRAGMENTS = 4
#: Shingles that occur in one set only are told by the first KEPT bits of their hashes, in ranges by the first RANGE of
#: those; what occurs twice is noted in a filter of 2 ** NOTED bits. More bits than that only make the order sharper.
KEPT, RANGE, NOTED = 40, 14, 27
#: Bits of the filter that names the sets to read again; false hits fall out in the join.
FILTER_BITS = 1 << 22


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n that must hold one of any set at least that similar."""
    return n - -(-percent * n // 100) + 1


def enough(n_a: Column, n_b: Column, overlap: Column, percent: int) -> Column:
    return overlap * 100 >= percent * (n_a + n_b - overlap)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per row its set's size and name; per task its counters, in blocks."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    kind = None
    for batch in batches:
        n, names, waiting, size = [], [], [], 0
        for s in shingle_sets(batch.column(1).to_pylist(), width):
            n.append(len(s))
            names.append(set_name(s))
            waiting.append(s)
            size += len(s)
            if size > BUCKETS:
                counts += np.bincount(bucket(np.concatenate(waiting)), minlength=BUCKETS)
                waiting, size = [], 0
        if size:
            counts += np.bincount(bucket(np.concatenate(waiting)), minlength=BUCKETS)
        kind = batch.schema.field(0).type
        rows = len(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["key", "n", "node", "block", "counts"])
    if counts.any():
        blocks = BUCKETS // BLOCK
        yield pa.RecordBatch.from_arrays([pa.nulls(blocks, kind), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.binary()), pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(blocks, BLOCK)], pa.binary())], names=["key", "n", "node", "block", "counts"])


def truncated(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The distinct sets of a task as shortened hashes, a row for each range of them."""
    seen: set[bytes] = set()
    waiting: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        value = np.sort(np.concatenate(waiting) >> np.uint64(64 - KEPT))
        place = (value >> np.uint64(KEPT - RANGE)).astype(np.int32)
        low = (value & np.uint64((1 << (KEPT - RANGE)) - 1)).astype(np.uint32)
        at = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)]
        planes = [np.ascontiguousarray(np.diff(low[i:j], prepend=low.dtype.type(0)).view(np.uint8).reshape(-1, 4).T).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(place[at[:-1]]), pa.array(planes, pa.binary())], names=["range", "low"])

    for batch in batches:
        for s in shingle_sets(batch.column(0).to_pylist(), width):
            if len(s) and (name := set_name(s)) not in seen:
                seen.add(name)
                waiting.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield rows()
                    waiting, size = [], 0
    if size:
        yield rows()


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range the bits of the filter for values that come more than once; bitmaps bound the memory of a large one."""
    span = 1 << (KEPT - RANGE)
    waiting: dict[int, list[np.ndarray]] = {}
    maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def settle(r: int) -> None:
        once, twice = maps.setdefault(r, (np.zeros(span, dtype=bool), np.zeros(span, dtype=bool)))
        for low in waiting.pop(r, []):
            new, count = np.unique(low, return_counts=True)
            twice[new[once[new] | (count > 1)]] = True
            once[new] = True

    for batch in batches:
        for r, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            delta = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            waiting.setdefault(r, []).append(np.cumsum(delta, dtype=np.uint32))
            if sum(map(len, waiting[r])) > span // 8:
                settle(r)
    for r in {*waiting, *maps}:
        if r in maps:
            settle(r)
            low = np.flatnonzero(maps.pop(r)[1])
        else:
            value = np.sort(np.concatenate(waiting.pop(r)))
            low = value[1:][value[1:] == value[:-1]]
        bits = np.zeros(1 << (NOTED - RANGE), dtype=bool)
        bits[low >> (KEPT - NOTED)] = True
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])


def noted(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether shingles may occur in more than one set."""
    at = hashes >> np.uint64(64 - NOTED)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of each block, added up row by row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_py(), dtype=np.int64)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, counts: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per set of a task its rarest shingles with their places in the global order; those of one set only are left out."""
    seen: set[bytes] = set()
    for batch in batches:
        tokens, names, sizes, places = [], [], [], []
        for s in shingle_sets(batch.column(0).to_pylist(), width):
            if not len(s) or (name := set_name(s)) in seen:
                continue
            seen.add(name)
            shared = noted(s, bits)
            alone = len(s) - int(shared.sum())
            p = prefix_size(len(s), percent) - alone
            if p <= 0:
                continue
            s = s[shared]
            s = s[np.lexsort((s, counts[bucket(s)]))[:p]]
            tokens.append(s)
            names += [name] * len(s)
            sizes.append(np.full(len(s), len(shared)))
            places.append(alone + np.arange(len(s)))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(names, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], names=["token", "node", "n", "place"])


def segments(batches: Iterator[pa.RecordBatch], width: int, fragment: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The wanted sets of a task, cut by the fragments of the global order."""
    seen: set[bytes] = set()
    for batch in batches:
        names, places, arrays = [], [], []
        for s in shingle_sets(batch.column(0).to_pylist(), width):
            if not len(s) or (name := set_name(s)) in seen or not wanted[int.from_bytes(name[:4], "big") % FILTER_BITS]:
                continue
            seen.add(name)
            f = fragment[bucket(s)]
            for k in range(FRAGMENTS):
                part = s[f == k]
                if len(part):
                    names.append(name)
                    places.append(k)
                    arrays.append(part.view(np.int64))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(places, pa.int32()), pa.array(arrays, pa.list_(pa.int64()))], names=["node", "fragment", "tokens"])


def overlaps(docs: DataFrame, pairs: DataFrame, text: str, width: int, fragment: np.ndarray) -> DataFrame:
    """Pairs (a, b) with ``overlap``: partial counts per fragment, summed. Pairs without common shingles are left out."""
    spark = docs.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bit = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long") % FILTER_BITS
    wanted = np.zeros(FILTER_BITS, dtype=bool)
    for row in named.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("at")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).collect():
        wanted[row.word * 64 : row.word * 64 + 64] = np.unpackbits(np.frombuffer((row.bits & (2**64 - 1)).to_bytes(8, "little"), dtype=np.uint8), bitorder="little").astype(bool)
    kept = spark.sparkContext.broadcast(np.packbits(wanted))
    cut = docs.select(text).mapInArrow(lambda b: segments(b, width, fragment, np.unpackbits(kept.value).astype(bool)), "node binary, fragment int, tokens array<bigint>")
    cut = cut.repartition("node", "fragment").dropDuplicates(["node", "fragment"])
    parts = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    one = parts.join(cut.select(F.col("node").alias("a"), "fragment", F.col("tokens").alias("left")), ["a", "fragment"])
    both = one.join(cut.select(F.col("node").alias("b"), "fragment", F.col("tokens").alias("right")), ["b", "fragment"])
    return both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("common")).groupBy("a", "b").agg(F.sum("common").alias("overlap"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, and component_id, the least key among the rows linked with it.

    Two rows link when ``100 * intersection >= percent * union`` of their sets of lower-cased ``width``-word shingles;
    a text with fewer words is one shingle, a NULL or empty text has none and links with nothing (its component is
    itself). Equal texts link. NULL keys take part; they never become a component's name unless it has no other key.
    Repeated rows give repeated rows, an empty table an empty one; other columns are not looked at. The numbers of
    partners and of candidates have no limit.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    first = table_cut(docs.mapInArrow(lambda b: sets(b, width), f"key {kind}, n bigint, node binary, block int, counts binary"))
    rows = first.where("node IS NOT NULL").select("key", "n", "node")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in first.where("node IS NULL").select("block", "counts").repartition("block").mapInArrow(summed, "block int, counts binary").collect():
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    by_count = np.argsort(counts, kind="stable")
    fragment = np.zeros(BUCKETS, dtype=np.int8)
    if counts.any():
        mass = np.cumsum(counts[by_count])
        fragment[by_count] = np.minimum(FRAGMENTS - 1, (mass - 1) * FRAGMENTS // mass[-1])
    bits = np.zeros(1 << (NOTED - 3), dtype=np.uint8)
    found = docs.select("text").mapInArrow(lambda b: truncated(b, width), "range int, low binary").repartition("range").mapInArrow(repeated, "range int, bits binary")
    size = 1 << (NOTED - RANGE - 3)
    for r in found.collect():  # at most 2 ** NOTED bits in all
        bits[r.range * size : (r.range + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    # The global order: shingles of one set, then by count, then by hash.
    order = spark.sparkContext.broadcast((counts, bits))
    lists = docs.select("text").mapInArrow(lambda b: prefixes(b, width, percent, *order.value), "token bigint, node binary, n int, place int")
    lists = lists.repartition("token").dropDuplicates(["token", "node"])
    # A list's head is the set with the least before the shared shingle; lists of one set are done.
    heads = lists.groupBy("token").agg(F.min(F.struct("place", "n", "node")).alias("head"), F.count("*").alias("members")).where("members > 1")
    lists = table_cut(lists.join(heads, "token").select("token", "node", "n", "place", "head"))
    fits = lambda na, pa_, nb, pb: enough(na, nb, F.least(na - pa_, nb - pb), percent)
    near = lists.where((F.col("node") != F.col("head.node")) & fits(F.col("n"), F.col("place"), F.col("head.n"), F.col("head.place")))
    best = near.groupBy("node", "n").agg(F.min(F.struct(F.col("head.place").alias("place"), F.col("place").alias("own"), F.col("head.n").alias("n"), F.col("head.node").alias("node"))).alias("head"))
    tried = table_cut(best.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("head.node").alias("b"), F.col("head.n").alias("nb")))
    links = linked(docs, tried, width, percent, fragment)
    root = labels(links)
    # What is left: members of one list in different components.
    placed = table_cut(lists.join(root, "node", "left").select("token", "node", "n", "place", F.coalesce("root", "node").alias("root")))
    mixed_lists = placed.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token")
    # A pair is proposed where it first meets: members with the same shared shingle before this one met there already.
    # Sizes differ by one step of a scale at most.
    before = F.lag("token").over(Window.partitionBy("node").orderBy("place"))
    step = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    left = placed.join(mixed_lists, "token").withColumn("before", F.coalesce(before.cast("string"), F.lit(""))).withColumn("step", step)
    left = table_cut(left)
    # Members alike in component, size and place are one group; groups are matched, and only matches are spelled out.
    own = ["root", "before", "n", "place"]
    parts = left.groupBy("token", "step", *own).agg(F.count("*").alias("members"))
    named_as = lambda s: [F.col(c).alias(f"{c}_{s}") for c in own]
    beside = lambda table: table.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    cross = parts.select("token", "step", *named_as("a")).join(beside(parts).select("token", "step", *named_as("b")), ["token", "step"])
    cross = cross.where("root_a < root_b AND (before_a <> before_b OR before_a = '')").where(fits(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b")))
    pairs = cross.join(left.select("token", "step", *named_as("a"), F.col("node").alias("a")), ["token", "step", *[f"{c}_a" for c in own]])
    pairs = pairs.join(beside(left).select("token", "step", *named_as("b"), F.col("node").alias("b")), ["token", "step", *[f"{c}_b" for c in own]])
    pairs = pairs.select("a", F.col("n_a").alias("na"), "b", F.col("n_b").alias("nb"))
    pairs = table_cut(pairs.select("a", "na", "b", "nb").distinct())
    if not pairs.isEmpty() and not (more := linked(docs, pairs, width, percent, fragment)).isEmpty():
        root = labels(links.union(more))
    named = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    named = named.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    chief = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = named.join(chief, "root").select("node", "component_id")
    out = rows.where("n > 0").join(placed, "node", "left").select("key", "n", "component_id").union(rows.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int, fragment: np.ndarray) -> DataFrame:
    counted = overlaps(docs, pairs, "text", width, fragment)
    return table_cut(counted.join(pairs, ["a", "b"]).where(enough(F.col("na"), F.col("nb"), F.col("overlap"), percent)).select("a", "b"))
