"""Best-fit packing into sequences of several permitted lengths.

Pieces are dealt evenly over shards (round robin, no key, so no length and no source can make a hot shard);
each shard is packed by itself in one task and holds a bounded number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import WORD, table_cut

SIZES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence: its length, a fixed part, and attention that grows with the square of the length.
FIXED, QUADRATIC = 16.0, 1 / 65536
SHARD_PIECES = 20_000


def cost(size: float) -> float:
    return FIXED + size + QUADRATIC * size * size


def fill(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece, and capacity of each bin, for lengths in descending order, none over the largest size.

    Best fit over the open bins of all sizes together. A piece that fits in none opens the size with the least cost
    per token it can still hope to hold: at most the size, at most the piece and all later pieces that fit beside it.
    At the end each bin shrinks to the least permitted size for its contents.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    sizes = sorted(sizes)
    left = np.r_[np.cumsum(lengths[::-1])[::-1], 0]
    rising = -lengths
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    open_rooms = 0
    bins, used = np.empty(len(lengths), dtype=np.int64), []
    capacity: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        fits = open_rooms >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            possible = [s for s in sizes if s >= length]
            beside = [left[max(i + 1, int(np.searchsorted(rising, length - s)))] for s in possible]
            r = min(zip(possible, beside, strict=True), key=lambda x: (cost(x[0]) / min(x[0], length + x[1]), x[0]))[0]
            b = len(used)
            used.append(0)
            capacity.append(r)
        bins[i] = b
        used[b] += length
        if r > length:
            room[r - length].append(b)
            open_rooms |= 1 << (r - length)
    return bins, np.asarray(sizes)[np.searchsorted(sizes, used)] if used else np.empty(0, dtype=np.int64)


def word_count(text: Column) -> Column:
    """Words of a text and one end mark; a NULL or empty text has length 1."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1


def pack(docs: DataFrame, length: Column | None = None, key: str = "doc_id", sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per bin: shard, bin, capacity, used, cost, and of its pieces the lists ``<key>s``, starts, lengths.

    ``length`` defaults to the words of ``text`` and an end mark. A document over the largest size is cut into pieces
    of that size and a rest. NULL lengths count as 0 and lengths under 1 take no part; NULL keys and repeated rows
    are packed like others; an empty table gives no bins. Other columns are not looked at.
    """
    measure = word_count(F.col("`text`")) if length is None else length
    largest = max(sizes)
    measured = table_cut(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(measure, F.lit(0)).cast("long").alias("all")))
    pieces = measured.where("all >= 1").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / largest))))
    pieces = pieces.select("key", (F.col("place") * largest).alias("start"), F.least(F.lit(largest), F.col("all") - F.col("place") * largest).cast("int").alias("length"))
    total = measured.where("all >= 1").agg(F.sum(F.floor((F.col("all") - 1) / largest) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    kind = measured.schema["key"].dataType.simpleString()
    schema = f"shard int, bin int, capacity int, used int, cost double, `{key}s` array<{kind}>, starts array<bigint>, lengths array<int>"
    return pieces.repartition(shards).mapInArrow(lambda batches: packed(batches, sizes), schema)


def packed(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = list(batches)
    if not rows or not sum(b.num_rows for b in rows):
        return
    pieces = pa.Table.from_batches(rows)
    by_key = [("key", "ascending")] if not pa.types.is_nested(pieces.schema.field("key").type) else []
    pieces = pieces.sort_by([("length", "descending"), *by_key, ("start", "ascending")]).combine_chunks()
    lengths = pieces["length"].to_numpy()
    bins, capacity = fill(lengths, sizes)
    order = np.argsort(bins, kind="stable")
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(bins))].astype(np.int32))
    moved = pieces.take(pa.array(order)).combine_chunks()
    column = lambda name: pa.ListArray.from_arrays(offsets, moved[name].chunk(0))
    n = len(capacity)
    shard = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = [pa.array(np.full(n, shard, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(capacity.astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(cost(capacity.astype(float)))]
    yield pa.RecordBatch.from_arrays([*made, column("key"), column("start"), column("length")], names=["shard", "bin", "capacity", "used", "cost", "keys", "starts", "lengths"])
