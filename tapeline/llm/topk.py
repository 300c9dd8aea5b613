"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into groups; each (group, block of vectors) is a node that knows partial scores only.
Phase 1: every task gathers the best partial scores of each query and group; their totals give each query a safe
cutoff, a lower bound of its k-th best score. Phase 2: the cutoff goes to every node. A vector that reaches it has in
at least one group, measured from that group's mean, an equal share of what the cutoff has above all means; every node
sends the entries that reach the share. Phase 3: partial scores that the lists leave open are resolved exactly.
Queries are handled in blocks, never as rows against rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut, with_size

GROUPS = 2
#: Vectors of a block, queries of a block, (block, query block) pairs of a task.
BLOCK, QUERIES, PAIRS = 512, 512, 32
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
#: Partial score of a list that phase 3 computes anew, as it is not known exactly.
OPEN = -(1 << 63)
LISTS = "block bigint, qblock int, group int, q array<int>, x array<int>, s array<bigint>"


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Components as ``floor(256 * x)``, kept as doubles, which hold every such value."""
    values = F.col(f"`{vector}`")
    fine = F.forall(values, lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False)))
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    return vectors.where(values.isNotNull() & fine).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(values, lambda x: whole(x.cast("double") * 256)).alias("v"))


def cells(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one task, cut by groups of components; short vectors are filled up with 0."""
    from pyspark import TaskContext

    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    for batch in batches:
        flat, offsets = batch.column(1).flatten().to_numpy(), np.asarray(batch.column(1).offsets)
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        x = np.zeros((len(size), dim))
        row = np.repeat(np.arange(len(size)), size)
        x[row, np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
        for at in range(0, len(x), BLOCK):
            ids = batch.column(0).slice(at, BLOCK).to_pylist()
            parts = [x[at : at + BLOCK, g::GROUPS] for g in range(GROUPS)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * GROUPS, pa.int64()), pa.array(range(GROUPS), pa.int32()), pa.array([ids] * GROUPS, pa.list_(pa.int64())), pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())], names=["block", "group", "ids", "values"])
            block += 1


def asked(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Queries among the rows of the cells."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for block, group, ids, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x = np.frombuffer(values).reshape(len(ids), -1)
            for i, key in enumerate(ids):
                if key is not None and key % every == 0:
                    for column, value in zip(out, (group, block * BLOCK + i, key, x[i].tobytes()), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["group", "qrow", "qid", "values"])


def largest(q: np.ndarray, x: np.ndarray) -> float:
    """No sum of products of a row of ``q`` and one of ``x`` is larger."""
    return float(np.abs(q).max(initial=1)) * float(np.abs(x).max(initial=1)) * max(1, q.shape[1])


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as finite doubles; exact where ``largest`` is below EXACT."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(q @ x.T)


def totals(q: np.ndarray, x: np.ndarray, whole_q: np.ndarray, whole_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of products, row by row, and on which side (-1, 1; 0: none) the sum of the whole rows leaves the longs.

    Rows whose whole sum might not fit are summed whole in integers of any length; for the others ``q`` and ``x`` count.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        safe = np.abs(whole_q).max(axis=1, initial=1) * np.abs(whole_x).max(axis=1, initial=1) * max(1, whole_q.shape[1]) < 2.0**62
    total, over = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int8)
    total[safe] = np.einsum("ij,ij->i", q[safe].astype(np.int64), x[safe].astype(np.int64))
    for i in np.flatnonzero(~safe):
        value = sum(int(a) * int(b) for a, b in zip(whole_q[i].tolist(), whole_x[i].tolist(), strict=True))
        over[i] = (value >= 1 << 63) - (value < -(1 << 63))
        total[i] = 0 if over[i] else value
    return total, over


def matrix(parts: list[bytes] | bytes, rows: int) -> np.ndarray:
    return np.frombuffer(parts if isinstance(parts, bytes) else b"".join(parts)).reshape(rows, -1)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def local_lists(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: of each task, query and group the best k partial scores besides the query's own row."""
    best: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in rows_of(batches):
        qrows = np.array([a["qrow"] for a in r["asked"]])
        q = matrix([a["values"] for a in r["asked"]], len(qrows))
        x = matrix(r["values"], len(r["ids"]))
        rows = r["block"] * BLOCK + np.arange(len(x))
        s = product(q, x)
        inexact = largest(q, x) >= EXACT
        s[qrows[:, None] == rows[None, :]] = -np.inf
        rows, doubt = np.broadcast_to(rows, s.shape), np.full(s.shape, inexact)
        if old := best.get((r["group"], r["qblock"])):
            s, rows, doubt = (np.concatenate([a, b], 1) for a, b in zip(old, (s, rows, doubt), strict=True))
        top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        best[r["group"], r["qblock"]] = [np.take_along_axis(a, top, 1) for a in (s, rows, doubt)]
    for (group, qblock), (s, rows, doubt) in best.items():
        q = np.broadcast_to(np.arange(len(s))[:, None], s.shape)
        ok = np.isfinite(s)
        n = int(ok.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int32)), pa.array(np.full(n, qblock, np.int32)), pa.array(q[ok].astype(np.int32)), pa.array(rows[ok] // BLOCK), pa.array((rows[ok] % BLOCK).astype(np.int32)), pa.array(np.where(doubt[ok], OPEN, np.where(doubt[ok], 0, s[ok]).astype(np.int64)))], names=["group", "qblock", "q", "block", "x", "s"])


def sufficient(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phase 2: the entries of a node that reach the query's share of the cutoff."""
    for r in rows_of(batches):
        qrows = [a["qrow"] for a in r["asked"]]
        cutoff = dict(zip(*([c[n] for c in r["cutoffs"] or []] for n in ("qrow", "tau")), strict=True))
        tau = np.array([cutoff.get(x, -np.inf) for x in qrows], dtype=np.float64)
        q = matrix([a["values"] for a in r["asked"]], len(qrows))
        whole = matrix([a["whole"] for a in r["asked"]], len(qrows))
        x = matrix(r["values"], len(r["ids"]))
        centre = mean[r["group"] :: GROUPS]
        exact = largest(q, x) < EXACT
        # What doubles may be off by; where nothing can be said the entry is sent.
        with np.errstate(over="ignore", invalid="ignore"):
            share = q @ centre + (tau - whole @ mean) / GROUPS
            slack = 1e-9 * (1 + np.abs(q) @ np.abs(centre) + np.abs(whole) @ np.abs(mean) + np.where(np.isfinite(tau), np.abs(tau), 0))
            slack = slack[:, None] if exact else slack[:, None] + 1e-9 * (np.abs(q) @ np.abs(x).T)
            s = q @ x.T
            at, x = np.nonzero(~(s < share[:, None] - slack))
        s = s[at, x].astype(np.int64) if exact else np.full(len(at), OPEN)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["qblock"]], pa.int32()), pa.array([r["group"]], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([x.astype(np.int32)], pa.list_(pa.int32())), pa.array([s], pa.list_(pa.int64()))], names=["block", "qblock", "group", "q", "x", "s"])


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 3: totals of all listed entries; partial scores that no list has are computed."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda n: batch.column(batch.schema.get_field_index(n))[i]  # noqa: B023, E731
            queries = get("asked").as_py()
            qrows, qids = np.array([a["qrow"] for a in queries]), [a["qid"] for a in queries]
            cutoff = {c["qrow"]: c["tau"] for c in get("cutoffs").as_py() or []}
            whole = matrix([a["whole"] for a in queries], len(queries))
            ids, block = get("ids").as_py(), get("block").as_py()
            values = {p["group"].as_py(): matrix(p["values"].as_py(), len(ids)) for p in get("parts")}
            lists = {p["group"].as_py(): [p[n].values.to_numpy() for n in ("q", "x", "s")] for p in get("lists")}
            rows_whole = np.zeros((len(ids), whole.shape[1]))
            for g, part in values.items():
                rows_whole[:, g::GROUPS] = part
            code = {g: q.astype(np.int64) * BLOCK + x for g, (q, x, _) in lists.items()}
            pairs = np.unique(np.concatenate([*code.values()]))
            q, x = pairs // BLOCK, pairs % BLOCK
            total, over = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int8)
            for g in range(GROUPS):
                missing = np.ones(len(pairs), dtype=bool)
                if g in lists:
                    known = lists[g][2] != OPEN
                    at = np.searchsorted(pairs, code[g][known])
                    total[at] += lists[g][2][known]
                    missing[at] = False
                left = np.flatnonzero(missing)
                total[left] += totals(whole[q[left]][:, g::GROUPS], values[g][x[left]], whole[q[left]], rows_whole[x[left]])[0]
            # Sums that might leave the longs are taken once more, whole.
            risky = np.flatnonzero(np.abs(whole).max(axis=1, initial=1)[q] * np.abs(rows_whole).max(axis=1, initial=1)[x] * max(1, whole.shape[1]) >= 2.0**62)
            total[risky], over[risky] = totals(whole[q[risky]], rows_whole[x[risky]], whole[q[risky]], rows_whole[x[risky]])
            tau = np.array([cutoff.get(r, -(2**63)) for r in qrows.tolist()], dtype=np.int64)
            open_ = np.array([r not in cutoff for r in qrows.tolist()], dtype=bool)
            keep = ((over > 0) | ((over == 0) & (total >= tau[q])) | open_[q]) & (qrows[q] != block * BLOCK + x)
            q, x, total, over = q[keep], x[keep], total[keep], over[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), get("qblock").as_py(), np.int32)), pa.array(qrows[q]), pa.array([qids[j] for j in q], pa.int64()), pa.array(block * BLOCK + x), pa.array([ids[j] for j in x], pa.int64()), pa.array(total), pa.array(over)], names=["qblock", "qrow", "query_id", "row", "vec_id", "score", "over"])


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best integer inner products of each row whose key ``every`` divides.

    Components count as ``floor(256 * x)``. Candidates are all rows but the query's own, repeated rows included; ties
    go to the smaller key, NULL keys last (they are candidates, never queries). Vectors that are NULL or hold NULL or
    non-finite components take no part (256 * x must be finite too). Components may have any size: sums that might not
    fit a long are taken in integers of any length, and a score among the k best that does not fit is an error; shorter vectors count as filled up with 0; fewer than k
    candidates give fewer rows, an empty table none. Other columns are not looked at.
    """
    table = table_cut(quantised(vectors, key, vector))
    rows, dim = table.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(GROUPS, dim or 0)
    mean = np.zeros(dim)
    for r in table.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("double")).alias("x")).collect():
        mean[r["at"]] = r["x"] / rows
    nodes = table_cut(table.repartition(max(1, -(-rows // (8 * BLOCK)))).mapInArrow(lambda b: cells(b, dim), "block bigint, group int, ids array<bigint>, values binary"))
    queries = table_cut(nodes.mapInArrow(lambda b: asked(b, every), "group int, qrow bigint, qid bigint, values binary"))
    n_queries = queries.where("group = 0").count()
    blocks = max(1, -(-n_queries // QUERIES))
    part = F.pmod(F.xxhash64("qrow"), F.lit(blocks)).cast("int").alias("qblock")
    # Each query also knows its other components, which phase 3 needs; their order is that of the whole vector.
    wholes = queries.groupBy("qrow").agg(F.array_sort(F.collect_list(F.struct("group", "values"))).alias("parts"))
    wholes = wholes.mapInArrow(lambda b: joined(b, dim), "qrow bigint, whole binary")
    listed = queries.join(wholes, "qrow").groupBy("group", part).agg(F.array_sort(F.collect_list(F.struct("qrow", "qid", "values", "whole"))).alias("asked"))
    listed = table_cut(listed.withColumn("cutoffs", F.array().cast("array<struct<qrow:bigint,tau:bigint>>")))

    def work(asked_now: DataFrame) -> DataFrame:
        left = nodes.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        n = max(1, -(-(-(-rows // BLOCK) * blocks * GROUPS) // PAIRS))
        return left.repartition(n).join(with_size(asked_now, QUERIES * dim * 16), ["group", "qblock"])

    def resolve(lists: DataFrame, asked_now: DataFrame) -> DataFrame:
        both = lists.groupBy("block", "qblock").agg(F.collect_list(F.struct("group", "q", "x", "s")).alias("lists"))
        grouped = nodes.groupBy("block").agg(F.first("ids").alias("ids"), F.collect_list(F.struct("group", "values")).alias("parts"))
        joined_ = both.join(grouped, "block").join(with_size(asked_now.where("group = 0").drop("group"), QUERIES * dim * 16), "qblock")
        return joined_.mapInArrow(resolved, "qblock int, qrow bigint, query_id bigint, row bigint, vec_id bigint, score bigint, over tinyint")

    first = work(listed).mapInArrow(lambda b: local_lists(b, k), "group int, qblock int, q int, block bigint, x int, s bigint")
    best = Window.partitionBy("group", "qblock", "q").orderBy(F.desc("s"), "block", "x")
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    first = first.groupBy("block", "qblock", "group").agg(F.collect_list("q").alias("q"), F.collect_list("x").alias("x"), F.collect_list("s").alias("s"))
    ranked = Window.partitionBy("qrow").orderBy(F.desc("over"), F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    sure = resolve(first, listed).withColumn("place", F.row_number().over(ranked)).where((F.col("place") == k) & (F.col("over") == 0))
    cutoffs = table_cut(sure.groupBy("qblock").agg(F.collect_list(F.struct("qrow", F.col("score").alias("tau"))).alias("cutoffs")))
    told = table_cut(listed.drop("cutoffs").join(cutoffs, "qblock", "left"))
    lists = table_cut(work(told).mapInArrow(lambda b: sufficient(b, mean), LISTS))
    final = resolve(lists, told).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best does not fit a long"))).alias("score"))


def joined(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The whole vectors of queries from their groups."""
    for batch in batches:
        whole = []
        for parts in batch.column(1).to_pylist():
            v = np.zeros(dim)
            for p in parts:
                v[p["group"] :: GROUPS] = np.frombuffer(p["values"])
            whole.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], names=["qrow", "whole"])
