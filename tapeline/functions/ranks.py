"""Row numbers, running sums, average ranks and exact quantiles of groups of any size.

No group is ever one task. Rows are dealt by ranges of (key, order), so that a key with a third of all rows lies in
many partitions; each partition counts on its own, and a small table of counts per (key, partition) carries the
offsets. The dealt rows are written once: ranges come from a sample, so counts and rows have to be of the same deal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import table_cut

#: Rows of the table of offsets that may travel to every task; longer ones are joined by shuffle.
SMALL = 100_000


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def _offsets(counts: DataFrame, n_keys: int, total: str) -> DataFrame:
    """``counts`` (_k.., _part, _n) with _before, the sum of the partitions before, and ``total`` per key."""
    keys = [f"_k{i}" for i in range(n_keys)] or [F.lit(0)]
    own = Window.partitionBy(*keys)
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return table_cut(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(total, F.sum("_n").over(own)))


def _joined(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows meet the offsets of their partition and key; NULL keys are a key."""
    same = [F.col("_part") == F.col("_p")] + [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(_sized(offsets.withColumnRenamed("_part", "_p")), reduce(lambda a, b: a & b, same)).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def _named(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]


def numbered(df: DataFrame, keys: list[str], order: list[Column], into: str = "place", total: str = "total") -> DataFrame:
    """``df`` with ``into``, the row's place (from 0) within ``keys`` by ``order``, and ``total``, the rows of its key.

    NULL keys form a key of their own; ``order`` columns say themselves where NULL goes. Rows equal in the whole order
    get places in any order, each its own. An empty table stays empty. One exchange, whatever the keys hold; equal
    rows of the whole order share a range, so give a tie-break that tells them apart.
    """
    laid = df.repartitionByRange(*[F.col(f"`{k}`") for k in keys], *order).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys], *order)
    stored = table_cut(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = stored.groupBy(*_named(keys), "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    joined = _joined(stored, _offsets(counts, len(keys), total), keys)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first")).alias(into), total)


def running(df: DataFrame, keys: list[str], value: str, measure: str, into: str = "before", total: str = "total") -> DataFrame:
    """``df`` with ``into``, the sum of ``measure`` over smaller ``value`` of its key, and the key's ``total``.

    One row per (key, value) is expected, as a grouping by both leaves it.
    """
    stored = table_cut(df.repartitionByRange(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`")).withColumn("_part", F.spark_partition_id()))
    counts = stored.groupBy(*_named(keys), "_part").agg(F.sum(measure).alias("_n"))
    local = Window.partitionBy("_part", *[F.col(f"`{k}`") for k in keys]).orderBy(F.col(f"`{value}`")).rowsBetween(Window.unboundedPreceding, -1)
    within = stored.withColumn("_within", F.coalesce(F.sum(measure).over(local), F.lit(0)))
    joined = _joined(within, _offsets(counts, len(keys), total), keys)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_within")).alias(into), total)


def ranked_values(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """Per (key, distinct value) its count ``n``, average ``rank`` (from 1), ``before`` and the key's ``total``; NULL and NaN values take no part.

    ``more`` are further aggregates of the value's rows.
    """
    real = F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double"))
    held = df.where(real).groupBy(*[F.col(f"`{k}`") for k in keys], F.col(f"`{value}`")).agg(F.count("*").alias("n"), *more)
    return running(held, keys, value, "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def average_ranks(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """``df`` with ``into``, the average rank of ``value`` within ``keys``; NULL where the value is NULL or NaN."""
    table = ranked_values(df, keys, value).select(*_named(keys), F.col(f"`{value}`").alias("_v"), F.col("rank").alias(into))
    same = [F.col(f"`{value}`") == F.col("_v")] + [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(table, reduce(lambda a, b: a & b, same), "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], value: str, into: dict[str, float]) -> DataFrame:
    """Per key the exact quantiles of ``value``, between neighbours on a straight line; keys without values are not listed.

    ``into`` names a column for each probability.
    """
    table = ranked_values(df, keys, value).withColumn("_v", F.col(f"`{value}`").cast("double"))
    out = []
    for name, p in into.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        held = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
        below, above = F.max(F.when(held(low), F.col("_v"))), F.max(F.when(held(high), F.col("_v")))
        out.append((below + (above - below) * F.max(at - low)).alias(name))
    return table.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*out)
