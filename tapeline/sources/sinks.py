"""Append-only, idempotent and latest-wins tables on partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tapeline.functions.series import finite
from tapeline.operators.quality import validate


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # the table does not exist yet
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def append_new(rows: DataFrame, path: str, keys: list[str], partitions: list[str] = ()) -> DataFrame:
    """Append rows whose key is not stored; of equal keys the least row wins.  Returns received/inserted/duplicates/stored."""
    spark = rows.sparkSession
    stored = _read(spark, path, rows.schema)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns) if rest else rows.dropDuplicates(keys)
    fresh = first.join(stored.select(*keys), keys, "left_anti")
    before, received = stored.count(), rows.count()
    fresh.write.mode("append").partitionBy(*partitions).parquet(path)
    after = _read(spark, path, rows.schema).count()
    return spark.createDataFrame([(received, after - before, received - (after - before), after)], "received long, inserted long, duplicates long, stored long")


def append_candles(rows: DataFrame, path: str) -> DataFrame:
    """Validated, append-only candles: nothing is written unless every arriving row is sound (needs seq)."""
    checked = validate(rows)
    if checked.filter("code is not null").limit(1).count():
        return checked.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).filter("code is not null")
    return append_new(rows.drop("seq"), path, ["market", "symbol", "interval", "ts"], ["market", "interval"])


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], sticky: list[str] = ()) -> DataFrame:
    """Latest row per key; columns in ``sticky`` keep the old value where the new one is NULL.

    Of repeated incoming keys the row with the largest ``updated_at`` counts, else the largest values.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = [c for c in ("updated_at",) if c in rest] + [c for c in rest if c != "updated_at"]
    rows = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
    new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("_new"))
    joined = stored.join(new, keys, "full")
    pick = lambda c: F.coalesce(f"_n_{c}", c) if c in sticky else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*keys, *[pick(c).alias(c) for c in stored.columns if c not in keys])


def replace_partitions(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite only the partitions that ``rows`` touches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def keep_newest(rows: DataFrame, order: str, top: int = 90) -> DataFrame:
    """The newest ``top`` snapshots (retention)."""
    return rows.orderBy(F.desc(order)).limit(top)


def read_newest(spark: SparkSession, path: str, schema: T.StructType, order: str, top: int, where: str | None = None) -> DataFrame:
    df = _read(spark, path, schema)
    return (df.filter(where) if where else df).orderBy(F.desc(order)).limit(top)


def feature_observations(frame: DataFrame, names: list[str]) -> DataFrame:
    """Finite values of each series' last row, long."""
    last = F.row_number().over(Window.partitionBy("symbol", "interval").orderBy(F.desc("ts")))
    end = frame.withColumn("_r", last).filter("_r = 1").select("symbol", "ts", *[finite(F.col(n)).alias(n) for n in names])
    return end.unpivot(["symbol", "ts"], names, "feature_name", "value").filter("value is not null")


def flatten_numbers(df: DataFrame, root: str, skip: tuple[str, ...] = ("source", "headlines", "errors")) -> DataFrame:
    """Numeric leaves of a nested struct as (path, value) rows with dotted names."""
    leaves: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        for field in kind.fields:
            name = f"{path}.{field.name}"
            if field.name in skip:
                continue
            if isinstance(field.dataType, T.StructType):
                walk(field.dataType, name)
            elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
                leaves.append(name)

    walk(df.schema[root].dataType, root)
    keys = [c for c in df.columns if c != root]
    pairs = F.array(*[F.struct(F.lit(x.removeprefix(f"{root}.")).alias("path"), finite(F.col(x).cast("double")).alias("value")) for x in leaves])
    return df.select(*keys, F.inline(pairs)).filter("value is not null")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table for the audit report."""
    out = None
    for name, df in tables.items():
        part = df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
