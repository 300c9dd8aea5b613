"""Settlement as an incremental job: arriving bars are stored and the predictions they concern settled, once each.

Everything a micro-batch writes lies in a folder named by its id and is made from folders of this and earlier ids only.
A batch that is run again, after a crash between its writes and the commit, replaces its own folders by the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tapeline.functions.series import KEYS
from tapeline.operators import ledger
from tapeline.sources.sinks import _read


def _upto(spark: SparkSession, path: str, schema: T.StructType, batch: int) -> DataFrame:
    """Rows of the batches below ``batch``; other folders are pruned, not read."""
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return _read(spark, path, stored).filter(F.col("batch") < batch)


def stored_bars(spark: SparkSession, path: str, schema: T.StructType, upto: int) -> DataFrame:
    """Bars of the batches up to ``upto``; of bars that came again the latest batch's counts."""
    rest = [c for c in schema.names if c not in (*KEYS, "ts")]
    rows = _upto(spark, f"{path}/bars", schema, upto + 1)
    return rows.groupBy(*KEYS, "ts").agg(F.max(F.struct("batch", *rest)).alias("_v")).select(*KEYS, "ts", *[f"_v.{c}" for c in rest])


SETTLED = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(n, T.StringType()) for n in (*KEYS, "market", "horizon", "prediction", "actual")],
                        T.StructField("actual_return", T.DoubleType()), T.StructField("end_ts", T.TimestampType()), T.StructField("correct", T.BooleanType()),
                        T.StructField("stop_hit", T.BooleanType()), T.StructField("target_hit", T.BooleanType()), T.StructField("realized_r", T.DoubleType())])


def settle_batch(arrived: DataFrame, batch: int, predictions: DataFrame, path: str) -> None:
    """Store the batch's bars, then settle what is pending for the series they belong to."""
    spark = arrived.sparkSession
    arrived.write.mode("overwrite").parquet(f"{path}/bars/batch={batch}")
    assets = spark.read.schema(arrived.schema).parquet(f"{path}/bars/batch={batch}").select(*KEYS).distinct()
    done = _upto(spark, f"{path}/settled", SETTLED, batch)
    fresh = ledger.settle_assets(predictions, done, stored_bars(spark, path, arrived.schema, batch), assets)
    fresh.select(*[F.col(f.name).cast(f.dataType) for f in SETTLED]).write.mode("overwrite").parquet(f"{path}/settled/batch={batch}")


def settle_available(arrivals: DataFrame, predictions: DataFrame, path: str) -> StreamingQuery:
    """Settle with all bars there are now, then end; offsets lie beside the results, so the next call goes on from there."""
    return (arrivals.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/offsets")
            .foreachBatch(lambda df, i: settle_batch(df, i, predictions, path)).start())


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """All settled predictions with the batch that settled them."""
    return _read(spark, f"{path}/settled", T.StructType([*SETTLED.fields, T.StructField("batch", T.LongType())]))
