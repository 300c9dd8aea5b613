"""Session defaults. On a cluster the submitter's settings win; these only fill gaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(name: str = "tapeline", cores: str = "8", **conf: str) -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for cut lineage; a fresh one in local mode where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there, for inputs used more than once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A path, not there yet, in a fresh folder under the shared checkpoint folder that goes when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tapeline-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return f"{path}/data"


def table_cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there: what was dealt or sampled is then fixed."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
