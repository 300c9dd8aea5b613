"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import decontam, lines, ngram_join, packing, toxicity
from tapeline.llm.common import read, shared_folder


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold calibrated for their language go.

    The model learns from the labelled rows of the documents themselves.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    into = unused(docs, "toxic_score")
    scored = toxicity.score_texts(docs, model, into=into)
    return scored.where(~toxicity.flagged(F.col(into), F.col("lang"), model)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier, or one edit from an earlier one, leave their texts; documents of which nothing is left go."""
    into = unused(docs, "dropped_lines")
    cleaned = lines.dedup_lines(docs, into=into)
    emptied = (F.size(into) > 0) & (F.btrim("text", F.lit(lines.BLANK + "\n")) == "")
    kept = cleaned.where(~emptied)
    return kept.select(*[(F.length("text").cast(kind).alias(name) if name == "n_chars" else F.col(name)) for name, kind in docs.dtypes])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the least key stays, and one row of it.

    The key is the id (NULL before all others) and, for repeated ids, a hash of the text; rows that repeat both are
    one document.
    """
    place = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(""))
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.concat_ws(":", place, F.hex(F.xxhash64("text"))))
    groups = ngram_join.similar_groups(keyed, key=key, width=5, percent=80)
    kept = groups.where(F.col(key) == F.col("component_id")).select(key).distinct()
    stay = keyed.join(kept, key, "left_semi")
    # Rows of one key are equal in id and text; the first of them stays.
    twice = groups.groupBy(key).count().where("count > 1").select(key)
    once = stay.join(twice, key, "left_anti")
    again = stay.join(twice, key, "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds question and answer of a test item go."""
    into = unused(docs, "leaks")
    marked = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"), into=into)
    return marked.where(F.size(into) == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of several permitted lengths with the ids of their documents."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: A trained classifier, greedy packing and iterated links have no SQL; tests/llm/test_pipeline.py stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet in the shared folder and read again.

    A stage's files go once the next stage is written, the last ones when the driver ends.
    """
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.deleteOnExit(path)
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:
            files.delete(before, True)
        before = path
    return docs
