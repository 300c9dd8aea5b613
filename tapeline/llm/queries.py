"""Registered queries of the training-data operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import chat, decontam, lexical, lines, lm, merkle, ngram_join, packing, pii, quality_rules, topk, toxicity, warc
from tapeline.llm.common import fold, read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = found.select("doc_id", F.explode("leaks").alias("leak"))
    return hit.select("doc_id", F.col("leak.item").alias("item_id"), *[F.round(f"leak.{c}", 6).alias(c) for c in ("score", "question", "answer")])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), toxicity.flagged(F.col("score"), F.col("lang"), model).alias("flagged"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lines.dedup_lines(docs).select("doc_id", "dropped_lines", F.size("dropped_lines").alias("n_dropped"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars_left"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve_revisits(warc.page_records(read(spark, sf_dir, "pages"))))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    return lm.score(docs, lm.fit(docs.where(~held_out))).withColumn("held_out", held_out)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations")
    return chat.link_calls(chat.conversation_calls(messages), chat.conversation_results(messages), chat.SCHEMAS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(read(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "op1_packing": (op1_packing, None),
    "op2_topk": (op2_topk, OP2_SQL),
    "op3_decontamination": (op3_decontamination, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_line_dedup": (op5_line_dedup, None),
    "op6_warc": (op6_warc, warc.SQL),
    "op7_ngram_join": (op7_ngram_join, None),
    "op8_lm_scoring": (op8_lm_scoring, None),
    "op9_chat_formatting": (op9_chat_formatting, None),
    "op10_pii": (op10_pii, None),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle.SQL),
    "op12_quality_rules": (op12_quality_rules, None),
    "op13_lexical_search": (op13_lexical_search, lexical.SQL),
}
