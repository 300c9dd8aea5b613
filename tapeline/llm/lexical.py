"""Ranked lexical search of a few items over all documents, by scanning the texts with one automaton.

Every term of every item, with a guard before and after it, goes into one Aho-Corasick automaton that travels to the
tasks. Texts are scanned twice, whole: once for the corpus counts, once for the scores; the documents are never
indexed. An output of the automaton is a term, and a table leads from it to the items that hold it. Each task keeps
the best rows of every item, and the best of those are the answer.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks between terms are the ASCII characters but letters and digits; letters A-Z are lowered.
GUARD = "\x00"
SPREAD = {c: (chr(c).lower() if chr(c).isalnum() else GUARD) for c in range(128)}
TERM = re.compile("[^\x00]+")
#: Text of items that one automaton may hold (a node of it takes some 50 bytes); more items go in slices, two scans each.
SLICE_BYTES = 2 << 20
#: Characters scanned at once, and (document, item) cells scored at once.
AT_ONCE, CELLS = 1 << 19, 1 << 22


def spread(text: str | None) -> str:
    """Lower-cased in A-Z, one guard between terms, before the first and after the last; '' without terms."""
    terms = TERM.findall(text.translate(SPREAD)) if text else []
    return GUARD + GUARD.join(terms) + GUARD if terms else ""


def terms_of(text: str | None) -> list[str]:
    return spread(text).split(GUARD)[1:-1] if text else []


@dataclass
class Items:
    """Terms by number; per term the items that hold it and how often."""

    automaton: bytes
    terms: list[str]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    count: int


def built(texts: list[str]) -> Items:
    numbers: dict[str, int] = {}
    held: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        own: dict[int, int] = {}
        for term in terms_of(text):
            t = numbers.setdefault(term, len(numbers))
            own[t] = own.get(t, 0) + 1
        held += [(t, i, n) for t, n in own.items()]
    machine = ahocorasick.Automaton()
    for term, t in numbers.items():
        machine.add_word(GUARD + term + GUARD, t)
    if numbers:
        machine.make_automaton()
    held.sort()
    table = np.array(held, dtype=np.int64).reshape(-1, 3)
    return Items(pickle.dumps(machine), list(numbers), np.searchsorted(table[:, 0], np.arange(len(numbers) + 1)), table[:, 1], table[:, 2], len(texts))


def found(texts: list[str | None], machine: ahocorasick.Automaton, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; then text, term and count of each term found in one, by text."""
    laid = [spread(t) for t in texts]
    length = np.array([max(0, s.count(GUARD) - 1) for s in laid], dtype=np.int64)
    hits = [np.fromiter((t for _, t in machine.iter(s)), np.int64) if s else np.empty(0, np.int64) for s in laid]
    key = np.concatenate(hits) + np.repeat(np.arange(len(hits)) * terms, [len(h) for h in hits]) if hits else np.empty(0, np.int64)
    key, tf = np.unique(key, return_counts=True)
    return length, key // terms, key % terms, tf


def parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of a bounded size with the place of the first; one text is never cut."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= AT_ONCE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def tallied(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Of a task: documents that hold each term; documents with a term and their length in a row without term."""
    machine, terms = pickle.loads(items.automaton), len(items.terms)
    df = np.zeros(terms, dtype=np.int64)
    docs = length = 0
    for batch in batches:
        for _, some in parts(batch.column(0).to_pylist()):
            n, _, term, _ = found(some, machine, terms)
            df += np.bincount(term, minlength=terms)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), None], pa.int64()), pa.array([*df[seen].tolist(), docs], pa.int64()), pa.array([0] * len(seen) + [length], pa.int64())], names=["term", "docs", "length"])


def best(rows: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` by falling score, then by key, a NULL key last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]


def scanned(batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, number: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of a task for each item: (item, key, score)."""
    machine, terms = pickle.loads(items.automaton), len(items.terms)
    top: dict[int, list[tuple]] = {}
    bar = np.zeros(items.count, dtype=np.int64)  # the least score that may still count
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        keys = batch.column(0).to_pylist()
        for at, some in parts(batch.column(1).to_pylist()):
            n, text, term, tf = found(some, machine, terms)
            m = 75 + (25 * n * number) // length
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[text]))
            step = max(1, CELLS // items.count)
            for low in range(0, len(some), step):
                own = slice(*np.searchsorted(text, [low, low + step]))
                reach = items.start[term[own] + 1] - items.start[term[own]]
                owner = np.repeat(np.arange(own.start, own.stop), reach)
                entry = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(items.start[term[own]], reach)
                score = np.zeros(min(step, len(some) - low) * items.count, dtype=np.int64)
                np.add.at(score, (text[owner] - low) * items.count + items.item[entry], value[owner] * items.times[entry])
                score = score.reshape(-1, items.count)
                for d, i in zip(*np.nonzero((score >= bar) & (score > 0)), strict=True):
                    rows = top.setdefault(int(i), [])
                    rows.append((int(score[d, i]), keys[at + low + int(d)]))
                    if len(rows) >= 8 * k:
                        top[int(i)] = best(rows, k)
                        bar[i] = top[int(i)][-1][0]
    rows = [(i, key, score) for i, held in top.items() for score, key in best(held, k)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "key", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The ``k`` best rows of ``docs`` for every row of ``items``: (item, rank from 1, key, score), scores above 0 only.

    Whole texts are read. Rank follows falling score, then rising ``key``, a NULL key last; rows alike in both keep any
    order. A text without terms, or a NULL one, is found by nothing and counts for nothing; an item without terms has
    no rows; items that repeat an id, NULL included, are each an item. Empty tables give no rows. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    kind, item_kind = texts.schema["key"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    results = []
    for s in range(slices):
        held = (asked if slices == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == s)).collect()  # slice_bytes of text
        own = built([r.text for r in held])
        if not own.terms:
            continue
        machine = spark.sparkContext.broadcast(own)
        counts = texts.select("text").mapInArrow(lambda b, m=machine: tallied(b, m.value), "term bigint, docs bigint, length bigint").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).collect()
        number, length = next((r.docs, r["length"]) for r in counts if r.term is None) if counts else (0, 0)
        if not number:
            continue
        df = np.zeros(len(own.terms), dtype=np.int64)
        for r in counts:
            if r.term is not None:
                df[r.term] = r.docs
        weight = np.floor(1000 * np.log((2 * number + 2) / (2 * df + 1))).astype(np.int64)
        found_rows = texts.mapInArrow(lambda b, m=machine, w=weight, n=number, size=length: scanned(b, m.value, w, n, size, k), f"item bigint, key {kind}, score bigint")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = found_rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(held)], f"item bigint, name {item_kind}")
        results.append(ranked.join(names, "item").select(F.col("name").alias("item"), "rank", "key", "score"))
    out = results[0] if results else spark.createDataFrame([], f"item {item_kind}, rank int, key {kind}, score bigint")
    for more in results[1:]:
        out = out.union(more)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


SQL = r"""
WITH found AS (
    SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
texts AS (SELECT *, len(ws) AS n FROM found WHERE len(ws) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len_all FROM texts),
tfs AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(ws) AS term FROM texts) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL),
scored AS (
    SELECT item_id, row_id, any_value(doc_id) AS doc_id,
        CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len_all)))) AS BIGINT) AS score
    FROM asked JOIN tfs USING (term) JOIN dfs USING (term), totals GROUP BY item_id, row_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20
"""
