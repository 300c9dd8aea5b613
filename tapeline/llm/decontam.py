"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds per word the items with their impacts (BM25 weight as a share of the item's own total, so a score of
1 is the whole item), sorted into blocks of items with block maxima. Every item scored at THRESHOLD or more is found,
as in block-max WAND: words whose list maxima cannot reach the threshold together propose nothing; a block is read
only if its maxima reach it. All passages of a batch are handled at once in numpy. Then question and answer of the
item are looked for in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.shingles import word_hashes

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.8
#: Least step between passages; a passage is two steps, so that an item up to a step long lies whole in one.
STEP, BLOCK_ITEMS, GRAM = 64, 8, 3
#: Text of test items that one index may hold; a larger benchmark is indexed in slices, one after the other.
SLICE_BYTES = 64 << 20
#: Characters handled at once.
AT_ONCE = 1 << 19
#: Below so many (word, block) keys an index keeps a table of them.
DENSE = 1 << 22
SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def cleaned(text: str | None) -> bytes:
    """Lower-case text with ASCII marks and blanks as spaces."""
    return text.lower().encode("utf-8", "surrogatepass").translate(SPLIT) if text else b""


def tokens(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def question_answer(text: str) -> tuple[str, str]:
    """Last sentence, and what stands before it; a single sentence is both."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def grams(ids: np.ndarray, n: int = GRAM) -> set[tuple[int, ...]]:
    return set(zip(*(ids[i : len(ids) - n + 1 + i].tolist() for i in range(n)), strict=True)) if 0 < n <= len(ids) else set()


def parts_of(question: list[int], answer: list[int]) -> tuple[tuple[int, set], tuple[int, set]]:
    """What is looked for of question and answer: run length and runs.

    Runs of GRAM words; a part with fewer words is looked for as one run together with the words next to it (up to
    GRAM of the other part), since a word or two alone say little. An item of one short sentence is that run.
    """
    def sought(own: list[int], run: list[int]) -> tuple[int, set]:
        return (GRAM, grams(np.array(own))) if len(own) >= GRAM else (len(run), {tuple(run)} if run else set())

    if question == answer:
        return sought(question, question), sought(question, question)
    return sought(question, question + answer[:GRAM]), sought(answer, question[-GRAM:] + answer)


@dataclass
class Index:
    words: dict[bytes, int]
    hashes: np.ndarray  # of the words, sorted
    hash_word: np.ndarray
    items: list
    step: int
    most: np.ndarray  # per word its largest impact
    block_start: np.ndarray  # per word its first entry in block_of
    block_of: np.ndarray
    block_most: np.ndarray
    entry_key: np.ndarray  # word * blocks + block, sorted
    entry_item: np.ndarray
    entry_impact: np.ndarray
    blocks: int
    questions: list[tuple[int, set]]
    answers: list[tuple[int, set]]

    def __post_init__(self) -> None:
        self.starts = np.searchsorted(self.entry_key, np.arange(len(self.words) * self.blocks + 1)) if len(self.words) * self.blocks < DENSE else None

    def entries(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the entries of each (word, block) key."""
        if self.starts is not None:
            return self.starts[key], self.starts[key + 1]
        return np.searchsorted(self.entry_key, key), np.searchsorted(self.entry_key, key, side="right")


def build(items: list[tuple[object, str, str]], frequency: dict[bytes, int], number: int, mean_length: float, longest: int) -> Index:
    """Index of (id, question, answer) with document frequencies over the whole benchmark."""
    listed = [(key, tokens(q), tokens(a)) for key, q, a in items]
    words: dict[bytes, int] = {}
    for _, q, a in listed:
        for w in q + a:
            words.setdefault(w, len(words))
    idf = np.array([np.log(1 + (number - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in words])
    w_ids, i_ids, impacts, questions, answers = [], [], [], [], []
    for i, (_, q, a) in enumerate(listed):
        whole = q if q == a else q + a
        ids, tf = np.unique([words[w] for w in whole], return_counts=True)
        weight = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole) / mean_length))
        w_ids.append(ids)
        i_ids.append(np.full(len(ids), i))
        impacts.append(weight / weight.sum())
        asked, told = parts_of([words[w] for w in q], [words[w] for w in a])
        questions.append(asked)
        answers.append(told)
    w, i, x = np.concatenate(w_ids), np.concatenate(i_ids), np.concatenate(impacts)
    blocks = -(-len(listed) // BLOCK_ITEMS)
    key = w * blocks + i // BLOCK_ITEMS
    order = np.argsort(key, kind="stable")
    key, i, x = key[order], i[order], x[order]
    at = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
    pairs = key[at]
    block_most = np.maximum.reduceat(x, at)
    block_start = np.searchsorted(pairs, np.arange(len(words) + 1) * blocks)
    most = np.maximum.reduceat(block_most, block_start[:-1])
    hashes, _ = word_hashes(b" ".join(words) + b" ")
    by_hash = np.argsort(hashes)
    return Index(words, hashes[by_hash], by_hash, [k for k, _, _ in listed], max(STEP, longest), most, block_start, pairs % blocks, block_most, key, i, x, blocks, questions, answers)


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of every entry of the given ranges."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def search(passage: np.ndarray, word: np.ndarray, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all scores of ``threshold`` or more; input: distinct (passage, word), by passage."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    slack = threshold - 1e-9
    reach = np.bincount(passage, weights=index.most[word])[passage] >= slack if len(passage) else np.empty(0, bool)
    passage, word = passage[reach], word[reach]
    # Words by rising maximum within the passage; those whose running total stays below the threshold propose nothing.
    top = index.most[word]
    order = np.lexsort((top, passage))
    passage, word, top = passage[order], word[order], top[order]
    first = np.r_[0, np.flatnonzero(np.diff(passage)) + 1] if len(passage) else np.empty(0, np.int64)
    if not len(first):
        return none
    run = np.cumsum(top)
    before = np.repeat(run[first] - top[first], np.diff(np.r_[first, len(passage)]))
    essential = run - before >= slack
    if not essential.any():
        return none
    rest = np.bincount(passage, weights=np.where(essential, 0.0, top))
    p, w = passage[essential], word[essential]
    owner, at = expand(index.block_start[w], index.block_start[w + 1])
    key, back = np.unique(p[owner] * index.blocks + index.block_of[at], return_inverse=True)
    bound = np.bincount(back, weights=index.block_most[at])
    key = key[bound + rest[key // index.blocks] >= slack]
    if not len(key):
        return none
    # The blocks left are read: every word of the passage in that block.
    p, block = key // index.blocks, key % index.blocks
    ends = np.r_[first[1:], len(passage)]
    owner, at = expand(first[np.searchsorted(passage[first], p)], ends[np.searchsorted(passage[first], p)])
    wanted = word[at] * index.blocks + block[owner]
    low, high = index.entries(wanted)
    some = np.flatnonzero(high > low)
    owner2, entry = expand(low[some], high[some])
    owner2 = some[owner2]
    pair, back = np.unique(p[owner[owner2]] * len(index.items) + index.entry_item[entry], return_inverse=True)
    score = np.bincount(back, weights=index.entry_impact[entry])
    kept = score >= slack
    return pair[kept] // len(index.items), pair[kept] % len(index.items), score[kept]


def hits_of(texts: list[str | None], index: Index, threshold: float, overlap: float) -> list[list[dict]]:
    """Verified hits of each text, by item."""
    out: list[list[dict]] = [[] for _ in texts]
    raw = [cleaned(t) for t in texts]
    hashes, starts = word_hashes(b" ".join(raw) + b" ")
    if not len(hashes):
        return out
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    length = np.bincount(owner, minlength=len(raw))
    first = np.cumsum(length) - length
    at = np.minimum(np.searchsorted(index.hashes, hashes), len(index.hashes) - 1)
    ids = np.where(index.hashes[at] == hashes, index.hash_word[at], -1)
    passages = np.maximum(1, -(-length // index.step) - 1)
    base = np.cumsum(passages) - passages
    known = np.flatnonzero(ids >= 0)
    d = owner[known]
    chunk = (known - first[d]) // index.step
    ahead, behind = chunk < passages[d], chunk >= 1
    passage = np.r_[(base[d] + chunk)[ahead], (base[d] + chunk - 1)[behind]]
    word = np.r_[ids[known][ahead], ids[known][behind]]
    distinct = np.unique(passage * len(index.words) + word)
    passage, word = distinct // len(index.words), distinct % len(index.words)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, i, score in zip(*search(passage, word, index, threshold), strict=True):
        d = int(np.searchsorted(base, p, side="right")) - 1
        k = int(p - base[d])
        own = ids[first[d] + k * index.step : first[d] + min(length[d], (k + 2) * index.step)]
        wanted = (index.questions[i], index.answers[i])
        seen = {n: grams(own, n) for n in {n for n, _ in wanted}}
        q, a = (len(runs & seen[n]) / max(1, len(runs)) for n, runs in wanted)
        if q >= overlap and a >= overlap:
            best[(d, int(i))] = max(best.get((d, int(i)), (0.0, 0.0, 0.0)), (float(score), q, a))
    for (d, i), (score, q, a) in sorted(best.items()):
        out[d].append({"item": index.items[i], "score": min(1.0, score), "question": q, "answer": a})
    return out


def marked(batches: Iterator[pa.RecordBatch], text: str, into: str, index: Index, threshold: float, overlap: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[list[dict]] = []
        part: list[str | None] = []
        size = 0
        for value in [*batch.column(text).to_pylist(), ...]:
            if value is ... or size > AT_ONCE:
                found += hits_of(part, index, threshold, overlap)
                part, size = [], 0
            if value is not ...:
                part.append(value)
                size += len(value or "")
        old = batch.column(into).to_pylist()
        kind = batch.schema.field(into).type
        yield batch.set_column(batch.schema.get_field_index(into), into, pa.array([x + y for x, y in zip(old, found, strict=True)], kind))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, into: str = "leaks", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``into``: array of (item, score, question, answer) of the test items that a passage holds.

    ``score`` is the best BM25 share over the passages, ``question`` and ``answer`` the shares of their three-word
    runs in that passage, both ``overlap`` or more; a part of one or two words counts with its neighbours, as
    :func:`parts_of` says. Whole texts are read. Items without words take no part; repeated
    items are listed each; NULL and empty texts, an empty benchmark or an empty table give empty arrays or rows.
    Other columns pass through, except that a column named ``into`` is replaced.
    """
    spark = docs.sparkSession
    item = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    kind = item.schema["item"].dataType.simpleString()
    out = docs.withColumn(into, F.array().cast(f"array<struct<item:{kind},score:double,question:double,answer:double>>"))
    total = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return out
    counted = item.select("text").mapInArrow(word_counts, COUNTS)
    stats = counted.where("word IS NULL").agg(F.sum("items"), F.sum("length"), F.max("longest")).first()
    number, mean_length, longest = stats[0], stats[1] / max(1, stats[0]), stats[2]
    frequencies = counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("items").alias("items"))
    slices = -(-total // slice_bytes)
    for s in range(slices):
        own = item.where(F.pmod(F.xxhash64("item", "text", "row"), F.lit(slices)) == s)
        listed = [(r.item, *question_answer(r.text)) for r in own.collect() if tokens(r.text)]
        if not listed:
            continue
        words = own.select("text").mapInArrow(word_counts, COUNTS).where("word IS NOT NULL").select("word").distinct()
        frequency = {bytes(r.word): r["items"] for r in frequencies.join(words, "word").collect()}
        index = spark.sparkContext.broadcast(build(listed, frequency, number, mean_length, longest))
        schema = out.schema
        out = out.mapInArrow(lambda batches, index=index: marked(batches, text, into, index.value, threshold, overlap), schema)
    return out


COUNTS = "word binary, items bigint, length bigint, longest bigint"


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: words with the number of its items that hold them, and one row (NULL word) of items, words, longest item."""
    frequency: dict[bytes, int] = {}
    number = length = longest = 0
    for batch in batches:
        for value in batch.column(0).to_pylist():
            if words := tokens(value):
                number, length, longest = number + 1, length + len(words), max(longest, len(words))
                for w in set(words):
                    frequency[w] = frequency.get(w, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array([*frequency, None], pa.binary()), pa.array([*frequency.values(), number], pa.int64()), pa.array([0] * len(frequency) + [length], pa.int64()), pa.array([0] * len(frequency) + [longest], pa.int64())], names=["word", "items", "length", "longest"])
