"""Log-bilinear language model: trained in numpy by noise-contrastive estimation, normalised scores of whole texts.

The model predicts the class of a token from the class before it: score(w | v) = context(v) . target(w) + bias(w).
Classes: the end mark, the most frequent words (OWN, or GROWTH times the root of the number of word types where that is
more, so that the square of the classes grows as the vocabulary does), RARE classes of less frequent words by their first
two bytes, and one class for the tail: words under a count that only a join can look up, and unknown words, which are one
symbol.
Within a class the counts divide the probability; in the tail a discount goes to the unknown symbol. So every token
of any text has a probability, and they sum to 1.

Training sees the corpus as counts of (class before, class), gathered over all training rows. Every pair is visited, in
blocks of PAIRS, and its visits weigh as much together as its count: the work grows with the distinct pairs. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import table_cut
from tapeline.llm.shingles import LOWER, word_hashes

#: Words that stand for themselves at least, their growth, classes of rarer ones, words that tasks hold in memory at most.
OWN, GROWTH, RARE, FREQUENT = 2500, 4, 64, 1 << 20
#: (before, after) pairs that the driver holds at once.
PAIRS = 1 << 21
#: Components of a vector, noise classes a step, steps at least, visits a step, rate, seed, discount in the tail.
DIM, NOISE, STEPS, BATCH, RATE, SEED, DISCOUNT = 24, 64, 1500, 4096, 0.2, 11, 0.75
END = np.uint64(1)
STEM = np.uint64(RARE - 1)
SLOTS = 1 << 22
#: Characters handled at once.
AT_ONCE = 1 << 19


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token: the words of each text, then its end.

    The lowest bits of a word's hash are those of its first two bytes, so that a hash tells the class of a rare word.
    """
    raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) if t else b"" for t in texts]
    made, starts = word_hashes(b" ".join(raw) + b" ", (2,))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    n = np.bincount(owner, minlength=len(raw))
    at = np.arange(len(owner)) + owner
    size = len(owner) + len(raw)
    hashes = np.full(size, END)
    hashes[at] = made[:, 0] & ~STEM | made[:, 1] & STEM
    return hashes, np.repeat(np.arange(len(raw)), n + 1)


def parts(values: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for value in values:
        part.append(value)
        size += len(value or "")
        if size > AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch], keyed) -> Iterator[pa.RecordBatch]:
    """Counts of what ``keyed`` yields for a task's texts; kept small by merging, sent on when many."""
    keys, counts, size = [], [], 0
    for batch in batches:
        for part in parts(batch.column(0).to_pylist()):
            key, count = np.unique(keyed(part), return_counts=True)
            keys.append(key)
            counts.append(count)
            size += len(key)
            if size > 2_000_000:
                keys, counts = ([x] for x in merged(keys, counts))
                size = len(keys[0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], names=["key", "count"])
                    keys, counts, size = [], [], 0
    if keys:
        key, count = merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "count"])


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 22)).astype(np.int64)


@dataclass
class Vocabulary:
    tokens: int  # N
    types: int  # V
    least: int  # count under which words are tail
    keys: np.ndarray  # sorted hashes of the other words
    counts: np.ndarray
    classes: np.ndarray
    inside: np.ndarray  # log10 of the word's share of its class
    tail_tokens: int
    tail_types: int
    own: int = OWN  # words that stand for themselves

    @property
    def size(self) -> int:
        """Number of classes; the last one is the tail."""
        return self.own + RARE + 2

    def __post_init__(self) -> None:
        self.slots = np.zeros(SLOTS, dtype=np.int32)
        self.slots[slot(self.keys)] = np.arange(len(self.keys))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}  # made again where it is used

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is tail."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = self.slots[slot(hashes)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != hashes)
        again = np.minimum(np.searchsorted(self.keys, hashes[missed]), len(self.keys) - 1)
        at[missed] = np.where(self.keys[again] == hashes[missed], again, -1)
        return at

    def classes_of(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.classes[at] if len(self.classes) else self.size - 1, self.size - 1)


def made(keys: np.ndarray, counts: np.ndarray, total: int, types: int, least: int) -> Vocabulary:
    """Classes of the words (sorted hashes) that tasks hold: the end mark 0, the most frequent their own, then by stem."""
    own = max(OWN, math.ceil(GROWTH * math.sqrt(types)))
    classes = 1 + own + (keys & STEM).astype(np.int64)
    top = [i for i in np.lexsort((keys, -counts))[: own + 1] if keys[i] != END][:own]
    classes[top] = 1 + np.arange(len(top))
    classes[keys == END] = 0
    mass = np.bincount(classes, weights=counts, minlength=own + RARE + 2)
    inside = np.log10(counts / mass[classes])
    return Vocabulary(total, types, least, keys, counts, classes, inside, int(total - counts.sum()), int(types - len(keys)), own)


def class_pairs(vocabulary: Vocabulary, texts: list[str | None]) -> np.ndarray:
    hashes, owner = tokens(texts)
    classes = vocabulary.classes_of(vocabulary.find(hashes))
    return before(classes, owner) * vocabulary.size + classes


#: Classes of the smallest vocabularies.
CLASSES = OWN + RARE + 2


def before(classes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Class before each token; before the first one the end mark's."""
    out = np.r_[0, classes[:-1]]
    out[np.r_[True, owner[1:] != owner[:-1]]] = 0
    return out


def visits(counts: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the pair of each visit, and its weight (1 at most): a pair's visits come to its count, in ``unit``."""
    times = np.maximum(np.ceil(counts / unit), 1).astype(np.int64)
    return np.repeat(np.arange(len(counts), dtype=np.int32), times), np.repeat((counts / (times * unit)).astype(np.float32), times)


def train(blocks: Iterable[tuple[np.ndarray, np.ndarray]], unigram: np.ndarray, unit: float, seed: int = SEED) -> dict:
    """Noise-contrastive estimation on blocks of weighted (before * classes + after) pairs, each visited wholly."""
    rng = np.random.default_rng(seed)
    size = len(unigram)
    noise = (unigram + 1.0) / (unigram.sum() + len(unigram))
    log_noise = np.log(noise * NOISE).astype(np.float32)
    context, target = (rng.normal(0, 0.1, (size, DIM)).astype(np.float32) for _ in range(2))
    bias = np.log(noise).astype(np.float32)
    squares = [np.full(x.shape, 1e-2, dtype=np.float32) for x in (context, target, bias)]
    noise_chance = np.cumsum(noise)

    def move(k: int, value: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        row, back = np.unique(rows, return_inverse=True)
        total = np.zeros((len(row), *value.shape[1:]), dtype=np.float32)
        np.add.at(total, back, gradient)
        squares[k][row] += total**2
        value[row] += RATE * total / np.sqrt(squares[k][row])

    for pairs, counts in blocks:
        place, share = visits(counts, unit)
        order = rng.permutation(len(place)).astype(np.int32)
        for at in range(0, len(order), BATCH):
            step = order[at : at + BATCH]
            chosen, weight = pairs[place[step]], share[step]
            v, w = chosen // size, chosen % size
            n = np.minimum(np.searchsorted(noise_chance, rng.random(NOISE)), size - 1)
            c, q, m = context[v], target[w], target[n]
            true = weight / (1 + np.exp(np.clip((c * q).sum(1) + bias[w] - log_noise[w], -30, 30)))
            false = -weight[:, None] / (1 + np.exp(-np.clip(c @ m.T + bias[n] - log_noise[n], -30, 30)))
            scale = np.float32(1 / 64)
            move(0, context, v, scale * (true[:, None] * q + false @ m))
            move(1, target, np.r_[w, n], scale * np.r_[true[:, None] * c, false.T @ c])
            move(2, bias, np.r_[w, n], scale * np.r_[true, false.sum(0)])
    return {"context": context, "target": target, "bias": bias, "norm": normalisers(context, target, bias)}


def normalisers(context: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum of exp(score) over all classes, for each class before, by batches of contexts."""
    out = np.empty(len(bias))
    for at in range(0, len(bias), 256):
        s = context[at : at + 256] @ target.T + bias
        most = s.max(axis=1, keepdims=True)
        out[at : at + 256] = most[:, 0] + np.log(np.exp(s - most).sum(axis=1, dtype=np.float64))
    return out


def class_logs(net: dict, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 P(class w | class before v) of each pair, normalised."""
    out = np.empty(len(v))
    for at in range(0, len(v), 1 << 16):
        x, y = v[at : at + (1 << 16)], w[at : at + (1 << 16)]
        score = np.einsum("ij,ij->i", net["context"][x], net["target"][y]) + net["bias"][y]
        out[at : at + (1 << 16)] = (score - net["norm"][x]) / math.log(10)
    return out


def log_probabilities(net: dict) -> np.ndarray:
    """log10 P(class | class before) of all classes: the whole table, for looking at a small model."""
    size = len(net["bias"])
    return np.array([class_logs(net, np.full(size, v), np.arange(size)) for v in range(size)])


@dataclass
class Model:
    vocabulary: Vocabulary
    net: dict
    tail: DataFrame  # key, count of the tail's words


def fit(docs: DataFrame, text: str = "text", steps: int = STEPS) -> Model:
    """Count the words of ``docs``, all of which train, and train the net on the counts of their classes."""
    content = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = "key bigint, count bigint"
    counts = content.mapInArrow(lambda b: counted(b, lambda t: tokens(t)[0]), schema).groupBy("key").agg(F.sum("count").alias("count"))
    counts = table_cut(counts)
    level = F.floor(F.log2("count") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("count").alias("tokens"), F.min("count").alias("least")).orderBy(F.desc("level")).collect()
    total, types = sum(r["tokens"] for r in sizes), sum(r["types"] for r in sizes)
    least, held = 1 << 62, 0
    for r in sizes:
        held += r["types"]
        if held > FREQUENT or r["least"] < 2:
            break
        least = r["least"]
    frequent = counts.where(F.col("count") >= least).toArrow()
    keys, n = frequent["key"].to_numpy().view(np.uint64), frequent["count"].to_numpy()
    order = np.argsort(keys)
    vocabulary = made(keys[order], n[order], total, types, least)
    kept = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pairs = content.mapInArrow(lambda b: counted(b, lambda t: class_pairs(kept.value, t)), schema).groupBy("key").agg(F.sum("count").alias("count"))
    pairs = table_cut(pairs)
    after = pairs.groupBy((F.col("key") % vocabulary.size).alias("class")).agg(F.sum("count").alias("count"), F.count("*").alias("pairs")).toArrow()
    unigram, distinct = np.zeros(vocabulary.size), sum(after["pairs"].to_pylist())
    unigram[after["class"].to_numpy()] = after["count"].to_numpy()
    unit = max(1.0, float(unigram.sum())) / max(1, steps * BATCH, distinct)
    return Model(vocabulary, train(pair_blocks(pairs, distinct, unit), unigram, unit), counts.where(F.col("count") < least))


def pair_blocks(pairs: DataFrame, distinct: int, unit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs and their counts, dealt into blocks by a hash of the pair; a pair of many visits is in several blocks."""
    blocks = -(-distinct // PAIRS)
    if blocks > 1:
        times = F.least(F.lit(blocks), F.greatest(F.lit(1), F.ceil(F.col("count") / unit))).cast("int")
        split = pairs.select("key", (F.col("count") / times).alias("count"), F.explode(F.sequence(F.lit(0), times - 1)).alias("i"))
        pairs = table_cut(split.select("key", "count", F.pmod(F.xxhash64("key") + F.col("i"), F.lit(blocks)).cast("int").alias("block")).sortWithinPartitions("block"))
    for k in range(blocks):
        block = (pairs.where(F.col("block") == k) if blocks > 1 else pairs).select("key", "count").toArrow()
        code, weight = block["key"].to_numpy(), block["count"].to_numpy()
        order = np.argsort(code)
        yield code[order], weight[order]


def scored(batches: Iterator[pa.RecordBatch], model: tuple[Vocabulary, dict]) -> Iterator[pa.RecordBatch]:
    """Per row its key, a number of its own, sums over the tokens that the task knows, and the tail's hashes."""
    from pyspark import TaskContext

    vocabulary, net = model
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for part in parts(batch.column(1).to_pylist()):
            hashes, owner = tokens(part)
            at = vocabulary.find(hashes)
            classes = vocabulary.classes_of(at)
            known = at >= 0
            model_log = class_logs(net, before(classes, owner), classes)
            model_log[known] += vocabulary.inside[at[known]]
            base = np.zeros(len(at))
            base[known] = np.log10(vocabulary.counts[at[known]] + 1.0)
            sums = [np.bincount(owner, minlength=len(part)), *(np.bincount(owner, weights=x, minlength=len(part)) for x in (known, base, model_log))]
            rest = np.split(hashes[~known].view(np.int64), np.cumsum(np.bincount(owner[~known], minlength=len(part)))[:-1])
            for column, value in zip(out, [*sums, rest], strict=True):
                column.extend(value)
        rows = len(out[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number + np.arange(rows)), pa.array(out[0], pa.int64()), pa.array(np.array(out[1], dtype=np.int64)), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.list_(pa.int64()))], names=["key", "number", "n_tokens", "n_known", "base", "model", "tail"])
        number += rows


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    A NULL or empty text is an end mark alone. Without training tokens every token is the unknown symbol, of
    probability 1. Repeated rows are scored each; NULL keys stay; an empty table stays empty; other columns are not
    looked at.
    """
    v = model.vocabulary
    kept = docs.sparkSession.sparkContext.broadcast((v, model.net))
    content = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = content.schema["key"].dataType.simpleString()
    rows = table_cut(content.mapInArrow(lambda b: scored(b, kept.value), f"key {kind}, number bigint, n_tokens bigint, n_known bigint, base double, model double, tail array<bigint>"))
    tail = rows.select("number", F.explode("tail").alias("hash")).join(model.tail.select(F.col("key").alias("hash"), "count"), "hash", "left")
    count = F.coalesce("count", F.lit(0))
    share = F.when(count > 0, count - DISCOUNT).otherwise(F.lit(DISCOUNT * v.tail_types)) / max(1, v.tail_tokens) if v.tail_types else F.lit(1.0)
    looked = tail.groupBy("number").agg(F.sum((count > 0).cast("long")).alias("known"), F.sum(F.log10(count + 1.0)).alias("b"), F.sum(F.log10(share)).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rows.join(looked, "number", "left")
    base = F.col("base") + zero("b") - F.col("n_tokens") * math.log10(v.tokens + v.types + 1)
    whole = F.col("model") + zero("m") if v.tokens else F.lit(0.0)
    return out.select(F.col("key").alias(key), "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))
