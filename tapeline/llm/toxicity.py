"""Toxicity: a convolutional text classifier, trained on every labelled row outside the held-out fold, scored on every text.

A word is embedded by two hashes of the whole and by hashes of its first bytes, each with a table of its own, so two
words are taken for one another only if they collide in all, and word forms share their stem. Filters of several widths run over the whole text and are max-pooled. Word vectors start at zero:
words that training never pointed at stay silent.

The labelled rows are dealt into shards. In each round every shard starts from the same net and goes once over its rows,
a mini-batch at a time; then the nets are averaged, a word vector over the shards that moved it. The driver passes the
averaged rows on, packed as they come; whole tables stand in the tasks only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import fold, release_memory, with_size
from tapeline.llm.decontam import cleaned
from tapeline.llm.shingles import mixed, word_hashes
from tapeline.session import cut

#: Labelled rows of a shard, about, where there are more than SHARDS such shards; fewer rows make SHARDS shards of LEAST rows
#: or more. One labelled row in VALIDATION sets thresholds and is not trained on.
SHARD, SHARDS, LEAST, VALIDATION = 32_000, 8, 1000, 5
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
PREFIXES = (4, 6)
TABLES = 2 + len(PREFIXES)
EPOCHS, BATCH, RATE, WEIGHT, SEED = 8, 64, 0.1, 3.0, 7
#: A threshold is set from that many rows of each label at least, and stays in that range.
EVIDENCE, RANGE = 20, (0.3, 0.7)
#: Steps of a score between which a threshold may lie.
BINS = 1 << 12
#: Rows of a table that are averaged together; texts and characters shuffled together before they are dealt into batches.
PIECE, MIXED, MIXED_CHARS = 1 << 14, 2048, 1 << 22
#: Characters handled at once; windows multiplied at once; bytes that a broadcast label takes, about.
AT_ONCE, SPAN, LABEL_BYTES = 1 << 19, 1 << 12, 64


@dataclass
class Net:
    tables: list[np.ndarray]
    kernels: list[np.ndarray]  # per width: width x TABLES*DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    squares: dict = field(default_factory=dict)
    moved: dict = field(default_factory=dict)

    @staticmethod
    def of(small: dict) -> Net:
        tables = [np.zeros((BUCKETS, DIM), dtype=np.float32) for _ in range(TABLES)]
        for t, r, v in zip(tables, small["rows"], small["values"], strict=True):
            t[r] = v
        return Net(tables, small["kernels"], small["biases"], small["out"], small["bias"])


def fresh(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.3, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Net([np.zeros((BUCKETS, DIM), dtype=np.float32) for _ in range(TABLES)], kernels, [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32))


def word_ids(texts: list[str | None]) -> list[np.ndarray]:
    """Per text the buckets of its lower-cased words, a column for each table."""
    raw = [cleaned(t) for t in texts]
    hashes, starts = word_hashes(b" ".join(raw) + b" ", PREFIXES)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    hashes = np.concatenate([hashes[:, :1], mixed(hashes[:, :1]), hashes[:, 1:]], axis=1)
    buckets = (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + np.int32(1)
    return np.split(buckets, np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1])


def laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words in a row, two silent ones after each text; first window and text of each window."""
    gap = max(WIDTHS) - 1
    sizes = np.array([len(t) + gap for t in texts])
    first = np.cumsum(sizes) - sizes
    buckets = np.zeros((TABLES, int(sizes.sum()) + gap), dtype=np.int64)
    if len(texts):
        words = np.concatenate(texts)
        at = np.arange(len(words)) + np.repeat(np.arange(len(texts)) * gap, [len(t) for t in texts])
        buckets[:, at] = words.T
    return buckets, first, np.repeat(np.arange(len(texts)), sizes)


def vectors(net: Net, buckets: np.ndarray) -> np.ndarray:
    """A row per word: its vectors of all tables."""
    return np.concatenate([table.take(own, axis=0) for table, own in zip(net.tables, buckets, strict=True)], axis=1)


def forward(net: Net, buckets: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per width the windows' values, a row for each filter; per text the pooled filters of all widths."""
    gap = max(WIDTHS) - 1
    n = buckets.shape[1] - gap
    flat = np.concatenate([part for kernel in net.kernels for part in kernel], axis=1).T
    windows = [np.empty((FILTERS, n), dtype=np.float32) for _ in WIDTHS]
    for at in range(0, n, SPAN):
        product = flat @ vectors(net, buckets[:, at : at + SPAN + gap]).T
        size, row = min(SPAN, n - at), 0
        for h, width, bias in zip(windows, WIDTHS, net.biases, strict=True):
            own = h[:, at : at + size]
            np.add(product[row : row + FILTERS, :size], bias[:, None], out=own)
            for o in range(1, width):
                own += product[row + o * FILTERS : row + (o + 1) * FILTERS, o : o + size]
            row += width * FILTERS
    silent = np.flatnonzero(buckets[0][:n] == 0)
    for h in windows:
        h[:, silent] = 0  # a window begins at a word: one that began after a text would reach into the next
    pooled = np.concatenate([np.maximum.reduceat(h, first, axis=1) for h in windows]).T
    return windows, np.maximum(pooled, 0, order="C")


def scores(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    buckets, first, _ = laid(texts)
    _, pooled = forward(net, buckets, first)
    return 1 / (1 + np.exp(-np.clip((pooled @ net.out + net.bias).astype(np.float64), -60, 60)))


def step(net: Net, name: object, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
    """Adagrad, on the given rows only where there are any."""
    if name not in net.squares:
        net.squares[name] = np.full(value.shape, 1e-3, dtype=np.float32)
    square = net.squares[name]
    if rows is None:
        square += gradient**2
        value -= RATE * gradient / np.sqrt(square)
    else:
        square[rows] += gradient**2
        value[rows] -= RATE * gradient / np.sqrt(square[rows])
        if name not in net.moved:
            net.moved[name] = np.zeros(len(value), dtype=bool)
        net.moved[name][rows] = True


def learn(net: Net, texts: list[np.ndarray], y: np.ndarray) -> None:
    """One step of the net on a mini-batch."""
    buckets, first, owner = laid(texts)
    windows, pooled = forward(net, buckets, first)
    sizes = np.bincount(owner, minlength=len(texts))
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
    g = ((p - y) * np.where(y > 0, WEIGHT, 1.0) / len(y)).astype(np.float32)
    back = g[:, None] * net.out[None, :] * (pooled > 0)
    step(net, "out", net.out, pooled.T @ g)
    step(net, "bias", net.bias, g.sum(keepdims=True))
    places, pushes = [], []
    for k, (h, kernel) in enumerate(zip(windows, net.kernels, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        top = np.where(own != 0, pooled[:, k * FILTERS : (k + 1) * FILTERS], np.float32(np.nan))
        f, t = np.divmod(np.flatnonzero(h == np.repeat(top.T, sizes, axis=1)), h.shape[1])
        # Of a filter's equal tops in a text the first counts.
        pair = f * len(texts) + owner[t]
        one = np.flatnonzero(np.diff(pair, prepend=-1))
        f, t = f[one], t[one]
        w = own[owner[t], f]
        spread = np.zeros((len(t), FILTERS), dtype=np.float32)
        spread[np.arange(len(t)), f] = w
        change = np.empty_like(kernel)
        for o in range(len(kernel)):
            change[o] = vectors(net, buckets[:, t + o]).T @ spread
            places.append(t + o)
            pushes.append(w[:, None] * kernel[o].T[f])
        step(net, ("kernel", k), kernel, change)
        step(net, ("shift", k), net.biases[k], own.sum(axis=0))
    place, push = np.concatenate(places), np.concatenate(pushes)
    if not len(place):
        return
    for k, table in enumerate(net.tables):
        order = np.argsort(buckets[k][place], kind="stable")
        rows = buckets[k][place[order]]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        rows, gradient = rows[begins], np.add.reduceat(push[order, k * DIM : (k + 1) * DIM], begins, axis=0)
        live = (rows > 0) & gradient.any(axis=1)
        step(net, ("table", k), table, gradient[live], rows[live])


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    net, rng = fresh(seed), np.random.default_rng(seed)
    for _ in range(epochs):
        mixed_batches(net, texts, labels, rng)
    return net


def mixed_batches(net: Net, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        chosen = order[at : at + BATCH]
        learn(net, [texts[i] for i in chosen], labels[chosen])


def best_threshold(bins: dict[int, tuple[int, int]], otherwise: float) -> float:
    """Cut with the best F1, within RANGE, from counts (rows, positive rows) per step of the score.

    ``otherwise`` where either label has fewer than EVIDENCE rows.
    """
    at = np.array(sorted(bins, reverse=True), dtype=np.int64)
    n, y = np.array([bins[k] for k in at], dtype=np.int64).reshape(-1, 2).T
    if min(y.sum(), n.sum() - y.sum()) < EVIDENCE:
        return otherwise
    k = int(np.argmax(2 * np.cumsum(y) / (np.cumsum(n) + y.sum())))
    below = at[k + 1] + 1 if k + 1 < len(at) else 0
    return float(np.clip((at[k] + below) / 2 / BINS, *RANGE))


@dataclass
class Model:
    net: dict | None
    rate: float
    thresholds: dict
    threshold: float


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", folds: int = 5, shard: int = SHARD, least: int = LEAST) -> Model:
    """Train on all labelled rows whose crc32 fold (of ``folds``) is not 0, in shards of about ``shard`` rows.

    Conflicting labels of one key count as the larger, NULL labels not at all; NULL texts are empty. Without rows of both
    labels the model is their rate. One row in VALIDATION, by a hash of its key, is not trained on: thresholds per language
    come from these rows, all of them, the general one, for other and NULL languages, from those of all languages; none
    of it enters a score.
    """
    context = docs.sparkSession.sparkContext
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != 0)).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    told = with_size(told, LABEL_BYTES)  # few labels go to the texts, which then are not shuffled
    tongue = F.col(f"`{lang}`") if lang in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(tongue, F.lit("")).alias("lang"))
    rows = texts.join(told, "key").withColumn("held", F.pmod(F.xxhash64("key"), F.lit(VALIDATION)) == 0)
    counts = {r.held: (r.n, r.y) for r in rows.groupBy("held").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    total, positive = (sum(x) for x in zip((0, 0), *counts.values(), strict=True))
    if positive in (0, total):
        return Model(None, positive / max(total, 1), {}, 0.5)
    size, ones = counts.get(False, (0, 0))
    enough = 0 < ones < size
    size = size if enough else total
    shards = max(-(-size // shard), min(SHARDS, -(-size // least)))
    used = rows.where("NOT held") if enough else rows
    used = used.select("text", "y", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("key", "text").alias("h"))
    # A checkpoint keeps the partitions, so a shard stays in one of them and in one order.
    dealt = cut(used.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "text", "y"))
    state: dict[int, bytes] = {}
    for turn in range(EPOCHS):
        kept = context.broadcast(state)
        nets = dealt.mapInArrow(lambda b: learned(b, kept.value, turn), "shard int, piece int, data binary")  # noqa: B023
        # As Arrow, since rows would be unpacked, pickled and copied in the driver's JVM.
        means = nets.repartition("piece").sortWithinPartitions("piece", "shard").mapInArrow(averaged, "piece int, data binary").toArrow()
        for piece, data in zip(means.column("piece"), means.column("data"), strict=True):
            state[piece.as_py()] = over(state.get(piece.as_py()), data.as_py())
        del means
        kept.destroy()
    model = Model(compact(state), positive / total, {}, 0.5)
    del state
    told_scores = score_texts(rows.where("held").select("text", "lang", "y"), model)
    bins: dict[str, dict[int, tuple[int, int]]] = {}
    for r in told_scores.groupBy("lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():
        bins.setdefault(r.lang, {})[r.bin] = (r.n, r.y)
    whole = {k: tuple(sum(x) for x in zip(*(own[k] for own in bins.values() if k in own), strict=True)) for k in {k for own in bins.values() for k in own}}
    model.threshold = best_threshold(whole, 0.5)
    model.thresholds = {x: best_threshold(own, model.threshold) for x, own in bins.items() if x}
    return model


def started(state: dict[int, bytes]) -> Net:
    """The net and its squares from averaged pieces; a fresh one from none."""
    net = fresh()
    for piece, data in state.items():
        if piece < 0:
            dense = pickle.loads(data)
            net.kernels, net.biases, net.out, net.bias = dense["kernels"], dense["biases"], dense["out"], dense["bias"]
            net.squares |= dense["squares"]
        else:
            table, block = divmod(piece, BUCKETS // PIECE)
            at, value, square = pickle.loads(data)
            net.tables[table][at + block * PIECE] = value
            net.squares.setdefault(("table", table), np.full((BUCKETS, DIM), 1e-3, dtype=np.float32))[at + block * PIECE] = square
    return net


def compact(state: dict[int, bytes]) -> dict:
    """What scores take of averaged pieces: the rows that training moved, and the dense part."""
    dense = pickle.loads(state[-1])
    rows: list[list[np.ndarray]] = [[np.empty(0, np.int32)] for _ in range(TABLES)]
    values: list[list[np.ndarray]] = [[np.empty((0, DIM), np.float32)] for _ in range(TABLES)]
    for piece in sorted(p for p in state if p >= 0):
        table, block = divmod(piece, BUCKETS // PIECE)
        at, value, _ = pickle.loads(state[piece])
        rows[table].append(at + np.int32(block * PIECE))
        values[table].append(value)
    return {"rows": [np.concatenate(r) for r in rows], "values": [np.concatenate(v) for v in values]} | {k: dense[k] for k in ("kernels", "biases", "out", "bias")}


def pieces(net: Net, shard: int) -> pa.RecordBatch:
    """What a shard changed: the dense part as piece -1, the rows it moved in pieces of each table."""
    dense = {"kernels": net.kernels, "biases": net.biases, "out": net.out, "bias": net.bias, "squares": {k: v for k, v in net.squares.items() if k[0] != "table"}}
    names, data = [-1], [pickle.dumps(dense)]
    for table in range(TABLES):
        rows = np.flatnonzero(net.moved.get(("table", table), np.zeros(0, dtype=bool)))
        for block in np.unique(rows // PIECE):
            at = rows[rows // PIECE == block]
            names.append(table * (BUCKETS // PIECE) + int(block))
            data.append(pickle.dumps(((at - block * PIECE).astype(np.int32), net.tables[table][at], net.squares["table", table][at])))
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["shard", "piece", "data"])


def learned(batches: Iterator[pa.RecordBatch], state: dict[int, bytes], turn: int) -> Iterator[pa.RecordBatch]:
    """Per shard of a task (shard, text, y; shards one after the other) its net after one pass over its rows."""
    shard, net, rng = None, None, None
    texts: list[str] = []
    labels: list[int] = []
    size = 0

    def pass_on() -> None:
        nonlocal texts, labels, size
        words = [w for at in range(0, len(texts), 200) for w in word_ids(texts[at : at + 200])]
        if words:
            mixed_batches(net, words, np.array(labels, dtype=np.float64), rng)
        texts, labels, size = [], [], 0

    for batch in batches:
        for own, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if own != shard:
                if net is not None:
                    pass_on()
                    yield pieces(net, shard)
                shard, net, rng = own, started(state), np.random.default_rng((SEED, own, turn))
            texts.append(text)
            labels.append(y)
            size += len(text)
            if len(texts) == MIXED or size > MIXED_CHARS:
                pass_on()
    if net is not None:
        pass_on()
        last = pieces(net, shard)
        del net
        release_memory()
        yield last


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each piece over the shards that changed it, row by row for tables; rows come in order of pieces."""
    piece, total, count = None, None, 0

    def done() -> pa.RecordBatch:
        if piece < 0:
            data = {k: [x / count for x in v] if isinstance(v, list) else {n: x / count for n, x in v.items()} if isinstance(v, dict) else v / count for k, v in total.items()}
        else:
            at = np.flatnonzero(count)
            mean = (total[at] / count[at, None]).astype(np.float32)
            data = (at.astype(np.int32), mean[:, :DIM], mean[:, DIM:])
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([pickle.dumps(data)], pa.binary())], names=["piece", "data"])

    for batch in batches:
        for own, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != piece:
                if piece is not None:
                    yield done()
                piece, total, count = own, None, 0
                if own >= 0:
                    total, count = np.zeros((PIECE, 2 * DIM)), np.zeros(PIECE, dtype=np.int64)
            value = pickle.loads(data)
            if own >= 0:
                total[value[0]] += np.concatenate(value[1:], axis=1)
                count[value[0]] += 1
            else:
                count += 1
                total = value if total is None else {k: [a + b for a, b in zip(v, value[k], strict=True)] if isinstance(v, list) else {n: x + value[k][n] for n, x in v.items()} if isinstance(v, dict) else v + value[k] for k, v in total.items()}
    if piece is not None:
        yield done()


def over(before: bytes | None, after: bytes) -> bytes:
    """Rows of a piece as they were, those averaged anew in their place; the dense part is always new."""
    if before is None or isinstance(new := pickle.loads(after), dict):
        return after
    old = pickle.loads(before)
    stays = ~np.isin(old[0], new[0])
    return pickle.dumps(tuple(np.concatenate([a[stays], b]) for a, b in zip(old, new, strict=True)))


def scored(batches: Iterator[pa.RecordBatch], text: str, into: str, model: Model) -> Iterator[pa.RecordBatch]:
    net = Net.of(model.net)
    for batch in batches:
        out, part, size = [], [], 0
        for value in [*batch.column(text).to_pylist(), ...]:
            if value is ... or size > AT_ONCE:
                out.append(scores(net, word_ids(part)) if part else np.empty(0))
                part, size = [], 0
            if value is not ...:
                part.append(value)
                size += len(value or "")
        yield batch.set_column(batch.schema.get_field_index(into), into, pa.array(np.concatenate(out)))


def score_texts(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, the score (0 to 1) of each whole text.

    NULL and empty texts get the score of a text without words; repeated rows are scored each; an empty table stays
    empty. Other columns pass through, except that a column named ``into`` is replaced.
    """
    out = docs.withColumn(into, F.lit(model.rate))
    if model.net is None:
        return out
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return out.mapInArrow(lambda b: scored(b, text, into, kept.value), out.schema)


def flagged(score: Column, lang: Column, model: Model) -> Column:
    """Whether a score reaches the threshold of its language."""
    limit = F.lit(model.threshold)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(lang == name, F.lit(value)).otherwise(limit)
    return F.coalesce(score >= limit, F.lit(False))
