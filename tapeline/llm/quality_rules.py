"""Quality of documents: rule counts, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and word pairs are hashed into BUCKETS; two multinomials over them are counted, one over the documents labelled
good, one over the whole corpus. A document's score is the mean log ratio of its n-grams, so length does not matter.
It is kept where the score reaches a threshold, set once from labelled documents that neither count as trusted. The
raw counts cover every document and grow with the corpus; the number of buckets is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import fold, with_size
from tapeline.llm.shingles import IS_GAP, runs, word_hashes

#: Counters of each multinomial, in blocks of BLOCK; n-grams that share one are taken for each other.
BUCKETS, BLOCK = 1 << 18, 4096
#: Added to every counter.
PRIOR = 0.5
#: Labelled documents of one crc32 fold of FOLDS set the threshold, the others are the trusted text.
FOLDS = 5
#: Scores are told apart in steps of 1 / GRAIN from -SPAN to SPAN when the threshold is set.
GRAIN, SPAN = 64, 16
#: Without that many rows of each label the threshold is UNTOLD.
EVIDENCE, UNTOLD = 20, -1.0
#: Bytes handled at once.
AT_ONCE = 1 << 19
#: Fixed values of the rules: symbols, words of a window, and when a document fails.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 5, 10, 20
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Bytes that begin a code point and stand in a word.
BEGINS = ~IS_GAP & ((np.arange(256) & 0xC0) != 0x80)
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = "block int, target boolean, counts binary"
RULES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def parts(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, a bounded number of bytes at a time; one text is never cut."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the text each belongs to."""
    hashes, starts = word_hashes(b"\n".join(raw) + b"\n")
    return hashes, np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")


def buckets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of texts, and the text of each."""
    if len(hashes) < 2:
        grams, text = hashes, owner
    else:
        same = owner[1:] == owner[:-1]
        grams, text = np.concatenate([hashes, runs(hashes, 2)[same]]), np.concatenate([owner, owner[1:][same]])
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64), text


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task over all its texts and over its trusted ones, in blocks."""
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        trusted = np.array(batch.column(1).to_pylist(), dtype=bool)
        at = 0
        for raw in parts(batch.column(0).to_pylist()):
            place, text = buckets(*hashed(raw))
            total[0] += np.bincount(place, minlength=BUCKETS)
            total[1] += np.bincount(place[trusted[at + text]], minlength=BUCKETS)
            at += len(raw)
    for target in (0, 1):
        if total[target].any():
            cut = total[target].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([bool(target)] * len(cut)), pa.array([c.tobytes() for c in cut], pa.binary())], names=["block", "target", "counts"])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, bool], np.ndarray] = {}
    for batch in batches:
        for block, target, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = np.frombuffer(own, dtype=np.int64)
            total[block, target] = total[block, target] + value if (block, target) in total else value
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in total], pa.int32()), pa.array([t for _, t in total], pa.bool_()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "target", "counts"])


def ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the trusted over the raw share of each bucket."""
    own, all_ = trusted + PRIOR, raw + PRIOR
    return np.log(own / own.sum()) - np.log(all_ / all_.sum())


def mean_ratios(hashes: np.ndarray, owner: np.ndarray, n: int, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each of ``n`` texts; 0 without words."""
    place, text = buckets(hashes, owner)
    return np.bincount(text, weights=ratio[place], minlength=n) / np.maximum(1, np.bincount(text, minlength=n))


def rules(raw: list[bytes], hashes: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of each text."""
    n = len(raw)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    of = np.repeat(np.arange(n), [len(r) for r in raw])
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": np.bincount(of[BEGINS[data]], minlength=n), "n_symbols": np.bincount(of[IS_SYMBOL[data]], minlength=n)}
    dup = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(raw):
        lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) >= WINDOW:
        own = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
        grams = runs(hashes, WINDOW)[own]
        order = np.lexsort((grams, owner[own]))
        sorted_grams, text = grams[order], owner[own][order]
        equal = (sorted_grams[1:] == sorted_grams[:-1]) & (text[1:] == text[:-1])
        first = own[order[np.r_[equal, False] | np.r_[False, equal]]]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def judged(batches: Iterator[pa.RecordBatch], text: str, ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches with the rule counts and the score behind their columns."""
    for batch in batches:
        made: list[dict[str, np.ndarray]] = []
        for raw in parts(batch.column(text).to_pylist()):
            hashes, owner = hashed(raw)
            made.append(rules(raw, hashes, owner) | {"score": mean_ratios(hashes, owner, len(raw), ratio)})
        names = [*(f.split()[0] for f in RULES.split(", ")), "score"]
        more = [pa.array(np.concatenate([m[c] for m in made]) if made else [], pa.float64() if c == "score" else pa.int64()) for c in names]
        kept = [c for c in batch.schema.names if c != text]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, *names])


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def best_threshold(good: dict[int, int], bad: dict[int, int]) -> float:
    """The step at which the shares of good documents kept and of bad ones dropped are highest together; the middle
    of the range where they are."""
    if min(sum(good.values()), sum(bad.values())) < EVIDENCE:
        return UNTOLD
    steps = np.arange(-SPAN * GRAIN, SPAN * GRAIN + 1)
    share = lambda told: np.array([told.get(int(s), 0) for s in steps]) / sum(told.values())
    kept = 1 - np.r_[0, np.cumsum(share(good))[:-1]]
    dropped = np.r_[0, np.cumsum(share(bad))[:-1]]
    best = np.flatnonzero(kept + dropped >= (kept + dropped).max() - 1e-12)
    return float((steps[best[0]] + steps[best[-1]]) // 2 / GRAIN)


def told(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Texts with ``good`` (conflicting labels of one key: not good; NULL without a label) and ``fold`` of the key."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) > 0).alias("good"))
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    return rows.join(with_size(own, 24), F.col("_id") == F.col("_key"), "left").select("text", "good", fold(F.col("_id"), FOLDS).alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Counters over all ``docs`` and over the good ones outside fold 0; threshold from the labelled ones of fold 0.

    Without trusted text every ratio is 0; with too few labelled rows of either kind the threshold is UNTOLD.
    """
    rows = told(docs, labels, key, text, label)
    trusted = F.coalesce(F.col("good") & (F.col("fold") != 0), F.lit(False))
    blocks = rows.select("text", trusted.alias("trusted")).mapInArrow(counted, COUNTS).repartition("block").mapInArrow(added, COUNTS)
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in blocks.collect():  # 2 * BUCKETS counters in all
        total[int(r.target), r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    ratio = ratios(total[1], total[0]) if total[1].any() else np.zeros(BUCKETS)
    held = rows.where("fold = 0 AND good IS NOT NULL").select("text", "good")
    kept = docs.sparkSession.sparkContext.broadcast(ratio)
    scored = held.mapInArrow(lambda b: judged(b, "text", kept.value), f"good boolean, {RULES}, score double").where(f"n_words >= {LEAST_WORDS}")
    step = F.greatest(F.least(F.floor(F.col("score") * GRAIN), F.lit(SPAN * GRAIN)), F.lit(-SPAN * GRAIN)).cast("int")
    told_at: tuple[dict, dict] = ({}, {})
    for r in scored.groupBy("good", step.alias("step")).count().collect():  # a row per step and label
        told_at[int(r.good)][r.step] = r["count"]
    return Model(ratio, best_threshold(told_at[1], told_at[0]))


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with its rule counts, ``score``, ``base_failed`` and ``kept``.

    NULL and empty texts have no words and fail; repeated rows are judged each; an empty table stays empty. Other
    columns pass through, except that those named as a result are replaced.
    """
    made = [f.split()[0] for f in RULES.split(", ")] + ["score", "base_failed", "kept"]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made or c == text])
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != text) + f"{', ' if len(rows.columns) > 1 else ''}{RULES}, score double"
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)
    out = rows.mapInArrow(lambda b: judged(b, text, ratio.value), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
