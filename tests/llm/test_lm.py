import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tapeline.llm import lm
from tapeline.llm.common import fold


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def texts(n):
    r = random.Random(3)
    out = []
    for i in range(n):
        lang = r.choice("ab")
        words = ["Start"] + [lang + r.choice("cdefg") * r.randrange(1, 4) for _ in range(r.randrange(60))]
        out.append((i, " ".join(words + [f"only{i}"] * (i % 3 == 0))))
    return out + [(7000, None), (7001, ""), (7002, " \n"), (7003, "never seen words"), (None, "ac bd"), (5, "ac bd"), (7004, "x" * 60000)]


def test_base_counts_and_held_out_gain(spark):
    rows = texts(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS tail")
    held = fold(F.col("doc_id"), 7) == 2
    model = lm.fit(docs.where(~held), steps=800)
    got = lm.score(docs, model).collect()
    train = Counter(w for d, t in rows if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2 for w in split(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(split(t)), sum(w in train for w in split(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    mine = {r.doc_id: (r.score, r.base_score) for r in got}
    out = [d for d, _ in rows if d is not None and d < 400 and zlib.crc32(str(d).encode()) % 7 == 2]
    assert sum(mine[d][0] for d in out) > sum(mine[d][1] for d in out) and all(r.score <= 1e-9 for r in got)
    assert mine[7000] == mine[7001] == mine[7002]


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(texts(60), "doc_id long, text string")
    model = lm.fit(docs, steps=50)
    v = model.vocabulary
    p = 10.0 ** lm.log_probabilities(model.net).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    inside = np.bincount(v.classes, weights=10.0**v.inside, minlength=lm.CLASSES)
    assert np.allclose(inside[inside > 0], 1)
    tail = [r["count"] for r in model.tail.collect()]
    assert math.isclose(sum((c - lm.DISCOUNT) / v.tail_tokens for c in tail) + lm.DISCOUNT * v.tail_types / v.tail_tokens, 1)
    assert sum(tail) == v.tail_tokens and len(tail) == v.tail_types and v.tail_tokens + v.counts.sum() == v.tokens


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = lm.fit(none)
    assert [tuple(r) for r in lm.score(docs, model).collect()] == [(1, 3, 0, 0, 0.0, 0.0)]
    assert lm.score(none, lm.fit(docs, steps=5)).collect() == []


def test_classes_grow_and_every_pair_trains(spark, monkeypatch):
    keys = np.arange(2, 1_000_002, dtype=np.uint64) << np.uint64(8)
    v = lm.made(keys, np.arange(1_000_000, 0, -1), 1 << 40, 1_000_000, 1)
    assert v.size > lm.CLASSES and v.classes[lm.OWN] == lm.OWN + 1 and v.classes.max() < v.size
    # One pair holds nearly all the mass: the others are visited all the same, and the visits come to the counts.
    counts = np.r_[10**7, np.ones(5000)]
    place, share = lm.visits(counts, 10**7 / lm.BATCH)
    assert set(place) == set(range(5001)) and np.allclose(np.bincount(place, weights=share) * 10**7 / lm.BATCH, counts, rtol=1e-4)
    pairs = np.arange(5001) % 2500 * lm.CLASSES + np.arange(5001) % 2501
    start, net = (lm.train(b, np.ones(lm.CLASSES), 10**7 / lm.BATCH) for b in ([], [(pairs, counts)]))
    assert (net["context"] != start["context"]).any(1)[:2500].all()
    # Blocks together hold every pair's whole count.
    rows = [(i, 1 + (i == 7) * 900) for i in range(300)]
    monkeypatch.setattr(lm, "PAIRS", 50)
    got = list(lm.pair_blocks(spark.createDataFrame(rows, "key bigint, count bigint"), 300, 4.0))
    assert len(got) == 6 and max(map(len, (k for k, _ in got))) < 100
    assert np.allclose(np.bincount(np.concatenate([k for k, _ in got]), weights=np.concatenate([c for _, c in got])), [c for _, c in rows])
