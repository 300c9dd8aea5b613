import math
import random
import re

import numpy as np

from tapeline.llm import quality_rules as q
from tapeline.llm.common import read
from tapeline.llm.queries import op12_quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The rules, spelled out word by word."""
    text = text or ""
    words = WORDS.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def texts():
    r = random.Random(2)
    word = lambda: r.choice(["a", "b", "c#", "é", "語", "x|y", "|", "\x1c", "\xa0", "d e"])
    out = [None, "", " \n\t\x0b", "a b c d e a b c d e", "a b c d e f", "z" * 3_000_000, "\n\n\n", "#" * 50, "u v w x y " * 9]
    for _ in range(120):
        out.append("".join(word() + r.choice([" ", "\n", "  ", "\t", "\r\n"]) for _ in range(r.randrange(40))))
    return out


def test_rules_equal_word_by_word(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS kept", "2 AS n_words").repartition(3)
    got = q.judge(docs, q.Model(np.zeros(q.BUCKETS), -1.0)).collect()
    rows = {r.doc_id: r for r in got}
    assert len(rows) == len(texts())
    for i, text in enumerate(texts()):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), i
        assert r.kept == (not r.base_failed) and r.score == 0


def test_ratio_equals_plain_counts(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcdefgh" if i % 2 else "fghijklm") for _ in range(r.randrange(12, 30)))) for i in range(400)] + [(None, "q r s"), (3, "again a b"), (9999, None)]
    labels = [(i, i % 2) for i in range(300)] + [(3, None), (5, 0), (None, 1), (7, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.fit(table, told)
    import zlib
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % q.FOLDS
    good = {i: min(v for k, v in labels if k == i and v is not None) for i in range(300)}
    counts, trusted = {}, {}
    grams = lambda t: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:]))
    for i, t in docs:
        for g in grams(t or ""):
            counts[g] = counts.get(g, 0) + 1
            if good.get(i) and fold(i):
                trusted[g] = trusted.get(g, 0) + 1
    n, m = sum(counts.values()), sum(trusted.values())
    ratio = lambda g: math.log((trusted.get(g, 0) + q.PRIOR) / (m + q.PRIOR * q.BUCKETS)) - math.log((counts[g] + q.PRIOR) / (n + q.PRIOR * q.BUCKETS))
    got = q.judge(table, model).collect()
    assert len(got) == len(docs)
    want = sorted((repr(i), round(sum(map(ratio, grams(t or ""))) / max(1, len(grams(t or ""))), 9)) for i, t in docs)
    assert sorted((repr(x.doc_id), round(x.score, 9)) for x in got) == want
    assert all(x.kept == (not x.base_failed and x.score >= model.threshold) for x in got)
    judged = {x.doc_id: x for x in got if x.doc_id is not None and x.doc_id >= 300 and not x.base_failed}
    assert np.mean([x.kept == (i % 2 == 1) for i, x in judged.items()]) > 0.95


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.fit(docs, none)
    assert model.threshold == q.UNTOLD and not model.ratio.any() and q.judge(docs, model).first().kept
    assert q.judge(docs.limit(0), q.fit(docs.limit(0), none)).collect() == []


def test_threshold_by_hand():
    good, bad = {0: 30, 1: 30, 5: 40}, {-3: 30, -2: 20, 0: 5}
    cut = q.best_threshold(good, bad) * q.GRAIN
    assert -2 < cut <= 0 and q.best_threshold({0: 3}, bad) == q.UNTOLD


def test_held_out_labels_are_told_apart(spark, sf):
    got = op12_quality_rules(spark, sf.replace("sf0.001", "sf0.01")).join(read(spark, sf.replace("sf0.001", "sf0.01"), "labels"), "doc_id")
    held = got.where(q.fold(q.F.col("doc_id"), q.FOLDS) == 0).select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in held]) > 0.9
