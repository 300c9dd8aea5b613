import math
import random
import re

import pytest

from tapeline.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, k):
    held = [(key, terms(t)) for key, t in docs if terms(t)]
    n, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for key, t in held:
            m = 75 + (25 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 12 * m)) for w in terms(text) if w in t)
            if score > 0:
                rows.append((score, key))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, i, key, score) for i, (score, key) in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def tables():
    r = random.Random(6)
    word = lambda: r.choice(["a", "B", "ab", "abc", "É", "é", "x1", "1", "日本", "zz", "q_r", "it's", "\x85"]) + r.choice(["", "", str(r.randrange(5))])
    text = lambda n: "".join(word() + r.choice([" ", "-", "\n", ", ", "\x00"]) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, "?! \n"), (203, "ab " * 60000), (None, "ab abc É"), (None, "ab abc É")]
    docs += [(i, docs[3][1]) for i in range(300, 340)] + [docs[7], docs[7]]
    items = [(i, text(r.randrange(1, 25))) for i in range(12)] + [(3, "ab ab ab"), (None, "é 日本"), (20, None), (21, "..."), (22, "notthere"), (23, "")]
    return docs, items


@pytest.mark.parametrize("size", [lexical.SLICE_BYTES, 150])
def test_equals_every_document_and_item(spark, size):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS rank", "'x' AS score").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS key")
    got = lexical.search(d, b, k=7, slice_bytes=size).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items, 7)


def test_ties_by_key_and_few_rows(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(400)] + [(999, "other")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "other same")], "item_id long, text string")
    got = lexical.search(docs, items).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 1] == list(range(20))
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 2] == [999, *range(19)]


def test_empty_tables_and_text_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "two")], "item_id string, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id = 'z'").union(spark.createDataFrame([("c", None)], docs.schema)), items).collect() == []
    got = lexical.search(docs.union(spark.createDataFrame([("z", "nothing here")], docs.schema)), items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b", None]
