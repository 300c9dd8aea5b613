import random
import re

from tapeline.llm import ngram_join


def slow(rows, width, percent):
    """Every pair, by the definition."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    out = []
    for i, (k, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(group, default=None)))
    return sorted(out, key=str)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuvwxyz")
    base = [[word() for _ in range(r.choice([1, 2, 5, 30, 60, 120]))] for _ in range(n // 8)]
    shared = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 9])):
            at = r.randrange(len(w))
            if r.random() < .5:
                w[at] = word()
            else:
                w.insert(at, word())
        if r.random() < .2:
            w += shared
        t = r.choice([" ", "\n", "  "]).join(w)
        out.append(t.upper() if r.random() < .1 else t)
    return out


def test_equals_all_pairs(spark):
    for seed, width, percent in ((1, 3, 90), (2, 5, 80)):
        rows = list(enumerate(texts(seed, 260))) + [(900, None), (901, ""), (902, " \n "), (903, "ONE"), (904, "one"), (905, "a b"), (906, "b a"), (3, "one"), (None, "one"), (None, "alone here"), (907, "É b c"), (908, "é b c"), (10, "again x y z"), (10, "again x y z")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS key", "1 AS node", "2 AS n").repartition(5)
        got = ngram_join.similar_groups(docs, width=width, percent=percent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == slow(rows, width, percent)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 9973}x{i % 7}" for i in range(60000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "w" * 100000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert ngram_join.similar_groups(docs.limit(0)).collect() == []
