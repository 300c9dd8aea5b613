import math
import random

from tapeline.llm import decontam


def slow(texts, items, threshold, overlap):
    """Scores every passage against every item by the formula."""
    split = [(k, *map(decontam.tokens, decontam.question_answer(t))) for k, t in items if decontam.tokens(t)]
    whole = [q if q == a else q + a for _, q, a in split]
    mean = sum(len(decontam.tokens(t)) for _, t in items if t) / len(split)
    df = {w: sum(w in set(x) for x in whole) for x in whole for w in x}
    step = max(decontam.STEP, max(map(len, whole)))
    grams = lambda x, n=3: {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}

    def share(part, run, passage):
        if len(part) >= 3:
            return len(grams(part) & grams(passage)) / len(grams(part))
        return float(tuple(run) in grams(passage, len(run)))

    out = []
    for t in texts:
        w, best = decontam.tokens(t), {}
        for k in range(max(1, math.ceil(len(w) / step) - 1)):
            passage = w[k * step:(k + 2) * step]
            for (item, q, a), x in zip(split, whole):
                weight = {v: math.log(1 + (len(split) - df[v] + .5) / (df[v] + .5)) * x.count(v) * 2.2 / (x.count(v) + 1.2 * (.25 + .75 * len(x) / mean)) for v in set(x)}
                score = sum(weight[v] for v in set(passage) & set(x)) / sum(weight.values())
                shares = [share(q, q, passage)] if q == a else [share(q, q + a[:3], passage), share(a, q[-3:] + a, passage)]
                if score >= threshold and min(shares) >= overlap:
                    best[item] = max(best.get(item, 0), score)
        out.append({k: round(v, 6) for k, v in best.items()})
    return out


def test_equals_every_passage_and_item(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdefgh") + r.choice("ijkl")
    sentence = lambda: " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 8, 20, 29]))).capitalize() + r.choice(".?!")
    items = [(i, " ".join(sentence() for _ in range(r.choice([1, 2, 3])))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (3, "One repeated id here.")]
    texts = [None, "", "?!", "x" * 50000]
    for _ in range(60):
        parts = [sentence() for _ in range(r.randrange(12))]
        for _ in range(r.choice([0, 1, 2])):
            leak = r.choice(items[:40])[1].split()
            if r.random() < .4:
                leak[r.randrange(len(leak))] = word()
            parts.insert(r.randrange(len(parts) + 1), " ".join(leak).upper() if r.random() < .3 else " ".join(leak))
        texts.append("\n".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS item", "7 AS leaks").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.SLICE_BYTES, 1500):
        got = decontam.find_leaks(docs, table, slice_bytes=size)
        want = slow(texts, items, decontam.THRESHOLD, decontam.OVERLAP)
        rows = {x.doc_id: {h.item: round(h.score, 6) for h in x.leaks} for x in got.collect()}
        assert [rows[i] for i in range(len(texts))] == want and any(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in decontam.find_leaks(docs, none).collect()] == [[]]
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontam.find_leaks(docs.limit(0), items).collect() == []
    assert [r.leaks[0].score for r in decontam.find_leaks(docs, items).collect()] == [1.0]


def test_every_item_pasted_whole_is_found(spark, sf):
    table = spark.read.parquet(f"{sf}/benchmark.parquet".replace("sf0.001", "sf0.1"))
    items = {r.item_id: r.text for r in table.collect()}
    filler = " ".join(f"filler{i}" for i in range(150))
    docs = spark.createDataFrame([(i, f"{filler}\n{t}\n{filler}") for i, t in items.items()] + [(-1, filler)], "doc_id long, text string")
    got = {r.doc_id: {h.item for h in r.leaks} for r in decontam.find_leaks(docs, table).collect()}
    assert all(i in got[i] for i in items) and not got[-1]


def test_short_parts_need_their_neighbours(spark):
    items = [(1, "What is the tallest tree of all here? Oak."), (2, "Go. The answer is long and holds many words indeed."), (3, "Yes no.")]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = ["see: what is the tallest tree of all here? OAK!", "what is the tallest tree of all here? A pine, or perhaps an oak", "go the answer is long and holds many words indeed", "the answer is long and holds many words indeed, so go", "they say yes no more", "no and yes"]
    got = decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()
    assert [[h.item for h in r.leaks] for r in sorted(got, key=lambda r: r.doc_id)] == [[1], [], [2], [], [3], []]
