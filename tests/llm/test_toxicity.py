import random
import zlib

import numpy as np

from tapeline.llm import toxicity
from tapeline.llm.common import fold


def corpus(n, seed=1):
    r = random.Random(seed)
    bad = {"en": ["scum", "moron", "trash"], "de": ["loweig", "loweilo", "schlumm"]}
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "de"])
        words = [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("klmnop") + r.choice("aeiou") for _ in range(r.choice([1, 5, 40, 200]))]
        toxic = int(r.random() < .25)
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words) + 1), r.choice(bad[lang]))
        docs.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    rows, told = corpus(1500)
    extra = [(5000, None, "en"), (5001, "", None), (5002, "x" * 200000, "xx"), (5003, "scum trash " * 30000, "en"), (None, "moron scum", None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "'s' AS score", "1 AS key")
    labels = spark.createDataFrame(told + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_texts(docs, model).withColumn("held_out", fold(toxicity.F.col("doc_id"), 5) == 0).withColumn("flag", toxicity.flagged(toxicity.F.col("score"), toxicity.F.col("lang"), model)).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r for r in out}
    want = dict(told)
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([(got[i].score >= .5) == want[i] for i in held]) > .97 and np.mean([got[i].flag == want[i] for i in held]) > .97
    assert got[5000].score == got[5001].score < .5 and got[5002].score < .5 and got[5003].score > .5
    assert set(model.thresholds) <= {"en", "de"}


def test_score_does_not_read_the_language(spark):
    rows, told = corpus(300, 2)
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.withColumn("lang", toxicity.F.lit("zz"))
    a, b = ({r.doc_id: r.score for r in toxicity.score_texts(d, toxicity.fit(d, labels)).collect()} for d in (docs, other))
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score_texts(docs.limit(0), toxicity.fit(docs, none)).collect() == []


def test_gradients_follow_differences():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, toxicity.BUCKETS, (9, toxicity.TABLES)).astype(np.int32) for _ in range(4)]
    net = toxicity.train(texts, np.array([0.0, 1, 0, 1]), epochs=30)
    assert (toxicity.scores(net, texts) >= .5).tolist() == [False, True, False, True]


def test_forward_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    net = toxicity.fresh(2)
    for t in net.tables:
        t[1:40] = rng.normal(0, 1, (39, toxicity.DIM))
    texts = [rng.integers(1, 40, (n, toxicity.TABLES)).astype(np.int32) for n in (1, 2, 3, 7, 0, 30)]
    want = []
    for text in texts:
        words = [np.concatenate([t[b] for t, b in zip(net.tables, w)]) for w in text]
        pooled = []
        for width, kernel, bias in zip(toxicity.WIDTHS, net.kernels, net.biases):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(words)):  # a window begins at a word and may end in the silence after the text
                    best = max(best, float(bias[f] + sum((c * kernel[o, :, f]).sum() for o, c in enumerate(words[at : at + width]))))
                pooled.append(best)
        want.append(1 / (1 + np.exp(-(np.dot(pooled, net.out) + net.bias[0]))))
    assert np.allclose(toxicity.scores(net, texts), want, atol=1e-5)
    assert np.allclose([toxicity.scores(net, [t])[0] for t in texts], want, atol=1e-5)


def test_every_labelled_row_trains_in_shards(spark):
    rows, told = corpus(1500, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, shard=300, least=150)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    held = [i for i, _ in told if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= .5) == dict(told)[i] for i in held]) > .95
    # Every word of a row that is trained on and was told toxic has moved, whatever shard it lies in.
    net = toxicity.Net.of(model.net)
    kept = [r.key for r in labels.selectExpr("doc_id AS key").where("crc32(cast(key AS string)) % 5 <> 0 AND pmod(xxhash64(key), 5) <> 0").collect()]
    single = [t for i, t, _ in rows if i in set(kept) and " " not in t]
    assert single and all(net.tables[0][w[:, 0]].any() for w in toxicity.word_ids(single))


def test_averages_rows_over_the_shards_that_moved_them():
    import pickle

    nets = [toxicity.fresh(), toxicity.fresh()]
    for net, own in zip(nets, (3, 5)):
        for row, value in ((own, 1.0 * own), (7, 2.0 * own)):
            toxicity.step(net, ("table", 0), net.tables[0], np.full((1, toxicity.DIM), value, dtype=np.float32), np.array([row]))
        toxicity.step(net, "out", net.out, net.out * own)
    sent = sorted((r for k, net in enumerate(nets) for r in toxicity.pieces(net, k).to_pylist()), key=lambda r: (r["piece"], r["shard"]))
    batch = toxicity.pa.RecordBatch.from_pylist(sent)
    state = {r["piece"]: r["data"] for b in toxicity.averaged(iter([batch])) for r in b.to_pylist()}
    mean = toxicity.started(state)
    a, b = nets
    assert np.allclose(mean.tables[0][[3, 5, 7]], [a.tables[0][3], b.tables[0][5], (a.tables[0][7] + b.tables[0][7]) / 2])
    assert np.allclose(mean.out, (a.out + b.out) / 2) and np.flatnonzero(mean.tables[0].any(axis=1)).tolist() == [3, 5, 7]
    newer = pickle.dumps((np.array([7], np.int32), np.ones((1, toxicity.DIM), np.float32), np.ones((1, toxicity.DIM), np.float32)))
    assert toxicity.started({0: toxicity.over(state[0], newer)}).tables[0][[3, 7], 0].tolist() == [float(a.tables[0][3, 0]), 1.0]


def test_training_passes_through_the_driver_packed(spark, monkeypatch):
    import tracemalloc

    rows, told = corpus(600, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    collected = []
    plain = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.schema.simpleString()) or plain(df))
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Whole tables with their squares would take 67 MB; rows with nets would be unpacked in the driver's JVM.
    assert most < 24 << 20 and collected and not any("binary" in x for x in collected)
    assert all(len(np.unique(r)) == len(r) > 0 and v.any(axis=1).all() for r, v in zip(model.net["rows"], model.net["values"]))


def test_few_labels_go_to_the_texts(spark, monkeypatch):
    rows, told = corpus(200, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    plans = []
    cut = toxicity.cut
    monkeypatch.setattr(toxicity, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "strategy=broadcast" in plans[0]


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(8)
    texts = [rng.integers(1, 30, (n, toxicity.TABLES)).astype(np.int32) for n in (5, 1, 0, 12)]
    y = np.array([1.0, 0, 1, 0])

    def made():
        net = toxicity.fresh(3)
        for t in net.tables:
            t[1:30] = np.random.default_rng(9).normal(0, 1, (29, toxicity.DIM))
        return net

    def loss(net):
        p = toxicity.scores(net, texts)
        return float(-(np.where(y > 0, toxicity.WEIGHT * np.log(p), np.log(1 - p))).mean())

    told = {}
    net, step = made(), toxicity.step
    try:
        toxicity.step = lambda net, name, value, gradient, rows=None: told.update({name: (gradient.copy(), rows)})
        toxicity.learn(net, texts, y)
    finally:
        toxicity.step = step
    gradient, rows = told["table", 1]
    for place, value, want in (
        [((rows[i], d), net.tables[1], gradient[i, d]) for i in range(0, len(rows), 5) for d in (0, 5)]
        + [((1, d, f), net.kernels[2], told["kernel", 2][0][1, d, f]) for d in (3, 20) for f in range(toxicity.FILTERS)]
        + [((f,), net.biases[1], told["shift", 1][0][f]) for f in range(toxicity.FILTERS)]
    ):
        at, sides = value[place], []
        for move in (1e-2, -1e-2):
            value[place] = at + move
            sides.append(loss(net))
        value[place] = at
        assert abs((sides[0] - sides[1]) / 2e-2 - want) < 2e-3 + 0.03 * abs(want)


def test_texts_without_words_train_to_one_score(spark):
    docs = spark.createDataFrame([(i, " " if i % 2 else None) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(60)], "doc_id long, toxic int")
    got = [r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()]
    assert len(got) == 60 and len(set(got)) == 1 and 0 < got[0] < 1
