"""Rows in against rows out, where rows once were lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import walk_frame
from tapeline.functions.series import ewm
from tapeline.operators import market, ml, news
from tapeline.sources import sinks


def test_clusters_keep_titles_of_any_script(spark):
    titles = ["Markets rally on earnings", "Markets rally on earnings!", "Рынки растут", "!!!", None, "Ελλάδα"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, title string")
    got = {r.id: r.relation for r in news.clusters(rows).collect()}
    assert got == {0: "ORIGINAL", 1: "DUPLICATE", 2: "ORIGINAL", 3: "DUPLICATE", 4: "DUPLICATE", 5: "DUPLICATE"}


def test_similar_scores_other_kinds_and_null_regimes(spark):
    schema = "id long, event_type string, label string, sectors array<string>, market_regime string, volatility_regime string, impact double"
    rows = spark.createDataFrame([(1, "A", "bullish", ["x"], None, "HIGH", 50.0), (2, "A", "bearish", ["y"], "BEAR", "LOW", 0.0), (3, "B", "bullish", ["x"], None, "HIGH", 50.0)], schema)
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in news.similar(rows, rows).collect()}
    assert len(got) == 6 and got[1, 1][0] == 3 and got[1, 1][1] == pytest.approx(0.55) and got[1, 2] == (2, pytest.approx(0.425))


def test_similar_looks_at_the_nearest_impacts_and_finds_what_all_pairs_find(spark):
    import itertools
    import random
    r = random.Random(5)
    rows = [(i, r.choice("AB"), r.choice(["bullish", "bearish"]), r.choice([[], ["x"], ["x", "y"]]), r.choice([None, "BULL"]), "HIGH", r.choice([None, 0.0, 150.0, 310.0, round(r.random() * 90, 1)])) for i in range(220)]
    schema = "id long, event_type string, label string, sectors array<string>, market_regime string, volatility_regime string, impact double"

    def score(a, b):
        near = 0.0 if a[6] is None or b[6] is None else max(0.0, 1 - abs(b[6] - a[6]) / 100)
        both = set(a[3]) | set(b[3])
        shared = len(set(a[3]) & set(b[3])) / len(both) if both else 0.0
        return round(0.35 * (a[1] == b[1]) + 0.15 * (a[2] == b[2]) + 0.15 * near + 0.15 * shared + 0.1 * (a[4] == b[4] is not None) + 0.1, 6)

    df = spark.createDataFrame(rows, schema)
    got = {(x.query_id, x["rank"]): (x.id, pytest.approx(x.similarity, abs=2e-6)) for x in news.similar(df, df).collect()}
    want = {(a[0], k + 1): (i, s) for a in rows for k, (s, i) in enumerate([(-n, i) for n, i in itertools.islice(sorted((-score(a, b), b[0]) for b in rows if b[0] != a[0]), 5)])}
    assert got == want
    # A profile meets the profiles beside it, not all of its kind.
    line = spark.createDataFrame([("k", n, n / 10, [n]) for n in range(500)], "kind string, grid long, impact double, ids array<long>")
    beside = news.nearest_of_kind(line, line.select("kind", "grid"), 3)
    assert {x.id for x in beside.filter("grid = 250").collect()} == {249, 250, 251} and beside.count() == 1500


def test_entities_are_decoded_once(spark):
    text = "Caf&eacute; &#8217;s &mdash; &amp;lt; &#x41; &nope; &lt;b&gt; &apos;"
    got = spark.createDataFrame([(text,)], "t string").select(news.plain(F.col("t"))).first()[0]
    assert got == "Café ’s — &lt; A &nope; <b> '"


def test_frames_finer_than_the_source_are_reported(spark):
    bars = spark.createDataFrame(walk_frame(50))
    got = {r.interval: r.status for r in market.timeframe_matrix(bars, 60, {"15m": 15, "1H": 60}).collect()}
    assert got == {"15m": "NO_DATA", "1H": "AVAILABLE"}


def test_exponential_mean_stops_at_an_interior_gap(spark):
    frame = walk_frame(10)
    frame.loc[5, "close"] = None
    got = [r.m for r in ewm(spark.createDataFrame(frame).withColumn("close", F.when(~F.isnan("close"), F.col("close"))), {"m": ("close", 0.2)}).orderBy("ts").collect()]
    assert all(x is not None for x in got[:5]) and got[5:] == [None] * 5


def test_incomplete_rows_leave_before_training_and_fail_at_scoring(spark):
    rows = [(float(i % 7), float(i % 3), i % 3 - 1) for i in range(60)]
    train = spark.createDataFrame(rows, "a double, b double, label int")
    model = ml.fit_classifier("LogisticRegression", train, ["a", "b"], 60)
    assert model(train).count() == 60
    assert ml.complete(train.union(spark.createDataFrame([(None, 1.0, 0)], train.schema)), ["a", "b"]).count() == 60
    with pytest.raises(Exception, match="(?i)null|nan|error"):
        model(spark.createDataFrame([(None, 1.0, 0)], train.schema)).collect()


def test_sinks_take_one_row_of_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1)), (1, 3, dt.datetime(2024, 1, 2)), (2, 1, dt.datetime(2024, 1, 1))], "k long, v long, updated_at timestamp")
    stored = spark.createDataFrame([(1, 0, dt.datetime(2023, 1, 1))], rows.schema)
    assert {r.k: r.v for r in sinks.upsert(stored, rows, ["k"]).collect()} == {1: 3, 2: 1}
    out = sinks.append_new(rows.withColumn("p", F.lit("x")), str(tmp_path / "t"), ["k"], ["p"]).first()
    assert (out.received, out.inserted, out.duplicates) == (3, 2, 1)
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: 3, 2: 1}


def test_tournament_derives_its_panel_once(spark, sf, monkeypatch):
    from tapeline.plans import ml as plans

    class Seen(Exception):
        pass

    def look(panel, *rest):
        raise Seen(panel._jdf.queryExecution().toString())

    monkeypatch.setattr(ml, "walk_forward", look)
    with pytest.raises(Seen) as seen:
        plans.ml_tournament(spark, sf)
    assert "lineitem" not in str(seen.value)
