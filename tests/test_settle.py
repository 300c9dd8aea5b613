"""Incremental settlement: every prediction once, whatever is run again."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import walk_frame
from tapeline.operators import ledger
from tapeline.plans.ledger import _predictions
from tapeline.streaming import settle


def test_a_batch_run_again_changes_nothing_and_settles_once(spark, tmp_path):
    bars = spark.createDataFrame(pd.concat([walk_frame(60, symbol=s, seed=i) for i, s in enumerate(("view", "signup"))])).cache()
    said = _predictions(bars).cache()
    early, late = bars.filter("ts < '2025-01-02 06:00:00'"), bars.filter("ts >= '2025-01-02 06:00:00'")
    path = str(tmp_path)
    rows = lambda: sorted(map(tuple, settle.settlements(spark, path).select("id", "actual", F.round("actual_return", 9), "batch").collect()))
    settle.settle_batch(early, 0, said, path)
    first = rows()
    settle.settle_batch(early, 0, said, path)  # crash after the writes, before the commit
    assert rows() == first and first
    settle.settle_batch(late, 1, said, path)
    second = rows()
    settle.settle_batch(late, 1, said, path)
    settle.settle_batch(late.filter("symbol = 'view'"), 2, said, path)  # bars that came again
    assert rows() == second and len({r[0] for r in second}) == len(second)
    whole = ledger.settle(said, bars).filter("status = 'SETTLED'").select("id", "actual", F.round("actual_return", 9)).collect()
    assert sorted(map(tuple, whole)) == [r[:3] for r in second]


def test_only_the_assets_asked_for_are_settled(spark):
    bars = spark.createDataFrame(pd.concat([walk_frame(40, symbol=s, seed=i) for i, s in enumerate(("view", "signup"))]))
    said = _predictions(bars)
    none = said.select("id").limit(0)
    got = ledger.settle_assets(said, none, bars, spark.createDataFrame([("view", "1h"), ("view", "1h"), ("new", "1h"), (None, "1h")], "symbol string, interval string"))
    want = ledger.settle_new(said, none, bars).filter("symbol = 'view'")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
