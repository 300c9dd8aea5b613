import numpy as np
import pandas as pd
import pytest

from tapeline.operators import comoments


@pytest.mark.parametrize("width, days", [(64, 30), (3, 2), (1, 400)])
def test_all_pairs_equal_pandas(spark, width, days):
    rng = np.random.default_rng(width)
    stamps = pd.date_range("2024-01-01", periods=120, freq="6h")
    wide = pd.DataFrame({f"S{i:02d}": rng.normal(size=120) for i in range(11)}, index=stamps)
    wide["S01"] += wide["S00"]
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["flat"] = 0.25
    wide["short"] = pd.Series(1.0 + np.arange(5.0), index=stamps[:5])
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret")
    long.loc[len(long)] = [stamps[0], None, 1.0]
    got = comoments.pair_correlation(spark.createDataFrame(long), least=20, width=width, days=days).toPandas()
    want = {}
    for i, a in enumerate(names := sorted(wide.columns)):
        for b in names[i + 1:]:
            both = wide[[a, b]].dropna()
            if len(both) >= 20:
                want[a, b] = (len(both), None if "flat" in (a, b) else both[a].corr(both[b]))
    assert not got.duplicated(["left", "right"]).any()
    assert {(r.left, r.right): r.samples for r in got.itertuples()} == {k: v[0] for k, v in want.items()}
    for r in got.itertuples():
        expected = want[r.left, r.right][1]
        assert np.isnan(r.correlation) if expected is None else abs(r.correlation - expected) < 1e-9


def test_no_pairs_of_nothing(spark):
    assert comoments.pair_correlation(spark.createDataFrame([], "symbol string, ts timestamp, ret double")).count() == 0
