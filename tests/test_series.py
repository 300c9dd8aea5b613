import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import walk_frame
from tapeline.functions.series import as_of, ewm
from tapeline.operators import features as feat, indicators as ind
from tapeline.schema import FEATURES


def pdf(df, *cols):
    return df.select("symbol", "ts", *cols).orderBy("symbol", "ts").toPandas()


def test_ewm_matches_recursion_across_blocks(spark):
    frame = pd.concat([walk_frame(2300), walk_frame(40, 8, "BBB")])
    out = pdf(ewm(spark.createDataFrame(frame), {"fast": ("close", 1 / 3), "slow": ("close", 2 / 201)}), "fast", "slow")
    for symbol, part in frame.groupby("symbol"):
        mine = out[out.symbol == symbol]
        for name, alpha in (("fast", 1 / 3), ("slow", 2 / 201)):
            want = part.close.ewm(alpha=alpha, adjust=False).mean().to_numpy()
            assert np.allclose(mine[name].to_numpy(), want, rtol=1e-12)


def test_adx_rsi_macd_match_pandas(spark):
    f = walk_frame(1500, 5)
    out = pdf(ind.compose(spark.createDataFrame(f), ind._adx("adx"), ind._rsi(), ind._macd(2.0, "")), "adx", "rsi", "macd_hist")
    prev = f.close.shift(1)
    tr = pd.concat([f.high - f.low, (f.high - prev).abs(), (f.low - prev).abs()], axis=1).max(axis=1)
    up, down = f.high.diff(), -f.low.diff()
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean()
    atr = wilder(tr)
    pdi, mdi = (100 * wilder(pd.Series(np.where((a > b) & (a > 0), a, 0.0))) / atr for a, b in ((up, down), (down, up)))
    adx = wilder(100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, np.nan))
    assert np.allclose(out.adx.to_numpy()[1:], adx.to_numpy()[1:], rtol=1e-9)
    delta = f.close.diff()
    rsi = (100 - 100 / (1 + wilder(delta.clip(lower=0)) / wilder(-delta.clip(upper=0)))).fillna(50)
    assert np.allclose(out.rsi.to_numpy(), rsi.to_numpy(), rtol=1e-9)
    macd = f.close.ewm(span=12, adjust=False).mean() - f.close.ewm(span=26, adjust=False).mean()
    assert np.allclose(out.macd_hist.to_numpy(), 2 * (macd - macd.ewm(span=9, adjust=False).mean()).to_numpy(), atol=1e-9)


def test_features_do_not_see_the_future(spark):
    f = walk_frame(420, 11)
    changed = f.copy()
    changed.loc[300:, ["open", "high", "low", "close"]] *= 3.0
    a, b = (pdf(feat.features(spark.createDataFrame(x)), *FEATURES).head(300) for x in (f, changed))
    for name in FEATURES:
        assert np.allclose(a[name].astype(float), b[name].astype(float), equal_nan=True, rtol=1e-9), name


def test_as_of_matches_search(spark):
    rng = np.random.default_rng(3)
    bars = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp("2025-01-01") + pd.to_timedelta(np.sort(rng.choice(9000, 200, False)), unit="min")}).assign(v=lambda x: np.arange(len(x)))
    events = pd.DataFrame({"symbol": "A", "id": range(300), "event_ts": pd.Timestamp("2024-12-30") + pd.to_timedelta(rng.integers(0, 14000, 300), unit="min")})
    events.loc[:40, "event_ts"] = bars.ts.to_numpy()[:41]
    b, e = spark.createDataFrame(bars), spark.createDataFrame(events)
    stamps = bars.ts.to_numpy()
    for strict, forward, side in ((True, True, "right"), (False, True, "left"), (True, False, "left"), (False, False, "right")):
        got = as_of(e, b, ["v"], strict=strict, forward=forward).toPandas().set_index("id").v
        for row in events.itertuples():
            k = int(np.searchsorted(stamps, np.datetime64(row.event_ts), side=side)) - (0 if forward else 1)
            want = k if 0 <= k < len(bars) else None
            assert (pd.isna(got[row.id]) and want is None) or got[row.id] == want
