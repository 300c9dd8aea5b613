import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import walk_frame
from tapeline.functions.kernels import expanding_regularity, expanding_share, open_gaps, stop_and_reverse, structure_breaks
from tapeline.operators import backtest as bt, indicators as ind, signals as sg, structure as st


def test_kernels_against_plain_loops():
    rng = np.random.default_rng(1)
    values = rng.normal(size=80)
    assert np.allclose(expanding_share(values), [np.mean(values[:i + 1] <= values[i]) for i in range(80)])
    gaps = np.r_[np.nan, rng.integers(1, 9, 60).astype(float)]
    want = [0.0] + [float(np.mean(gaps[1:i + 1] <= 3 * np.median(gaps[1:i + 1]))) for i in range(1, 61)]
    assert np.allclose(expanding_regularity(gaps), want)
    f = walk_frame(60)
    levels = stop_and_reverse(f.high.to_numpy(), f.low.to_numpy(), 0.02, 0.2)
    assert levels[0] == f.low[0] and len(levels) == 60


def test_breaks_pop_back_to_older_swing():
    close = [10, 10, 12, 13, 9, 12.5, 14]
    # Two known highs at 13.5 (old) and 11 (new): breaking the new one exposes the old one again.
    events = structure_breaks(close, [0.1] * 7, ["HIGH", "HIGH"], [13.5, 11.0], [0, 0])
    assert [(e[0], e[1], e[3]) for e in events] == [(2, 1, "BOS"), (6, 0, "BOS")]


def test_open_gaps_against_rescan():
    f = walk_frame(300, 9)
    rng = np.random.default_rng(4)
    high, low = f.high.to_numpy() - 0.3 * rng.random(300), f.low.to_numpy() + 0.3 * rng.random(300)
    nan = np.full(300, np.nan)
    sides, bottoms, tops, _ = open_gaps(high, low, nan, nan, np.zeros(300))
    for i in range(2, 300, 7):
        live = []
        for k in range(2, i + 1):
            if high[k - 2] < low[k]:
                top, bottom, side = low[k], high[k - 2], 1
                deep = max([(top - x) / (top - bottom) for x in low[k + 1:i + 1]], default=0)
            elif low[k - 2] > high[k]:
                top, bottom, side = low[k - 2], high[k], -1
                deep = max([(x - bottom) / (top - bottom) for x in high[k + 1:i + 1]], default=0)
            else:
                continue
            if deep < 0.999:
                live.append((side, bottom, top))
        if live:
            assert sides[i] == live[-1][0] and abs(bottoms[i] - live[-1][1]) < 1e-5 and abs(tops[i] - live[-1][2]) < 1e-5
        else:
            assert sides[i] == 0


def test_swings_are_known_after_their_right_bars(spark):
    rows = st.swing_table(spark.createDataFrame(walk_frame(200))).collect()
    assert rows and all(r.known_from == r.pivot + 3 and r.known_at > r.formed_at for r in rows)


def test_gap_golden(spark):
    f = walk_frame(60)
    f.loc[:, ["open", "high", "low", "close"]] = [100.0, 100.2, 99.8, 100.0]
    f.loc[40, ["open", "high", "low", "close"]] = [100.5, 100.7, 100.4, 100.6]
    f.loc[41, ["open", "high", "low", "close"]] = [100.7, 101.3, 100.6, 101.2]
    f.loc[42, ["open", "high", "low", "close"]] = [101.3, 101.6, 101.2, 101.5]
    gap = st.price_gaps(ind.sx_atr(spark.createDataFrame(f))).filter("n = 42").first()
    assert gap.direction == "BULLISH" and abs(gap.bottom - 100.7) < 1e-9 and abs(gap.top - 101.2) < 1e-9


def test_signals_are_causal_and_trades_follow_the_rules(spark):
    f = walk_frame(360, 21)
    cut = 300
    full = sg.signals(sg.context(spark.createDataFrame(f))).filter(F.col("n") < cut)
    part = sg.signals(sg.context(spark.createDataFrame(f.head(cut))))
    cols = ["n", "strategy", "score", "signal", "strength"]
    a, b = (x.select(*cols).orderBy("n", "strategy").toPandas() for x in (full, part))
    assert len(a) == len(b) == cut * 30
    assert np.allclose(a.score, b.score, rtol=1e-9) and (a.signal == b.signal).all()

    ctx = sg.context(spark.createDataFrame(f))
    got = bt.barrier_trades(ctx, ["trend", "donchian"]).orderBy("strategy", "n").toPandas()
    rows = sg.signals(ctx, ["trend", "donchian"]).select("strategy", "n", "signal", "unit", "l1_price", "h1_price").toPandas()
    want = []
    for key, part in rows.groupby("strategy"):
        part = part.sort_values("n").set_index("n")
        i = 80
        while i < len(f) - 9:
            signal = part.signal[i]
            if signal == "HOLD":
                i += 1
                continue
            side = 1 if signal == "BUY" else -1
            entry = f.open[i + 1] * (1 + side * 0.0005)
            unit = part.unit[i]
            anchor = part.l1_price[i] if side > 0 else part.h1_price[i]
            stop = min(anchor - 0.2 * unit, entry - 0.75 * unit) if side > 0 else max(anchor + 0.2 * unit, entry + 0.75 * unit)
            target = entry + side * abs(entry - stop) * 1.75
            leave, how = f.close[i + 8], "TIME"
            for k in range(i + 1, i + 9):
                if (f.low[k] <= stop) if side > 0 else (f.high[k] >= stop):
                    leave, how = stop, "SL"
                    break
                if (f.high[k] >= target) if side > 0 else (f.low[k] <= target):
                    leave, how = target, "TP"
                    break
            want.append((key, i, how, side * (leave / entry - 1) - 0.0025))
            i += 8
    assert [(r.strategy, r.n, r.outcome) for r in got.itertuples()] == [w[:3] for w in want]
    assert np.allclose(got.ret, [w[3] for w in want])


def test_structure_state_changes_only_with_events(spark):
    from conftest import walk_frame
    from tapeline.operators import indicators as ind
    bars = spark.createDataFrame(walk_frame(240))
    out = st.structure_state(ind.sx_atr(bars)).toPandas().sort_values("n")
    state = list(zip(*(out[c].fillna(-1) for c in ("bos_at", "choch_at", "gap_at"))))
    assert list(out.changed) == [i == 0 or state[i] != state[i - 1] for i in range(len(state))]
    assert 1 < out.changed.sum() < len(out)
    broken = {(r.n, r.break_type) for r in st.breaks(ind.sx_volume(ind.sx_atr(bars))).collect()}
    assert {(int(x), "BOS") for x in out.bos_at.dropna().unique()} | {(int(x), "CHOCH") for x in out.choch_at.dropna().unique()} == broken


def test_short_series_say_nothing_about_their_timeframe(spark):
    import pandas as pd
    from conftest import walk_frame
    from tapeline.operators import signals
    bars = spark.createDataFrame(pd.concat([walk_frame(59, symbol="short"), walk_frame(60, symbol="long")]))
    assert {r.symbol for r in signals.long_enough(bars).collect()} == {"long"}


def test_features_are_finite_or_null(spark):
    import numpy as np
    from conftest import walk_frame
    from tapeline.operators import features
    from tapeline.schema import FEATURES
    frame = walk_frame(150)
    frame.loc[40:90, ["open", "high", "low", "close"]] = 100.0
    frame.loc[50:60, "volume"] = 0.0
    got = features.features(spark.createDataFrame(frame)).select(*FEATURES).toPandas().astype(float)
    assert not np.isinf(got.to_numpy()).any() and len(FEATURES) == 57
