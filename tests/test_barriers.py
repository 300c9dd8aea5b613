import random

import pytest
from conftest import walk_frame

from tapeline.operators import backtest as bt, barriers as br, signals as sg


def kept(positions, gap):
    out, free = [], None
    for p in sorted(set(positions)):
        if free is None or p >= free:
            out.append(p)
            free = p + gap
    return out


@pytest.mark.parametrize("gap", [1, 7, 24, 700])
def test_spacing_equals_the_greedy_pass(spark, gap):
    rng = random.Random(gap)
    runs = {"dense": list(range(3000)), "sparse": rng.sample(range(6000), 400), "edges": [511, 512, 513, 1023, 1024, 1535, 1536], "one": [5], "twice": [4, 4, 4, 90, 90], "late": [100_000, 100_003, 100_600]}
    rows = [(k, p) for k, ps in runs.items() for p in ps] + [("dense", None), ("nothing", None)]
    rng.shuffle(rows)
    got = br.spaced_entries(spark.createDataFrame(rows, "run string, n long"), ("run",), gap).collect()
    assert sorted(map(tuple, got)) == sorted((k, p) for k, ps in runs.items() for p in kept(ps, gap))


def test_spacing_of_nothing(spark):
    assert br.spaced_entries(spark.createDataFrame([], "run string, n long"), ("run",), 5).count() == 0


@pytest.mark.parametrize("horizon", [1, 5, 8, 23])
def test_first_passage_equals_a_walk_along_the_path(spark, horizon):
    f = walk_frame(150, 3)
    rng = random.Random(horizon)
    entries = []
    for n in range(150):
        for side in (1, -1):
            width = rng.choice([0.001, 0.004, 0.02, 0.5])
            barrier = lambda sign: None if rng.random() < 0.05 else float(f.close[n] * (1 + sign * side * width))
            entries += [("AAA", "1h", n, side, barrier(-1), barrier(1))] * rng.choice([1, 1, 2])
    want = []
    for _, _, n, side, stop, target in entries:
        outcome = leave = price = None
        for k in range(n + 1, min(n + horizon, 149) + 1):
            low, high = f.low[k], f.high[k]
            if stop is not None and (low <= stop if side > 0 else high >= stop):
                outcome, leave, price = "SL", k, stop
            elif target is not None and (high >= target if side > 0 else low <= target):
                outcome, leave, price = "TP", k, target
            if outcome:
                break
        if not outcome and n + horizon <= 149:
            outcome, leave, price = "TIME", n + horizon, float(f.close[n + horizon])
        path = f.iloc[n + 1:n + horizon + 1]
        ends = (float(path.low.min()), float(path.high.max())) if len(path) else (None, None)
        want.append((n, side, stop, target, outcome, leave, price, *ends))
    bars = spark.createDataFrame(f.assign(n=range(150)))
    df = spark.createDataFrame(entries, "symbol string, interval string, n long, side int, stop double, target double")
    got = br.first_passage(df, bars, horizon).select("n", "side", "stop", "target", "outcome", "exit_n", "exit", "bottom", "top")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_trades_use_no_python_after_the_context(spark, capsys):
    ctx = sg.context(spark.createDataFrame(walk_frame(200, 21)))
    from tapeline.session import cut
    bt.barrier_trades(cut(ctx), list(sg.FAMILIES)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" in plan and "Pandas" not in plan and "Python" not in plan


def test_grid_judges_each_strategy_by_its_own_pair(spark):
    import pandas as pd
    bars = spark.createDataFrame(pd.concat([walk_frame(420, 5), walk_frame(420, 8, symbol="BBB")]))
    both = bt.parameter_grid(bars, ["macd", "trend"]).toPandas()
    judged = both[both.segment == "out_of_sample"]
    assert judged.locked.all() and not judged.duplicated(["symbol", "strategy"]).any() and len(judged)
    alone = bt.parameter_grid(bars, ["macd"]).toPandas()
    cols = ["symbol", "swing", "threshold", "segment", "number_of_trades", "locked"]
    pick = lambda d: sorted(map(tuple, d[d.strategy == "macd"][cols].values))
    assert pick(both) == pick(alone)


def test_increment_of_every_variant(spark):
    rows = [("A", "1h", "x", 6, 0.5, 0.2, 1.0, 0.1), ("A", "1h", "base", 5, 0.25, 0.1, 0.5, 0.3), ("B", "1h", "base", 9, 0.25, 0.1, 0.5, 0.3), ("C", "1h", "other", 9, 0.25, 0.1, 0.5, 0.3)]
    table = spark.createDataFrame(rows, "symbol string, interval string, strategy string, number_of_trades long, win_rate double, expectancy double, sharpe double, max_drawdown double")
    got = {(r.symbol, r.variant): (round(r.win_rate, 6), r.status) for r in bt.incremental(table, ("x", "y"), "base").collect()}
    assert got == {("A", "x"): (0.25, "VALIDATED"), ("A", "y"): (-0.25, "NOT_VALIDATED"), ("B", "x"): (-0.25, "NOT_VALIDATED"), ("B", "y"): (-0.25, "NOT_VALIDATED")}
