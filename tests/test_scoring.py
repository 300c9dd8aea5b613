import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import scoring

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    parts = []
    for symbol in ("AAA", "BBB"):
        n = 300
        a, b = rng.normal(size=n), rng.normal(size=n)
        ts = pd.date_range("2024-01-01", periods=n, freq="D")
        ret = 0.02 * a + rng.normal(0, 0.01, n)
        parts.append(pd.DataFrame({"symbol": symbol, "ts": ts, "target_time": ts + pd.Timedelta(days=1), "a": a, "b": b, "future_return": ret, "future_max_drawdown": np.minimum(ret, 0) - 0.005,
                                   "atr_normalized": 0.01, "volatility": rng.uniform(0.1, 0.2, n), "ma20_gap": rng.normal(0, 0.01, n)}))
    return spark.createDataFrame(pd.concat(parts))


def test_saved_version_scores_the_latest_rows(spark, frame, tmp_path):
    root = str(tmp_path)
    scoring.train_version({"1D": frame, "2D": frame}, COLUMNS, root, "v1", ("LogisticRegression",))
    newest = frame.withColumn("a", F.when(F.col("symbol") == "AAA", 3.0).otherwise(-3.0))
    newest = newest.unionByName(newest.filter("symbol = 'AAA'").withColumns({"ts": F.lit("2030-01-01").cast("timestamp"), "b": F.lit(None).cast("double")}))
    new = newest.filter("symbol = 'BBB'").withColumn("symbol", F.lit("NEW"))
    latest = scoring.latest_complete(newest.unionByName(new), COLUMNS)
    rows = scoring.predict_latest(spark, root, "v1", latest).collect()
    assert sorted((r.symbol, r.horizon) for r in rows) == [(s, h) for s in ("AAA", "BBB", "NEW") for h in ("1D", "2D")]
    for r in rows:
        assert abs(r.prob_down + r.prob_flat + r.prob_up - 1) < 1e-9 and r.consensus == 1 and r.models == 1
        assert r.called == (1 if r.symbol == "AAA" else -1) and r.ts.year == 2024
        assert r.risk_probability < 0.5 if r.symbol == "AAA" else r.risk_probability > 0.5
    with pytest.raises(ValueError, match="v1 exists"):
        scoring.train_version({"1D": frame}, COLUMNS, root, "v1", ("LogisticRegression",))
    again = scoring.predict_latest(spark, root, "v1", latest).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_weights_by_regime(spark):
    rng = np.random.default_rng(2)
    n = 200
    p = rng.dirichlet([1, 1, 1], n)
    df = pd.DataFrame({"model": "m", "regime": rng.choice(["BULL", "BEAR", "RARE", "SINGLE"], n, p=[0.4, 0.4, 0.05, 0.15]), "label": rng.integers(-1, 2, n), "prob_down": p[:, 0], "prob_flat": p[:, 1], "prob_up": p[:, 2]})
    df.loc[df.regime == "SINGLE", "label"] = 1
    df["called"] = p.argmax(1) - 1

    def weight(part):
        classes = sorted(set(part.label) | set(part.called))
        f1 = [2 * ((part.label == k) & (part.called == k)).sum() / ((part.label == k).sum() + (part.called == k).sum()) for k in classes]
        q = part[["prob_down", "prob_flat", "prob_up"]].to_numpy()
        hot = np.eye(3)[part.label.to_numpy() + 1]
        brier, loss = ((q - hot) ** 2).sum(1).mean(), -np.log((q * hot).sum(1)).mean()
        return max(0.01, ((part.label == part.called).mean() + np.mean(f1)) / 2 * max(0.05, 1 - brier) * max(0.05, 1 - loss / 2.5))

    got = {r.regime: r.weight for r in scoring.regime_weights(spark.createDataFrame(df)).collect()}
    assert (df.regime == "RARE").sum() < 20 <= (df.regime == "SINGLE").sum() and set(got) == {None, "BULL", "BEAR"}
    assert got[None] == pytest.approx(weight(df)) and all(got[k] == pytest.approx(weight(df[df.regime == k])) for k in ("BULL", "BEAR"))


def test_risk_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (1, 1.0, 0.4), (1, 0.0, 0.2), (1, 0.0, 0.1), (2, 0.0, 0.5)], "fold int, risk_label double, risk_probability double")
    got = {r.fold: r for r in scoring.risk_metrics(df, ["fold"]).collect()}
    one, two = got[1], got[2]
    assert one.samples == 4 and one.balanced_accuracy == pytest.approx(0.75) and one.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2) and one.mcc == pytest.approx(2 / 12 ** 0.5)
    assert one.brier == pytest.approx((0.01 + 0.36 + 0.04 + 0.01) / 4) and one.log_loss == pytest.approx(-np.mean(np.log([0.9, 0.4, 0.8, 0.9])))
    assert (two.balanced_accuracy, two.macro_f1, two.mcc) == (0.0, 0.0, 0.0)


def test_a_version_without_manifest_does_not_exist(spark, frame, tmp_path):
    (tmp_path / "v2" / "levels").mkdir(parents=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scoring.predict_latest(spark, str(tmp_path), "v2", frame)
