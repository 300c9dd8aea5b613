"""Fits from co-moments against plain least squares and MLlib, fold marks against the fold by fold split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tapeline.operators import gram, ml


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    rows = []
    for s in range(4):
        x = rng.normal(0, 1, (200, 3)) * [1.0, 2.0, 0.5]
        y = 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.2, 200) + 0.05
        rows.append(pd.DataFrame({"symbol": f"S{s}", "ts": days, "session_date": days.date, "target_time": days + pd.Timedelta(days=5), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "flat": 1.5, "y": y}))
    return spark.createDataFrame(pd.concat(rows)).withColumns({"symbol": F.col("symbol")}).repartition(5).cache()


def test_marks_are_the_folds_of_the_plain_split(panel):
    marked = gram.mark_folds(panel, 3).toPandas()
    placed = panel.join(ml.sessions(panel), "session_date")
    for fold in ml.fold_plan(3, 200):
        plain = ml.mark_fold(placed, fold).toPandas()
        for part, chosen in (("train", marked[marked.train_from <= fold["fold"]]), ("test", marked[marked.test_fold == fold["fold"]])):
            assert set(zip(chosen.symbol, chosen.ts)) == set(zip(*plain.loc[plain.part == part, ["symbol", "ts"]].values.T))


def test_fits_equal_plain_algebra(panel):
    marked = gram.mark_folds(panel, 3)
    groups = {"all": ["a", "b", "c", "flat"], "two": ["b", "c"]}
    fits = {(r.group, r.model, r.fold): r for r in gram.fold_models(marked, groups, gram.LINEAR, "y", 3).collect()}
    assert len(fits) == 2 * 3 * 3
    rows = marked.toPandas()
    columns = ["a", "b", "c", "flat"]
    for (group, model, fold), r in fits.items():
        train = rows[rows.train_from <= fold]
        assert r.samples == len(train)
        x, y = train[groups[group]].to_numpy(), train["y"].to_numpy()
        sd = np.where(x.std(0) > 0, x.std(0), 1)
        z = (x - x.mean(0)) / sd
        w = np.array([r.coefficients[columns.index(n)] for n in groups[group]]) * sd
        assert all(r.coefficients[i] == 0 for i, n in enumerate(columns) if n not in groups[group] or n == "flat")
        slope = z.T @ (y - y.mean() - z @ w)
        if model == "Lasso":  # optimality: the slope is the penalty on live inputs, below it elsewhere
            assert np.all(np.where(w != 0, np.abs(slope / len(y) - gram.LASSO * np.sign(w)), np.maximum(np.abs(slope / len(y)) - gram.LASSO, 0)) < 1e-9)
        else:
            assert np.allclose(slope, gram.LINEAR[model][0] * w, atol=1e-7)
        assert r.intercept == pytest.approx(y.mean() - (w / sd) @ x.mean(0), abs=1e-9)
    scored = gram.scored_tests(marked, gram.fold_models(marked, groups, {"Ridge": (5.0, 0.0)}, "y", 3), columns, ["symbol", "ts", *columns]).toPandas()
    assert len(scored) == 2 * int(rows.test_fold.notna().sum())
    for t in scored.head(50).itertuples():
        r = fits[t.group, "Ridge", t.fold]
        assert t.predicted == pytest.approx(r.intercept + sum(w * getattr(t, n) for w, n in zip(r.coefficients, columns)), abs=1e-12)


def test_plain_fit_equals_mllib(panel):
    marked = gram.mark_folds(panel, 3)
    fit = next(r for r in gram.fold_models(marked, {"all": ["a", "b", "c"]}, {"LinearRegression": (0.0, 0.0)}, "y", 3).collect() if r.fold == 2)
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(marked.filter("train_from <= 2"))
    model = LinearRegression(labelCol="y", solver="normal").fit(train)
    assert np.allclose(fit.coefficients, model.coefficients.toArray(), atol=1e-6) and fit.intercept == pytest.approx(model.intercept, abs=1e-6)


def test_unsound_rows_and_empty_panels_take_no_part(spark, panel):
    marked = gram.mark_folds(panel, 3)
    bad = marked.limit(20).withColumn("a", F.lit(float("nan"))).unionByName(marked.limit(20).withColumn("y", F.lit(None).cast("double"))).withColumn("train_from", F.lit(1))
    key = lambda df: sorted((r.key, r["at"], round(r.value, 6)) for r in gram.co_moments(df, ["a", "y"], "train_from").collect())
    assert key(marked.unionByName(bad)) == key(marked)
    assert gram.running(gram.co_moments(marked.limit(0), ["a", "y"], "train_from"), 2, 3) == {}
    assert gram.fold_models(marked.limit(0), {"all": ["a"]}, {"Ridge": (5.0, 0.0)}, "y", 3).count() == 0
