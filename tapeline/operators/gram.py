"""Linear models of all folds and feature groups from one table of co-moments.

One scan gives, per first fold that may train on a row, the sums of all products of columns and targets. Training parts
only grow from fold to fold, so each fold is a running total of that table and each feature group a part of its rows
and columns: fits cost (folds x columns^2) numbers on the driver, whatever the panel holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeline.operators.ml import fold_plan, sessions

#: Penalties as sums over rows (ridge) and as means over rows (lasso), on inputs of mean 0 and population deviation 1.
RIDGE, LASSO = 5.0, 0.0002
LINEAR = {"LinearRegression": (0.0, 0.0), "Ridge": (RIDGE, 0.0), "Lasso": (0.0, LASSO)}


def mark_folds(panel: DataFrame, count: int = 5, **kw) -> DataFrame:
    """Add train_from, the first fold whose purged train part holds the row, and test_fold, the one that tests on it.

    A label must end before its fold's validation part begins. Later folds begin later, so a row that one fold trains
    on is in the train part of all folds after it. Needs session_date, ts and target_time; NULL means no fold.
    """
    c = F.col
    days = sessions(panel).join(panel.groupBy("session_date").agg(F.min(F.unix_micros("ts")).alias("_first")), "session_date")
    total = days.count()
    plan = fold_plan(count, total, **kw)
    held = lambda f: (c("place") >= f["train_end"]) & (c("place") < f["validation_end"])
    starts = days.agg(*[F.min(F.when(held(f), c("_first"))).alias(str(f["fold"])) for f in plan]).first()
    train = [F.when((c("place") < f["train_end"]) & (F.unix_micros("target_time") < starts[str(f["fold"])]), f["fold"]) for f in plan]
    test = [F.when((c("place") >= f["validation_end"]) & (c("place") < f["test_end"]), f["fold"]) for f in plan]
    return panel.join(F.broadcast(days.drop("_first")), "session_date").withColumns({"train_from": F.coalesce(*train), "test_fold": F.coalesce(*test)})


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width))])
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        sound = np.isfinite(x).all(axis=1)
        for key in np.unique(keys[sound]):
            part = x[sound & (keys == key)]
            total[int(key)] = total.get(int(key), 0.0) + part.T @ part
    for key, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["key", "sums"])


def co_moments(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Sums of products of (1, *columns) by ``key``: one row (key, at, value) per cell of the matrix, row by row.

    Every task hands on one matrix per key. Rows with a NULL key, or a NULL or non-finite column, take no part. Columns
    should lie around zero (z-scores do), as sums of raw squares are taken.
    """
    chosen = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("int").alias("key"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(columns)])
    sums = chosen.mapInArrow(lambda b: _sums(b, len(columns)), "key int, sums array<double>")
    return sums.select("key", F.posexplode("sums").alias("at", "value")).groupBy("key", "at").agg(F.sum("value").alias("value"))


def running(moments: DataFrame, width: int, folds: int) -> dict[int, np.ndarray]:
    """Matrix of each fold's train part: folds x (width + 1)^2 numbers."""
    own = np.zeros((folds + 1, (width + 1) ** 2))
    for r in moments.collect():
        own[r["key"], r["at"]] = r["value"]
    return {f: m.reshape(width + 1, width + 1) for f, m in enumerate(np.cumsum(own, axis=0)) if f and m[0] > 0}


def solve(m: np.ndarray, inputs: list[int], target: int, ridge: float = 0.0, lasso: float = 0.0, rounds: int = 3000, tolerance: float = 1e-10) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from a matrix of co-moments; ``inputs`` and ``target`` are its rows (0 counts rows).

    Inputs are brought to mean 0 and population deviation 1 first (constant ones count nothing); the answer is on the
    scale of the data. Without a penalty it is the least of all best solutions.
    """
    n = m[0, 0]
    mean, middle = m[0, inputs] / n, m[0, target] / n
    spread = m[np.ix_(inputs, inputs)] / n - np.outer(mean, mean)
    along = m[inputs, target] / n - mean * middle
    deviation = np.sqrt(np.maximum(np.diag(spread), 0.0))
    live = deviation > 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(live, deviation, 1.0)
    a = np.where(np.outer(live, live), spread / np.outer(scale, scale), 0.0)
    b = np.where(live, along / scale, 0.0)
    if lasso:
        w = np.zeros(len(b))
        for _ in range(rounds):
            before = w.copy()
            for j in np.flatnonzero(live):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(0.0, abs(rest) - lasso) / a[j, j]
            if np.abs(w - before).max(initial=0.0) <= tolerance * max(1e-12, np.abs(w).max(initial=0.0)):
                break
    elif ridge:
        w = np.linalg.solve(a + np.eye(len(b)) * ridge / n, b)
    else:
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    w = np.where(live, w / scale, 0.0)
    return float(middle - w @ mean), w


def fold_models(marked: DataFrame, groups: dict[str, list[str]], models: dict[str, tuple[float, float]], target: str, count: int) -> DataFrame:
    """(group, model, fold, samples, intercept, coefficients) of every fit; coefficients in the order of all columns.

    ``groups`` names the columns of each fit, ``models`` its (ridge, lasso) penalties. One scan serves them all.
    """
    columns = list(dict.fromkeys(x for group in groups.values() for x in group))
    found = running(co_moments(marked, [*columns, target], "train_from"), len(columns) + 1, count)
    out = []
    for fold, m in found.items():
        for group, names in groups.items():
            chosen = [columns.index(x) for x in names]
            for model, (ridge, lasso) in models.items():
                intercept, w = solve(m, [i + 1 for i in chosen], len(columns) + 1, ridge, lasso)
                full = np.zeros(len(columns))
                full[chosen] = w
                out.append((group, model, fold, int(m[0, 0]), intercept, full.tolist()))
    return marked.sparkSession.createDataFrame(out, "group string, model string, fold int, samples long, intercept double, coefficients array<double>")


def scored_tests(marked: DataFrame, fits: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Out-of-sample ``predicted`` of every test row by every fit of its fold; fits are a small table by construction."""
    c = F.col
    tests = marked.where("test_fold is not null").select(c("test_fold").alias("fold"), *keep, F.array(*[c(x).cast("double") for x in columns]).alias("_x"))
    dot = F.aggregate(F.zip_with("_x", "coefficients", lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)
    return tests.join(F.broadcast(fits), "fold").withColumn("predicted", c("intercept") + dot).drop("_x", "coefficients", "intercept", "samples")


def regression_metrics(scored: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Samples, mean absolute and root mean squared error by ``keys``."""
    miss = F.col("predicted") - F.col(target)
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"))
