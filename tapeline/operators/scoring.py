"""Saved model versions: fitted once, scored later from what was saved, with weights by regime and a risk model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeline.functions.series import ratio
from tapeline.operators import ml
from tapeline.operators.features import regime_labels
from tapeline.session import cut

PROBABILITIES = ("prob_down", "prob_flat", "prob_up")
SCRATCH = ("_raw", "features", "rawPrediction", "probability", "prediction")


def _risk_pipeline(columns: list[str], rows: int):
    return ml._stages(columns, LogisticRegression(labelCol="risk_label", featuresCol="features", weightCol="weight", family="binomial", regParam=1 / (0.5 * max(rows, 1)), maxIter=100, standardization=False))


def fit_risk(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Balanced binary model of ``risk_label``, penalty 1 / (0.5 n)."""
    return _risk_pipeline(columns, train.count()).fit(ml.balanced_weights(train, "risk_label"))


def risk_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("risk_probability", vector_to_array("probability")[1]).drop(*SCRATCH)


def risk_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Two-class scores of risk_probability against risk_label by ``keys``; a class that never occurs says nothing."""
    c = F.col
    said, real = c("risk_probability") >= 0.5, c("risk_label") == 1
    count = lambda cond: F.sum(cond.cast("double"))
    p = F.least(F.greatest("risk_probability", F.lit(1e-15)), F.lit(1 - 1e-15))
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), count(said & real).alias("_tp"), count(said & ~real).alias("_fp"), count(~said & real).alias("_fn"), count(~said & ~real).alias("_tn"),
                              F.avg(F.pow(c("risk_probability") - c("risk_label"), 2)).alias("brier"), (-F.avg(F.when(real, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))
    tp, fp, fn, tn = (c(x) for x in ("_tp", "_fp", "_fn", "_tn"))
    recalls = F.array_compact(F.array(ratio(tp, tp + fn), ratio(tn, tn + fp)))
    f1 = F.array_compact(F.array(ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    mcc = F.coalesce(ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return m.withColumns({"balanced_accuracy": mean(recalls), "macro_f1": mean(f1), "mcc": mcc}).drop("_tp", "_fp", "_fn", "_tn")


def risk_walk_forward(panel: DataFrame, columns: list[str], count: int = 5, **kw) -> DataFrame:
    """Out-of-sample risk probabilities of every fold; labels and thresholds come from the fold's train part."""
    panel = ml.complete(panel, columns)
    placed = panel.join(F.broadcast(ml.sessions(panel)), "session_date")
    total = placed.agg(F.max("place") + 1).first()[0]
    parts = []
    for fold in ml.fold_plan(count, total, **kw):
        rows = cut(ml.fold_labels(ml.mark_fold(placed, fold)))
        model = fit_risk(rows.filter("part = 'train'"), columns)
        parts.append(risk_scores(model, rows.filter("part = 'test'")).select("fold", "symbol", "ts", "risk_label", "risk_probability"))
    return reduce(DataFrame.unionByName, parts)


def regime_weights(scored: DataFrame, least: int = 20) -> DataFrame:
    """Weight per model over everything (regime NULL) and per regime with ``least`` rows of two classes or more."""
    c = F.col
    whole = ml.performance_weight(ml.class_metrics(scored, ["model"])).select("model", F.lit(None).cast("string").alias("regime"), "samples", "weight")
    classes = scored.groupBy("model", "regime").agg(F.count_distinct("label").alias("_k"))
    split = ml.performance_weight(ml.class_metrics(scored, ["model", "regime"])).join(classes, ["model", "regime"]).filter((c("_k") >= 2) & (c("samples") >= least))
    return whole.unionByName(split.select("model", "regime", "samples", "weight"))


def train_version(frames: dict[str, DataFrame], columns: list[str], root: str, version: str, models: tuple[str, ...] = ("LogisticRegression", "RandomForest")) -> None:
    """Fit, calibrate, weigh and save one version; ``frames`` holds labelled rows per horizon.

    Rows need symbol, ts, target_time, future_return, future_max_drawdown, atr_normalized, volatility, ma20_gap and the
    columns.  Each series is cut into purged train, calibration, validation and test parts; weights see validation only.
    The manifest is written last: a version without one does not exist for ``predict_latest``, so a run that breaks off
    changes nothing and may be repeated.  A version with a manifest is never written again.
    """
    spark = next(iter(frames.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{version}/manifest/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"version {version} exists")
    manifest, levels = [], []
    for horizon, frame in frames.items():
        parts = ml.purged_slices(frame.dropna(subset=[*columns, "future_return", "target_time"])).withColumn("fold", F.lit(1))
        rows = cut(ml.fold_labels(parts))
        train, held, valid = (rows.filter(F.col("part") == p) for p in ("train", "calibration", "validation"))
        size = train.count()
        levels.append(train.groupBy("symbol").agg(F.percentile("volatility", F.lit(0.75)).alias("vol_cut")).withColumn("horizon", F.lit(horizon)))
        valid = regime_labels(valid, train)
        scored, fitted = [], {}
        for name in models:
            model = ml.fit_classifier(name, train, columns, size)
            adjust = ml.calibrate(cut(model(held).select("label", *PROBABILITIES)))
            model.model.write().overwrite().save(f"{root}/{version}/{horizon}/{name}")
            fitted[name] = adjust.fitted
            scored.append(ml.call(adjust(model(valid))).select(F.lit(name).alias("model"), "regime", "label", "called", *PROBABILITIES))
        fit_risk(train, columns).write().overwrite().save(f"{root}/{version}/{horizon}/risk")
        for w in regime_weights(cut(reduce(DataFrame.unionByName, scored))).collect():
            manifest.append((horizon, w.model, w.regime, w.weight, [x[1] for x in fitted[w.model]], [x[2] for x in fitted[w.model]]))
    reduce(DataFrame.unionByName, levels).write.mode("overwrite").parquet(f"{root}/{version}/levels")
    told = spark.createDataFrame(manifest, "horizon string, model string, regime string, weight double, slopes array<double>, offsets array<double>")
    told.write.mode("overwrite").parquet(f"{root}/{version}/manifest")


def latest_complete(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row of each series that has all features."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return frame.dropna(subset=columns).withColumn("_r", last).filter("_r = 1").drop("_r")


def predict_latest(spark: SparkSession, root: str, version: str, latest: DataFrame) -> DataFrame:
    """One row per series and horizon from the saved models alone: calibrated, weighted probabilities, consensus and risk.

    A model counts with its weight of the row's regime, or with its whole weight where that regime has none; series that
    the version never saw fall under no volatility cut and keep the trend regimes.
    """
    c = F.col
    manifest = spark.read.parquet(f"{root}/{version}/manifest")
    levels = spark.read.parquet(f"{root}/{version}/levels")
    kept = ["symbol", "ts"]
    parts = []
    told = {(m.horizon, m.model): m for m in manifest.filter("regime is null").collect()}
    for horizon in sorted({h for h, _ in told}):
        rows = latest.join(levels.filter(c("horizon") == horizon).drop("horizon"), "symbol", "left")
        gap = c("ma20_gap")
        rows = cut(risk_scores(PipelineModel.load(f"{root}/{version}/{horizon}/risk"), rows.withColumn(
            "regime", F.when(c("volatility") >= c("vol_cut"), "HIGH_VOL").when(gap > 0.005, "BULL").when(gap < -0.005, "BEAR").otherwise("SIDEWAYS"))))
        for (h, name), m in told.items():
            if h != horizon:
                continue
            raw = PipelineModel.load(f"{root}/{version}/{horizon}/{name}").transform(rows).withColumn("_v", vector_to_array("probability")).drop(*SCRATCH)
            p = [F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) for i in range(3)]
            fixed = [F.lit(b) if a is None else 1 / (1 + F.exp(-(p[i] * a + b))) for i, (a, b) in enumerate(zip(m.slopes, m.offsets, strict=True))]
            total = F.greatest(fixed[0] + fixed[1] + fixed[2], F.lit(1e-12))
            parts.append(ml.call(raw.select(*kept, "regime", "risk_probability", F.lit(horizon).alias("horizon"), F.lit(name).alias("model"), *[(x / total).alias(n) for x, n in zip(fixed, PROBABILITIES, strict=True)])))
    scored = reduce(DataFrame.unionByName, parts)
    whole = manifest.filter("regime is null").select("horizon", "model", c("weight").alias("_whole"))
    split = manifest.filter("regime is not null").select("horizon", "model", "regime", c("weight").alias("_split"))
    scored = scored.join(F.broadcast(whole), ["horizon", "model"]).join(F.broadcast(split), ["horizon", "model", "regime"], "left").withColumn("weight", F.coalesce("_split", "_whole"))
    out = scored.groupBy(*kept, "horizon", "regime", "risk_probability").agg(
        *[(F.sum(c("weight") * c(n)) / F.sum("weight")).alias(n) for n in PROBABILITIES], F.count(F.lit(1)).alias("models"), *[F.sum((c("called") == k).cast("int")).alias(f"_v{k + 1}") for k in ml.CLASSES])
    return ml.call(out).withColumn("consensus", F.greatest("_v0", "_v1", "_v2") / c("models")).drop("_v0", "_v1", "_v2")


def newest_runs(runs: DataFrame, count: int = 50) -> DataFrame:
    """The newest runs of the registry, equal stamps by run_id, newest first."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(count)
