"""Datasets, folds, training, calibration and evaluation with Spark MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks
from tapeline.functions.series import corr, ratio
from tapeline.session import cut, table_cut

CLASSES = (-1, 0, 1)


# --- splits -------------------------------------------------------------------


def sessions(panel: DataFrame) -> DataFrame:
    """Distinct sessions with their place; calendar-bounded, so one ordered window is fine."""
    days = panel.select("session_date").distinct()
    return days.withColumn("place", (F.row_number().over(Window.orderBy("session_date")) - 1).cast("long"))


def fold_plan(count: int, sessions_total: int, start_share: float = 0.5, least_start: int = 100, least_chunk: int = 15, least_sessions: int = 180) -> list[dict]:
    """Expanding windows over session places: train, then the last 15 % as validation, then the test chunk."""
    if sessions_total < least_sessions:
        raise ValueError(f"{least_sessions} sessions needed, {sessions_total} found")
    start = max(least_start, int(sessions_total * start_share))
    chunk = max(least_chunk, (sessions_total - start) // count)
    plan = []
    for begin in range(start, sessions_total, chunk):
        size = max(20, int(begin * 0.15))
        plan.append({"fold": len(plan) + 1, "train_end": begin - size, "validation_end": begin, "test_end": min(sessions_total, begin + chunk)})
        if len(plan) == count:
            return plan
    raise ValueError("too few sessions for the folds asked for")


def mark_fold(placed: DataFrame, fold: dict) -> DataFrame:
    """Tag rows train/validation/test and purge those whose label reaches into the next part.

    Needs place, ts and target_time; rows of no part are dropped.
    """
    c = F.col
    part = (F.when(c("place") < fold["train_end"], "train").when(c("place") < fold["validation_end"], "validation").when(c("place") < fold["test_end"], "test"))
    df = placed.withColumn("part", part).filter("part is not null")
    starts = df.agg(F.min(F.when(c("part") == "validation", c("ts"))).alias("_v"), F.min(F.when(c("part") == "test", c("ts"))).alias("_t"))
    df = df.crossJoin(F.broadcast(starts))
    keep = (c("part") == "test") | ((c("part") == "train") & (c("target_time") < c("_v"))) | ((c("part") == "validation") & (c("target_time") < c("_t")))
    return df.filter(keep).drop("_v", "_t").withColumn("fold", F.lit(fold["fold"]))


def fold_table(panel: DataFrame, count: int = 5, **kw) -> DataFrame:
    """Sizes and spans of every fold's parts after purging."""
    placed = panel.join(F.broadcast(sessions(panel)), "session_date")
    total = placed.agg(F.max("place") + 1).first()[0]
    out = None
    for fold in fold_plan(count, total, **kw):
        part = mark_fold(placed, fold).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


def purged_slices(rows: DataFrame, fractions: tuple = (0.56, 0.70, 0.84), embargo: int = 1, key: str = "symbol") -> DataFrame:
    """Chronological train/calibration/validation/test per series, each purged of labels that reach the next."""
    c = F.col
    w = Window.partitionBy(key).orderBy("ts")
    df = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    cuts = [F.floor(c("_n") * f) for f in fractions]
    names = ("train", "calibration", "validation", "test")
    part = F.when(c("_i") < cuts[0], names[0]).when(c("_i") < cuts[1], names[1]).when(c("_i") < cuts[2], names[2]).otherwise(names[3])
    df = df.withColumn("part", part).withColumn("_edge", F.when(c("_i") < cuts[0], cuts[0]).when(c("_i") < cuts[1], cuts[1]).when(c("_i") < cuts[2], cuts[2]))
    starts = [F.max(F.when(c("_i") == x, c("ts"))).over(Window.partitionBy(key)) for x in cuts]
    df = df.withColumn("_start", F.when(c("part") == "train", starts[0]).when(c("part") == "calibration", starts[1]).when(c("part") == "validation", starts[2]))
    # The boundary is one past the last row whose label ends in time, and at least the embargo before the next part.
    safe = F.max(F.when(c("target_time") < c("_start"), c("_i"))).over(Window.partitionBy(key, "part"))
    keep = (c("part") == "test") | ((c("_i") <= c("_safe")) & (c("_i") < c("_edge") - max(1, embargo)))
    return df.withColumn("_safe", safe).filter(keep).drop("_i", "_n", "_edge", "_start", "_safe")


def fold_labels(marked: DataFrame) -> DataFrame:
    """Direction and risk labels with thresholds from the train part alone."""
    c = F.col
    train = table_cut(marked.filter("part = 'train'").select("fold", "atr_normalized", "future_max_drawdown"))
    cuts = marked.select("fold").distinct().join(ranks.quantiles(train, ["fold"], "atr_normalized", {"_m": 0.5}), "fold", "left")
    cuts = cuts.join(ranks.quantiles(train, ["fold"], "future_max_drawdown", {"_q": 0.2}), "fold", "left").select("fold", F.least(F.lit(0.025), F.greatest(F.lit(0.001), c("_m") * 0.5)).alias("threshold"), F.least(F.lit(-0.01), c("_q")).alias("risk_threshold"))
    r = c("future_return")
    return marked.join(F.broadcast(cuts), "fold").withColumns({
        "label": F.when(r > c("threshold"), 1).when(r < -c("threshold"), -1).otherwise(0), "risk_label": (c("future_max_drawdown") <= c("risk_threshold")).cast("double")})


# --- models -------------------------------------------------------------------


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Weight rows so that classes count equally: n / (classes * n_class)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    total = counts.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("weight"))
    return train.join(F.broadcast(weights), label)


def _stages(columns: list[str], estimator):
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True), estimator])


def classifier(name: str, columns: list[str], rows: int, seed: int = 42, trees: int = 160, depth: int = 7):
    """Pipelines by name; the strength of the logistic penalty follows 1/(C*n)."""
    common = {"labelCol": "target", "featuresCol": "features"}
    if name == "LogisticRegression":
        return _stages(columns, LogisticRegression(**common, weightCol="weight", family="multinomial", regParam=1 / (0.75 * max(rows, 1)), maxIter=60, standardization=False))
    if name == "RandomForest":
        return _stages(columns, RandomForestClassifier(**common, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed))
    raise ValueError(f"unknown classifier {name}")


def fit_classifier(name: str, train: DataFrame, columns: list[str], rows: int):
    """Fitted model as a function df -> df with prob_down, prob_flat, prob_up."""
    train = balanced_weights(train.withColumn("target", (F.col("label") + 1).cast("double")), "target")
    if name == "BoostedTrees":
        # One booster per class, shares normalised: the multi-class wrapper exposes no probability.
        models = []
        for k in CLASSES:
            estimator = GBTClassifier(labelCol="_one", featuresCol="features", maxIter=15, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42)
            models.append(_stages(columns, estimator).fit(train.withColumn("_one", (F.col("label") == k).cast("double"))))

        def boosted(df: DataFrame) -> DataFrame:
            for i, model in enumerate(models):
                df = model.transform(df).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")
            total = F.greatest(F.col("_p0") + F.col("_p1") + F.col("_p2"), F.lit(1e-12))
            return df.withColumns({n: F.col(f"_p{i}") / total for i, n in enumerate(("prob_down", "prob_flat", "prob_up"))}).drop("_p0", "_p1", "_p2")

        return boosted
    model = classifier(name, columns, rows).fit(train)

    def plain(df: DataFrame) -> DataFrame:
        df = model.transform(df).withColumn("_v", vector_to_array("probability"))
        return df.withColumns({n: F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) for i, n in enumerate(("prob_down", "prob_flat", "prob_up"))}).drop("_v", "_raw", "features", "rawPrediction", "probability", "prediction")

    plain.model = model
    return plain


def calibrate(calibration: DataFrame):
    """Platt scaling per class on a held-out part; a class without both outcomes keeps its share."""
    fitted = []
    total = calibration.count()
    shares = calibration.agg(*[F.avg((F.col("label") == k).cast("double")).alias(f"s{i}") for i, k in enumerate(CLASSES)]).first()
    for i, (k, name) in enumerate(zip(CLASSES, ("prob_down", "prob_flat", "prob_up"))):
        share = shares[i] or 0.0
        if share in (0.0, 1.0):
            fitted.append((name, None, share))
            continue
        pipe = Pipeline(stages=[VectorAssembler(inputCols=[name], outputCol="features"), LogisticRegression(labelCol="_one", featuresCol="features", regParam=1 / max(1, total), maxIter=50, standardization=False)])
        lr = pipe.fit(calibration.withColumn("_one", (F.col("label") == k).cast("double"))).stages[-1]
        fitted.append((name, float(lr.coefficients[0]), float(lr.intercept)))

    def apply(df: DataFrame) -> DataFrame:
        raw = {name: (F.lit(b) if a is None else 1 / (1 + F.exp(-(F.col(name) * a + b)))) for name, a, b in fitted}
        df = df.withColumns({f"_{n}": v for n, v in raw.items()})
        total = F.greatest(F.col("_prob_down") + F.col("_prob_flat") + F.col("_prob_up"), F.lit(1e-12))
        return df.withColumns({n: F.col(f"_{n}") / total for n in raw}).drop(*[f"_{n}" for n in raw])

    apply.fitted = fitted
    return apply


def fit_regressor(name: str, train: DataFrame, columns: list[str], target: str, rows: int):
    """LinearRegression, Ridge, Lasso, RandomForest or BoostedTrees on standardised inputs; df -> df with predicted."""
    common = {"labelCol": target, "featuresCol": "features", "predictionCol": "predicted"}
    made = {"LinearRegression": lambda: LinearRegression(**common, standardization=False), "Ridge": lambda: LinearRegression(**common, regParam=5.0 / max(rows, 1), elasticNetParam=0.0, standardization=False),
            "Lasso": lambda: LinearRegression(**common, regParam=0.0002, elasticNetParam=1.0, standardization=False),
            "RandomForest": lambda: RandomForestRegressor(**common, numTrees=40, maxDepth=5, minInstancesPerNode=5, seed=42),
            "BoostedTrees": lambda: GBTRegressor(**common, maxIter=15, maxDepth=3, stepSize=0.1, seed=42)}
    model = _stages(columns, made[name]()).fit(train)
    return lambda df: model.transform(df).drop("_raw", "features")


# --- evaluation ---------------------------------------------------------------


def call(df: DataFrame) -> DataFrame:
    """Predicted class: the likeliest, the lower class on a tie."""
    top = F.greatest("prob_down", "prob_flat", "prob_up")
    return df.withColumn("called", F.when(F.col("prob_down") == top, -1).when(F.col("prob_flat") == top, 0).otherwise(1))


def class_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro scores, MCC, Brier and log loss by ``keys``; one aggregation."""
    c = F.col
    aggs = {"samples": F.count(F.lit(1)), "accuracy": F.avg((c("called") == c("label")).cast("double"))}
    brier = F.lit(0.0)
    mine = F.when(c("label") == -1, c("prob_down")).when(c("label") == 0, c("prob_flat")).otherwise(c("prob_up"))
    for i, (k, p) in enumerate(zip(CLASSES, ("prob_down", "prob_flat", "prob_up"))):
        brier = brier + F.pow(c(p) - (c("label") == k).cast("double"), 2)
        aggs[f"_t{i}"] = F.sum(((c("called") == k) & (c("label") == k)).cast("double"))
        aggs[f"_c{i}"] = F.sum((c("called") == k).cast("double"))
        aggs[f"_l{i}"] = F.sum((c("label") == k).cast("double"))
    aggs["brier"] = F.avg(brier)
    aggs["log_loss"] = -F.avg(F.ln(F.least(F.lit(1.0), F.greatest(mine, F.lit(1e-12)))))
    aggs["ic"] = corr(c("prob_up") - c("prob_down"), c("future_return")) if "future_return" in df.columns else F.lit(None).cast("double")
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    recall = [ratio(c(f"_t{i}"), c(f"_l{i}")) for i in range(3)]
    seen = sum((r.isNotNull().cast("int") for r in recall[1:]), recall[0].isNotNull().cast("int"))
    total = sum((F.coalesce(r, F.lit(0.0)) for r in recall[1:]), F.coalesce(recall[0], F.lit(0.0)))
    f1 = [F.coalesce(2 * c(f"_t{i}") / F.when(c(f"_c{i}") + c(f"_l{i}") > 0, c(f"_c{i}") + c(f"_l{i}")), F.lit(0.0)) for i in range(3)]
    present = [((c(f"_c{i}") + c(f"_l{i}")) > 0).cast("int") for i in range(3)]
    n, right = c("samples").cast("double"), c("_t0") + c("_t1") + c("_t2")
    cross = c("_c0") * c("_l0") + c("_c1") * c("_l1") + c("_c2") * c("_l2")
    spread = lambda t: n * n - (c(f"{t}0") * c(f"{t}0") + c(f"{t}1") * c(f"{t}1") + c(f"{t}2") * c(f"{t}2"))
    mcc = F.coalesce((right * n - cross) / F.when(spread("_c") * spread("_l") > 0, F.sqrt(spread("_c") * spread("_l"))), F.lit(0.0))
    out = out.withColumns({"balanced_accuracy": total / seen, "macro_f1": (f1[0] + f1[1] + f1[2]) / (present[0] + present[1] + present[2]), "mcc": mcc})
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def rank_ic(df: DataFrame, score: str, outcome: str, group: list[str]) -> DataFrame:
    """Correlation of average ranks within ``group`` (a session or fold); needs three rows and spread in both.

    Ranks come from range partitions with offsets, so a group may hold any number of rows.
    """
    c = F.col
    known_rows = df.select(*group, score, outcome).filter(c(score).isNotNull() & c(outcome).isNotNull() & ~F.isnan(c(score).cast("double")) & ~F.isnan(c(outcome).cast("double")))
    known_rows = table_cut(known_rows)  # read five times
    both = ranks.average_ranks(ranks.average_ranks(known_rows, group, score, f"_rank_{score}"), group, outcome, f"_rank_{outcome}")
    out = both.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), corr(score, outcome).alias("ic"), corr(f"_rank_{score}", f"_rank_{outcome}").alias("rank_ic"))
    known = lambda x: F.when((c("rows") >= 3) & ~F.isnan(x), c(x))
    return out.withColumns({"ic": known("ic"), "rank_ic": known("rank_ic")})


def auc_ovr(df: DataFrame, keys: list[str]) -> DataFrame:
    """One-versus-rest area under the curve, averaged over classes, from rank sums."""
    c = F.col
    long = df.select(*keys, "label", F.inline(F.array(*[F.struct(F.lit(k).alias("cls"), c(p).alias("p")) for k, p in zip(CLASSES, ("prob_down", "prob_flat", "prob_up"))])))
    tally = ranks.ranked_values(long, [*keys, "cls"], "p", F.sum((c("label") == c("cls")).cast("double")).alias("_pos"))
    per = tally.groupBy(*keys, "cls").agg(F.sum(c("rank") * c("_pos")).alias("_s"), F.sum("_pos").alias("_p"), F.sum("n").alias("_n"))
    auc = (c("_s") - c("_p") * (c("_p") + 1) / 2) / F.when(c("_p") * (c("_n") - c("_p")) > 0, c("_p") * (c("_n") - c("_p")))
    return per.withColumn("_auc", auc).groupBy(*keys).agg(F.when(F.count("_auc") == 3, F.avg("_auc")).alias("auc_ovr"))


def reliability(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ten confidence bins and the calibration error they add up to."""
    c = F.col
    df = df.withColumns({"_c": F.greatest("prob_down", "prob_flat", "prob_up"), "_k": (c("called") == c("label")).cast("double")})
    bins = df.groupBy(*keys, F.least(F.lit(9), F.floor(c("_c") * 10)).alias("bin")).agg(F.count(F.lit(1)).alias("samples"), F.avg("_c").alias("predicted"), F.avg("_k").alias("observed"))
    w = Window.partitionBy(*keys)
    return bins.withColumn("ece", F.sum(c("samples") * F.abs(c("predicted") - c("observed"))).over(w) / F.sum("samples").over(w))


def performance_weight(metrics: DataFrame) -> DataFrame:
    c = F.col
    skill = (c("accuracy") + c("macro_f1")) / 2
    return metrics.withColumn("weight", F.greatest(F.lit(0.01), skill * F.greatest(F.lit(0.05), 1 - c("brier")) * F.greatest(F.lit(0.05), 1 - c("log_loss") / 2.5)))


def ensemble(predictions: DataFrame, weights: DataFrame, row: list[str]) -> DataFrame:
    """Weighted mean of the models' probabilities per row, with consensus, margin and disagreement."""
    c = F.col
    df = predictions.join(F.broadcast(weights.select("model", "weight")), "model")
    names = ("prob_down", "prob_flat", "prob_up")
    out = df.groupBy(*row).agg(*[(F.sum(c("weight") * c(n)) / F.sum("weight")).alias(n) for n in names], F.count(F.lit(1)).alias("models"),
                               *[F.sum((c("called") == k).cast("int")).alias(f"_v{i}") for i, k in enumerate(CLASSES)])
    top = F.greatest(*names)
    second = F.element_at(F.sort_array(F.array(*names)), 2)
    votes = F.greatest("_v0", "_v1", "_v2")
    return call(out).withColumns({"consensus": votes / c("models"), "margin": top - second, "disagree": votes < c("models")}).drop("_v0", "_v1", "_v2")


def stability(values: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, spread, information ratio, worst and share of positive windows."""
    c = F.col
    df = values.filter(c(value).isNotNull() & ~F.isnan(value))
    out = df.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
                              F.min(value).alias("worst"), F.avg((c(value) > 0).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("windows"))
    return out.withColumn("icir", ratio(c("mean"), c("std")))


def baselines(df: DataFrame, majority: DataFrame) -> DataFrame:
    """Rows of the naive forecasters: majority class, even odds, last five bars' sign.

    ``df`` needs fold, label, return_5; ``majority`` holds (fold, majority).
    """
    c = F.col
    df = df.join(F.broadcast(majority), "fold")
    spread = lambda name, pick, hit, rest: df.withColumns({"model": F.lit(name), "prob_down": F.when(pick == -1, hit).otherwise(rest), "prob_flat": F.when(pick == 0, hit).otherwise(rest),
                                                           "prob_up": F.when(pick == 1, hit).otherwise(rest)})
    momentum = F.signum("return_5").cast("int")
    out = spread("MajorityClass", c("majority"), 0.95, 0.025).unionByName(spread("NaiveMomentum", momentum, 0.7, 0.15))
    third = F.lit(1 / 3)
    return call(out.unionByName(df.withColumns({"model": F.lit("EvenOdds"), "prob_down": third, "prob_flat": third, "prob_up": third})))


def majority_class(train: DataFrame) -> DataFrame:
    counts = train.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("_k"))
    return counts.groupBy("fold").agg(F.max_by("label", F.struct("_k", (-F.col("label")).alias("_l"))).alias("majority"))


def train_majority(panel: DataFrame, columns: list[str], count: int = 3, **kw) -> DataFrame:
    """Majority class of each fold's train part, the only part a naive forecaster may know."""
    panel = complete(panel, columns)
    placed = panel.join(F.broadcast(sessions(panel)), "session_date")
    total = placed.agg(F.max("place") + 1).first()[0]
    out = None
    for fold in fold_plan(count, total, **kw):
        part = majority_class(fold_labels(mark_fold(placed, fold)).filter("part = 'train'"))
        out = part if out is None else out.unionByName(part)
    return out


def complete(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all features; every one of them is trained on or scored, an incomplete row later is an error."""
    return cut(panel.dropna(subset=columns))


def walk_forward(panel: DataFrame, columns: list[str], models: tuple[str, ...] = ("LogisticRegression", "RandomForest"), count: int = 3, **kw) -> DataFrame:
    """Out-of-sample probabilities of every model over expanding, purged folds, calibrated on each fold's validation part.

    The driver loops over folds and models only; every fit runs on all rows of its part in Spark.
    """
    panel = complete(panel, columns)
    placed = panel.join(F.broadcast(sessions(panel)), "session_date")
    total = placed.agg(F.max("place") + 1).first()[0]
    out = None
    for fold in fold_plan(count, total, **kw):
        rows = cut(fold_labels(mark_fold(placed, fold)))
        train, held, test = (rows.filter(F.col("part") == p) for p in ("train", "validation", "test"))
        size = train.count()
        for name in models:
            model = fit_classifier(name, train, columns, size)
            scored = call(calibrate(model(held))(model(test))).withColumn("model", F.lit(name))
            part = scored.select("fold", "model", "symbol", "session_date", "ts", "label", "called", "prob_down", "prob_flat", "prob_up", "future_return", "return_5")
            out = part if out is None else out.unionByName(part)
    return out


def regression_walk_forward(panel: DataFrame, columns: list[str], models: tuple[str, ...] = ("LinearRegression", "Ridge", "Lasso"), target: str = "alpha_target", count: int = 3, **kw) -> DataFrame:
    panel = complete(panel, columns)
    placed = panel.join(F.broadcast(sessions(panel)), "session_date")
    total = placed.agg(F.max("place") + 1).first()[0]
    out = None
    for fold in fold_plan(count, total, **kw):
        rows = cut(mark_fold(placed, fold))
        train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
        size = train.count()
        for name in models:
            scored = fit_regressor(name, train, columns, target, size)(test)
            part = scored.select("fold", F.lit(name).alias("model"), "symbol", "session_date", "ts", "predicted", target, "future_return")
            out = part if out is None else out.unionByName(part)
    return out


def research_returns(df: DataFrame, holding: int, cost: float) -> DataFrame:
    """Net return of non-overlapping entries where the call is confident; needs symbol, ts, prob_*, future_return."""
    c = F.col
    w = Window.partitionBy("symbol").orderBy("ts")
    df = df.withColumn("_i", F.row_number().over(w) - 1).filter(c("_i") % holding == 0)
    signal = c("prob_up") - c("prob_down")
    sure = F.greatest("prob_down", "prob_flat", "prob_up") >= 0.45
    df = df.withColumn("position", F.when(sure & (F.abs(signal) >= 0.08), F.signum(signal)).otherwise(0.0))
    df = df.withColumn("turnover", F.abs(c("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    return df.withColumns({"gross": c("position") * c("future_return")}).withColumn("net", c("gross") - c("turnover") * cost).drop("_i")


def buy_and_hold(bars: DataFrame, periods: int) -> DataFrame:
    c = F.col
    w = Window.partitionBy("symbol").orderBy("ts")
    df = bars.withColumns({"_r": ratio(c("close"), F.lag("close").over(w)) - 1, "_top": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("samples"), (ratio(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("net_return"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
                                   F.min(ratio(c("close"), c("_top")) - 1).alias("maximum_drawdown"))
    return out.select("symbol", "samples", "net_return", (ratio(c("_m"), c("_s")) * periods ** 0.5).alias("sharpe"), "maximum_drawdown")


def top_factors(importances: DataFrame, latest: DataFrame, history: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Most important features with the sign of the newest standardised value; ``importances``: feature, importance."""
    melted = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in columns])
    past = table_cut(history.select(F.inline(melted)))
    stats = ranks.quantiles(past, ["feature"], "value", {"_m": 0.5}).join(past.groupBy("feature").agg(F.stddev_samp("value").alias("_s")), "feature")
    long = latest.select("symbol", F.inline(melted)).join(F.broadcast(stats), "feature", "left").join(F.broadcast(importances), "feature")
    long = long.withColumn("z", F.coalesce(ratio(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("positive", F.col("z") >= 0)


def promote(challengers: DataFrame, champions: DataFrame) -> DataFrame:
    """Replace a champion only for accuracy +0.01 and F1 within 0.005; needs key, model, accuracy, f1."""
    c = F.col
    old = champions.select("key", c("model").alias("champion"), c("accuracy").alias("_a"), c("f1").alias("_f"))
    joined = challengers.join(old, "key", "left")
    better = c("champion").isNull() | ((c("accuracy") >= c("_a") + 0.01) & (c("f1") >= c("_f") - 0.005))
    return joined.withColumns({"promoted": better, "serving": F.when(better, c("model")).otherwise(c("champion"))}).drop("_a", "_f")


def registry_versions(runs: DataFrame) -> DataFrame:
    """Version numbers per (market, horizon, model) and the newest run per market."""
    w = Window.partitionBy("market", "horizon", "model").orderBy("created_at", "run_id")
    newest = F.max(F.struct("created_at", "run_id")).over(Window.partitionBy("market"))
    return runs.withColumns({"version": F.row_number().over(w), "latest": F.struct("created_at", "run_id") == newest})


def drift(resolved: DataFrame, now) -> DataFrame:
    """Accuracy and calibration over 30, 90 and 180 days; a drop above 0.05 is drift once history suffices."""
    c = F.col
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")) / 86400e6
    sure = F.greatest("prob_down", "prob_flat", "prob_up")
    df = resolved.withColumns({"_age": age, "_ok": c("correct").cast("double"), "_gap": F.abs(sure - c("correct").cast("double"))})
    out = df.groupBy("symbol").agg(
        *[x.alias(f"{n}_{d}") for d in (30, 90, 180) for n, x in (("accuracy", F.avg(F.when(c("_age") <= d, c("_ok")))), ("gap", F.avg(F.when(c("_age") <= d, c("_gap")))), ("samples", F.count(F.when(c("_age") <= d, 1))))],
        (F.max("_age") - F.min("_age")).alias("coverage_days"))
    enough = c("coverage_days") >= 170
    fell = enough & (c("samples_30") >= 20) & (c("samples_180") >= 40) & (c("accuracy_30") < c("accuracy_180") - 0.05)
    return out.withColumns({
        "status": F.when(fell, "MODEL_DRIFT").when(~enough, "INSUFFICIENT_TIME_COVERAGE").when(c("samples_30") < 20, "INSUFFICIENT_DATA").otherwise("NO_DRIFT_DETECTED"),
        "action": F.when(fell, "DOWNGRADE_TO_EXPERIMENTAL").otherwise("KEEP_EXPERIMENTAL")})


def confidence_grade(df: DataFrame) -> DataFrame:
    """Score, grade and reasons for doubt.

    Needs walk_accuracy, samples, completeness, coverage, consensus, brier, factor, margin, advantage and baseline.
    """
    c = F.col
    score = F.bround(100 * (0.25 * c("walk_accuracy") + 0.15 * F.least(F.lit(1.0), c("samples") / 5000) + 0.2 * c("completeness") + 0.15 * c("coverage")
                            + 0.15 * c("consensus") + 0.1 * F.greatest(F.lit(0.0), 1 - c("brier"))) * c("factor"))
    doubts = F.filter(F.array(F.when(c("consensus") < 0.6, "MODEL_DISAGREEMENT"), F.when(c("margin") < 0.08, "PROBABILITY_MARGIN_TOO_SMALL"), F.when(c("completeness") < 0.8, "DATA_QUALITY"),
                              F.when(c("samples") < 300, "LIMITED_SAMPLE"), F.when((c("advantage") < 0.03) | (c("walk_accuracy") <= c("baseline")), "NO_VALIDATED_BASELINE_EDGE")),
                      lambda x: x.isNotNull())
    df = df.withColumns({"confidence_score": score, "doubts": doubts})
    return df.withColumns({"grade": F.when(c("confidence_score") >= 85, "A").when(c("confidence_score") >= 70, "B").when(c("confidence_score") >= 55, "C").otherwise("D"), "clear_edge": F.size("doubts") == 0})
