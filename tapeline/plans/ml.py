"""Model research queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeline.functions.series import ratio
from tapeline.operators import features as feat, gram, indicators as ind, ledger as ld, ml, scoring
from tapeline.plans.bars import q
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, W, daily, hourly, r, show, table
from tapeline.plans.features import PANEL_CTES, X, zsql
from tapeline.plans.ledger import RES, _predictions
from tapeline.schema import FEATURE_GROUPS
from tapeline.session import cut, scratch, table_cut

COLUMNS = ["z_return_1", "z_return_5", "z_return_20", "z_high_position_20", "z_volume_zscore", "z_flow_pressure"]
FOLDS = 5


def _panel(spark, d):
    bars = ind.volume_set(ind.atr_sma(daily(spark, d)))
    frame = feat.volume_features(feat.price_features(bars)).withColumn("atr_normalized", F.col("atr") / F.col("close"))
    return feat.panel(frame, 5, ["return_1", "return_5", "return_20", "high_position_20", "volume_zscore", "flow_pressure"]).select(
        "symbol", "ts", "session_date", "target_time", "future_return", "future_max_drawdown", "alpha_target", "return_5", "atr_normalized", *COLUMNS)


def _scored(spark, d):
    """The resolved ledger as a scored test set."""
    bars = hourly(spark, d)
    c = F.col
    num = lambda x: F.when(c(x) == "UP", 1).when(c(x) == "DOWN", -1).otherwise(0)
    return ld.resolve(_predictions(bars), bars).select("id", "symbol", "horizon", "prediction_time", num("actual").alias("label"), num("prediction").alias("called"), "prob_down", "prob_flat", "prob_up",
                                                       c("actual_return").alias("future_return"), "correct", "regime")


def ml_purged_slices(spark, d):
    rows = feat.future_path(hourly(spark, d), 4).filter("target_time is not null").select("symbol", "ts", "target_time")
    return ml.purged_slices(rows, embargo=4).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("target_time").alias("last_label"))


def ml_fold_table(spark, d):
    return ml.fold_table(_panel(spark, d), 5)


def ml_class_metrics(spark, d):
    return show(ml.class_metrics(_scored(spark, d), ["symbol"]), "symbol", "samples", "accuracy", "balanced_accuracy", "macro_f1", "mcc", "brier", "log_loss", "ic")


def ml_auc(spark, d):
    df = _scored(spark, d)
    df = df.withColumns({p: F.round(p, 9) for p in ("prob_down", "prob_flat", "prob_up")})
    return show(ml.auc_ovr(df, ["symbol"]), "symbol", "auc_ovr")


def ml_reliability(spark, d):
    return show(ml.reliability(_scored(spark, d), ["symbol"]), "symbol", "bin", "samples", "predicted", "observed", "ece")


def ml_rank_ic(spark, d):
    bars = feat.future_path(ind.returns(daily(spark, d), (5,)), 5).filter("return_5 is not null and future_return is not null")
    df = bars.select(F.to_date("ts").alias("session_date"), F.round("return_5", 3).alias("score"), F.round("future_return", 3).alias("outcome"))
    return show(ml.rank_ic(df, "score", "outcome", ["session_date"]), "session_date", "rows", "ic", "rank_ic")


def ml_ic_stability(spark, d):
    bars = feat.future_path(ind.returns(daily(spark, d), (5,)), 5).filter("return_5 is not null and future_return is not null")
    df = bars.select(F.to_date("ts").alias("session_date"), F.round("return_5", 3).alias("score"), F.round("future_return", 3).alias("outcome"))
    ics = ml.rank_ic(df, "score", "outcome", ["session_date"]).withColumns({"year": F.year("session_date").cast("long"), "rank_ic": F.round("rank_ic", 9)})
    return show(ml.stability(ics, "year", "rank_ic"), "year", "mean", "median", "std", "worst", "positive_share", "windows", "icir")


def ml_drift(spark, d):
    df = _scored(spark, d).withColumn("ts", F.col("prediction_time"))
    return show(ml.drift(df, "2024-02-01 00:00:00"), "symbol", "samples_30", "accuracy_30", "gap_30", "coverage_days", "status", "action")


def ml_confidence(spark, d):
    c = F.col
    m = ml.class_metrics(_scored(spark, d), ["symbol", "horizon"])
    df = m.select("symbol", "horizon", c("accuracy").alias("walk_accuracy"), (c("samples") * 9).alias("samples"), F.lit(0.97).alias("completeness"), F.lit(0.8).alias("coverage"), c("balanced_accuracy").alias("consensus"),
                  "brier", F.lit(0.9).alias("factor"), F.abs("mcc").alias("margin"), (c("accuracy") - 0.4).alias("advantage"), F.lit(0.4).alias("baseline"))
    out = ml.confidence_grade(df)
    return show(out.withColumn("doubts", F.array_join("doubts", "|")), "symbol", "horizon", "confidence_score", "grade", "doubts", "clear_edge")


def ml_ensemble(spark, d):
    base = _scored(spark, d)
    models = base.withColumn("model", F.lit("a")).unionByName(ml.call(base.withColumns({"prob_up": F.col("prob_down"), "prob_down": F.col("prob_up")})).withColumn("model", F.lit("b")))
    weights = ml.performance_weight(ml.class_metrics(models, ["model"]))
    return show(ml.ensemble(models, weights, ["id"]), "id", "prob_down", "prob_flat", "prob_up", "called", "models", "consensus", "margin", "disagree")


def ml_research_returns(spark, d):
    df = _scored(spark, d).withColumn("ts", F.col("prediction_time"))
    return show(ml.research_returns(df, 3, 0.001), "symbol", "ts", "position", "turnover", "gross", "net")


def ml_buy_and_hold(spark, d):
    return show(ml.buy_and_hold(hourly(spark, d), 8760), "symbol", "samples", "net_return", "sharpe", "maximum_drawdown")


def ml_promotion(spark, d):
    m = ml.class_metrics(_scored(spark, d), ["symbol", "horizon"]).select(F.col("symbol").alias("key"), F.col("horizon").alias("model"), "accuracy", F.col("macro_f1").alias("f1"))
    return show(ml.promote(m.filter("model <> '1H'"), m.filter("model = '1H' and key <> 'view'")), "key", "model", "champion", "promoted", "serving")


def ml_registry(spark, d):
    c = F.col
    bars = hourly(spark, d)
    said = _predictions(bars)
    runs = said.groupBy("market", "horizon", c("prediction").alias("model"), F.date_trunc("week", "prediction_time").alias("created_at")).agg(F.min("id").alias("run_id"))
    return ml.registry_versions(runs).select("market", "horizon", "model", "run_id", c("version").cast("long").alias("version"), "latest")


def ml_walk_forward(spark, d):
    out = ml.walk_forward(_panel(spark, d), COLUMNS, ("LogisticRegression",), FOLDS)
    return show(ml.class_metrics(out, ["model", "fold"]), "model", "fold", "samples", "accuracy", "balanced_accuracy", "macro_f1", "mcc", "brier", "log_loss")


def ml_risk(spark, d):
    return show(scoring.risk_metrics(scoring.risk_walk_forward(_panel(spark, d), COLUMNS, FOLDS), ["fold"]), "fold", "samples", "balanced_accuracy", "macro_f1", "mcc", "brier", "log_loss")


RAW = ["return_1", "return_5", "return_20", "high_position_20", "volume_zscore", "flow_pressure", "atr_normalized", "volatility", "ma20_gap"]


def _frame(spark, d):
    bars = ind.volume_set(ind.atr_sma(daily(spark, d)))
    frame = ind.volatility(feat.volume_features(feat.price_features(bars)))
    ma = F.avg("close").over(Window.partitionBy("symbol", "interval").orderBy("ts").rowsBetween(-19, 0))
    return cut(frame.withColumns({"atr_normalized": ratio(F.col("atr"), F.col("close")), "ma20_gap": ratio(F.col("close"), ma) - 1}))


def predict_latest(spark, d):
    """A version of three horizons is trained and saved, then every brand's newest complete bar is scored from the files."""
    frame, root = _frame(spark, d), scratch(spark)
    scoring.train_version({f"{n}D": feat.future_path(frame, n) for n in (1, 5, 20)}, RAW, root, "v1")
    out = scoring.predict_latest(spark, root, "v1", scoring.latest_complete(frame, RAW))
    return show(out, "symbol", "ts", "horizon", "regime", "prob_down", "prob_flat", "prob_up", "called", "consensus", "risk_probability")


def ml_registry_newest(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("market"), F.col("ts").alias("created_at"))
    return scoring.newest_runs(runs, 50)


def ml_tournament(spark, d):
    """Two learners and the naive forecasters, medians over folds. The panel is derived once for all of them."""
    panel = table_cut(_panel(spark, d))
    out = ml.cut(ml.walk_forward(panel, COLUMNS, ("LogisticRegression", "RandomForest"), FOLDS))
    first = out.filter("model = 'LogisticRegression'").drop("model", "prob_down", "prob_flat", "prob_up", "called")
    naive = ml.baselines(first, ml.train_majority(panel, COLUMNS, FOLDS)).select(out.columns)
    return show(ml.stability(ml.class_metrics(out.unionByName(naive), ["model", "fold"]), "model", "balanced_accuracy"), "model", "mean", "median", "worst", "windows")


def _whole_panel(spark, d):
    """Complete rows of all 57 features with labels over five sessions, fold marks added."""
    keep = ["symbol", "ts", "session_date", "target_time", "future_return", "alpha_target", *[f"z_{x}" for g in FEATURE_GROUPS.values() for x in g]]
    return table_cut(gram.mark_folds(table_cut(feat.panel(feat.features(daily(spark, d)), 5).select(*keep)), FOLDS))


Z_GROUPS = {name: [f"z_{x}" for x in group] for name, group in FEATURE_GROUPS.items()}
Z_ALL = [x for group in Z_GROUPS.values() for x in group]


def ml_regression(spark, d):
    """The three linear models over all features: one scan for all their fits."""
    marked = _whole_panel(spark, d)
    fits = gram.fold_models(marked, {"all_observed": Z_ALL}, gram.LINEAR, "alpha_target", FOLDS)
    out = table_cut(gram.scored_tests(marked, fits, Z_ALL, ["symbol", "ts", "alpha_target", "future_return"]))
    both = gram.regression_metrics(out, "alpha_target", ["model", "fold"]).drop("samples").join(ml.rank_ic(out, "predicted", "future_return", ["model", "fold"]), ["model", "fold"])
    return show(both.withColumn("fold", F.col("fold").cast("long")), "model", "fold", "rows", "mae", "rmse", "ic", "rank_ic")


def ml_ablation(spark, d):
    """Ridge on each of the five feature groups and on all of them, per fold."""
    marked = _whole_panel(spark, d)
    fits = gram.fold_models(marked, {**Z_GROUPS, "all_observed": Z_ALL}, {"Ridge": (gram.RIDGE, 0.0)}, "alpha_target", FOLDS)
    out = gram.scored_tests(marked, fits, Z_ALL, ["future_return"])
    return show(ml.rank_ic(out, "predicted", "future_return", ["group", "fold"]).withColumn("fold", F.col("fold").cast("long")), "group", "fold", "rows", "ic", "rank_ic")


PAIR = ["z_return_5", "z_volume_zscore"]


def ml_gram_ridge(spark, d):
    """Ridge on two features, beside its closed form in SQL."""
    c = F.col
    fits = gram.fold_models(gram.mark_folds(table_cut(_panel(spark, d).select("session_date", "ts", "target_time", "alpha_target", *PAIR)), FOLDS), {"pair": PAIR}, {"Ridge": (gram.RIDGE, 0.0)}, "alpha_target", FOLDS)
    return show(fits.select(c("fold").cast("long").alias("fold"), "samples", "intercept", c("coefficients")[0].alias("first"), c("coefficients")[1].alias("second")), "fold", "samples", "intercept", "first", "second", intercept=9, first=9, second=9)


SCO = [*RES, "m0 AS (SELECT *, CASE actual WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS label, CASE prediction WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS called FROM rs)"]


def _cm(keys: str, src: str = "m0") -> list[str]:
    n = {k: (f"count(*) FILTER (called = {k} AND label = {k})", f"count(*) FILTER (called = {k})", f"count(*) FILTER (label = {k})") for k in (-1, 0, 1)}
    t, cc, l = ([n[k][i] for k in (-1, 0, 1)] for i in range(3))
    cols = ", ".join(f"CAST({t[i]} AS DOUBLE) AS t{i}, CAST({cc[i]} AS DOUBLE) AS c{i}, CAST({l[i]} AS DOUBLE) AS l{i}" for i in range(3))
    return [f"""k0 AS (SELECT {keys}, count(*) AS samples, avg(CASE WHEN called = label THEN 1.0 ELSE 0 END) AS accuracy, {cols}, avg(pow(pd - CAST(label = -1 AS INT), 2) + pow(pf - CAST(label = 0 AS INT), 2) + pow(pu - CAST(label = 1 AS INT), 2)) AS brier,
  -avg(ln(greatest(CASE label WHEN -1 THEN pd WHEN 0 THEN pf ELSE pu END, 1e-12))) AS ll, corr(pu - pd, ar) AS ic FROM {src} GROUP BY {keys})""",
            """k1 AS (SELECT *, (coalesce(t0/nullif(l0,0),0) + coalesce(t1/nullif(l1,0),0) + coalesce(t2/nullif(l2,0),0)) / (CAST(l0>0 AS INT) + CAST(l1>0 AS INT) + CAST(l2>0 AS INT)) AS ba,
  (coalesce(2*t0/nullif(c0+l0,0),0) + coalesce(2*t1/nullif(c1+l1,0),0) + coalesce(2*t2/nullif(c2+l2,0),0)) / (CAST(c0+l0>0 AS INT) + CAST(c1+l1>0 AS INT) + CAST(c2+l2>0 AS INT)) AS f1,
  coalesce(((t0+t1+t2)*samples - (c0*l0+c1*l1+c2*l2)) / nullif(sqrt((samples*samples - (c0*c0+c1*c1+c2*c2)) * (samples*samples - (l0*l0+l1*l1+l2*l2))), 0), 0) AS mcc FROM k0)"""]


SLICES = q(HOURLY_SQL, f"f AS (SELECT symbol, ts, lead(ts, 4) {W} AS tt FROM c)", f"g AS (SELECT symbol, ts, tt, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE tt IS NOT NULL)",
           "e AS (SELECT *, CAST(floor(n * 0.56) AS BIGINT) AS a, CAST(floor(n * 0.70) AS BIGINT) AS b, CAST(floor(n * 0.84) AS BIGINT) AS d FROM g)",
           "p AS (SELECT *, CASE WHEN i < a THEN 'train' WHEN i < b THEN 'calibration' WHEN i < d THEN 'validation' ELSE 'test' END AS part, CASE WHEN i < a THEN a WHEN i < b THEN b WHEN i < d THEN d END AS edge FROM e)",
           "s AS (SELECT p.*, x.ts AS st FROM p LEFT JOIN p x ON p.symbol = x.symbol AND x.i = p.edge)", "u AS (SELECT *, max(CASE WHEN tt < st THEN i END) OVER (PARTITION BY symbol, part) AS safe FROM s)",
           final='SELECT symbol, part, count(*) AS rows, min(ts) AS "first", max(tt) AS last_label FROM u WHERE part = \'test\' OR (i <= safe AND i < edge - 4) GROUP BY 1, 2')
RIC = [DAILY_SQL, f"z AS (SELECT CAST(ts AS DATE) AS d, round(close / lag(close, 5) {W} - 1, 3) AS s, round(lead(close, 5) {W} / close - 1, 3) AS o FROM c)",
       "z1 AS (SELECT d, s, o, rank() OVER (PARTITION BY d ORDER BY s) + (count(*) OVER (PARTITION BY d, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY d ORDER BY o) + (count(*) OVER (PARTITION BY d, o) - 1) / 2.0 AS ro FROM z WHERE s IS NOT NULL AND o IS NOT NULL)",
       "z2 AS (SELECT d, count(*) AS n, corr(s, o) AS ic, round(corr(rs, ro), 9) AS ric FROM z1 GROUP BY 1)", "zz AS (SELECT d, n, CASE WHEN n >= 3 AND NOT isnan(ic) THEN ic END AS ic, CASE WHEN n >= 3 AND NOT isnan(ric) THEN ric END AS ric FROM z2)"]

FOLD_CTES = [*PANEL_CTES, f"pz AS (SELECT symbol, ts, session_date, target_time, {zsql('return_5')} AS x1, {zsql('volume_zscore')} AS x2, future_return - avg(future_return) {X} AS y FROM pb)",
             "dy AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS place, count(*) OVER () AS s FROM (SELECT DISTINCT session_date FROM pz))",
             "st AS (SELECT DISTINCT s, greatest(100, CAST(floor(CAST(s AS DOUBLE) * 0.5) AS BIGINT)) AS b0 FROM dy)",
             f"fd AS (SELECT i + 1 AS fold, b0 + i * greatest(15, (s - b0) // {FOLDS}) AS b, s, greatest(15, (s - b0) // {FOLDS}) AS k FROM st, range({FOLDS}) t(i))",
             "fo AS (SELECT fold, b - greatest(20, CAST(floor(b * CAST(0.15 AS DOUBLE)) AS BIGINT)) AS te, b AS ve, least(s, b + k) AS xe FROM fd WHERE b < s)",
             "fr AS (SELECT fo.fold, CASE WHEN place < te THEN 'train' WHEN place < ve THEN 'validation' ELSE 'test' END AS part, pz.* FROM pz JOIN dy USING (session_date) JOIN fo ON place < xe)",
             "fs AS (SELECT fold, min(ts) FILTER (part = 'validation') AS v, min(ts) FILTER (part = 'test') AS t FROM fr GROUP BY 1)",
             "fk AS (SELECT fr.* FROM fr JOIN fs USING (fold) WHERE part = 'test' OR (part = 'train' AND target_time < v) OR (part = 'validation' AND target_time < t))"]
RIDGE_CTES = [*FOLD_CTES, "m AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM fk WHERE part = 'train' GROUP BY 1)",
              f"w AS (SELECT *, ((1 + {gram.RIDGE} / n) * c1 - r * c2) / (pow(1 + {gram.RIDGE} / n, 2) - r * r) / s1 AS w1, ((1 + {gram.RIDGE} / n) * c2 - r * c1) / (pow(1 + {gram.RIDGE} / n, 2) - r * r) / s2 AS w2 FROM m)"]

QUERIES = {
    "ml_gram_ridge": (ml_gram_ridge, q(*RIDGE_CTES, final=f"SELECT fold, n AS samples, {R('my - w1 * m1 - w2 * m2', 9)} AS intercept, {R('w1', 9)} AS \"first\", {R('w2', 9)} AS second FROM w")),
    "ml_purged_slices": (ml_purged_slices, SLICES),
    "ml_fold_table": (ml_fold_table, q(*FOLD_CTES, final='SELECT CAST(fold AS INT) AS fold, part, count(*) AS rows, min(session_date) AS "first", max(session_date) AS "last" FROM fk GROUP BY 1, 2')),
    "ml_class_metrics": (ml_class_metrics, q(*SCO, *_cm("symbol"), final=f"SELECT symbol, samples, {R('accuracy')} AS accuracy, {R('ba')} AS balanced_accuracy, {R('f1')} AS macro_f1, {R('mcc')} AS mcc, {R('brier')} AS brier, {R('ll')} AS log_loss, {R('ic')} AS ic FROM k1")),
    "ml_auc": (ml_auc, q(*SCO, "lg AS (SELECT symbol, id, label = -1 AS y, round(pd, 9) AS p, -1 AS k FROM m0 UNION ALL SELECT symbol, id, label = 0, round(pf, 9), 0 FROM m0 UNION ALL SELECT symbol, id, label = 1, round(pu, 9), 1 FROM m0)",
                         "a AS (SELECT x.symbol, x.k, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0 END) AS auc FROM lg x JOIN lg z ON x.symbol = z.symbol AND x.k = z.k AND x.y AND NOT z.y GROUP BY 1, 2)",
                         final=f"SELECT symbol, {R('avg(auc)')} AS auc_ovr FROM a GROUP BY 1")),
    "ml_reliability": (ml_reliability, q(*SCO, "k AS (SELECT symbol, CAST(least(9, floor(greatest(pu, pd, pf) * 10)) AS BIGINT) AS bin, greatest(pu, pd, pf) AS cf, CAST(called = label AS INT) AS ok FROM m0)", "b AS (SELECT symbol, bin, count(*) AS samples, avg(cf) AS predicted, avg(ok) AS observed FROM k GROUP BY 1, 2)",
                                         final=f"SELECT symbol, bin, samples, {R('predicted')} AS predicted, {R('observed')} AS observed, {R('sum(samples * abs(predicted - observed)) OVER (PARTITION BY symbol) / sum(samples) OVER (PARTITION BY symbol)')} AS ece FROM b")),
    "ml_rank_ic": (ml_rank_ic, q(*RIC, final=f"SELECT d AS session_date, n AS rows, {R('ic')} AS ic, {R('ric')} AS rank_ic FROM zz")),
    "ml_ic_stability": (ml_ic_stability, q(*RIC, final=f"SELECT year(d) AS year, {R('avg(ric)')} AS mean, {R('median(ric)')} AS median, {R('stddev_samp(ric)')} AS std, {R('min(ric)')} AS worst, {R('avg(CASE WHEN ric > 0 THEN 1.0 ELSE 0 END)')} AS positive_share, count(*) AS windows, {R('avg(ric) / stddev_samp(ric)')} AS icir FROM zz WHERE ric IS NOT NULL GROUP BY 1")),
    "ml_drift": (ml_drift, q(*SCO, "k AS (SELECT symbol, epoch(TIMESTAMP '2024-02-01') - epoch(pt) AS a, CAST(called = label AS INT) AS ok, abs(greatest(pu, pd, pf) - CAST(called = label AS INT)) AS gap FROM m0)",
                             final=f"SELECT symbol, count(*) FILTER (a <= 2592000) AS samples_30, {R('avg(ok) FILTER (a <= 2592000)')} AS accuracy_30, {R('avg(gap) FILTER (a <= 2592000)')} AS gap_30, {R('(max(a) - min(a)) / 86400')} AS coverage_days, 'INSUFFICIENT_TIME_COVERAGE' AS status, 'KEEP_EXPERIMENTAL' AS action FROM k GROUP BY 1")),
    "ml_confidence": (ml_confidence, q(*SCO, *_cm("symbol, horizon"), "s AS (SELECT *, samples * 9 AS sm, round_even(100 * (0.25*accuracy + 0.15*least(1.0, samples * 9 / 5000) + 0.2*0.97 + 0.15*0.8 + 0.15*ba + 0.1*greatest(0, 1 - brier)) * 0.9, 0) AS sc FROM k1)",
                                       "t AS (SELECT *, concat_ws('|', CASE WHEN ba < 0.6 THEN 'MODEL_DISAGREEMENT' END, CASE WHEN abs(mcc) < 0.08 THEN 'PROBABILITY_MARGIN_TOO_SMALL' END, CASE WHEN sm < 300 THEN 'LIMITED_SAMPLE' END, CASE WHEN accuracy - 0.4 < 0.03 OR accuracy <= 0.4 THEN 'NO_VALIDATED_BASELINE_EDGE' END) AS doubts FROM s)",
                                       final=f"SELECT symbol, horizon, {R('sc')} AS confidence_score, CASE WHEN sc >= 85 THEN 'A' WHEN sc >= 70 THEN 'B' WHEN sc >= 55 THEN 'C' ELSE 'D' END AS grade, doubts, doubts = '' AS clear_edge FROM t")),
    "ml_ensemble": (ml_ensemble, None),
    "ml_research_returns": (ml_research_returns, q(*SCO, "a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pt) - 1 AS i FROM m0)", "b AS (SELECT symbol, pt, ar, CASE WHEN greatest(pu, pd, pf) >= 0.45 AND abs(pu - pd) >= 0.08 THEN sign(pu - pd) ELSE 0 END AS pos FROM a WHERE i % 3 = 0)",
                                                   "e AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY pt), 0)) AS tv FROM b)", final=f"SELECT symbol, pt AS ts, {R('pos')} AS position, {R('tv')} AS turnover, {R('pos * ar')} AS gross, {R('pos * ar - tv * 0.001')} AS net FROM e")),
    "ml_buy_and_hold": (ml_buy_and_hold, q(HOURLY_SQL, f"a AS (SELECT *, close / lag(close) {W} - 1 AS rr, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM c)",
                                           final=f"SELECT symbol, count(*) AS samples, {R('arg_max(close, ts) / arg_min(close, ts) - 1')} AS net_return, {R('avg(rr) / stddev_samp(rr) * sqrt(8760)')} AS sharpe, {R('min(close / top - 1)')} AS maximum_drawdown FROM a GROUP BY 1")),
    "ml_promotion": (ml_promotion, q(*SCO, *_cm("symbol, horizon"), "o AS (SELECT symbol, accuracy AS a0, f1 AS f0 FROM k1 WHERE horizon = '1H' AND symbol <> 'view')",
                                     "j AS (SELECT k1.symbol, horizon, a0, a0 IS NULL OR (accuracy >= a0 + 0.01 AND f1 >= f0 - 0.005) AS ok FROM k1 LEFT JOIN o ON k1.symbol = o.symbol WHERE horizon <> '1H')",
                                     final="SELECT symbol AS key, horizon AS model, CASE WHEN a0 IS NOT NULL THEN '1H' END AS champion, ok AS promoted, CASE WHEN ok THEN horizon ELSE '1H' END AS serving FROM j")),
    "ml_registry": (ml_registry, q(*SCO[:len(RES)], "a AS (SELECT market, horizon, prediction AS model, date_trunc('week', pt) AS cr, min(id) AS run_id FROM sd GROUP BY 1, 2, 3, 4)",
                                   final="SELECT market, horizon, model, run_id, row_number() OVER (PARTITION BY market, horizon, model ORDER BY cr, run_id) AS version, row(cr, run_id) = max(row(cr, run_id)) OVER (PARTITION BY market) AS latest FROM a")),
    "ml_walk_forward": (ml_walk_forward, None),
    "ml_risk": (ml_risk, None),
    "predict_latest": (predict_latest, None),
    "ml_registry_newest": (ml_registry_newest, "SELECT event_id AS run_id, event_type AS market, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "ml_tournament": (ml_tournament, None),
    "ml_regression": (ml_regression, None),
    "ml_ablation": (ml_ablation, None),
}
