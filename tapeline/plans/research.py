"""Queries over whole strategy runs and fused decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import backtest as bt, candles, features as feat, indicators as ind, ledger as ld, market as mk, ml, screen as sc, signals as sg
from tapeline.plans.bars import ADX_CTES, TR, WIN, macd_ctes, q, RSI_CTES
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, W, daily, ewm_sql, hourly, r, roll, rows, show, table
from tapeline.session import cut


def _ctx(spark, d):
    return cut(sg.context(hourly(spark, d)))


def _runs(spark, d):
    return cut(bt.barrier_trades(_ctx(spark, d), list(sg.FAMILIES)))


def strategy_risk_plans(spark, d):
    ctx = _ctx(spark, d)
    return show(sg.risk_plan(ctx, sg.confluence(sg.signals(sg.last_bar(ctx)))), "symbol", "entry", "side", "stop", "risk", "tp1", "tp2", "tp3", "rr1", "rr2", "rr3", "p1", "p2", "p3", "p_stop", "samples", "expected_value")


def strategy_evidence(spark, d):
    out = sg.evidence(sg.signals(sg.last_bar(_ctx(spark, d))))
    return out.select("symbol", *[F.size(x).alias(x) for x in ("bullish", "bearish", "neutral")])


def strategy_scores(spark, d):
    """Every bar's raw score of the rules that need no path-dependent state."""
    keys = ["breakout", "moving_average", "macd", "momentum", "donchian", "gann"]
    found = sg.signals(sg.context(hourly(spark, d)), keys)
    return found.select("symbol", "ts", "strategy", r("score", 4).alias("score"), "status")


def strategy_order_flow(spark, d):
    e = table(spark, d, "events")
    flow = e.groupBy(F.col("event_type").alias("symbol")).agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("bid_volume"),
                                                              F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value")).otherwise(0.0)).alias("ask_volume"))
    return show(sg.signals(sg.last_bar(sg.context(hourly(spark, d), flow)), ["order_flow"]), "symbol", "strategy", "score", "status")


def strategy_metrics(spark, d):
    return show(bt.trade_metrics(_runs(spark, d)), "symbol", "strategy", "number_of_trades", "win_rate", "profit_factor", "expectancy", "average_win", "average_loss", "max_drawdown", "sharpe", "sortino", "calmar",
                "mae", "mfe", "return_percent")


def strategy_trade_curve(spark, d):
    return show(bt.trade_curve(_runs(spark, d), 100000.0), "symbol", "strategy", "n", "equity", "drawdown")


def strategy_walk_forward(spark, d):
    return show(bt.walk_forward(_ctx(spark, d), list(sg.FAMILIES)), "symbol", "strategy", "fold", "number_of_trades", "win_rate", "expectancy", "sharpe", "max_drawdown")


def strategy_parameter_grid(spark, d):
    return show(bt.parameter_grid(hourly(spark, d), list(sg.FAMILIES)), "symbol", "strategy", "swing", "threshold", "segment", "number_of_trades", "expectancy", "sharpe", "max_drawdown", "selection_score", "locked")


def strategy_incremental(spark, d):
    return show(bt.incremental(cut(bt.trade_metrics(_runs(spark, d))), ("fibonacci", "fvg", "bos", "fib_fvg_bos"), "trend"), "symbol", "variant", "win_rate", "expectancy", "sharpe", "max_drawdown", "status")


def strategy_leaderboard(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("symbol"), F.lit("1h").alias("interval"), F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("strategy"), F.col("ts").alias("created_at"),
                    F.col("event_id").alias("run_id"), F.when(F.col("user_id") % 7 != 0, F.col("value") / 100).alias("expectancy"), (F.col("user_id") % 11).cast("double").alias("sharpe"))
    return show(bt.leaderboard(runs), "symbol", "strategy", "run_id", "expectancy", "sharpe", "rank")


def multi_timeframe(spark, d):
    bars = hourly(spark, d)
    frames = bars.drop("ticks").unionByName(candles.resample(bars, "4h").drop("ticks"))
    agreed = sg.confluence(sg.signals(sg.last_bar(cut(sg.context(sg.long_enough(frames))))))
    return show(sg.multi_timeframe(agreed), "symbol", "up", "down", "frames", "alignment", "conflict", "confidence_factor")


def _said(bars):
    c = F.col
    end = mk.latest(ind.compose(bars, ind._ma((20,)), ind._atr_sma()))
    return end.select("symbol", "interval", "ts", c("close").alias("entry"), "atr", F.when(c("close") > c("ma20"), "UP").otherwise("DOWN").alias("prediction"),
                      F.when(c("close") > c("ma20"), 0.5).otherwise(0.2).alias("up"), F.lit(0.3).alias("flat"), F.when(c("close") > c("ma20"), 0.2).otherwise(0.5).alias("down"))


def opportunity_scores(spark, d):
    bars = hourly(spark, d)
    c = F.col
    flow = mk.capital_flow(bars)
    df = (_said(bars).join(flow.select("symbol", "flow_ratio", "flow_acceleration"), "symbol").join(mk.market_regime(bars, flow).select("symbol", "trend_score", "volatility_percentile"), "symbol")
          .withColumns({"consensus": F.lit(0.67), "coverage": F.lit(0.8), "risk_reward": F.lit(1.6), "reward": c("atr") * 2.4, "stop_distance": c("atr") * 1.5, "costs": c("entry") * 0.003,
                        "event_risk": F.when(c("symbol") == "view", "HIGH").otherwise("LOW"), "reasonableness": F.lit("NORMAL")}))
    return show(mk.opportunity(df), "symbol", "prediction", "expected_value", "opportunity", "risk_score", "risk_level", "decision")


def breakout_odds(spark, d):
    bars = hourly(spark, d)
    flow = mk.capital_flow(bars)
    df = (_said(bars).join(flow.select("symbol", "flow_ratio", "persistence"), "symbol").join(mk.market_regime(bars, flow).select("symbol", "trend_score"), "symbol")
          .join(mk.snapshot_structure(ind.volume_set(ind.atr_sma(bars))).select("symbol", "volume_confirmed"), "symbol"))
    return show(mk.breakout_odds(df), "symbol", "breakout_probability", "fake_breakout_risk", "continuation_probability")


def stops_and_targets(spark, d):
    c = F.col
    end = mk.latest(ind.atr_sma(daily(spark, d).withColumn("low40", F.min("low").over(mk.trail(40)))))
    df = end.select("symbol", c("close").alias("entry"), "atr", F.lit(1).alias("side"), F.lit(1.5).alias("multiplier"), F.lit(0.5).alias("volatility_percentile"), c("low40").alias("swing"), (c("close") - c("atr")).alias("zone_edge"))
    df = mk.dynamic_stop(df)
    df = df.select("symbol", "entry", "stop", "side", "atr", "reasonableness", (c("atr") / 2).alias("typical_move"), F.array(c("entry") + c("atr") * 0.7, c("entry") - 1).alias("levels"))
    return show(mk.take_profits(df), "symbol", "entry", "stop", "reasonableness", "target", "price", "risk_reward")


def price_oi_relation(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.max_by("user_id", "ts") - F.min_by("user_id", "ts")).cast("double").alias("open_interest_change"))
    return mk.capital_flow(hourly(spark, d), e).select("symbol", "price_oi_relation")


def macro_signal(spark, d):
    label = F.create_map(*[F.lit(x) for x in ("view", "SPX", "click", "DXY", "signup", "US10Y")])
    bars = hourly(spark, d).select(F.try_element_at(label, F.col("symbol")).alias("label"), "ts", "close").filter("label is not null")
    return show(mk.macro_signal(bars), "score", "labels", "macro_signal")


def final_actions(spark, d):
    bars = hourly(spark, d)
    c = F.col
    df = _said(bars).select("symbol", c("prediction").alias("model_direction"), F.when(c("entry") > 40, "BUY").when(c("entry") < 15, "SELL").otherwise("HOLD").alias("signal"), (c("atr") - c("entry")).alias("expected_value"),
                            (F.length("symbol") == 4).alias("conflict"), (c("symbol") != "error").alias("actionable"))
    return sg.final_action(df).select("symbol", "action", "reason")


def top_factors(spark, d):
    cols = ["return_1", "return_5", "volume_ratio", "high_position_20"]
    bars = feat.price_features(ind.volume_set(hourly(spark, d)))
    imp = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.element_at(F.array(*[F.lit(x) for x in cols]), (F.col("k") + 1).cast("int")).alias("feature"), (F.col("n") / 1e6).alias("importance"))
    return show(ml.top_factors(imp, mk.latest(bars), bars, cols, 3), "symbol", "feature", "importance", "z", "value", "rank", "positive")


def open_alerts(spark, d):
    e = table(spark, d, "events")
    stored = e.select(F.col("event_type").alias("symbol"), F.lit("crypto").alias("asset_type"), F.when(F.col("user_id") % 2 == 0, "STALE_DATA").otherwise("STATE_CHANGE").alias("alert_type"),
                      F.col("event_id").cast("string").alias("fingerprint"), (F.col("user_id") % 5 == 0).alias("acknowledged"), F.col("ts").alias("created_at"))
    fresh = e.filter("event_type = 'view'").select(F.col("event_type").alias("symbol"), F.lit("crypto").alias("asset_type"))
    return sc.open_alerts(stored, fresh, 100).select("symbol", "alert_type", "fingerprint")


FE = [HOURLY_SQL, *macd_ctes("1"), *[ewm_sql(f"e{n}", "c", "close", f"(2.0/{n + 1})") for n in (20, 50, 100, 200)], f"trc AS (SELECT symbol, ts, {TR} AS tr FROM c {WIN})", ewm_sql("ea", "trc", "tr", "(1.0/14)"),
      "f0 AS (SELECT c.symbol, c.ts, close, volume, macd, signal, hist, e20, e50, e100, e200, greatest(ea, close * 0.001) AS unit, " + ", ".join(f"{roll(a + '({})', f, n, -1)} AS {k}{n}".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY c.symbol ORDER BY c.ts") for n in (20, 55, 100) for k, a, f in (("u", "max", "high"), ("l", "min", "low")))
      + f", volume / nullif({roll('median({})', 'volume', 30)}, 0) AS vr".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY c.symbol ORDER BY c.ts")
      + ", close / nullif(lag(close, 10) OVER w, 0) - 1 AS roc FROM c JOIN mm USING (symbol, ts) JOIN ea USING (symbol, ts) " + " ".join(f"JOIN e{n} USING (symbol, ts)" for n in (20, 50, 100, 200)) + " WINDOW w AS (PARTITION BY c.symbol ORDER BY c.ts))",
      f"f1 AS (SELECT *, coalesce(lag(e20) {W}, 0) AS p20, coalesce(lag(e50) {W}, 0) AS p50, coalesce(lag(macd) {W}, 0) AS pm, coalesce(lag(signal) {W}, 0) AS ps, lag(hist) {W} AS ph, roc - lag(roc, 3) {W} AS acc, coalesce(e20 / nullif(lag(e20, 5) {W}, 0) - 1, 0) AS sl, "
      f"CASE WHEN count(*) {rows(30)} < 30 THEN 0 WHEN min(close) {rows(15)} < min(close) {rows(15, -15)} AND min(roc) {rows(15)} > min(roc) {rows(15, -15)} THEN 1 WHEN max(close) {rows(15)} > max(close) {rows(15, -15)} AND max(roc) {rows(15)} < max(roc) {rows(15, -15)} THEN -1 ELSE 0 END AS rd FROM f0)",
      "f2 AS (SELECT *, CASE WHEN close > u20 THEN 1 WHEN close < l20 THEN -1 ELSE 0 END AS bw, coalesce((close - u20) / unit, 0) AS mg FROM f1)"]
SCORES = {"breakout": "35*bw + CASE WHEN coalesce(vr, 0) >= 1.2 THEN 22*bw ELSE -12*bw END + CASE WHEN abs(mg) >= 0.1 THEN 18*bw ELSE -8*bw END",
          "moving_average": "28 * CASE WHEN p20 <= p50 AND e20 > e50 THEN 1 WHEN p20 >= p50 AND e20 < e50 THEN -1 ELSE 0 END + 32 * CASE WHEN e20 > e50 AND e50 > e100 AND e100 > e200 THEN 1 WHEN e20 < e50 AND e50 < e100 AND e100 < e200 THEN -1 ELSE 0 END + 18 * sign(sl)",
          "macd": "32 * CASE WHEN pm <= ps AND macd > signal THEN 1 WHEN pm >= ps AND macd < signal THEN -1 ELSE 0 END + 25 * CASE WHEN pm <= 0 AND macd > 0 THEN 1 WHEN pm >= 0 AND macd < 0 THEN -1 ELSE 0 END + 15 * coalesce(sign(hist - ph), 0)",
          "momentum": "30 * coalesce(sign(roc), 0) + 22 * coalesce(sign(acc), 0) + 15 * rd",
          "donchian": " + ".join(f"{w} * CASE WHEN close > u{n} THEN 1 WHEN close < l{n} THEN -1 ELSE 0 END" for n, w in ((20, 24), (55, 22), (100, 18))), "gann": "0"}
SCORES_SQL = q(*FE, final=" UNION ALL ".join(f"SELECT symbol, ts, '{k}' AS strategy, {R(v, 4)} AS score, '{'INSUFFICIENT_EVIDENCE' if k == 'gann' else 'AVAILABLE'}' AS status FROM f2" for k, v in SCORES.items()))

QUERIES = {
    "strategy_scores": (strategy_scores, SCORES_SQL),
    "strategy_order_flow": (strategy_order_flow, f"WITH f AS (SELECT event_type AS symbol, sum(value) FILTER (event_id % 2 = 0) AS b, sum(value) FILTER (event_id % 2 = 1) AS a FROM events GROUP BY 1) SELECT symbol, 'order_flow' AS strategy, {R('60 * sign(a - b) * least(abs(a - b) / greatest(a + b, 1), 1)')} AS score, 'AVAILABLE' AS status FROM f"),
    "strategy_risk_plans": (strategy_risk_plans, None),
    "strategy_evidence": (strategy_evidence, None),
    "strategy_metrics": (strategy_metrics, None),
    "strategy_trade_curve": (strategy_trade_curve, None),
    "strategy_walk_forward": (strategy_walk_forward, None),
    "strategy_parameter_grid": (strategy_parameter_grid, None),
    "strategy_incremental": (strategy_incremental, None),
    "strategy_leaderboard": (strategy_leaderboard, f"""WITH k AS (SELECT event_type AS symbol, 's' || user_id % 30 AS strategy, event_id AS run_id, CASE WHEN user_id % 7 <> 0 THEN value / 100 END AS e, user_id % 11 AS s FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 30 ORDER BY ts DESC, event_id DESC) = 1)
  SELECT symbol, strategy, run_id, {R('e')} AS expectancy, {R('s')} AS sharpe, row_number() OVER (ORDER BY e DESC NULLS LAST, s DESC NULLS LAST, symbol, strategy) AS rank FROM k"""),
    "multi_timeframe": (multi_timeframe, None),
    "opportunity_scores": (opportunity_scores, None),
    "breakout_odds": (breakout_odds, None),
    "stops_and_targets": (stops_and_targets, q(DAILY_SQL, f"t AS (SELECT *, {TR} AS tr, min(low) {rows(40)} AS l40 FROM c {WIN})", f"a AS (SELECT symbol, ts, close AS e, {roll('avg({})', 'tr', 14)} AS atr, l40 FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)",
                                               "s AS (SELECT *, greatest(CASE WHEN e - 1.5*atr < e THEN e - 1.5*atr END, CASE WHEN l40 - 0.21*atr < e THEN l40 - 0.21*atr END, CASE WHEN e - atr - 0.21*atr < e THEN e - 1.21*atr END) AS st FROM a)",
                                               "m AS (SELECT symbol, e, st, atr, unnest([1.0, 1.75, 2.5]) AS x FROM s)", "p AS (SELECT symbol, e, st, atr, e + greatest(abs(e - st) * x, atr * x, atr / 2 * x / 3) AS p FROM m UNION SELECT symbol, e, st, atr, e + atr * 0.7 FROM s)",
                                               "k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p) AS target FROM p WHERE p > e)",
                                               final=f"SELECT symbol, {R('e')} AS entry, {R('st')} AS stop, CASE WHEN abs(e - st) / atr BETWEEN 0.65 AND 3.5 THEN 'NORMAL' WHEN abs(e - st) / atr < 0.65 THEN 'TOO_CLOSE_NOISE_RISK' ELSE 'TOO_FAR_RISK_REWARD_RISK' END AS reasonableness, target, {R('p')} AS price, {R('abs(p - e) / abs(e - st)')} AS risk_reward FROM k WHERE target <= 3")),
    "price_oi_relation": (price_oi_relation, None),
    "macro_signal": (macro_signal, q(HOURLY_SQL, "k AS (SELECT CASE symbol WHEN 'view' THEN 'SPX' WHEN 'click' THEN 'DXY' WHEN 'signup' THEN 'US10Y' END AS label, sign(close - lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)",
                                     "m AS (SELECT sum(CASE WHEN label = 'SPX' THEN s ELSE -s END) AS score, count(*) AS labels FROM k WHERE label IS NOT NULL)", final=f"SELECT {R('score')} AS score, labels, CASE WHEN score > 0 THEN 'POSITIVE' WHEN score < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS macro_signal FROM m")),
    "final_actions": (final_actions, None),
    "top_factors": (top_factors, None),
    "open_alerts": (open_alerts, "SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'STALE_DATA' ELSE 'STATE_CHANGE' END AS alert_type, CAST(event_id AS VARCHAR) AS fingerprint FROM events WHERE user_id % 5 <> 0 AND NOT (event_type = 'view' AND user_id % 2 = 0) ORDER BY ts DESC LIMIT 100"),
}
