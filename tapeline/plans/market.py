"""Flow, regime, level and cross-asset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import indicators as ind, market as mk
from tapeline.operators.comoments import pair_correlation as pair_correlation_of
from tapeline.plans.bars import TR, WIN, q
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, RUN, W, bars_sql, daily, hourly, r, roll, rows, show


def capital_flow(spark, d):
    return show(mk.capital_flow(hourly(spark, d)), "symbol", "net", "gross", "flow_ratio", "flow_momentum", "flow_acceleration", "persistence", "momentum",
                "active_buy", "active_sell", "relation", "direction", net=3, gross=3, active_buy=3, active_sell=3)


def market_regime(spark, d):
    bars = hourly(spark, d)
    return show(mk.market_regime(bars, mk.capital_flow(bars)), "symbol", "ts", "regime", "risk_mode", "liquidity", "trend", "volatility",
                "volatility_percentile", "trend_score", "volume_ratio", "combined")


def capital_rotation(spark, d):
    return show(mk.rotation(daily(spark, d)), "symbol", "ret", "flow_ratio", "rotation_score", "rank")


def cross_correlation(spark, d):
    return show(mk.cross_correlation(daily(spark, d), "Brand#1"), "target", "symbol", "correlation", "samples")


def anomalies(spark, d):
    return show(mk.anomalies(ind.volatility(ind.returns(hourly(spark, d), (1,)))), "symbol", "check", "z_score", "active")


def _weights(bars):
    return bars.select("symbol").distinct().withColumn("weight", F.length("symbol").cast("double"))


def portfolio_risk(spark, d):
    bars = hourly(spark, d)
    return show(mk.portfolio_risk(bars, _weights(bars)), "samples", "var_95", "cvar_95", "volatility", "max_drawdown", "concentration")


def pair_correlation(spark, d):
    return show(pair_correlation_of(mk.returns_of(daily(spark, d))), "left", "right", "samples", "correlation")


def momentum_environment(spark, d):
    return show(mk.momentum_environment(daily(spark, d), "Brand#11"), "target", "samples", "target_momentum", "peer_momentum", "environment")


def portfolio_correlation(spark, d):
    bars = hourly(spark, d)
    return show(mk.portfolio_correlation(bars, _weights(bars)), "left", "right", "samples", "correlation")


def position_values(spark, d):
    bars = daily(spark, d)
    held = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("quantity"))
    return show(mk.notionals(held, bars), "symbol", "quantity", "last_close", "notional", notional=3)


def position_sizes(spark, d):
    bars = mk.latest(ind.atr_sma(daily(spark, d))).select("symbol", F.col("close").alias("entry"), (F.col("close") - 1.5 * F.col("atr")).alias("stop"))
    return show(mk.position_size(bars, 1e6, 0.01, 0.001, 0.0005, 1.0, 1.0, 0.001), "symbol", "entry", "stop", "unit_risk", "quantity", "notional")


def structure_snapshot(spark, d):
    return show(mk.snapshot_structure(ind.volume_set(ind.atr_sma(hourly(spark, d)))), "symbol", "structure", "high_pattern", "low_pattern", "prior_high", "prior_low",
                "volume_confirmed", "retest", "range_width")


def price_zones(spark, d):
    bars = ind.compose(hourly(spark, d), ind._ma(), ind._bollinger(), ind._atr_sma())
    return show(mk.zones(bars), "symbol", "side", "rank", "center", "lower", "upper", "strength", "touches", "residence", "confluence", "primary_source")


def timeframe_matrix(spark, d):
    return show(mk.timeframe_matrix(hourly(spark, d), 60, {"15m": 15, "1H": 60, "4H": 240, "1D": 1440}), "symbol", "interval", "bars", "status", "trend", "flow",
                "momentum", "volatility", "support", "resistance", "atr_share")


def context_snapshot(spark, d):
    bars = hourly(spark, d)
    flow = mk.capital_flow(bars)
    return show(mk.context_snapshot(flow, mk.market_regime(bars, flow), mk.rotation(bars)), "symbol", "ts", "direction", "regime", "risk_mode", "liquidity",
                "volatility", "rotation_score", "rank", "regime_change_risk")


FLOW_CTES = ["f0 AS (SELECT *, CASE WHEN amount > 0 THEN amount ELSE (high+low+close)/3*volume END AS t, coalesce(sign(close - lag(close) OVER w), 0) AS s, "
             "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r, least(32, greatest(8, count(*) OVER (PARTITION BY symbol) // 20)) AS win FROM c " + WIN + ")",
             "f1 AS (SELECT *, s * t AS f, sum(CASE WHEN r <= win THEN s * t END) OVER (PARTITION BY symbol) AS net FROM f0 WHERE r <= 2 * win)",
             """f2 AS (SELECT symbol, any_value(net) AS net, sum(t) FILTER (r <= win) AS gross, sum(f) FILTER (r > win) AS pn, sum(t) FILTER (r > win) AS pg,
  avg(CASE WHEN sign(f) = sign(net) THEN 1.0 ELSE 0 END) FILTER (r <= win) AS pers, arg_max(close, ts) / arg_min(close, ts) FILTER (r <= win) - 1 AS mom,
  coalesce(sum(f) FILTER (r <= win AND f > 0), 0) AS buy, coalesce(-sum(f) FILTER (r <= win AND f < 0), 0) AS sell FROM f1 GROUP BY 1)""",
             """f3 AS (SELECT *, coalesce(net / nullif(gross, 0), 0) AS ratio, coalesce(pn / nullif(pg, 0), 0) AS prior FROM f2)""",
             """fl AS (SELECT symbol, net, gross, ratio AS flow_ratio, ratio - prior / 2 AS flow_momentum, ratio - prior AS flow_acceleration, CASE WHEN net <> 0 THEN pers ELSE 0.5 END AS persistence,
  mom AS momentum, buy AS active_buy, sell AS active_sell, CASE WHEN mom > 0 AND ratio < 0 THEN 'BEARISH_DIVERGENCE' WHEN mom < 0 AND ratio > 0 THEN 'BULLISH_DIVERGENCE' ELSE 'CONFIRMED' END AS relation,
  CASE WHEN ratio > 0.02 THEN 'INFLOW' WHEN ratio < -0.02 THEN 'OUTFLOW' ELSE 'NEUTRAL' END AS direction FROM f3)"""]
REG = [f"""m0 AS (SELECT symbol, ts, close, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret5, avg(close) {rows(20)} AS ma20, avg(close) {rows(60)} AS ma60,
  avg(volume) {rows(20)} AS v20, avg(volume) {rows(60, -20)} AS v60 FROM c {WIN})""",
       f"m1 AS (SELECT *, {roll('stddev_samp({})', 'ret', 20)} AS vol, ma20 / lag(ma20, 5) {W} - 1 AS slope, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM m0)",
       "m2 AS (SELECT * FROM m1 WHERE r = 1)",
       "m3 AS (SELECT a.symbol, avg(CASE WHEN a.vol <= b.vol THEN 1.0 ELSE 0 END) AS rk FROM m1 a JOIN m2 b USING (symbol) WHERE a.r > 1 AND a.vol IS NOT NULL GROUP BY 1)",
       """m4 AS (SELECT symbol, ts, ret5, greatest(vol, 1e-6) AS calm, coalesce(rk, 0.5) AS p, tanh(slope / greatest(vol, 1e-6)) * 0.6 + sign(close - ma60) * 0.4 AS t, v20 / greatest(v60, 1e-12) AS vr, flow_ratio, flow_acceleration, direction
  FROM m2 LEFT JOIN m3 USING (symbol) JOIN fl USING (symbol))""",
       """rg AS (SELECT symbol, ts, CASE WHEN p >= 0.9 AND ret5 < -2 * calm THEN 'PANIC' WHEN p >= 0.9 AND ret5 > 2 * calm THEN 'EUPHORIA' WHEN p >= 0.8 THEN 'HIGH_VOLATILITY' WHEN p <= 0.2 THEN 'LOW_VOLATILITY'
  WHEN t > 0.45 THEN 'BULL_TREND' WHEN t < -0.45 THEN 'BEAR_TREND' WHEN abs(t) < 0.18 THEN 'SIDEWAYS' ELSE 'TRANSITION' END AS regime,
  CASE WHEN t + 0.25 * sign(flow_ratio) > 0.25 THEN 'RISK_ON' WHEN t + 0.25 * sign(flow_ratio) < -0.25 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS risk_mode,
  CASE WHEN vr > 1.15 THEN 'IMPROVING' WHEN vr < 0.8 THEN 'TIGHTENING' ELSE 'NEUTRAL' END AS liquidity, CASE WHEN t > 0.2 THEN 'UP' WHEN t < -0.2 THEN 'DOWN' ELSE 'SIDEWAYS' END AS trend,
  CASE WHEN p > 0.75 THEN 'HIGH' WHEN p < 0.25 THEN 'LOW' ELSE 'MEDIUM' END AS volatility, p AS volatility_percentile, t AS trend_score, vr AS volume_ratio, t + 0.25 * sign(flow_ratio) AS combined, flow_acceleration, direction FROM m4)"""]
ROT = ["r0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM c)", f"r1 AS (SELECT *, lag(close) {W} AS p, CASE WHEN amount <> 0 THEN amount ELSE close * volume END AS t FROM r0 WHERE k <= 40)",
       "r2 AS (SELECT symbol, count(*) AS n, arg_max(close, ts) / arg_min(close, ts) - 1 AS ret, sum(t * sign(close - p)) / greatest(sum(t) FILTER (p IS NOT NULL), 1e-12) AS fr FROM r1 GROUP BY 1)",
       "ro AS (SELECT symbol, ret, fr AS flow_ratio, ret * 4 + fr AS rotation_score, row_number() OVER (ORDER BY ret * 4 + fr DESC, symbol) AS rank FROM r2 WHERE n >= 8)"]
RET = f"rt AS (SELECT symbol, ts, close / nullif(lag(close) {W}, 0) - 1 AS ret FROM c)"

STRUCT_SQL = q(HOURLY_SQL, f"t AS (SELECT *, {TR} AS tr, coalesce(sign(close - lag(close) OVER w), 0) * volume AS sv, close / lag(close) OVER w - 1 AS dc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM c {WIN})",
               f"t1 AS (SELECT *, {roll('avg({})', 'tr', 14)} AS atr FROM t)", "t2 AS (SELECT * FROM t1 WHERE r <= 160)",
               f"""t3 AS (SELECT *, CASE WHEN count(*) OVER p = 7 AND high = max(high) OVER p THEN high END AS ph, CASE WHEN count(*) OVER p = 7 AND low = min(low) OVER p THEN low END AS pl,
  CASE WHEN r < 160 THEN sv END AS dob, CASE WHEN r < 160 THEN dc END AS dcc FROM t2 WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""",
               """g AS (SELECT symbol, list(ph ORDER BY ts) FILTER (ph IS NOT NULL) AS hs, list(pl ORDER BY ts) FILTER (pl IS NOT NULL) AS ls, arg_max(close, ts) AS cur, greatest(arg_max(atr, ts), arg_max(close, ts) * 0.001) AS atr, arg_max(volume, ts) AS v,
  max(high) FILTER (r BETWEEN 2 AND 41) AS ph, min(low) FILTER (r BETWEEN 2 AND 41) AS pl, median(volume) FILTER (r <= 30) AS mv, max(high) FILTER (r <= 8) AS h8, min(low) FILTER (r <= 8) AS l8,
  avg(dob) FILTER (r <= 20) AS os, avg(dcc) FILTER (r <= 20) AS ps FROM t3 GROUP BY 1)""",
               """h AS (SELECT *, CASE WHEN len(hs) >= 2 AND hs[-1] > hs[-2] THEN 'HIGHER_HIGH' ELSE 'LOWER_HIGH' END AS hp, CASE WHEN len(ls) >= 2 AND ls[-1] > ls[-2] THEN 'HIGHER_LOW' ELSE 'LOWER_LOW' END AS lp, v > mv * 1.25 AS vc,
  (ph - pl) / greatest(cur, 1e-12) AS rw, abs(cur - ph) <= 0.35 * atr AND h8 > ph AS rh, abs(cur - pl) <= 0.35 * atr AND l8 < pl AS rl FROM g)""",
               final=f"""SELECT symbol, CASE WHEN cur > ph THEN CASE WHEN vc THEN 'BREAKOUT' ELSE 'FAKE_BREAKOUT_RISK' END WHEN cur < pl THEN CASE WHEN vc THEN 'BREAKDOWN' ELSE 'LIQUIDITY_SWEEP_RISK' END
  WHEN rh THEN 'RETEST_OF_BREAKOUT' WHEN rl THEN 'RETEST_OF_BREAKDOWN' WHEN rw < 0.06 AND os > 0 AND ps <= 0 THEN 'ACCUMULATION' WHEN rw < 0.06 AND os < 0 AND ps >= 0 THEN 'DISTRIBUTION'
  WHEN hp = 'HIGHER_HIGH' AND lp = 'HIGHER_LOW' THEN 'UPTREND_STRUCTURE' WHEN hp = 'LOWER_HIGH' AND lp = 'LOWER_LOW' THEN 'DOWNTREND_STRUCTURE' ELSE 'RANGE_OR_TRANSITION' END AS structure,
  hp AS high_pattern, lp AS low_pattern, {R('ph')} AS prior_high, {R('pl')} AS prior_low, vc AS volume_confirmed, rh OR rl AS retest, {R('rw')} AS range_width FROM h""")

TF = ("WITH " + HOURLY_SQL + ", b AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{k}' AS interval, to_timestamp(floor(epoch(ts)/{s})*{s})::TIMESTAMP AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM c GROUP BY symbol, to_timestamp(floor(epoch(ts)/{s})*{s})::TIMESTAMP"
    for k, s in (("1H", 3600), ("4H", 14400), ("1D", 86400))) + """),
 t AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(lag(close, 5) OVER w, 0) - 1 AS mom, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
   row_number() OVER (PARTITION BY symbol, interval ORDER BY ts DESC) AS r FROM b WINDOW w AS (PARTITION BY symbol, interval ORDER BY ts)),
 g AS (SELECT symbol, interval, count(*) AS bars, arg_max(close, ts) / avg(close) FILTER (r <= 20) - 1 AS tg, sum(coalesce(sign(ret), 0) * volume) FILTER (r <= 10) / greatest(sum(volume) FILTER (r <= 10), 1e-12) AS f,
   stddev_samp(ret) FILTER (r <= 20) AS vol, avg(tr) FILTER (r <= 14) / arg_max(close, ts) AS a, min(low) FILTER (r <= 40) AS s, max(high) FILTER (r <= 40) AS re, arg_max(mom, ts) AS mom FROM t GROUP BY 1, 2)
 SELECT symbol, interval, bars, CASE WHEN bars < 20 THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END AS status, CASE WHEN bars >= 20 THEN CASE WHEN tg > 0.002 THEN 'UP' WHEN tg < -0.002 THEN 'DOWN' ELSE 'FLAT' END END AS trend,
   CASE WHEN bars >= 20 THEN CASE WHEN f > 0.03 THEN 'UP' WHEN f < -0.03 THEN 'DOWN' ELSE 'FLAT' END END AS flow, """ + f"{R('mom')} AS momentum, {R('vol')} AS volatility, {R('s')} AS support, {R('re')} AS resistance, {R('a')} AS atr_share FROM g UNION ALL SELECT DISTINCT symbol, '15m', 0, 'NO_DATA', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c")

RISK_SQL = q(HOURLY_SQL, RET, "h AS (SELECT symbol, length(symbol) AS w FROM c GROUP BY 1)", "s AS (SELECT sum(w) AS t, count(*) AS n, sum(w*w) / (sum(w) * sum(w)) AS hhi FROM h)",
             "p AS (SELECT ts, sum(w / t * ret) AS r, any_value(hhi) AS hhi FROM rt JOIN h USING (symbol), s WHERE ret IS NOT NULL GROUP BY ts, n HAVING count(*) = n)",
             "e AS (SELECT *, product(1 + r) OVER (ORDER BY ts) AS eq, quantile_cont(r, 0.05) OVER () AS cut FROM p)", "f AS (SELECT *, 1 - eq / max(eq) OVER (ORDER BY ts) AS dd FROM e)",
             final=f"""SELECT count(*) AS samples, {R('-max(cut)')} AS var_95, {R('-avg(r) FILTER (r <= cut)')} AS cvar_95, {R('stddev_samp(r)')} AS volatility, {R('max(dd)')} AS max_drawdown, {R('max(hhi)')} AS concentration FROM f""")

ANOM = q(HOURLY_SQL, RET, "k AS (SELECT c.symbol, c.ts, volume, abs(ret) AS ar, CASE WHEN count(ret) OVER z = 20 THEN stddev_samp(ret) OVER z END AS vol FROM c JOIN rt USING (symbol, ts) WINDOW z AS (PARTITION BY c.symbol ORDER BY c.ts ROWS 19 PRECEDING))",
         'l AS (SELECT symbol, ts, \'volume_spike\' AS "check", volume AS v FROM k UNION ALL SELECT symbol, ts, \'price_spike\', ar FROM k UNION ALL SELECT symbol, ts, \'volatility_spike\', vol FROM k)',
         'm AS (SELECT * FROM l WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, "check" ORDER BY ts DESC) <= 120)',
         'z AS (SELECT symbol, "check", (arg_max(v, ts) - avg(v)) / stddev_samp(v) AS z FROM m GROUP BY 1, 2)',
         final=f'SELECT symbol, "check", {R("z")} AS z_score, abs(z) >= 2 AS active FROM z')

SIZE_SQL = q(DAILY_SQL, f"t AS (SELECT *, {TR} AS tr FROM c {WIN})", f"a AS (SELECT symbol, ts, close AS entry, close - 1.5 * {roll('avg({})', 'tr', 14)} AS stop FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)".replace("close - 1.5 * CASE", "close - 1.5 * (CASE").replace("END AS stop", "END) AS stop"),
             "b AS (SELECT *, abs(entry - stop) + entry * 0.003 AS u FROM a)", "q AS (SELECT *, greatest(0, floor(least(10000 / u, 1000000 / entry) / 0.001) * 0.001) AS n FROM b)",
             final=f"SELECT symbol, {R('entry')} AS entry, {R('stop')} AS stop, {R('u')} AS unit_risk, {R('n')} AS quantity, {R('n * entry')} AS notional FROM q")

QUERIES = {
    "capital_flow": (capital_flow, q(HOURLY_SQL, *FLOW_CTES, final=f"""SELECT symbol, {R('net', 3)} AS net, {R('gross', 3)} AS gross, {R('flow_ratio')} AS flow_ratio, {R('flow_momentum')} AS flow_momentum, {R('flow_acceleration')} AS flow_acceleration,
  {R('persistence')} AS persistence, {R('momentum')} AS momentum, {R('active_buy', 3)} AS active_buy, {R('active_sell', 3)} AS active_sell, relation, direction FROM fl""")),
    "market_regime": (market_regime, q(HOURLY_SQL, *FLOW_CTES, *REG, final=f"SELECT symbol, ts, regime, risk_mode, liquidity, trend, volatility, {R('volatility_percentile')} AS volatility_percentile, {R('trend_score')} AS trend_score, {R('volume_ratio')} AS volume_ratio, {R('combined')} AS combined FROM rg")),
    "capital_rotation": (capital_rotation, q(DAILY_SQL, *ROT, final=f"SELECT symbol, {R('ret')} AS ret, {R('flow_ratio')} AS flow_ratio, {R('rotation_score')} AS rotation_score, rank FROM ro")),
    "cross_correlation": (cross_correlation, q(DAILY_SQL, RET, "p AS (SELECT b.symbol, b.ts, a.ret AS x, b.ret AS y FROM rt a JOIN rt b USING (ts) WHERE a.symbol = 'Brand#1' AND b.symbol <> 'Brand#1' AND a.ret IS NOT NULL AND b.ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY b.symbol ORDER BY ts DESC) <= 120)",
                                               final=f"SELECT 'Brand#1' AS target, symbol, {R('corr(x, y)')} AS correlation, count(*) AS samples FROM p GROUP BY symbol HAVING count(*) >= 30")),
    "pair_correlation": (pair_correlation, q(DAILY_SQL, RET, final=f"""SELECT a.symbol AS "left", b.symbol AS "right", count(*) AS samples, {R('corr(a.ret, b.ret)')} AS correlation FROM rt a JOIN rt b USING (ts)
  WHERE a.symbol < b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30""")),
    "momentum_environment": (momentum_environment, q(DAILY_SQL, RET, "k AS (SELECT * FROM rt WHERE ret IS NOT NULL)", "m AS (SELECT * FROM k WHERE symbol = 'Brand#11')", "u AS (SELECT k.symbol FROM k JOIN m USING (ts) WHERE k.symbol <> 'Brand#11' GROUP BY 1 HAVING count(*) >= 30)",
                                                     "z AS (SELECT DISTINCT ts FROM k ORDER BY ts DESC LIMIT 24)", "t AS (SELECT sum(ret) AS tm FROM (SELECT ret FROM m ORDER BY ts DESC LIMIT 24))",
                                                     "p AS (SELECT coalesce(sum(a), 0) AS pm FROM (SELECT avg(ret) AS a FROM k JOIN u USING (symbol) JOIN z USING (ts) GROUP BY ts))",
                                                     final=f"SELECT 'Brand#11' AS target, (SELECT count(*) FROM m) AS samples, {R('tm')} AS target_momentum, {R('pm')} AS peer_momentum, CASE WHEN tm > 0 AND pm > 0 THEN 'FAVORABLE' WHEN tm < 0 AND pm < 0 THEN 'UNFAVORABLE' ELSE 'NEUTRAL' END AS environment FROM t, p")),
    "portfolio_correlation": (portfolio_correlation, q(HOURLY_SQL, RET, "k AS (SELECT * FROM rt WHERE ret IS NOT NULL)", "f AS (SELECT ts FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM c))",
                                                       final=f"""SELECT a.symbol AS "left", b.symbol AS "right", count(*) AS samples, {R('corr(a.ret, b.ret)')} AS correlation FROM k a JOIN k b USING (ts) JOIN f USING (ts) WHERE a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 60""")),
    "anomalies": (anomalies, ANOM),
    "portfolio_risk": (portfolio_risk, RISK_SQL),
    "position_values": (position_values, q(DAILY_SQL, final=f"SELECT symbol, count(*) AS quantity, {R('arg_max(close, ts)')} AS last_close, {R('count(*) * arg_max(close, ts)', 3)} AS notional FROM c GROUP BY 1")),
    "position_sizes": (position_sizes, SIZE_SQL),
    "structure_snapshot": (structure_snapshot, STRUCT_SQL),
    "price_zones": (price_zones, None),
    "timeframe_matrix": (timeframe_matrix, TF),
    "context_snapshot": (context_snapshot, q(HOURLY_SQL, *FLOW_CTES, *REG, *ROT, final=f"SELECT symbol, ts, rg.direction, regime, risk_mode, liquidity, volatility, {R('rotation_score')} AS rotation_score, rank, abs(flow_acceleration) > 0.08 OR volatility_percentile > 0.9 AS regime_change_risk FROM rg JOIN ro USING (symbol)")),
}
