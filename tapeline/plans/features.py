"""Feature, panel and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.series import numbered, whole
from tapeline.operators import features as feat, indicators as ind
from tapeline.plans.bars import ADX_CTES, RSI_CTES, TR, WIN, macd_ctes, q, sel
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, RUN, W, daily, ewm_sql, hourly, r, roll, rows, show
from tapeline.schema import FEATURE_GROUPS

PRICE = FEATURE_GROUPS["price"]
TECH = FEATURE_GROUPS["technical"]
VOLUME = FEATURE_GROUPS["volume"]


def feat_price(spark, d):
    return show(feat.price_features(hourly(spark, d)), "symbol", "ts", *PRICE)


def feat_technical(spark, d):
    bars = ind.adx(ind.atr_sma(ind.bollinger(ind.rsi(ind.macd(ind.moving_averages(hourly(spark, d), (5, 20)))))))
    return show(feat.technical_features(bars), "symbol", "ts", *TECH, "ma5_gap", "ema20_gap")


def feat_volume(spark, d):
    bars = ind.returns(ind.volume_set(hourly(spark, d)), (1,))
    return show(feat.volume_features(bars), "symbol", "ts", *VOLUME)


def feat_structure(spark, d):
    return show(feat.structure_features(ind.atr_sma(hourly(spark, d))), "symbol", "ts", *FEATURE_GROUPS["structure"])


def feat_regime(spark, d):
    bars = ind.volatility(ind.returns(hourly(spark, d), (1, 5, 20)))
    bars = feat.ewm(bars, {"ema20": ("close", 2 / 21)})
    bars = bars.withColumns({"ema20_gap": F.col("close") / F.col("ema20") - 1,
                             "ema20_slope": feat.change(F.col("ema20"), 5) / 5})
    return show(feat.regime_features(bars), "symbol", "ts", *FEATURE_GROUPS["regime"])


def feat_catalogue(spark, d):
    groups = {"price": ["return_1", "gap", "high_position_20"], "volume": ["volume_zscore", "flow_pressure"]}
    bars = feat.volume_features(feat.price_features(ind.volume_set(hourly(spark, d))))
    return show(feat.catalogue(bars, groups), "symbol", "ts", "feature_group", "feature_name", "value")


PANEL_COLS = ["return_1", "return_5", "return_20", "high_position_20", "volume_zscore", "flow_pressure"]


def _panel(spark, d):
    bars = feat.volume_features(feat.price_features(ind.volume_set(daily(spark, d))))
    return feat.panel(bars, 5, PANEL_COLS)


def panel_zscores(spark, d):
    return show(_panel(spark, d), "symbol", "ts", "session_date", *[f"z_{c}" for c in PANEL_COLS])


def panel_targets(spark, d):
    return show(_panel(spark, d), "symbol", "ts", "target_time", "future_return", "future_max_drawdown",
                "relative_return_5", "relative_return_20", "alpha_target")


def label_three_class(spark, d):
    df = feat.three_class_label(ind.atr_sma(hourly(spark, d)), 4).filter("label is not null")
    return show(df.withColumn("label", F.col("label").cast("long")), "symbol", "ts", "target_time", "threshold", "future_return", "label")


def _assets(spark, d):
    kinds = hourly(spark, d).select("symbol").distinct()
    # Event types stand in for one asset of each profile.
    code = F.create_map(*[F.lit(x) for x in ("view", "BTC/USDT", "click", "ETH-USDT", "purchase", "SOL", "signup", "600519.SH", "error", "NVDA")])
    return kinds.select("symbol", code[F.col("symbol")].alias("code"),
                        F.when(F.col("symbol").isin("signup", "error"), "stock").otherwise("crypto").alias("asset_type"))


def asset_profiles(spark, d):
    df = feat.asset_profile(hourly(spark, d), _assets(spark, d))
    return df.withColumns({c: F.col(c).cast("long") for c in ("max_depth", "min_leaf")})


def regime_labels(spark, d):
    bars = ind.volatility(ind.returns(ind.moving_averages(numbered(hourly(spark, d)), (20,)), (1,)))
    bars = bars.withColumns({"ma20_gap": F.col("close") / F.col("ma20") - 1, "rows": F.count(F.lit(1)).over(whole())})
    bars = bars.select("symbol", "ts", "n", "rows", "volatility", "ma20_gap")
    return feat.regime_labels(bars, bars.filter("n < rows * 0.6")).select("symbol", "ts", "regime")


def regime_five_way(spark, d):
    bars = numbered(hourly(spark, d)).withColumn("rows", F.count(F.lit(1)).over(whole()))
    bars = ind.volatility(ind.returns(bars, (1, 5, 20)))
    bars = feat.ewm(bars, {"ema20": ("close", 2 / 21)})
    bars = bars.withColumns({"ema20_gap": F.col("close") / F.col("ema20") - 1, "ema20_slope": feat.change(F.col("ema20"), 5) / 5})
    bars = feat.regime_features(bars).select("symbol", "ts", "n", "rows", "volatility", "regime_trend", "regime_high_vol")
    out = feat.research_regime(bars.filter("n >= rows * 0.6"), bars.filter("n < rows * 0.6"))
    return out.groupBy("symbol", "research_regime").agg(F.count(F.lit(1)).alias("bars"))


# --- SQL ------------------------------------------------------------------------

PR = ["p AS (SELECT *, lag(close) OVER w AS pc, " + ", ".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}" for n in (1, 3, 5, 10, 20))
      + f", ln(close / lag(close) OVER w) AS log_return, {TR} AS tr FROM c {WIN})"]


def pos(n: int) -> str:
    lo, hi = roll("min({})", "low", n), roll("max({})", "high", n)
    return f"(close - {lo}) / nullif({hi} - {lo}, 0)"


PRICE_SQL = {**{f"return_{n}": f"return_{n}" for n in (1, 3, 5, 10, 20)}, "log_return": "log_return", "gap": "open / pc - 1",
             "high_low_range": "(high - low) / pc", "close_open": "close / nullif(open, 0) - 1", "true_range": "tr / pc",
             "realized_volatility": f"{roll('stddev_samp({})', 'log_return', 20)} * sqrt(252)",
             "historical_volatility": f"{roll('stddev_samp({})', 'return_1', 60)} * sqrt(252)",
             **{f"high_position_{n}": pos(n) for n in (20, 60, 120)}}

FLOW = ("greatest(coalesce(sign(tp - lag(tp) OVER w), 0) * tp * volume, 0)", "greatest(-coalesce(sign(tp - lag(tp) OVER w), 0) * tp * volume, 0)")
TECH_CTES = [*RSI_CTES, *macd_ctes("2"), *ADX_CTES, *[ewm_sql(f"x{n}", "c", "close", f"(2.0/{n + 1})") for n in (5, 10, 20, 50, 100, 200)],
             "t0 AS (SELECT *, (high+low+close)/3 AS tp FROM c)",
             f"t1 AS (SELECT *, {FLOW[0]} AS fin, {FLOW[1]} AS fout, {TR} AS tr FROM t0 {WIN})",
             "dev AS (SELECT a.symbol, a.ts, avg(abs(b.tp - a.m)) AS md FROM (SELECT symbol, ts, row_number() OVER w AS i, CASE WHEN count(*) " + rows(20)
             + " = 20 THEN avg(tp) " + rows(20) + " END AS m FROM t0 " + WIN + ") a JOIN (SELECT symbol, tp, row_number() OVER w AS i FROM t0 " + WIN
             + ") b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 19 AND a.i GROUP BY 1, 2)",
             f"""t2 AS (SELECT symbol, ts, close, tp, volume, {roll('avg({})', 'close', 5)} AS ma5, {roll('avg({})', 'close', 20)} AS ma20, {roll('stddev_samp({})', 'close', 20)} AS sd,
               {roll('avg({})', 'tr', 14)} AS atr, {roll('avg({})', 'tp', 20)} AS tpm, {roll('min({})', 'low', 14)} AS lo14, {roll('max({})', 'high', 14)} AS hi14,
               {roll('sum({})', 'fin', 14)} AS f1, {roll('sum({})', 'fout', 14)} AS f2, close / nullif(lag(close, 12) {W}, 0) - 1 AS r12 FROM t1)""",
             "t3 AS (SELECT * FROM t2 JOIN mm USING (symbol, ts) JOIN rs USING (symbol, ts) LEFT JOIN adx USING (symbol, ts) JOIN dev USING (symbol, ts) "
             + " ".join(f"JOIN x{n} USING (symbol, ts)" for n in (5, 10, 20, 50, 100, 200)) + ")"]
TECH_SQL = {"rsi": "rsi", "rsi_slope": f"(rsi - lag(rsi, 3) {W}) / 3", "macd": "macd", "macd_signal": "signal", "macd_hist": "hist",
            "macd_slope": f"(macd - lag(macd, 3) {W}) / 3", "atr": "atr", "adx": "adx", "cci": "(tp - tpm) / nullif(0.015 * md, 0)",
            "stoch_k": "(close - lo14) / nullif(hi14 - lo14, 0) * 100", "williams_r": "(hi14 - close) / nullif(hi14 - lo14, 0) * -100",
            "roc": "r12 * 100", "mfi": "100 - 100 / (1 + f1 / nullif(f2, 0))", "boll_position": "(close - (ma20 - 2*sd)) / nullif(4*sd, 0)",
            "boll_width": "CASE WHEN sd <> 0 THEN 4*sd / ma20 END", "ema5_gap": "close / x5 - 1", "ema10_gap": "close / x10 - 1", "ma20_gap": "close / ma20 - 1",
            "ema50_gap": "close / x50 - 1", "ema100_gap": "close / x100 - 1", "ema200_gap": "close / x200 - 1",
            "ema20_slope": f"(x20 / lag(x20, 5) {W} - 1) / 5", "ma5_gap": "close / ma5 - 1", "ema20_gap": "close / x20 - 1"}

VOL_CTES = [f"""v0 AS (SELECT *, (high+low+close)/3*volume AS tv, close - lag(close) OVER w AS dc, close / nullif(lag(close) OVER w, 0) - 1 AS return_1,
  volume / nullif(lag(volume) OVER w, 0) - 1 AS vr, lag(volume, 5) OVER w AS v5, sign(close / nullif(lag(close, 5) OVER w, 0) - 1) AS s5 FROM c {WIN})""",
            f"v1 AS (SELECT *, coalesce(sign(dc), 0) * volume AS sv, sum(coalesce(sign(dc), 0) * volume) {RUN} AS obv, CASE WHEN return_1 IS NOT NULL AND vr IS NOT NULL THEN vr END AS pr FROM v0)",
            f"v2 AS (SELECT *, (volume - {roll('avg({})', 'volume', 20)}) / nullif({roll('stddev_samp({})', 'volume', 20)}, 0) AS z, "
            f"CASE WHEN count(pr) {rows(20)} = 20 THEN corr(return_1, vr) {rows(20)} END AS cr FROM v1)"]
VOLUME_SQL = {"volume_change": "vr * 100", "volume_ratio": f"volume / nullif({roll('avg({})', 'volume', 20)}, 0)", "volume_zscore": "z",
              "relative_volume": f"volume / nullif({roll('median({})', 'volume', 60)}, 0)", "obv_change": f"obv / nullif(lag(obv, 5) {W}, 0) - 1",
              "money_flow": f"tv / nullif(lag(tv, 5) {W}, 0) - 1", "price_volume_corr": "CASE WHEN NOT isnan(cr) THEN cr END",
              "vwap_deviation": f"close / ({roll('sum({})', 'tv', 20)} / nullif({roll('sum({})', 'volume', 20)}, 0)) - 1",
              "volume_trend": f"{roll('avg({})', 'volume', 5)} / nullif({roll('avg({})', 'volume', 20)}, 0) - 1",
              "volume_divergence": "-s5 * CASE WHEN v5 <> 0 OR volume <> 0 THEN sign(volume - v5) END",
              "abnormal_volume": "CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END",
              "flow_pressure": f"{roll('sum({})', 'sv', 20, least=5)} / nullif({roll('sum({})', 'volume', 20, least=5)}, 0)"}

PAST3 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
NEXT3 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
SWING_CTE = f"""sw AS (SELECT *, row_number() {W} - 1 AS n,
  count(*) {PAST3} = 3 AND count(*) {NEXT3} = 3 AND high > max(high) {PAST3} AND high >= max(high) {NEXT3} AS is_high,
  count(*) {PAST3} = 3 AND count(*) {NEXT3} = 3 AND low < min(low) {PAST3} AND low <= min(low) {NEXT3} AS is_low FROM c)"""
STRUCT_CTES = [SWING_CTE,
               f"""s1 AS (SELECT *, lag(CASE WHEN is_high THEN n END, 3) {W} AS hn, lag(CASE WHEN is_high THEN high END, 3) {W} AS hp,
  lag(CASE WHEN is_low THEN n END, 3) {W} AS ln, lag(CASE WHEN is_low THEN low END, 3) {W} AS lp, lag(close) {W} AS pc,
  lag(high, 2) {W} AS h2, lag(low, 2) {W} AS l2, {TR.replace('OVER w', W)} AS tr FROM sw)""",
               f"""s2 AS (SELECT *, last_value(hn IGNORE NULLS) {RUN} AS bh, last_value(hp IGNORE NULLS) {RUN} AS top,
  last_value(ln IGNORE NULLS) {RUN} AS bl, last_value(lp IGNORE NULLS) {RUN} AS bot, {roll('avg({})', 'tr', 14)} AS atr FROM s1)"""]
STRUCT_SQL = {"causal_bos": "CASE WHEN pc <= top AND top < close THEN 1 WHEN pc >= bot AND bot > close THEN -1 ELSE 0 END",
              "fvg_imbalance": "CASE WHEN h2 < low THEN 1 WHEN l2 > high THEN -1 ELSE 0 END",
              "fib_0618_distance": "CASE WHEN top > bot THEN (close - CASE WHEN bh > bl THEN top - 0.618*(top-bot) ELSE bot + 0.618*(top-bot) END) / nullif(atr, 0) END"}

REG_CTES = [ewm_sql("x20", "c", "close", "(2.0/21)"),
            f"g0 AS (SELECT c.symbol, c.ts, close / x20 - 1 AS gap, (x20 / lag(x20, 5) OVER w - 1) / 5 AS slope, "
            + ", ".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}" for n in (1, 5, 20))
            + " FROM c JOIN x20 USING (symbol, ts) WINDOW w AS (PARTITION BY c.symbol ORDER BY c.ts))",
            f"g1 AS (SELECT *, {roll('stddev_samp({})', 'return_1', 20)} AS vol, row_number() {W} - 1 AS n, count(*) OVER (PARTITION BY symbol) AS rows FROM g0)",
            f"g2 AS (SELECT *, {roll('quantile_cont({}, 0.75)', 'vol', 120, -1, 30)} AS cut, {roll('avg({})', 'return_5', 20, 0, 5)} AS mom FROM g1)"]
REG_SQL = {"volatility": "vol", "regime_trend": "tanh(slope * 100)", "regime_high_vol": "CASE WHEN vol > cut THEN 1 ELSE 0 END",
           "regime_risk_on": "CASE WHEN gap > 0 AND return_20 > 0 THEN 1 WHEN gap < 0 AND return_20 < 0 THEN -1 ELSE 0 END",
           "sentiment_score": "coalesce(CASE WHEN mom / nullif(vol, 0) > 3 THEN 3 WHEN mom / nullif(vol, 0) < -3 THEN -3 ELSE mom / nullif(vol, 0) END, 0) / 3"}

CAT = {"return_1": ("price", "close / nullif(pc, 0) - 1"), "gap": ("price", "open / nullif(pc, 0) - 1"), "high_position_20": ("price", pos(20)),
       "volume_zscore": ("volume", "z"), "flow_pressure": ("volume", VOLUME_SQL["flow_pressure"])}
CAT_SQL = q(HOURLY_SQL, *VOL_CTES, f"k AS (SELECT *, lag(close) {W} AS pc FROM v2)",
            "l AS (" + " UNION ALL ".join(f"SELECT symbol, ts, '{g}' AS feature_group, '{n}' AS feature_name, {e} AS v FROM k" for n, (g, e) in CAT.items()) + ")",
            final=f"SELECT symbol, ts, feature_group, feature_name, {R('v')} AS value FROM l WHERE v IS NOT NULL")

PANEL_CTES = [DAILY_SQL, *VOL_CTES, f"""pa AS (SELECT symbol, ts, close, low, {', '.join(f'close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}f' for n in (1, 5, 20))},
  {pos(20)} AS high_position_20, z AS volume_zscore, {VOLUME_SQL['flow_pressure']} AS flow_pressure, lead(ts, 5) OVER w AS target_time,
  lead(close, 5) OVER w / close - 1 AS future_return,
  min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / close - 1 AS dd FROM v2 {WIN})""",
              """pb AS (SELECT symbol, ts, CAST(ts AS DATE) AS session_date, target_time, future_return, dd AS future_max_drawdown, return_1f AS return_1, return_5f AS return_5,
  return_20f AS return_20, high_position_20, volume_zscore, flow_pressure FROM pa WHERE target_time IS NOT NULL AND return_20f IS NOT NULL AND high_position_20 IS NOT NULL
  AND volume_zscore IS NOT NULL AND flow_pressure IS NOT NULL AND return_1f IS NOT NULL AND return_5f IS NOT NULL)"""]
X = "OVER (PARTITION BY session_date)"


def zsql(c: str) -> str:
    return f"least(5, greatest(-5, coalesce(({c} - avg({c}) {X}) / nullif(stddev_samp({c}) {X}, 0), 0)))"


LABEL_SQL = q(HOURLY_SQL, f"t AS (SELECT *, {TR} AS tr FROM c {WIN})", f"a AS (SELECT *, {roll('avg({})', 'tr', 14)} / close AS sh FROM t)",
              f"""b AS (SELECT symbol, ts, lead(ts, 4) {W} AS target_time, lead(close, 4) {W} / close - 1 AS fr,
  least(0.018, greatest(0.001, 0.28 * ({roll('median({})', 'sh', 180, -1, 30)}))) AS th, count(sh) {rows(180, -1)} AS k FROM a)""",
              final=f"""SELECT symbol, ts, target_time, {R('th')} AS threshold, {R('fr')} AS future_return,
  CAST(CASE WHEN fr > th THEN 1 WHEN fr < -th THEN -1 ELSE 0 END AS BIGINT) AS label FROM b WHERE k >= 30 AND fr IS NOT NULL""")

PROFILE_SQL = q(HOURLY_SQL, "l AS (SELECT symbol, close * volume AS t FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100)",
                "m AS (SELECT symbol, median(t) AS t FROM l GROUP BY 1)",
                final="""SELECT symbol, CASE symbol WHEN 'view' THEN 'BTC' WHEN 'click' THEN 'ETH' WHEN 'purchase' THEN 'MAJOR_ALTCOIN' WHEN 'signup' THEN 'CN_EQUITY' ELSE 'US_EQUITY' END AS profile,
  CAST(CASE WHEN symbol IN ('view','click') THEN 8 ELSE 7 END AS BIGINT) AS max_depth,
  CAST(CASE WHEN symbol IN ('view','click') THEN 3 WHEN symbol = 'purchase' THEN 6 ELSE 5 END AS BIGINT) AS min_leaf,
  CAST(CASE WHEN symbol IN ('view','click') THEN 0.85 WHEN symbol = 'purchase' THEN 0.75 ELSE 0.82 END AS DOUBLE) AS subsample,
  CAST(CASE symbol WHEN 'click' THEN 0.97 WHEN 'purchase' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence_factor,
  CAST(CASE symbol WHEN 'purchase' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS slippage_factor,
  CASE WHEN symbol IN ('view','click','purchase') THEN round(t, 2) END AS median_turnover FROM m""")

REGIME_SQL = q(HOURLY_SQL, f"t AS (SELECT symbol, ts, close, {roll('avg({})', 'close', 20)} AS ma20, close / nullif(lag(close) {W}, 0) - 1 AS ret, row_number() {W} - 1 AS n, count(*) OVER (PARTITION BY symbol) AS rows FROM c)",
               f"u AS (SELECT *, {roll('stddev_samp({})', 'ret', 20)} AS vol FROM t)", "k AS (SELECT symbol, quantile_cont(vol, 0.75) AS cut FROM u WHERE n < rows * 0.6 GROUP BY 1)",
               final="SELECT symbol, ts, CASE WHEN vol >= cut THEN 'HIGH_VOL' WHEN close / ma20 - 1 > 0.005 THEN 'BULL' WHEN close / ma20 - 1 < -0.005 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime FROM u JOIN k USING (symbol)")

FIVE_SQL = q(HOURLY_SQL, *REG_CTES, "k AS (SELECT quantile_cont(vol, 0.25) AS lo FROM g2 WHERE n < rows * 0.6)",
             "f AS (SELECT symbol, CASE WHEN vol > cut THEN 'HIGH_VOL' WHEN tanh(slope*100) > 0.15 THEN 'BULL' WHEN tanh(slope*100) < -0.15 THEN 'BEAR' WHEN vol < lo THEN 'LOW_VOL' ELSE 'SIDEWAYS' END AS research_regime FROM g2, k WHERE n >= rows * 0.6)",
             final="SELECT symbol, research_regime, count(*) AS bars FROM f GROUP BY 1, 2")

QUERIES = {
    "feat_price": (feat_price, q(HOURLY_SQL, *PR, final=sel(PRICE_SQL, "p"))),
    "feat_technical": (feat_technical, q(*TECH_CTES, final=sel(TECH_SQL, "t3"))),
    "feat_volume": (feat_volume, q(HOURLY_SQL, *VOL_CTES, final=sel(VOLUME_SQL, "v2"))),
    "feat_structure": (feat_structure, q(HOURLY_SQL, *STRUCT_CTES, final=sel(STRUCT_SQL, "s2"))),
    "feat_regime": (feat_regime, q(HOURLY_SQL, *REG_CTES, final=sel(REG_SQL, "g2"))),
    "feat_catalogue": (feat_catalogue, CAT_SQL),
    "panel_zscores": (panel_zscores, q(*PANEL_CTES, final="SELECT symbol, ts, session_date, " + ", ".join(f"{R(zsql(c))} AS z_{c}" for c in PANEL_COLS) + " FROM pb")),
    "panel_targets": (panel_targets, q(*PANEL_CTES, final=f"""SELECT symbol, ts, target_time, {R('future_return')} AS future_return, {R('future_max_drawdown')} AS future_max_drawdown,
  {R(f'return_5 - median(return_5) {X}')} AS relative_return_5, {R(f'return_20 - median(return_20) {X}')} AS relative_return_20,
  {R(f'future_return - avg(future_return) {X}')} AS alpha_target FROM pb""")),
    "label_three_class": (label_three_class, LABEL_SQL),
    "asset_profiles": (asset_profiles, PROFILE_SQL),
    "regime_labels": (regime_labels, REGIME_SQL),
    "regime_five_way": (regime_five_way, FIVE_SQL),
}
