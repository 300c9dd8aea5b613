"""Candle construction and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.series import latest
from tapeline.operators import candles, indicators as ind
from tapeline.plans.base import (BRAND_TRADES_SQL, DAILY_SQL, HOURLY_SQL, R, RUN, TRADES_SQL, W, bars_sql, brand_trades,
                                 daily, ewm_sql, hourly, r, roll, rows, show, trades)

BAR_COLS = ("symbol", "interval", "ts", "open", "high", "low", "close", "volume", "amount")
BAR_SELECT = (f"SELECT symbol, '{{}}' AS interval, ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, "
              f"{R('close')} AS close, {R('volume', 4)} AS volume, {R('amount', 2)} AS amount FROM {{}}")


def _bars(df):
    return show(df, *BAR_COLS, volume=4, amount=2)


def candles_1h(spark, d):
    return _bars(hourly(spark, d))


def candles_4h(spark, d):
    return _bars(candles.resample(hourly(spark, d), "4h"))


def candles_1d_brand(spark, d):
    return _bars(daily(spark, d))


def candles_weekly(spark, d):
    return _bars(candles.weekly(daily(spark, d)))


def candles_fan_out(spark, d):
    return _bars(candles.fan_out(trades(spark, d), ["1m", "5m", "15m", "30m", "1h", "4h", "1d"]))


def candles_newest(spark, d):
    return _bars(candles.newest(hourly(spark, d), 60))


def candles_time_range(spark, d):
    return _bars(candles.between(hourly(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00", 200))


def volume_profile(spark, d):
    return show(candles.volume_profile(daily(spark, d)), "symbol", "bin", "rank", "price", "weight", price=3, weight=0)


def quote_fallback(spark, d):
    bars = hourly(spark, d)
    quotes = (bars.filter("symbol in ('view', 'click')").groupBy("symbol")
              .agg(F.max_by("high", "ts").alias("price"), F.max_by("low", "ts").alias("prev_price")))
    return show(candles.quotes_or_last_bar(quotes, bars), "symbol", "price", "change", "change_percent", "origin", "bar_ts")


WEEKLY_SQL = f"""WITH {DAILY_SQL},
 wk AS (SELECT *, CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS we FROM c),
 g AS (SELECT symbol, we, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
   sum(volume) AS volume, sum(amount) AS amount, max(ts) AS last_ts FROM wk GROUP BY 1, 2),
 w AS (SELECT symbol, CASE WHEN we = max(we) OVER (PARTITION BY symbol) THEN last_ts ELSE CAST(we AS TIMESTAMP) END AS ts,
   open, high, low, close, volume, amount FROM g) {BAR_SELECT.format('1w', 'w')}"""

FAN_SQL = (f"WITH {TRADES_SQL}, "
           + ", ".join(bars_sql(f"c{m}", m) for m in (1, 5, 15, 30, 60, 240, 1440)) + " "
           + " UNION ALL ".join(BAR_SELECT.format(k, f"c{m}") for k, m in
                                (("1m", 1), ("5m", 5), ("15m", 15), ("30m", 30), ("1h", 60), ("4h", 240), ("1d", 1440))))

PROFILE_SQL = f"""WITH {DAILY_SQL},
 b AS (SELECT symbol, (high+low+close)/3 AS p, greatest(CASE WHEN amount > 0 THEN amount ELSE (high+low+close)/3*volume END, 0) AS w FROM c),
 s AS (SELECT symbol, min(p) AS lo, max(p) AS hi, least(30, greatest(10, count(*) // 20)) AS bins FROM b GROUP BY 1),
 h AS (SELECT b.symbol, CAST(least(bins - 1, floor((p - lo) / ((hi - lo) / bins))) AS BIGINT) AS bin, any_value(lo) AS lo,
   any_value((hi - lo) / bins) AS step, sum(w) AS weight FROM b JOIN s USING (symbol) GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, bin) AS rank FROM h)
 SELECT symbol, bin, rank, {R('lo + (bin + 0.5) * step', 3)} AS price, {R('weight', 0)} AS weight FROM k WHERE rank <= 6"""

QUOTE_SQL = f"""WITH {HOURLY_SQL},
 l AS (SELECT symbol, arg_max(close, ts) AS bp, max(ts) AS bar_ts, arg_max(high, ts) AS qp, arg_max(low, ts) AS qprev FROM c GROUP BY 1),
 p AS (SELECT symbol, arg_max(prev, ts) AS bprev FROM (SELECT symbol, ts, lag(close) {W} AS prev FROM c) GROUP BY 1),
 f AS (SELECT symbol, bar_ts, CASE WHEN symbol IN ('view','click') THEN qp ELSE bp END AS price,
   CASE WHEN symbol IN ('view','click') THEN qprev ELSE bprev END AS prev,
   CASE WHEN symbol IN ('view','click') THEN 'quote' ELSE 'last_bar' END AS origin FROM l JOIN p USING (symbol))
 SELECT symbol, {R('price')} AS price, {R('price - prev')} AS change, {R('price / prev * 100 - 100')} AS change_percent, origin, bar_ts FROM f"""


# --- indicators ---------------------------------------------------------------


def ind_moving_averages(spark, d):
    return show(ind.moving_averages(hourly(spark, d)), "symbol", "ts", "ma5", "ma10", "ma20", "ma60")


def ind_bollinger(spark, d):
    return show(ind.bollinger(hourly(spark, d)), "symbol", "ts", "boll_mid", "boll_upper", "boll_lower")


def ind_atr_vwap_obv(spark, d):
    df = ind.volume_set(ind.vwap(ind.atr_sma(hourly(spark, d))))
    return show(df, "symbol", "ts", "tr", "atr", "vwap", "obv", "volume_ma20", "volume_ratio", "volume_change")


def ind_returns(spark, d):
    return show(ind.volatility(ind.returns(hourly(spark, d))), "symbol", "ts", "return_1", "return_3", "return_5", "volatility")


def ind_macd(spark, d):
    return show(ind.macd(hourly(spark, d)), "symbol", "ts", "ema12", "ema26", "macd", "macd_signal", "macd_hist")


def ind_rsi(spark, d):
    return show(ind.rsi(hourly(spark, d)), "symbol", "ts", "rsi")


def ind_kdj(spark, d):
    return show(ind.kdj(hourly(spark, d)), "symbol", "ts", "kdj_k", "kdj_d", "kdj_j")


def ind_adx(spark, d):
    return show(ind.adx(hourly(spark, d)), "symbol", "ts", "adx")


def ind_payload(spark, d):
    cols = ["ma5", "ma20", "boll_mid", "volume_ma20", "obv"]
    df = ind.volume_set(ind.bollinger(ind.moving_averages(hourly(spark, d), (5, 20))))
    return show(ind.payload(df, cols), "symbol", "ts", *cols)


def ind_score(spark, d):
    df = ind.rsi(ind.macd(ind.volume_set(ind.moving_averages(hourly(spark, d), (20,)))))
    return ind.indicator_score(df).select("symbol", "ts", F.col("score").cast("long").alias("score"))


def sx_averages(spark, d):
    df = ind.sx_averages(hourly(spark, d))
    return show(df, "symbol", "ts", *[f"sx_{k}{n}" for n in (20, 50, 100, 200) for k in ("sma", "ema")], "sx_wma20")


def sx_macd(spark, d):
    return show(ind.macd(hourly(spark, d), 1.0, "sx_"), "symbol", "ts", "sx_macd", "sx_macd_signal", "sx_macd_hist")


def sx_atr_adx(spark, d):
    return show(ind.adx(ind.sx_atr(hourly(spark, d)), "sx_adx"), "symbol", "ts", "sx_atr", "sx_atr_percent", "sx_adx")


def sx_bands(spark, d):
    return show(ind.sx_bands(hourly(spark, d)), "symbol", "ts", "sx_boll_width", "sx_boll_percent_b")


def sx_oscillators(spark, d):
    df = ind.sx_momentum(ind.sx_mfi(ind.sx_stochastic(hourly(spark, d))))
    return show(df, "symbol", "ts", "sx_stoch_k", "sx_stoch_d", "sx_mfi", "sx_roc", "sx_momentum", "sx_acceleration")


def sx_volume(spark, d):
    return show(ind.sx_volume(hourly(spark, d)), "symbol", "ts", "sx_volume_ratio", "sx_obv")


def sx_donchian(spark, d):
    return show(ind.sx_channels(hourly(spark, d)), "symbol", "ts",
                *[f"sx_donchian_{k}_{n}" for n in (20, 55, 100) for k in ("upper", "lower")])


def sx_parabolic_sar(spark, d):
    return show(ind.parabolic_sar(hourly(spark, d).select("symbol", "interval", "ts", "high", "low", "close")),
                "symbol", "ts", "sx_psar", "sx_psar_trend")


TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"
WIN = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def sel(items: dict[str, str], source: str = "c", places: dict[str, int] | None = None, tail: str = "") -> str:
    places = places or {}
    return ("SELECT symbol, ts, " + ", ".join(f"{R(e, places.get(k, 6))} AS {k}" for k, e in items.items())
            + f" FROM {source} {tail}")


def q(*ctes: str, final: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + final


DELTA = ("dl AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS delta FROM c), "
         "gl AS (SELECT symbol, ts, CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0.0 END AS gain, "
         "CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0.0 END AS loss FROM dl)")
RSI_CTES = [HOURLY_SQL, DELTA, ewm_sql("eg", "gl", "gain", "(1.0/14)"), ewm_sql("el", "gl", "loss", "(1.0/14)"),
            "rs AS (SELECT c.symbol, c.ts, coalesce(100 - 100 / (1 + eg / nullif(el, 0)), 50) AS rsi FROM c "
            "LEFT JOIN eg USING (symbol, ts) LEFT JOIN el USING (symbol, ts))"]


def macd_ctes(scale: str) -> list[str]:
    return [ewm_sql("e12", "c", "close", "(2.0/13)"), ewm_sql("e26", "c", "close", "(2.0/27)"),
            "md AS (SELECT symbol, ts, e12, e26, e12 - e26 AS macd FROM e12 JOIN e26 USING (symbol, ts))",
            ewm_sql("sg", "md", "macd", "0.2"),
            f"mm AS (SELECT symbol, ts, e12, e26, macd, sg AS signal, (macd - sg) * {scale} AS hist FROM md JOIN sg USING (symbol, ts))"]


TRC = f"trc AS (SELECT symbol, ts, {TR} AS tr FROM c {WIN})"
ADX_CTES = [
    TRC,
    "mv AS (SELECT symbol, ts, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM c " + WIN + ")",
    "dm AS (SELECT symbol, ts, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM mv)",
    ewm_sql("ea", "trc", "tr", "(1.0/14)"), ewm_sql("ep", "dm", "pdm", "(1.0/14)"), ewm_sql("em", "dm", "mdm", "(1.0/14)"),
    "dx AS (SELECT symbol, ts, 100 * abs(100*ep/nullif(ea,0) - 100*em/nullif(ea,0)) / nullif(100*ep/nullif(ea,0) + 100*em/nullif(ea,0), 0) AS dx "
    "FROM ea JOIN ep USING (symbol, ts) JOIN em USING (symbol, ts))",
    ewm_sql("adx", "dx", "dx", "(1.0/14)")]

SAR_SQL = f"""WITH RECURSIVE {HOURLY_SQL},
 o AS (SELECT symbol, ts, high, low, close, row_number() {W} AS i, lag(high, 1) {W} AS h1, lag(high, 2) {W} AS h2,
   lag(low, 1) {W} AS l1, lag(low, 2) {W} AS l2 FROM c),
 s AS (SELECT symbol, ts, close, i, low AS sar, TRUE AS up, high AS ep, CAST(0.02 AS DOUBLE) AS af FROM o WHERE i = 1
  UNION ALL
  SELECT symbol, ts, close, i, CASE WHEN flip THEN ep ELSE cand END,
    CASE WHEN flip THEN NOT up ELSE up END,
    CASE WHEN flip THEN (CASE WHEN up THEN low ELSE high END) WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN flip THEN 0.02 WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(0.2, af + 0.02) ELSE af END
  FROM (SELECT *, CASE WHEN up THEN low < cand ELSE high > cand END AS flip FROM (
    SELECT o.symbol, o.ts, o.close, o.i, o.high, o.low, s.up, s.ep, s.af,
      CASE WHEN s.up THEN least(s.sar + s.af * (s.ep - s.sar), l1, coalesce(l2, l1))
           ELSE greatest(s.sar + s.af * (s.ep - s.sar), h1, coalesce(h2, h1)) END AS cand
    FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1)))
 SELECT symbol, ts, {R('sar')} AS sx_psar, CASE WHEN close >= sar THEN 1 ELSE -1 END AS sx_psar_trend FROM s"""

OBV = f"sum(sign(coalesce(d, 0)) * volume) {RUN}"

QUERIES = {
    "candles_1h": (candles_1h, f"WITH {HOURLY_SQL} {BAR_SELECT.format('1h', 'c')}"),
    "candles_4h": (candles_4h, f"WITH {TRADES_SQL}, {bars_sql('c', 240)} {BAR_SELECT.format('4h', 'c')}"),
    "candles_1d_brand": (candles_1d_brand, f"WITH {DAILY_SQL} {BAR_SELECT.format('1d', 'c')}"),
    "candles_weekly": (candles_weekly, WEEKLY_SQL),
    "candles_fan_out": (candles_fan_out, FAN_SQL),
    "candles_newest": (candles_newest, f"WITH {HOURLY_SQL}, n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60) {BAR_SELECT.format('1h', 'n')}"),
    "candles_time_range": (candles_time_range, f"WITH {HOURLY_SQL}, n AS (SELECT * FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' QUALIFY count(*) OVER (PARTITION BY symbol) >= 200) {BAR_SELECT.format('1h', 'n')}"),
    "volume_profile": (volume_profile, PROFILE_SQL),
    "quote_fallback": (quote_fallback, QUOTE_SQL),
    "ind_moving_averages": (ind_moving_averages, q(HOURLY_SQL, final=sel({f"ma{n}": roll("avg({})", "close", n) for n in (5, 10, 20, 60)}))),
    "ind_bollinger": (ind_bollinger, q(HOURLY_SQL, f"b AS (SELECT symbol, ts, {roll('avg({})', 'close', 20)} AS m, {roll('stddev_samp({})', 'close', 20)} AS s FROM c)",
                                       final=sel({"boll_mid": "m", "boll_upper": "m + 2*s", "boll_lower": "m - 2*s"}, "b"))),
    "ind_atr_vwap_obv": (ind_atr_vwap_obv, q(
        HOURLY_SQL, f"t AS (SELECT *, {TR} AS tr, close - lag(close) OVER w AS d, lag(volume) OVER w AS pv FROM c {WIN})",
        final=sel({"tr": "tr", "atr": roll("avg({})", "tr", 14), "vwap": f"sum((high+low+close)/3*volume) {RUN} / nullif(sum(volume) {RUN}, 0)",
                   "obv": OBV, "volume_ma20": roll("avg({})", "volume", 20),
                   "volume_ratio": f"volume / nullif({roll('avg({})', 'volume', 20)}, 0)", "volume_change": "(volume / nullif(pv, 0) - 1) * 100"}, "t"))),
    "ind_returns": (ind_returns, q(HOURLY_SQL, f"t AS (SELECT symbol, ts, {', '.join(f'close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}' for n in (1, 3, 5))} FROM c {WIN})",
                                   final=sel({"return_1": "return_1", "return_3": "return_3", "return_5": "return_5", "volatility": roll("stddev_samp({})", "return_1", 20)}, "t"))),
    "ind_macd": (ind_macd, q(HOURLY_SQL, *macd_ctes("2"), final=sel({"ema12": "e12", "ema26": "e26", "macd": "macd", "macd_signal": "signal", "macd_hist": "hist"}, "mm"))),
    "ind_rsi": (ind_rsi, q(*RSI_CTES, final=sel({"rsi": "rsi"}, "rs"))),
    "ind_kdj": (ind_kdj, q(HOURLY_SQL, f"rv AS (SELECT symbol, ts, coalesce((close - {roll('min({})', 'low', 9)}) / nullif({roll('max({})', 'high', 9)} - {roll('min({})', 'low', 9)}, 0) * 100, 50) AS rsv FROM c)",
                           ewm_sql("k", "rv", "rsv", "(1.0/3)"), ewm_sql("kd", "k", "k", "(1.0/3)"),
                           final=sel({"kdj_k": "k", "kdj_d": "kd", "kdj_j": "3*k - 2*kd"}, "k JOIN kd USING (symbol, ts)"))),
    "ind_adx": (ind_adx, q(HOURLY_SQL, *ADX_CTES, final=sel({"adx": "adx"}, "c LEFT JOIN adx USING (symbol, ts)"))),
    "ind_payload": (ind_payload, q(HOURLY_SQL, "t AS (SELECT *, close - lag(close) OVER w AS d FROM c " + WIN + ")",
                                   final=sel({"ma5": roll("avg({})", "close", 5), "ma20": roll("avg({})", "close", 20), "boll_mid": roll("avg({})", "close", 20),
                                              "volume_ma20": roll("avg({})", "volume", 20), "obv": OBV}, "t"))),
    "ind_score": (ind_score, q(*RSI_CTES, *macd_ctes("2"),
                               f"t AS (SELECT c.symbol, c.ts, close, volume, {roll('avg({})', 'close', 20)} AS ma20, (volume / nullif(lag(volume) {W}, 0) - 1) * 100 AS vc FROM c)",
                               final="""SELECT symbol, ts, CAST(greatest(0, least(100, 50 + CASE WHEN close > ma20 THEN 12 ELSE 0 END + CASE WHEN macd > signal THEN 12 ELSE 0 END
                               + CASE WHEN rsi BETWEEN 45 AND 65 THEN 8 WHEN rsi > 75 THEN -8 ELSE 0 END + CASE WHEN vc > 10 THEN 6 ELSE 0 END)) AS BIGINT) AS score
                               FROM t JOIN mm USING (symbol, ts) JOIN rs USING (symbol, ts) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")),
    "sx_averages": (sx_averages, q(HOURLY_SQL, *[ewm_sql(f"e{n}", "c", "close", f"(2.0/{n + 1})") for n in (20, 50, 100, 200)],
                                   "wm AS (SELECT symbol, ts, CASE WHEN count(*) " + rows(20) + " = 20 THEN (" + " + ".join(f"{20 - k} * lag(close, {k}) OVER w" for k in range(20)) + ") / 210 END AS wma FROM c " + WIN + ")",
                                   final="SELECT c.symbol, c.ts, " + ", ".join(f"{R(roll('avg({})', 'close', n))} AS sx_sma{n}, {R(f'e{n}')} AS sx_ema{n}" for n in (20, 50, 100, 200)).replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY c.symbol ORDER BY c.ts")
                                   + f", {R('wma')} AS sx_wma20 FROM c JOIN wm USING (symbol, ts) " + " ".join(f"JOIN e{n} USING (symbol, ts)" for n in (20, 50, 100, 200)))),
    "sx_macd": (sx_macd, q(HOURLY_SQL, *macd_ctes("1"), final=sel({"sx_macd": "macd", "sx_macd_signal": "signal", "sx_macd_hist": "hist"}, "mm"))),
    "sx_atr_adx": (sx_atr_adx, q(HOURLY_SQL, *ADX_CTES, final=sel({"sx_atr": "ea", "sx_atr_percent": "ea / nullif(close, 0)", "sx_adx": "adx"}, "c JOIN ea USING (symbol, ts) LEFT JOIN adx USING (symbol, ts)"))),
    "sx_bands": (sx_bands, q(HOURLY_SQL, f"b AS (SELECT symbol, ts, close, {roll('avg({})', 'close', 20)} AS m, {roll('stddev_samp({})', 'close', 20)} AS s FROM c)",
                             final=sel({"sx_boll_width": "4*s / nullif(m, 0)", "sx_boll_percent_b": "(close - (m - 2*s)) / nullif(4*s, 0)"}, "b"))),
    "sx_oscillators": (sx_oscillators, q(
        HOURLY_SQL, "t AS (SELECT *, (high+low+close)/3 AS tp, (high+low+close)/3 - lag((high+low+close)/3) OVER w AS mv, close - lag(close, 10) OVER w AS mom, close / nullif(lag(close, 10) OVER w, 0) - 1 AS roc FROM c " + WIN + ")",
        "u AS (SELECT *, CASE WHEN mv > 0 THEN tp * volume ELSE 0 END AS pos, CASE WHEN mv < 0 THEN tp * volume ELSE 0 END AS neg, "
        f"coalesce(100 * (close - {roll('min({})', 'low', 14)}) / nullif({roll('max({})', 'high', 14)} - {roll('min({})', 'low', 14)}, 0), 50) AS k FROM t)",
        final=sel({"sx_stoch_k": "k", "sx_stoch_d": roll("avg({})", "k", 3),
                   "sx_mfi": f"coalesce(100 - 100 / (1 + {roll('sum({})', 'pos', 14)} / nullif({roll('sum({})', 'neg', 14)}, 0)), 50)",
                   "sx_roc": "roc", "sx_momentum": "mom", "sx_acceleration": f"roc - lag(roc, 3) {W}"}, "u"))),
    "sx_volume": (sx_volume, q(HOURLY_SQL, "t AS (SELECT *, close - lag(close) OVER w AS d FROM c " + WIN + ")",
                               final=sel({"sx_volume_ratio": f"volume / nullif({roll('median({})', 'volume', 30)}, 0)", "sx_obv": OBV}, "t"))),
    "sx_donchian": (sx_donchian, q(HOURLY_SQL, final=sel({f"sx_donchian_{k}_{n}": roll(f"{a}({{}})", c, n, -1) for n in (20, 55, 100) for k, a, c in (("upper", "max", "high"), ("lower", "min", "low"))}))),
    "sx_parabolic_sar": (sx_parabolic_sar, SAR_SQL),
}
