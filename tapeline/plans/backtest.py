"""Back-test, path and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.series import back, numbered
from tapeline.operators import backtest as bt, barriers as br, features as feat, indicators as ind, signals as sg
from tapeline.plans.bars import RSI_CTES, TR, WIN, macd_ctes, q
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, RUN, W, daily, hourly, roll, rows, show

CASH, FEE, SLIP = 100000.0, 0.001, 0.0005


def _curve(spark, d):
    bars = ind.compose(hourly(spark, d), ind._ma((5, 20)), ind._macd(2.0, ""), ind._rsi())
    return bt.equity_curve(bt.classic_signals(bars), CASH, FEE, SLIP)


def backtest_equity(spark, d):
    return show(_curve(spark, d), "symbol", "strategy", "ts", "held", "equity", "drawdown", "benchmark", equity=3, benchmark=3)


def backtest_trades(spark, d):
    return show(bt.trades(_curve(spark, d), CASH), "symbol", "strategy", "trade", "entry_ts", "exit_ts", "pnl", pnl=3)


def backtest_metrics(spark, d):
    curve = _curve(spark, d)
    return show(bt.metrics(curve, bt.trades(curve, CASH), CASH), "symbol", "strategy", "return_percent", "max_drawdown_percent",
                "benchmark_return_percent", "sharpe_ratio", "sortino_ratio", "trade_count", "winning_trades", "losing_trades", "win_rate_percent",
                "profit_factor", return_percent=2, sharpe_ratio=3, sortino_ratio=3, profit_factor=3)


def backtest_rsi_hold(spark, d):
    curve = bt.equity_curve(bt.threshold_and_hold(ind.rsi(hourly(spark, d)), 45.0, 5), CASH, FEE, SLIP)
    return show(bt.trades(curve, CASH), "symbol", "trade", "entry_ts", "exit_ts", "pnl", pnl=3)


def path_risk(spark, d):
    return show(bt.path_risk(daily(spark, d), 5), "symbol", "samples", "mae_median", "mae_p10", "mae_winning_median", "mfe_median", "mfe_p75",
                "stop_hit", "target_hit", "expected_return")


def stop_grid(spark, d):
    return show(bt.stop_grid(ind.atr_sma(hourly(spark, d)), 4), "symbol", "multiplier", "samples", "mean_r", "max_dd", "stop_hit_rate", "score", "best")


def plan_validation(spark, d):
    return show(bt.validate_plan(ind.atr_sma(daily(spark, d)), 5, 1.5, 1.5), "symbol", "samples", "stop_hit_rate", "tp_hit_rate", "average_r",
                "max_drawdown_r", "profit_factor")


def _scored(spark, d):
    bars = feat.future_path(ind.returns(daily(spark, d), (5,)), 5).withColumn("session_date", F.to_date("ts"))
    return bars.filter("return_5 is not null and future_return is not null").select("session_date", "symbol", F.round("return_5", 10).alias("score"), "future_return")


def portfolio_long_short(spark, d):
    return show(bt.long_short(_scored(spark, d), 5, 0.2), "session_date", "gross", "turnover")


def portfolio_metrics(spark, d):
    return show(bt.portfolio_metrics(bt.long_short(_scored(spark, d), 5, 0.1), 50, 0.0008), "observations", "total_return", "annualized_return",
                "volatility", "sharpe", "sortino", "maximum_drawdown", "calmar", "turnover", "transaction_cost", annualized_return=5, total_return=5, calmar=5)


def _ctx(spark, d):
    return sg.context(hourly(spark, d))


def strategy_signals(spark, d):
    return show(sg.signals(sg.last_bar(_ctx(spark, d))), "symbol", "ts", "strategy", "family", "status", "score", "signal", "strength", "confidence")


def strategy_confluence(spark, d):
    return show(sg.confluence(sg.signals(sg.last_bar(_ctx(spark, d)))), "symbol", "ts", "raw", "available", "unavailable", "score", "direction", "signal")


def strategy_all(spark, d):
    from tapeline.session import cut
    return show(sg.all_strategies(cut(_ctx(spark, d))), "symbol", "ts", "strategy", "status", "signal", "strength", "stop_loss", "take_profit",
                "risk_reward", "expected_value")


def strategy_backtest(spark, d):
    from tapeline.session import cut
    out = bt.barrier_trades(cut(_ctx(spark, d)), list(sg.FAMILIES))
    return show(out, "symbol", "strategy", "n", "ts", "execution_ts", "signal", "entry", "stop", "target", "exit", "outcome", "ret", "mae", "mfe")


def _sided(spark, d):
    """Every hourly bar with an ATR, bought and sold, between 1.5 ATR of loss and 2.5 ATR of gain."""
    c = F.col
    bars = numbered(ind.atr_sma(hourly(spark, d)))
    said = bars.filter("atr is not null").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    said = said.select("symbol", "interval", "n", "ts", "side", "close", "atr").withColumn("strategy", F.when(c("side") > 0, "long").otherwise("short"))
    return bars, said.withColumns({"stop": c("close") - c("side") * 1.5 * c("atr"), "target": c("close") + c("side") * 2.5 * c("atr")})


def barrier_outcomes(spark, d):
    bars, said = _sided(spark, d)
    return show(br.first_passage(said, bars, 48), "symbol", "n", "side", "stop", "target", "outcome", "exit_n", "exit", "bottom", "top")


def spaced_entries(spark, d):
    bars = numbered(hourly(spark, d))
    rising = bars.withColumn("up", F.col("close") > back("close")).filter("up")
    return br.spaced_entries(rising, ("symbol", "interval"), 24).select("symbol", "n")


def _sided_runs(spark, d):
    bars, said = _sided(spark, d)
    c = F.col
    kept = said.join(br.spaced_entries(said, bt.RUN_KEYS, 24), [*bt.RUN_KEYS, "n"], "left_semi")
    done = br.first_passage(kept, bars, 24).filter("outcome is not null")
    low, high = c("bottom") / c("close") - 1, c("top") / c("close") - 1
    return done.withColumns({"ret": c("side") * (c("exit") / c("close") - 1) - 0.0025, "mae": F.when(c("side") > 0, low).otherwise(-high), "mfe": F.when(c("side") > 0, high).otherwise(-low)})


def barrier_metrics(spark, d):
    return show(bt.trade_metrics(_sided_runs(spark, d)), "symbol", "strategy", "number_of_trades", "win_rate", "profit_factor", "expectancy", "average_win", "average_loss", "max_drawdown",
                "sharpe", "sortino", "calmar", "mae", "mfe", "return_percent", calmar=5, return_percent=4)


def barrier_curve(spark, d):
    return show(bt.trade_curve(_sided_runs(spark, d), 100000.0), "symbol", "strategy", "n", "equity", "drawdown", equity=1)


def strategy_correlation(spark, d):
    return show(sg.correlation_matrix(ind.strategy(hourly(spark, d), False)), "symbol", "left", "right", "samples", "correlation")


EQ = [*RSI_CTES, *macd_ctes("2"),
      f"t AS (SELECT c.symbol, c.ts, open, close, {roll('avg({})', 'close', 5)} AS ma5, {roll('avg({})', 'close', 20)} AS ma20 FROM c)".replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY c.symbol ORDER BY c.ts"),
      """sig AS (SELECT symbol, ts, open, close, 'ma' AS strategy, coalesce(ma5 > ma20, FALSE) AS a FROM t
  UNION ALL SELECT symbol, ts, open, close, 'macd', macd > signal FROM t JOIN mm USING (symbol, ts)
  UNION ALL SELECT symbol, ts, open, close, 'rsi', CASE WHEN rsi < 35 THEN TRUE WHEN rsi > 65 THEN FALSE END FROM t JOIN rs USING (symbol, ts))"""]
LOOP = """o AS (SELECT symbol, strategy, ts, open, close, lag(a) OVER w AS act, row_number() OVER w AS i, first_value(close) OVER w AS c0, count(*) OVER (PARTITION BY symbol, strategy) AS k
   FROM sig WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
 s AS (SELECT symbol, strategy, ts, i, k, close, c0, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS qty, CAST(100000 AS DOUBLE) AS peak, CAST(100000 AS DOUBLE) AS equity, 0 AS trade, FALSE AS bought, FALSE AS sold FROM o WHERE i = 1
  UNION ALL
  SELECT symbol, strategy, ts, i, k, close, c0, nc, nq, greatest(peak, nc + nq * close), nc + nq * close, trade + CASE WHEN buy THEN 1 ELSE 0 END, buy, sell FROM (
   SELECT *, CASE WHEN buy THEN 0 WHEN sell THEN qty * open * 0.9995 * 0.999 ELSE cash END AS nc, CASE WHEN buy THEN cash / (open * 1.0005 * 1.001) WHEN sell THEN 0 ELSE qty END AS nq FROM (
    SELECT o.symbol, o.strategy, o.ts, o.i, o.k, o.open, o.close, o.c0, s.cash, s.qty, s.peak, s.trade, coalesce(o.act, FALSE) AND s.qty = 0 AS buy, NOT coalesce(o.act, TRUE) AND s.qty > 0 AS sell
    FROM s JOIN o ON o.symbol = s.symbol AND o.strategy = s.strategy AND o.i = s.i + 1)))"""
EQ_HEAD = "WITH RECURSIVE " + ", ".join([*EQ, LOOP])
TRADES_SQL = """e AS (SELECT symbol, strategy, ts, i, k, trade, bought, sold, qty, equity, lag(equity) OVER w AS before, CASE WHEN i = k AND qty > 0 THEN equity * 0.9995 * 0.999 ELSE equity END AS closing FROM s WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
 tr2 AS (SELECT symbol, strategy, trade, min(CASE WHEN bought THEN ts END) AS entry_ts, min(CASE WHEN sold OR (i = k AND qty > 0) THEN ts END) AS exit_ts,
   max(CASE WHEN sold OR (i = k AND qty > 0) THEN closing END) - max(CASE WHEN bought THEN before END) AS pnl FROM e WHERE trade > 0 GROUP BY 1, 2, 3)"""
METRICS_SQL = f"""{EQ_HEAD}, {TRADES_SQL},
 r AS (SELECT *, round(closing, 2) AS pub, CASE WHEN lag(closing) OVER w IS NOT NULL THEN (round(closing, 2) - lag(round(closing, 2)) OVER w) / greatest(lag(round(closing, 2)) OVER w, 1e-12) END AS ret FROM e WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
 a AS (SELECT symbol, strategy, arg_max(closing, i) AS fin, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn FROM r GROUP BY 1, 2),
 b AS (SELECT symbol, strategy, max((peak - equity) / peak) AS dd, arg_max(close / c0, i) AS bench FROM s GROUP BY 1, 2),
 t2 AS (SELECT symbol, strategy, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS g, coalesce(-sum(pnl) FILTER (pnl <= 0), 0) AS l FROM tr2 GROUP BY 1, 2)
 SELECT symbol, strategy, {R('(fin / 100000 - 1) * 100', 2)} AS return_percent, {R('dd * 100', 2)} AS max_drawdown_percent, {R('(bench - 1) * 100', 2)} AS benchmark_return_percent,
  {R('coalesce(m / nullif(sd, 0) * sqrt(24 * 365), 0)', 3)} AS sharpe_ratio, {R('coalesce(m / nullif(dn, 0) * sqrt(24 * 365), 0)', 3)} AS sortino_ratio,
  coalesce(n, 0) AS trade_count, coalesce(wins, 0) AS winning_trades, coalesce(n - wins, 0) AS losing_trades, {R('coalesce(wins / nullif(n, 0) * 100, 0)', 2)} AS win_rate_percent,
  {R('CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN 999 END', 3)} AS profit_factor FROM a JOIN b USING (symbol, strategy) LEFT JOIN t2 USING (symbol, strategy)"""

RSI_HOLD_SQL = f"""WITH RECURSIVE {', '.join(RSI_CTES)},
 o AS (SELECT c.symbol, c.ts, open, close, lag(rsi < 45) OVER w AS sig, row_number() OVER w AS i, count(*) OVER (PARTITION BY c.symbol) AS k FROM c JOIN rs USING (symbol, ts) WINDOW w AS (PARTITION BY c.symbol ORDER BY c.ts)),
 s AS (SELECT symbol, ts, i, k, close, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS qty, 0 AS held, 0 AS trade, FALSE AS bought, FALSE AS sold, CAST(100000 AS DOUBLE) AS equity FROM o WHERE i = 1
  UNION ALL
  SELECT symbol, ts, i, k, close, nc, nq, CASE WHEN buy THEN 0 ELSE held + 1 END, trade + CASE WHEN buy THEN 1 ELSE 0 END, buy, sell, nc + nq * close FROM (
   SELECT *, CASE WHEN buy THEN 0 WHEN sell THEN qty * open * 0.9995 * 0.999 ELSE cash END AS nc, CASE WHEN buy THEN cash / (open * 1.0005 * 1.001) WHEN sell THEN 0 ELSE qty END AS nq FROM (
    SELECT o.symbol, o.ts, o.i, o.k, o.open, o.close, s.cash, s.qty, s.held, s.trade, coalesce(o.sig, FALSE) AND s.qty = 0 AS buy, s.qty > 0 AND s.held + 1 >= 5 AS sell
    FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1))),
 e AS (SELECT *, lag(equity) OVER w AS before, CASE WHEN i = k AND qty > 0 THEN equity * 0.9995 * 0.999 ELSE equity END AS closing FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, CAST(trade AS BIGINT) AS trade, min(CASE WHEN bought THEN ts END) AS entry_ts, min(CASE WHEN sold OR (i = k AND qty > 0) THEN ts END) AS exit_ts,
   {R('max(CASE WHEN sold OR (i = k AND qty > 0) THEN closing END) - max(CASE WHEN bought THEN before END)', 3)} AS pnl FROM e WHERE trade > 0 GROUP BY 1, 2"""

NEXT5 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
NEXT4 = NEXT5.replace("5 FOLLOWING", "4 FOLLOWING")
PATH_SQL = q(DAILY_SQL, f"p AS (SELECT symbol, min(low) {NEXT5} / close - 1 AS mae, max(high) {NEXT5} / close - 1 AS mfe, lead(close, 5) {W} / close - 1 AS ret FROM c)",
             final=f"""SELECT symbol, count(*) AS samples, {R('median(mae)')} AS mae_median, {R('quantile_cont(mae, 0.1)')} AS mae_p10, {R('median(mae) FILTER (ret > 0)')} AS mae_winning_median,
  {R('median(mfe)')} AS mfe_median, {R('quantile_cont(mfe, 0.75)')} AS mfe_p75, {R('avg(CASE WHEN mae <= -0.02 THEN 1.0 ELSE 0 END)')} AS stop_hit,
  {R('avg(CASE WHEN mfe >= 0.03 THEN 1.0 ELSE 0 END)')} AS target_hit, {R('avg(ret)')} AS expected_return FROM p WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 60""")
ATR = f"t AS (SELECT *, {TR} AS tr FROM c {WIN}), a0 AS (SELECT *, {roll('avg({})', 'tr', 14)} AS atr FROM t)"
GRID_SQL = q(HOURLY_SQL, ATR, f"""a1 AS (SELECT symbol, row_number() {W} - 1 AS n, greatest(0, (close - min(low) {NEXT4}) / atr) AS adv, greatest(0, (max(high) {NEXT4} - close) / atr) AS fav,
  (lead(close, 4) {W} - close) / atr AS term FROM a0 WHERE atr IS NOT NULL)""",
             "a2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS i, count(*) OVER (PARTITION BY symbol) AS k FROM a1 WHERE n >= 20 AND term IS NOT NULL)",
             "g AS (SELECT a2.*, CAST(round(0.8 + m * 0.1, 1) AS DOUBLE) AS mult FROM a2, (SELECT unnest(range(29)) AS m) WHERE i <= greatest(30, floor(k * 0.7)))",
             "h AS (SELECT *, CASE WHEN adv >= mult THEN -1.0 WHEN fav >= mult * 1.5 THEN 1.5 ELSE term / mult END AS r FROM g)",
             "j AS (SELECT *, sum(r) OVER (PARTITION BY symbol, mult ORDER BY n) AS cs FROM h)",
             "l AS (SELECT *, greatest(0, max(cs) OVER (PARTITION BY symbol, mult ORDER BY n)) AS pk FROM j)",
             "m AS (SELECT symbol, mult, count(*) AS samples, avg(r) AS mr, max(pk - cs) AS dd, avg(CASE WHEN adv >= mult THEN 1.0 ELSE 0 END) AS hit FROM l GROUP BY 1, 2)",
             final=f"""SELECT symbol, mult AS multiplier, samples, {R('mr')} AS mean_r, {R('dd')} AS max_dd, {R('hit')} AS stop_hit_rate, {R('mr - 0.0025 * dd')} AS score,
  row_number() OVER (PARTITION BY symbol ORDER BY mr - 0.0025 * dd DESC, mult) = 1 AS best FROM m""")
PLAN_SQL = q(DAILY_SQL, ATR, f"""a1 AS (SELECT symbol, row_number() {W} - 1 AS n, count(*) OVER (PARTITION BY symbol) AS k, close, atr * 1.5 AS u, min(low) {NEXT5} AS lo, max(high) {NEXT5} AS hi, lead(close, 5) {W} AS fin FROM a0 WHERE atr IS NOT NULL)""",
             "b AS (SELECT symbol, n, CASE WHEN lo <= close - u THEN -1.0 WHEN hi >= close + u * 1.5 THEN 1.5 ELSE (fin - close) / u END AS r, lo <= close - u AS s, lo > close - u AND hi >= close + u * 1.5 AS t FROM a1 WHERE n >= greatest(30, floor(k * 0.7)) AND fin IS NOT NULL AND u > 0)",
             "d AS (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY n) AS cs FROM b)", "f AS (SELECT *, greatest(0, max(cs) OVER (PARTITION BY symbol ORDER BY n)) AS pk FROM d)",
             final=f"""SELECT symbol, count(*) AS samples, {R('avg(CASE WHEN s THEN 1.0 ELSE 0 END)')} AS stop_hit_rate, {R('avg(CASE WHEN t THEN 1.0 ELSE 0 END)')} AS tp_hit_rate, {R('avg(r)')} AS average_r,
  {R('max(pk - cs)')} AS max_drawdown_r, {R('sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0)')} AS profit_factor FROM f GROUP BY 1""")


def _ls(share: str) -> list[str]:
    return [DAILY_SQL, f"""z AS (SELECT symbol, CAST(ts AS DATE) AS d, round(close / lag(close, 5) {W} - 1, 10) AS score, lead(close, 5) {W} / close - 1 AS fr FROM c)""",
            "z1 AS (SELECT *, dense_rank() OVER (ORDER BY d) - 1 AS di FROM z WHERE score IS NOT NULL AND fr IS NOT NULL)",
            f"z2 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY d) AS n FROM z1 WHERE di % 5 = 0)",
            f"z3 AS (SELECT *, greatest(1, CAST(ceil(n * CAST({share} AS DOUBLE)) AS BIGINT)) AS k, di // 5 AS s FROM z2)",
            "side AS (SELECT s, k, symbol, fr, 'L' AS side FROM z3 WHERE r > n - k UNION ALL SELECT s, k, symbol, fr, 'S' FROM z3 WHERE r <= k)",
            "chg AS (SELECT coalesce(a.s, b.s + 1) AS s, count(*) AS moved FROM side a FULL JOIN side b ON a.s = b.s + 1 AND a.side = b.side AND a.symbol = b.symbol WHERE a.s IS NULL OR b.s IS NULL GROUP BY 1)",
            "p AS (SELECT d AS session_date, s, max(k) AS k, avg(fr) FILTER (r > n - k) - avg(fr) FILTER (r <= k) AS gross FROM z3 GROUP BY 1, 2)",
            "ls AS (SELECT session_date, gross, coalesce(moved, 0) / (2.0 * k) AS turnover FROM p LEFT JOIN chg USING (s))"]


PM_SQL = q(*_ls("0.1"), "n AS (SELECT *, gross - turnover * 0.0008 AS net FROM ls)", "e AS (SELECT *, product(1 + net) OVER (ORDER BY session_date) AS eq FROM n)",
           "f AS (SELECT *, eq / greatest(max(eq) OVER (ORDER BY session_date), 1e-12) - 1 AS dd FROM e)",
           "g AS (SELECT count(*) AS k, arg_max(eq, session_date) - 1 AS tot, avg(net) AS m, stddev_samp(net) AS s, stddev_samp(net) FILTER (net < 0) AS dn, min(dd) AS dd, sum(turnover) AS tv, sum(turnover * 0.0008) AS tc FROM f)",
           "h AS (SELECT *, CASE WHEN tot > -1 THEN pow(1 + tot, 1 / greatest(k / 50.0, 0.02)) - 1 ELSE -1 END AS ann FROM g)",
           final=f"""SELECT k AS observations, {R('tot', 5)} AS total_return, {R('ann', 5)} AS annualized_return, {R('s * sqrt(50)')} AS volatility, {R('m / s * sqrt(50)')} AS sharpe, {R('m / dn * sqrt(50)')} AS sortino,
  {R('dd')} AS maximum_drawdown, {R('ann / abs(dd)', 5)} AS calmar, {R('tv')} AS turnover, {R('tc')} AS transaction_cost FROM h""")

SIDED = [HOURLY_SQL, ATR, "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM a0)",
         "e AS (SELECT symbol, n, ts, side, close, close - side * 1.5 * atr AS stop, close + side * 2.5 * atr AS target FROM b, (SELECT unnest([1, -1]) AS side) WHERE atr IS NOT NULL)"]


def passage_sql(entries: str, horizon: int) -> list[str]:
    """First touch by joining every entry with its whole path."""
    touch = "CASE WHEN side > 0 THEN p.low <= stop OR p.high >= target ELSE p.high >= stop OR p.low <= target END"
    return [f"""h AS (SELECT e.symbol, e.n, side, stop, target, e.close, min(p.n) FILTER ({touch}) AS hit, count(p.n) AS k, min(p.low) AS bottom, max(p.high) AS top, arg_max(p.close, p.n) AS fin
   FROM {entries} e LEFT JOIN b p ON p.symbol = e.symbol AND p.n BETWEEN e.n + 1 AND e.n + {horizon} GROUP BY 1, 2, 3, 4, 5, 6)""",
            f"""o AS (SELECT h.*, CASE WHEN hit IS NULL THEN CASE WHEN k = {horizon} THEN 'TIME' END WHEN side > 0 AND p.low <= stop OR side < 0 AND p.high >= stop THEN 'SL' ELSE 'TP' END AS outcome,
   coalesce(hit, CASE WHEN k = {horizon} THEN h.n + {horizon} END) AS exit_n FROM h LEFT JOIN b p ON p.symbol = h.symbol AND p.n = h.hit)""",
            "x AS (SELECT *, CASE outcome WHEN 'SL' THEN stop WHEN 'TP' THEN target WHEN 'TIME' THEN fin END AS leave FROM o)"]


def spaced_sql(rows: str, gap: int, keys: str = "symbol") -> list[str]:
    """Greedy pass by recursion over each row's successor."""
    same = " AND ".join(f"a.{k} = z.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return [f"nx AS (SELECT {own}, a.n, min(z.n) AS m FROM {rows} a LEFT JOIN {rows} z ON {same} AND z.n >= a.n + {gap} GROUP BY ALL)",
            f"g AS (SELECT {keys}, min(n) AS n FROM {rows} GROUP BY ALL UNION ALL SELECT {own.replace('a.', 'nx.')}, nx.m FROM g JOIN nx USING ({keys}, n) WHERE nx.m IS NOT NULL)"]


SIDED_RUNS = [*SIDED, *spaced_sql("e", 24, "symbol, side"), "ek AS (SELECT e.* FROM e JOIN g USING (symbol, side, n))", *passage_sql("ek", 24),
              "t0 AS (SELECT symbol, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS strategy, n, side * (leave / close - 1) - 0.0025 AS ret, "
              "CASE WHEN side > 0 THEN bottom / close - 1 ELSE 1 - top / close END AS mae, CASE WHEN side > 0 THEN top / close - 1 ELSE 1 - bottom / close END AS mfe FROM x WHERE outcome IS NOT NULL)",
              "t1 AS (SELECT *, product(1 + ret) OVER w AS growth FROM t0 WINDOW w AS (PARTITION BY symbol, strategy ORDER BY n))",
              "t2 AS (SELECT *, 1 - growth / greatest(1, max(growth) OVER (PARTITION BY symbol, strategy ORDER BY n)) AS drawdown FROM t1)"]
BARRIER_METRICS_SQL = q(*SIDED_RUNS, "m AS (SELECT symbol, strategy, count(*) AS k, avg(ret) AS e, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS dn, max(drawdown) AS dd, arg_max(growth, n) AS fin, avg(mae) AS mae, avg(mfe) AS mfe, "
                        "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS wr, sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret <= 0) AS pf, coalesce(avg(ret) FILTER (ret > 0), 0) AS aw, coalesce(avg(ret) FILTER (ret <= 0), 0) AS al FROM t2 GROUP BY 1, 2)",
                        final=f"""SELECT symbol, strategy, k AS number_of_trades, {R('wr')} AS win_rate, {R('pf')} AS profit_factor, {R('e')} AS expectancy, {R('aw')} AS average_win, {R('al')} AS average_loss, {R('dd')} AS max_drawdown,
  {R('coalesce(e / nullif(s, 0) * sqrt(k), 0)')} AS sharpe, {R('coalesce(e / nullif(dn, 0) * sqrt(k), 0)')} AS sortino, {R('e / nullif(dd, 0)', 5)} AS calmar, {R('mae')} AS mae, {R('mfe')} AS mfe, {R('(fin - 1) * 100', 4)} AS return_percent FROM m""").replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "barrier_outcomes": (barrier_outcomes, q(*SIDED, *passage_sql("e", 48), final=f"SELECT symbol, n, side, {R('stop')} AS stop, {R('target')} AS target, outcome, exit_n, {R('leave')} AS exit, {R('bottom')} AS bottom, {R('top')} AS top FROM x")),
    "spaced_entries": (spaced_entries, q(HOURLY_SQL, f"b AS (SELECT symbol, row_number() {W} - 1 AS n, close > lag(close) {W} AS up FROM c)", "k AS (SELECT * FROM b WHERE up)", *spaced_sql("k", 24), final="SELECT symbol, n FROM g").replace("WITH ", "WITH RECURSIVE ", 1)),
    "barrier_metrics": (barrier_metrics, BARRIER_METRICS_SQL),
    "barrier_curve": (barrier_curve, q(*SIDED_RUNS, final=f"SELECT symbol, strategy, n, {R('round(100000 * growth, 2)', 1)} AS equity, {R('drawdown')} AS drawdown FROM t2").replace("WITH ", "WITH RECURSIVE ", 1)),
    "backtest_equity": (backtest_equity, f"{EQ_HEAD} SELECT symbol, strategy, ts, qty > 0 AS held, {R('equity', 3)} AS equity, {R('(peak - equity) / peak')} AS drawdown, {R('100000 * close / c0', 3)} AS benchmark FROM s"),
    "backtest_trades": (backtest_trades, f"{EQ_HEAD}, {TRADES_SQL} SELECT symbol, strategy, CAST(trade AS BIGINT) AS trade, entry_ts, exit_ts, {R('pnl', 3)} AS pnl FROM tr2"),
    "backtest_metrics": (backtest_metrics, METRICS_SQL),
    "backtest_rsi_hold": (backtest_rsi_hold, RSI_HOLD_SQL),
    "path_risk": (path_risk, PATH_SQL),
    "stop_grid": (stop_grid, GRID_SQL),
    "plan_validation": (plan_validation, PLAN_SQL),
    "portfolio_long_short": (portfolio_long_short, q(*_ls("0.2"), final=f"SELECT session_date, {R('gross')} AS gross, {R('turnover')} AS turnover FROM ls")),
    "portfolio_metrics": (portfolio_metrics, PM_SQL),
    "strategy_signals": (strategy_signals, None),
    "strategy_confluence": (strategy_confluence, None),
    "strategy_all": (strategy_all, None),
    "strategy_backtest": (strategy_backtest, None),
    "strategy_correlation": (strategy_correlation, None),
}
