"""Screener, dashboard and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import indicators as ind, screen as sc
from tapeline.plans.bars import RSI_CTES, TR, TRC, WIN, macd_ctes, q
from tapeline.plans.base import HOURLY_SQL, R, W, hourly, r, roll, rows, show, table


def _scored(spark, d):
    bars = ind.compose(hourly(spark, d), ind._ma((20, 60)), ind._macd(2.0, ""), ind._rsi(), ind._atr_sma(), ind._volume())
    end = ind.indicator_score(sc.with_change(bars))
    news = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.floor(F.avg("user_id") % 100).cast("double").alias("news_points"))
    return sc.component_scores(end, news)


COLS = ("symbol", "trend", "technical", "news", "momentum", "volume_points", "risk", "ai_score", "verdict")


def screener(spark, d):
    return show(sc.screen(_scored(spark, d)), *COLS, "change_percent")


def screener_filtered(spark, d):
    return show(sc.screen(_scored(spark, d), min_score=30, max_risk=95, movement="up", top=10), "symbol", "ai_score", "risk", "change_percent")


def market_pulse(spark, d):
    return show(sc.pulse(_scored(spark, d)), "trend", "news", "volume_points", "risk", "assets", "pulse", "stance")


def movers_topk(spark, d):
    return show(sc.movers(_scored(spark, d), 3), "board", "symbol", "change_percent", "volume_ratio", "ai_score", "risk")


def compare_assets(spark, d):
    return show(sc.compare(_scored(spark, d), "view", "click"), "measure", "left", "right", "difference")


def _items(spark, d):
    c = F.col
    base = _scored(spark, d).select("symbol", "ai_score", c("close").alias("price"), c("close").alias("entry"), (c("close") * 0.9).alias("stop_loss"), c("ts").alias("cutoff"),
                                    (c("rsi") - 50).alias("technical_score"), F.when(c("symbol") != "error", c("news") - 40).alias("news_score"))
    df = sc.fused_verdict(base)
    return sc.decision_gate(df.withColumns({
        "asset_type": F.when(c("symbol").isin("view", "click"), "crypto").otherwise("stock"), "age_hours": F.length("symbol").cast("double") - 3, "samples": F.length("symbol") * 20,
        "news_count": F.when(c("symbol") == "view", 0).otherwise(3), "top_impact": F.when(c("symbol") == "signup", 85.0).otherwise(40.0)}))


def watch_report(spark, d):
    return show(_items(spark, d), "symbol", "combined", "verdict", "exit_line", "gate", "priority", "evidence_grade", "blockers")


def watch_alerts(spark, d):
    items = _items(spark, d)
    before = items.select("symbol", "asset_type", F.lit("NO_ACTION").alias("gate"), "verdict")
    return sc.new_alerts(sc.alerts(items, before), items.limit(0).select(F.lit("").alias("fingerprint"))).select("symbol", "asset_type", "alert_type", "severity")


def _checks(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("provider"), (F.col("user_id") % 8).cast("string")).alias("provider"), F.col("event_id").alias("id"), F.col("ts").alias("checked_at"),
                                            F.when(F.col("event_type") == "error", "ERROR").otherwise("CONNECTED").alias("status"))


def provider_health(spark, d):
    return show(sc.provider_health(_checks(spark, d), "2024-01-31 01:00:00"), "provider", "status", "error_rate", "freshness_seconds", "last_success")


def provider_last_success(spark, d):
    return sc.carry_last_success(_checks(spark, d)).select("provider", "id", "last_success")


def latency_p95(spark, d):
    calls = table(spark, d, "events").select((F.concat(F.lit("/p"), (F.col("user_id") % 10).cast("string"))).alias("path"), F.col("value").alias("duration_ms"))
    return show(sc.latency_summary(calls), "path", "calls", "average_ms", "p95_ms", "max_ms")


def news_dimension(spark, d):
    news = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").alias("published_at"), (F.col("user_id") % 200 - 100).cast("double").alias("sentiment"))
    return sc.news_dimension(news)


def watchlist(spark, d):
    cust = table(spark, d, "customer")
    rows_ = cust.select(F.concat(F.lit("N"), (F.col("c_custkey") % 400).cast("string")).alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("asset_type"), F.col("c_custkey").alias("created_at"))
    gone = table(spark, d, "supplier").select(F.concat(F.lit("N"), (F.col("s_suppkey") * 3).cast("string")).alias("symbol"))
    return sc.upsert_watchlist(rows_.filter("created_at < 600"), rows_.filter("created_at >= 600"), gone)


def market_overview(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("position"), F.concat(F.lit("B"), (F.col("p_partkey") % 700).cast("string")).alias("symbol"))
    quotes = table(spark, d, "part").select(F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("price"),
                                                                       (F.col("p_retailprice") - F.col("p_size")).alias("prev_price"))
    return show(sc.quote_table(asked, quotes), "position", "symbol", "price", "change", "change_percent", "available")


SC = [*RSI_CTES, *macd_ctes("2"), f"t AS (SELECT *, {TR} AS tr, volume / nullif(lag(volume) OVER w, 0) - 1 AS vc, close / nullif(lag(close) OVER w, 0) - 1 AS cp FROM c {WIN})",
      f"t1 AS (SELECT symbol, ts, close, vc * 100 AS vc, cp * 100 AS cp, {roll('avg({})', 'close', 20)} AS ma20, {roll('avg({})', 'close', 60)} AS ma60, {roll('avg({})', 'tr', 14)} AS atr, volume / nullif({roll('avg({})', 'volume', 20)}, 0) AS vr FROM t)",
      "t2 AS (SELECT * FROM t1 JOIN mm USING (symbol, ts) JOIN rs USING (symbol, ts) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)",
      "nw AS (SELECT event_type AS symbol, floor(avg(user_id) % 100) AS news FROM events GROUP BY 1)",
      """t3 AS (SELECT *, 50 + CASE WHEN close > ma20 THEN 18 ELSE -18 END + CASE WHEN close > ma60 THEN 10 ELSE -10 END AS trend,
  greatest(0, least(100, 50 + CASE WHEN close > ma20 THEN 12 ELSE 0 END + CASE WHEN macd > signal THEN 12 ELSE 0 END + CASE WHEN rsi BETWEEN 45 AND 65 THEN 8 WHEN rsi > 75 THEN -8 ELSE 0 END + CASE WHEN vc > 10 THEN 6 ELSE 0 END)) AS technical,
  greatest(0, least(100, 50 + CASE WHEN macd > signal THEN 18 ELSE -18 END + CASE WHEN rsi BETWEEN 45 AND 65 THEN 10 WHEN rsi >= 75 THEN -12 WHEN rsi <= 30 THEN -6 ELSE 0 END)) AS momentum,
  round_even(greatest(0, least(100, 50 + (vr - 1) * 30)), 0) AS volume_points, round_even(greatest(0, least(100, 28 + least(42, atr / close * 100 * 8) + CASE WHEN rsi >= 75 OR rsi <= 25 THEN 18 ELSE 0 END)), 0) AS risk FROM t2 JOIN nw USING (symbol))""",
      "sc0 AS (SELECT *, round_even(greatest(0, least(100, 0.28*trend + 0.24*technical + 0.16*news + 0.17*momentum + 0.15*volume_points - greatest(0, risk - 50) * 0.12)), 0) AS ai_score FROM t3)",
      "scr AS (SELECT *, CASE WHEN ai_score >= 60 THEN 'BULLISH' WHEN ai_score <= 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict FROM sc0)"]
NUM = ", ".join(f"{R(k)} AS {k}" for k in ("trend", "technical", "news", "momentum", "volume_points", "risk", "ai_score"))
ITEM = [*SC, """i0 AS (SELECT symbol, ts, close, ai_score, rsi - 50 AS tsx, CASE WHEN symbol <> 'error' THEN news - 40 END AS ns FROM scr)""",
        "i1 AS (SELECT *, round(greatest(-100, least(100, CASE WHEN ns IS NULL THEN 0.7 * tsx + 0.3 * (ai_score - 50) * 2 ELSE 0.55 * tsx + 0.25 * (ai_score - 50) * 2 + 0.2 * ns END)), 2) AS combined FROM i0)",
        "i2 AS (SELECT *, CASE WHEN combined >= 15 THEN 'BULLISH' WHEN combined <= -15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict FROM i1)",
        """i3 AS (SELECT *, CASE WHEN verdict = 'BEARISH' THEN close * 1.1 ELSE close * 0.9 END AS xl, CASE WHEN symbol IN ('view','click') THEN 'crypto' ELSE 'stock' END AS asset_type, length(symbol) - 3 > CASE WHEN symbol IN ('view','click') THEN 2 ELSE 96 END AS stale,
  length(symbol) * 20 AS samples, symbol = 'signup' AS important FROM i2)""",
        """it AS (SELECT *, CASE WHEN stale THEN 'NO_ACTION' WHEN important THEN 'RISK_REVIEW' WHEN verdict <> 'NEUTRAL' THEN 'WATCH_ONLY' ELSE 'NO_ACTION' END AS gate, CASE WHEN important THEN 80 WHEN stale THEN 70 WHEN verdict <> 'NEUTRAL' THEN 45 ELSE 20 END AS priority FROM i3)"""]
CHK = "k AS (SELECT 'provider' || user_id % 8 AS provider, event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'CONNECTED' END AS status FROM events)"


def _board(name: str, order: str) -> str:
    return f"(SELECT '{name}' AS board, symbol, {R('cp')} AS change_percent, {R('vr')} AS volume_ratio, {R('ai_score')} AS ai_score, {R('risk')} AS risk FROM scr ORDER BY {order}, symbol LIMIT 3)"


QUERIES = {
    "screener": (screener, q(*SC, final=f"SELECT symbol, {NUM}, verdict, {R('cp')} AS change_percent FROM scr")),
    "screener_filtered": (screener_filtered, q(*SC, final=f"SELECT symbol, {R('ai_score')} AS ai_score, {R('risk')} AS risk, {R('cp')} AS change_percent FROM scr WHERE ai_score >= 30 AND risk <= 95 AND cp > 0 ORDER BY scr.ai_score DESC, cp DESC LIMIT 10")),
    "market_pulse": (market_pulse, q(*SC, "m AS (SELECT round_even(avg(trend), 0) AS trend, round_even(avg(news), 0) AS news, round_even(avg(volume_points), 0) AS volume_points, round_even(avg(risk), 0) AS risk, count(*) AS assets FROM scr)",
                                     "p AS (SELECT *, round_even(0.30*trend + 0.20*news + 0.18*volume_points + 0.17*news + 0.15*(100-risk), 0) AS pulse FROM m)",
                                     final=f"SELECT {R('trend')} AS trend, {R('news')} AS news, {R('volume_points')} AS volume_points, {R('risk')} AS risk, assets, {R('pulse')} AS pulse, CASE WHEN pulse >= 60 THEN 'BULLISH' WHEN pulse <= 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS stance FROM p")),
    "movers_topk": (movers_topk, q(*SC, final=" UNION ALL ".join([_board("gainers", "cp DESC"), _board("losers", "cp"), _board("volume", "vr DESC"), _board("opportunities", "scr.ai_score DESC"), _board("risk_watch", "scr.risk DESC")]))),
    "compare_assets": (compare_assets, q(*SC, "l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS measure, max({k}) FILTER (symbol = 'view') AS a, max({k}) FILTER (symbol = 'click') AS b FROM scr" for k in ("trend", "technical", "news", "momentum", "volume_points", "risk", "ai_score")) + ")",
                                         final=f"SELECT measure, {R('a')} AS \"left\", {R('b')} AS \"right\", {R('a - b')} AS difference FROM l")),
    "watch_report": (watch_report, q(*ITEM, final=f"""SELECT symbol, {R('combined')} AS combined, verdict, {R('xl')} AS exit_line, gate, priority, CASE WHEN samples >= 100 AND NOT stale THEN 'C' ELSE 'D' END AS evidence_grade,
  concat_ws('|', 'NO_EDGE', CASE WHEN samples < 100 THEN 'FEW_SAMPLES' END, CASE WHEN stale THEN 'STALE_DATA' END, CASE WHEN symbol = 'view' THEN 'NO_NEWS' END) AS blockers FROM it""")),
    "watch_alerts": (watch_alerts, q(*ITEM, final="SELECT symbol, asset_type, 'STALE_DATA' AS alert_type, 'WARNING' AS severity FROM it WHERE stale UNION ALL SELECT symbol, asset_type, 'HIGH_IMPACT_NEWS', 'WARNING' FROM it WHERE important UNION ALL SELECT symbol, asset_type, 'STATE_CHANGE', 'INFO' FROM it WHERE gate <> 'NO_ACTION'")),
    "provider_health": (provider_health, q(CHK, "r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY id DESC) AS r FROM k)",
                                           "g AS (SELECT provider, arg_max(status, id) AS s, round(avg(CASE WHEN status <> 'CONNECTED' THEN 1.0 ELSE 0 END) FILTER (r <= 20), 4) AS er, arg_max(ts, id) AS t, max(ts) FILTER (status = 'CONNECTED') AS ok FROM r GROUP BY 1)",
                                           final=f"SELECT provider, CASE WHEN s = 'CONNECTED' AND epoch(TIMESTAMP '2024-01-31 01:00:00') - floor(epoch(t)) > 3600 THEN 'STALE' ELSE s END AS status, {R('er')} AS error_rate, CAST(epoch(TIMESTAMP '2024-01-31 01:00:00') - floor(epoch(t)) AS BIGINT) AS freshness_seconds, ok AS last_success FROM g")),
    "provider_last_success": (provider_last_success, q(CHK, final="SELECT provider, id, max(CASE WHEN status = 'CONNECTED' THEN ts END) OVER (PARTITION BY provider ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS last_success FROM k")),
    "latency_p95": (latency_p95, q("k AS (SELECT '/p' || user_id % 10 AS path, value AS ms FROM events)", "l AS (SELECT path, list_sort(list(ms)) AS v, avg(ms) AS a FROM k GROUP BY 1)",
                                   final=f"SELECT path, len(v) AS calls, {R('a')} AS average_ms, {R('v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT)) + 1]')} AS p95_ms, {R('v[-1]')} AS max_ms FROM l")),
    "news_dimension": (news_dimension, q("k AS (SELECT event_type AS symbol, event_id AS id, user_id % 200 - 100 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events)",
                                         "g AS (SELECT symbol, round_even(greatest(0, least(100, 50 + avg(s) / 2)), 0) AS p, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS top_ids FROM k WHERE r <= 50 GROUP BY 1)",
                                         final="SELECT symbol, p AS news_points, top_ids, CASE WHEN p >= 60 THEN 'POSITIVE' WHEN p <= 40 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM g")),
    "watchlist": (watchlist, """WITH k AS (SELECT 'N' || c_custkey % 400 AS symbol, c_name, c_mktsegment, c_custkey FROM customer) SELECT symbol, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS asset_type, min(c_custkey) AS created_at
  FROM k WHERE symbol NOT IN (SELECT 'N' || s_suppkey * 3 FROM supplier) GROUP BY 1"""),
    "market_overview": (market_overview, f"""WITH a AS (SELECT 'B' || p_partkey % 700 AS symbol, min(p_partkey) AS position FROM part GROUP BY 1), qt AS (SELECT 'B' || p_partkey AS symbol, p_retailprice AS price, p_retailprice - p_size AS prev FROM part)
  SELECT position, symbol, {R('price')} AS price, {R('price - prev')} AS change, {R('(price / nullif(prev, 0) - 1) * 100')} AS change_percent, price IS NOT NULL AS available FROM a LEFT JOIN qt USING (symbol)"""),
}
