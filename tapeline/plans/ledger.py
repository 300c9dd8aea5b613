"""Prediction ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.series import numbered
from tapeline.operators import ledger as ld
from tapeline.plans.bars import q
from tapeline.plans.base import HOURLY_SQL, R, W, hourly, r, show, table


def _predictions(bars):
    """A ledger that the bars imply: every third bar calls the sign of its last move."""
    c = F.col
    df = numbered(bars).withColumn("_p", F.lag("close").over(ld.Window.partitionBy("symbol").orderBy("ts"))).filter("n % 3 = 1")
    call = F.when(c("n") % 9 == 1, "FLAT").when(c("close") > c("_p"), "UP").otherwise("DOWN")
    base = F.lit(0.2) + (c("n") % 7) * 0.0501
    df = df.withColumn("prediction", call)
    up = F.when(c("prediction") == "UP", 0.3 + base).otherwise((0.7 - base) / 2)
    down = F.when(c("prediction") == "DOWN", 0.3 + base).otherwise((0.7 - base) / 2)
    side = F.when(c("prediction") == "DOWN", -1).otherwise(1)
    market = F.when(c("symbol").isin("view", "click", "purchase"), "CRYPTO").when(c("symbol") == "signup", "US").otherwise("CN")
    horizon = F.when(c("n") % 5 == 0, "1D").when(c("n") % 5 == 1, "T+5").when(c("n") % 5 == 2, "1H").otherwise("4H")
    return df.select(
        F.concat_ws("-", "symbol", "n").alias("id"), "symbol", "interval", market.alias("market"), horizon.alias("horizon"), (c("ts") + F.expr("interval 10 minutes")).alias("prediction_time"),
        (F.timestamp_seconds(F.unix_seconds("ts") + 4 * 3600)).alias("target_time"), c("close").alias("entry_price"), "prediction", up.alias("prob_up"), down.alias("prob_down"),
        (1 - up - down).alias("prob_flat"), F.lit(0.2).alias("threshold"), (c("close") * (1 - side * 0.3)).alias("stop_loss"), (c("close") * (1 + side * 0.5)).alias("tp1"),
        ((c("n") % 10) / 10).alias("data_quality"), F.when(c("n") % 2 == 0, "BULL").otherwise("BEAR").alias("regime"))


def _settled(spark, d):
    bars = hourly(spark, d)
    return ld.settle(_predictions(bars), bars)


def settle_predictions(spark, d):
    df = _settled(spark, d)
    df = df.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("stop_hit", "target_hit", "correct")})
    return show(df, "id", "market", "horizon", "status", "reason", "end_ts", "actual_return", "actual", "stop_hit", "target_hit", "realized_r", "correct")


def settle_incremental(spark, d):
    bars = hourly(spark, d)
    said = _predictions(bars)
    before = said.filter("prediction_time < '2024-01-15'").select("id")
    return show(ld.settle_new(said, before, bars), "id", "actual", "actual_return")


def settlement_status(spark, d):
    return ld.settlement_summary(_settled(spark, d))


def resolve_predictions(spark, d):
    bars = hourly(spark, d)
    return show(ld.resolve(_predictions(bars), bars), "id", "actual_return", "actual", "stop_hit", "target_hit", "realized_r", "mae", "mfe", "correct", "failure")


def _resolved(spark, d):
    bars = hourly(spark, d)
    return ld.resolve(_predictions(bars), bars)


def prediction_stats(spark, d):
    return show(ld.statistics(_resolved(spark, d)), "level", "key", "samples", "accuracy", "precision_macro", "recall_macro", "f1_macro", "brier_score", "log_loss", "calibration_gap",
                "stop_hit_rate", "tp_hit_rate", "average_r", "profit_factor", "ic", "sharpe")


def prediction_reliability(spark, d):
    return show(ld.reliability(_resolved(spark, d)), "bin", "samples", "predicted", "observed", "ece")


def track_record(spark, d):
    return show(ld.track_record(_resolved(spark, d)), "level", "key", "samples", "accuracy", "baseline", "edge", "status", "f1_macro")


def model_lab(spark, d):
    return show(ld.model_lab(_resolved(spark, d)), "symbol", "horizon", "samples", "accuracy", "mean_move")


def snapshot_changes(spark, d):
    said = _predictions(hourly(spark, d))
    snaps = said.select("symbol", "horizon", F.col("prediction_time").alias("generated_at"), F.col("prediction").alias("direction"), (F.col("prob_up") * 100).alias("up"))
    return show(ld.snapshot_changes(snaps), "symbol", "horizon", "from", "to", "up_delta")


def latest_predictions(spark, d):
    return show(ld.latest_group(_predictions(hourly(spark, d))), "id", "symbol", "horizon", "prediction", "prob_up")


def newest_predictions(spark, d):
    return ld.newest(_predictions(hourly(spark, d)), 100).select("id", "prediction")


def score_changes(spark, d):
    scores = hourly(spark, d).select("symbol", "ts", (F.floor(F.col("close") / 20)).alias("score"))
    return ld.change_log(scores).select("symbol", "ts", "score", *[F.col(k).cast("double").alias(k) for k in ("previous", "delta")])


def mark_to_market(spark, d):
    cust = table(spark, d, "customer").withColumn("currency", F.when(F.col("c_nationkey") % 3 == 0, "CNY").when(F.col("c_nationkey") % 3 == 1, "USD").otherwise("USDT"))
    cash = cust.groupBy("currency").agg(F.sum("c_acctbal").alias("cash"))
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    pos = li.groupBy("currency", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol")).agg(F.sum("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("average_cost"))
    quotes = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_retailprice").alias("price"))
    return show(ld.mark_to_market(pos, quotes, cash), "currency", "cash", "value", "unrealized", "equity", cash=2, value=1, unrealized=1, equity=1)


def daily_pnl(spark, d):
    o = table(spark, d, "events").select("ts", F.when(F.col("event_type") == "view", "USD").otherwise("CNY").alias("currency"), F.col("value").alias("equity"))
    return show(ld.daily_pnl(o), "trading_date", "currency", "pnl")


def intelligence_snapshot(spark, d):
    said = ld.latest_group(_predictions(hourly(spark, d))).withColumns({"confidence": F.greatest("prob_up", "prob_down") * 100, "samples": F.length("id") * 30})
    e = table(spark, d, "events")
    factors = e.groupBy(F.col("event_type").alias("symbol"), (F.col("user_id") % 4).alias("f")).agg(F.count(F.lit(1)).alias("k")).select(
        "symbol", F.concat(F.lit("f"), "f").alias("feature"), (F.col("k") / 10000).alias("importance"), (F.col("k") % 2 == 0).alias("positive"))
    news = e.select(F.col("event_type").alias("symbol"), (F.col("user_id") % 90 - 45).cast("double").alias("sentiment"), F.get_json_object("props", "$.k").cast("double").alias("impact"))
    return show(ld.intelligence_snapshot(said, factors, news), "symbol", "horizon", "prediction", "evidence", "contributions", "news_score", "news_count")


SAID = [HOURLY_SQL, f"n0 AS (SELECT *, row_number() {W} - 1 AS n, lag(close) {W} AS pc FROM c)",
        """n1 AS (SELECT *, CASE WHEN n % 9 = 1 THEN 'FLAT' WHEN close > pc THEN 'UP' ELSE 'DOWN' END AS prediction, 0.2 + (n % 7) * 0.0501 AS b FROM n0 WHERE n % 3 = 1)""",
        """sd AS (SELECT symbol || '-' || n AS id, symbol, n, CASE WHEN symbol IN ('view','click','purchase') THEN 'CRYPTO' WHEN symbol = 'signup' THEN 'US' ELSE 'CN' END AS market,
  CASE n % 5 WHEN 0 THEN '1D' WHEN 1 THEN 'T+5' WHEN 2 THEN '1H' ELSE '4H' END AS horizon, ts + INTERVAL 10 MINUTE AS pt, ts + INTERVAL 4 HOUR AS tt, close AS entry, prediction,
  CAST(CASE WHEN prediction = 'UP' THEN 0.3 + b ELSE (0.7 - b) / 2 END AS DOUBLE) AS pu, CAST(CASE WHEN prediction = 'DOWN' THEN 0.3 + b ELSE (0.7 - b) / 2 END AS DOUBLE) AS pd,
  close * CASE WHEN prediction = 'DOWN' THEN 1.3 ELSE 0.7 END AS stop, close * CASE WHEN prediction = 'DOWN' THEN 0.5 ELSE 1.5 END AS tp, (n % 10) / 10.0 AS dq, CASE WHEN n % 2 = 0 THEN 'BULL' ELSE 'BEAR' END AS regime FROM n1)""",
        "bb AS (SELECT symbol, ts AS bts, n AS bn, high, low, close, max(n) OVER (PARTITION BY symbol) AS mx FROM n0)"]
SET = [*SAID, "f1 AS (SELECT sd.*, min(bn) AS first_n, any_value(mx) AS mx FROM sd JOIN bb ON sd.symbol = bb.symbol AND bts > pt GROUP BY ALL)",
       "f2 AS (SELECT sd.*, first_n, mx FROM sd LEFT JOIN (SELECT id, first_n, mx FROM f1) USING (id))",
       "f3 AS (SELECT *, CASE WHEN market = 'CRYPTO' THEN CASE horizon WHEN '1D' THEN 1440 WHEN '1H' THEN 60 WHEN '4H' THEN 240 END END AS mins, CASE WHEN market <> 'CRYPTO' THEN CASE horizon WHEN '1D' THEN 1 WHEN 'T+5' THEN 5 END END AS steps FROM f2)",
       "f4 AS (SELECT f3.*, bn AS cn, bts AS cts FROM f3 ASOF LEFT JOIN bb ON f3.symbol = bb.symbol AND f3.pt + to_minutes(coalesce(mins, 0)) <= bb.bts)",
       "mxs AS (SELECT symbol, max(bn) AS m FROM bb GROUP BY 1)",
       "f5 AS (SELECT f4.*, m, CASE WHEN market = 'CRYPTO' THEN cn ELSE first_n + steps - 1 END AS e FROM f4 JOIN mxs USING (symbol))",
       "f6 AS (SELECT *, CASE WHEN coalesce(mins, steps) IS NULL THEN 'UNSUPPORTED_HORIZON' WHEN e IS NULL OR e > m THEN 'TARGET_NOT_OBSERVED' WHEN market = 'CRYPTO' AND cts - (pt + to_minutes(mins)) > INTERVAL 66 MINUTE THEN 'CANDLE_GAP_AT_TARGET' END AS reason FROM f5)",
       "pth AS (SELECT id, min(low) AS lo, max(high) AS hi, arg_max(close, bn) AS ec, max(bts) AS end_ts FROM f6 JOIN bb ON f6.symbol = bb.symbol AND bn BETWEEN first_n AND e WHERE reason IS NULL GROUP BY 1)",
       "st AS (SELECT f6.*, lo, hi, ec, end_ts, ec / nullif(entry, 0) - 1 AS ar FROM f6 LEFT JOIN pth USING (id))",
       """se AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN ar > 0.2 THEN 'UP' WHEN ar < -0.2 THEN 'DOWN' ELSE 'FLAT' END END AS actual, CASE WHEN reason IS NULL THEN 'SETTLED' WHEN reason = 'TARGET_NOT_OBSERVED' THEN 'PENDING' ELSE 'UNAVAILABLE' END AS status FROM st)"""]
RES = [*SAID, "r1 AS (SELECT sd.*, bn AS e FROM sd ASOF JOIN bb ON sd.symbol = bb.symbol AND sd.tt <= bb.bts)", "r2 AS (SELECT r1.*, bn AS s FROM r1 ASOF JOIN bb ON r1.symbol = bb.symbol AND r1.pt <= bb.bts)",
       "pth AS (SELECT id, min(low) AS lo, max(high) AS hi, arg_max(close, bn) AS ec FROM r2 JOIN bb ON r2.symbol = bb.symbol AND bn BETWEEN least(s + 1, e) AND e GROUP BY 1)",
       "r3 AS (SELECT r2.*, 1 - pu - pd AS pf, lo, hi, ec, ec / nullif(entry, 0) - 1 AS ar FROM r2 JOIN pth USING (id))",
       """rs AS (SELECT *, CASE WHEN ar > 0.2 THEN 'UP' WHEN ar < -0.2 THEN 'DOWN' ELSE 'FLAT' END AS actual, CASE prediction WHEN 'UP' THEN lo <= stop WHEN 'DOWN' THEN hi >= stop ELSE FALSE END AS sh, CASE prediction WHEN 'UP' THEN hi >= tp WHEN 'DOWN' THEN lo <= tp ELSE FALSE END AS th,
  CASE prediction WHEN 'UP' THEN (ec - entry) / greatest(abs(entry - stop), 1e-12) WHEN 'DOWN' THEN (entry - ec) / greatest(abs(entry - stop), 1e-12) ELSE 0 END AS rr FROM r3)"""]


def _metrics(src: str) -> str:
    tp = {k: f"count(*) FILTER (prediction = '{k}' AND actual = '{k}')" for k in ld.CLASSES}
    pp = {k: f"greatest(count(*) FILTER (prediction = '{k}'), 1)" for k in ld.CLASSES}
    ap = {k: f"greatest(count(*) FILTER (actual = '{k}'), 1)" for k in ld.CLASSES}
    prec = "(" + " + ".join(f"{tp[k]} / {pp[k]}" for k in ld.CLASSES) + ") / 3"
    rec = "(" + " + ".join(f"{tp[k]} / {ap[k]}" for k in ld.CLASSES) + ") / 3"
    f1 = "(" + " + ".join(f"2 * ({tp[k]} / {pp[k]}) * ({tp[k]} / {ap[k]}) / greatest({tp[k]} / {pp[k]} + {tp[k]} / {ap[k]}, 1e-12)" for k in ld.CLASSES) + ") / 3"
    base = "greatest(" + ", ".join(f"count(*) FILTER (actual = '{k}')" for k in ld.CLASSES) + ") / count(*)"
    return f"""count(*) AS samples, avg(CASE WHEN prediction = actual THEN 1.0 ELSE 0 END) AS accuracy, {prec} AS prec, {rec} AS rec, {f1} AS f1, {base} AS base,
  avg(pow(pd - CAST(actual = 'DOWN' AS INT), 2) + pow(pf - CAST(actual = 'FLAT' AS INT), 2) + pow(pu - CAST(actual = 'UP' AS INT), 2)) AS brier,
  -avg(ln(greatest(CASE actual WHEN 'DOWN' THEN pd WHEN 'FLAT' THEN pf ELSE pu END, 1e-12))) AS ll, avg(abs(greatest(pd, pf, pu) - CAST(prediction = actual AS INT))) AS gap,
  avg(CAST(sh AS INT)) AS shr, avg(CAST(th AS INT)) AS thr, avg(rr) AS ar2, sum(rr) FILTER (rr > 0) / -sum(rr) FILTER (rr < 0) AS pfac, corr(pu - pd, ar) AS ic, sqrt(252) * avg(rr) / stddev_samp(rr) AS sh2 FROM {src}"""


STATS = q(*RES, "g AS (" + " UNION ALL ".join(f"SELECT '{lv}' AS level, {k} AS key, {_metrics('rs')} GROUP BY {k}" if k != "'all'" else f"SELECT 'overall' AS level, 'all' AS key, {_metrics('rs')}"
                                               for lv, k in (("overall", "'all'"), ("horizon", "horizon"), ("regime", "regime"))) + ")",
          final=f"""SELECT level, key, samples, {R('accuracy')} AS accuracy, {R('prec')} AS precision_macro, {R('rec')} AS recall_macro, {R('f1')} AS f1_macro, {R('brier')} AS brier_score, {R('ll')} AS log_loss, {R('gap')} AS calibration_gap,
  {R('shr')} AS stop_hit_rate, {R('thr')} AS tp_hit_rate, {R('ar2')} AS average_r, {R('pfac')} AS profit_factor, {R('ic')} AS ic, {R('sh2')} AS sharpe FROM g""")
TRACK = q(*RES, "g AS (" + " UNION ALL ".join(f"SELECT '{lv}' AS level, {k} AS key, {_metrics('rs')} GROUP BY {k}" if k != "'all'" else f"SELECT 'overall' AS level, 'all' AS key, {_metrics('rs')}"
                                               for lv, k in (("overall", "'all'"), ("horizon", "horizon"), ("asset", "symbol"), ("market", "market"))) + ")",
          final=f"""SELECT level, key, samples, {R('accuracy')} AS accuracy, {R('base')} AS baseline, {R('accuracy - base')} AS edge, CASE WHEN samples < 30 THEN 'INSUFFICIENT_EVIDENCE' WHEN accuracy - base >= 0.03 THEN 'USEFUL' ELSE 'NO_EDGE' END AS status, {R('f1')} AS f1_macro FROM g""")

QUERIES = {
    "settle_predictions": (settle_predictions, q(*SET, final=f"""SELECT id, market, horizon, status, reason, end_ts, {R('ar')} AS actual_return, actual,
  coalesce(CASE prediction WHEN 'UP' THEN lo <= stop WHEN 'DOWN' THEN hi >= stop ELSE FALSE END, FALSE) AS stop_hit, coalesce(CASE prediction WHEN 'UP' THEN hi >= tp WHEN 'DOWN' THEN lo <= tp ELSE FALSE END, FALSE) AS target_hit,
  CASE WHEN reason IS NULL THEN {R("coalesce(CASE prediction WHEN 'UP' THEN ar WHEN 'DOWN' THEN -ar ELSE 0 END * entry / nullif(abs(entry - stop), 0), 0)")} END AS realized_r, coalesce(actual = prediction, FALSE) AS correct FROM se""")),
    "settle_incremental": (settle_incremental, q(*SET, final=f"SELECT id, actual, {R('ar')} AS actual_return FROM se WHERE status = 'SETTLED' AND pt >= TIMESTAMP '2024-01-15'")),
    "settlement_status": (settlement_status, q(*SET, final="SELECT market, symbol, horizon, count(*) AS total, count(*) FILTER (status = 'SETTLED') AS settled, count(*) FILTER (status = 'PENDING') AS pending FROM se GROUP BY ROLLUP (market, symbol, horizon)")),
    "resolve_predictions": (resolve_predictions, q(*RES, final=f"""SELECT id, {R('ar')} AS actual_return, actual, sh AS stop_hit, th AS target_hit, {R('rr')} AS realized_r, {R("CASE WHEN prediction = 'DOWN' THEN entry / nullif(hi, 0) - 1 ELSE lo / nullif(entry, 0) - 1 END")} AS mae,
  {R("CASE WHEN prediction = 'DOWN' THEN entry / nullif(lo, 0) - 1 ELSE hi / nullif(entry, 0) - 1 END")} AS mfe, actual = prediction AS correct, CASE WHEN actual <> prediction THEN CASE WHEN dq < 0.6 THEN 'DATA_QUALITY' WHEN greatest(pu, pd, pf) >= 0.65 THEN 'OVERCONFIDENCE' WHEN prediction = 'FLAT' THEN 'MAGNITUDE_ERROR'
  WHEN abs(ar) > 0.4 THEN 'VOLATILITY_SPIKE' ELSE 'WRONG_DIRECTION' END END AS failure FROM rs""")),
    "prediction_stats": (prediction_stats, STATS),
    "prediction_reliability": (prediction_reliability, q(*RES, "k AS (SELECT CAST(least(9, floor(round(greatest(pu, pd, pf) * 10, 9))) AS BIGINT) AS bin, greatest(pu, pd, pf) AS cf, CAST(prediction = actual AS INT) AS ok FROM rs)",
                                                         "b AS (SELECT bin, count(*) AS samples, avg(cf) AS predicted, avg(ok) AS observed FROM k GROUP BY 1)",
                                                         final=f"SELECT bin, samples, {R('predicted')} AS predicted, {R('observed')} AS observed, {R('sum(samples * abs(predicted - observed)) OVER () / sum(samples) OVER ()')} AS ece FROM b")),
    "track_record": (track_record, TRACK),
    "model_lab": (model_lab, q(*RES, final=f"SELECT symbol, horizon, count(*) AS samples, {R('avg(CAST(prediction = actual AS INT))')} AS accuracy, {R('avg(abs(ar))')} AS mean_move FROM rs GROUP BY 1, 2")),
    "snapshot_changes": (snapshot_changes, q(*SAID, "k AS (SELECT symbol, horizon, prediction, pu * 100 AS up, lag(prediction) OVER w AS pd0, lag(pu * 100) OVER w AS up0, row_number() OVER (PARTITION BY symbol, horizon ORDER BY pt DESC) AS r FROM sd WINDOW w AS (PARTITION BY symbol, horizon ORDER BY pt))",
                                             final=f"SELECT symbol, horizon, pd0 AS \"from\", prediction AS \"to\", {R('up - up0')} AS up_delta FROM k WHERE r = 1 AND (pd0 <> prediction OR abs(up - up0) >= 3)")),
    "latest_predictions": (latest_predictions, q(*SAID, final=f"SELECT id, symbol, horizon, prediction, {R('pu')} AS prob_up FROM sd QUALIFY pt = max(pt) OVER (PARTITION BY symbol)")),
    "newest_predictions": (newest_predictions, q(*SAID, final="SELECT id, prediction FROM sd ORDER BY id DESC LIMIT 100")),
    "score_changes": (score_changes, q(HOURLY_SQL, f"k AS (SELECT symbol, ts, CAST(floor(close / 20) AS BIGINT) AS score, CAST(lag(floor(close / 20)) {W} AS BIGINT) AS previous FROM c)", final="SELECT symbol, ts, score, CAST(previous AS DOUBLE) AS previous, CAST(score - previous AS DOUBLE) AS delta FROM k WHERE previous IS NULL OR previous <> score")),
    "mark_to_market": (mark_to_market, f"""WITH cu AS (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'USDT' END AS currency FROM customer),
  p AS (SELECT currency, l_partkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey GROUP BY 1, 2),
  v AS (SELECT currency, sum(CASE WHEN p_size > 10 THEN qty * p_retailprice ELSE cost END) AS value, sum(CASE WHEN p_size > 10 THEN qty * p_retailprice - cost ELSE 0 END) AS u FROM p JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT currency, {R('cash', 2)} AS cash, {R('value', 1)} AS value, {R('u', 1)} AS unrealized, {R('cash + value', 1)} AS equity FROM (SELECT currency, sum(c_acctbal) AS cash FROM cu GROUP BY 1) JOIN v USING (currency)"""),
    "daily_pnl": (daily_pnl, f"SELECT CAST(ts AS DATE) AS trading_date, CASE WHEN event_type = 'view' THEN 'USD' ELSE 'CNY' END AS currency, {R('arg_max(value, ts) - arg_min(value, ts)')} AS pnl FROM events GROUP BY 1, 2"),
    "intelligence_snapshot": (intelligence_snapshot, q(*SAID, "lp AS (SELECT * FROM sd QUALIFY pt = max(pt) OVER (PARTITION BY symbol))", "f AS (SELECT event_type AS symbol, 'f' || user_id % 4 AS feature, count(*) AS k FROM events GROUP BY 1, 2)",
                                                       "ff AS (SELECT symbol, string_agg(feature || ':' || printf('%.4f', CASE WHEN k % 2 = 0 THEN k / 100.0 ELSE -k / 100.0 END), '|' ORDER BY k DESC, feature) AS contributions FROM f GROUP BY 1)",
                                                       "nw AS (SELECT event_type AS symbol, avg((user_id % 90 - 45) * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS ns, count(*) AS nc FROM events GROUP BY 1)",
                                                       final=f"SELECT symbol, horizon, prediction, CASE WHEN length(id) * 30 >= 250 AND greatest(pu, pd) * 100 >= 70 THEN 'A' WHEN length(id) * 30 >= 120 AND greatest(pu, pd) * 100 >= 55 THEN 'B' ELSE 'C' END AS evidence, contributions, {R('ns')} AS news_score, nc AS news_count FROM lp JOIN ff USING (symbol) JOIN nw USING (symbol)")),
}
