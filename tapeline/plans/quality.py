"""Validation, calendar and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import ranks
from tapeline.operators import calendar as cal, features as feat, identity as idn, indicators as ind, quality as ql
from tapeline.plans.bars import TR, WIN, q
from tapeline.plans.base import DAILY_SQL, HOURLY_SQL, R, W, daily, hourly, r, roll, rows, show, table

NOW = "2024-01-25 00:00:00"


def _raw(spark, d):
    """Events read as raw candle rows in arrival order, with faults that their numbers imply."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return e.select(
        F.col("event_type").alias("symbol"), F.lit("1h").alias("interval"), F.date_trunc("hour", "ts").cast("string").alias("ts"), F.col("event_id").alias("seq"),
        v.cast("string").alias("open"), F.when(k % 17 == 0, v - 2).otherwise(v + 1).cast("string").alias("high"), (v - 1).cast("string").alias("low"),
        F.when(k % 29 == 0, None).otherwise(v.cast("string")).alias("close"), F.when(k % 13 == 0, "n/a").otherwise((k - 3).cast("string")).alias("volume"))


def validate_codes(spark, d):
    return ql.validate(_raw(spark, d)).groupBy("symbol", F.coalesce("code", F.lit("OK")).alias("code")).agg(F.count(F.lit(1)).alias("rows"))


def validate_rejects(spark, d):
    return ql.split_valid(ql.validate(_raw(spark, d)))[1].select("symbol", "seq", "code")


def _typed(spark, d):
    raw = _raw(spark, d)
    return raw.select("symbol", "interval", F.to_timestamp("ts").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def audit_dataset(spark, d):
    return ql.dataset_audit(_typed(spark, d), "CRYPTO", "1h", NOW).drop("interval")


def audit_totals(spark, d):
    return ql.audit_totals(ql.dataset_audit(_typed(spark, d), "CRYPTO", "1h", NOW))


def audit_version(spark, d):
    return ql.dataset_version(ql.dataset_audit(_typed(spark, d), "CRYPTO", "1h", NOW), "CRYPTO", "1h").select("version", "members")


def coverage_hash(spark, d):
    bars = hourly(spark, d).withColumn("market", F.lit("CRYPTO")).unionByName(daily(spark, d).withColumn("market", F.lit("US")))
    return ql.coverage_hash(bars)


def coverage_matrix(spark, d):
    bars = hourly(spark, d).withColumn("market", F.lit("CRYPTO"))
    e = table(spark, d, "events")
    said = e.select(F.lit("CRYPTO").alias("market"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "1H").otherwise("4H").alias("horizon"))
    extra = table(spark, d, "supplier").select(F.lit("US").alias("market"), F.col("s_name").alias("symbol"), F.lit("1D").alias("horizon"))
    return ql.coverage_matrix(bars, said.unionByName(extra))


def leakage_audit(spark, d):
    return ql.leakage_audit(feat.future_path(hourly(spark, d), 4).filter("target_time is not null"), NOW)


def strategy_quality(spark, d):
    return show(ql.strategy_quality(hourly(spark, d), "2024-01-31 02:00:00"), "symbol", "completeness", "continuity", "validity", "freshness", "score", "status")


def research_quality(spark, d):
    cols = ["return_1", "return_20", "high_position_120", "historical_volatility"]
    k = F.get_json_object("props", "$.k").cast("int")
    ext = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.when(k % 3 == 0, "AVAILABLE").when(k % 3 == 1, "NO_DATA").otherwise("NOT_APPLICABLE").alias("status"),
                                           F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("source"), (k == 99).cast("int").alias("conflicts"))
    return show(ql.research_quality(feat.price_features(hourly(spark, d)), ext, "2024-01-31 02:00:00", cols), "symbol", "completeness", "feature_alignment",
                "external_coverage", "source_count", "conflict_count", "score", "grade")


def prediction_completeness(spark, d):
    cols = ["return_1", "return_20", "high_position_120"]
    return show(ql.prediction_completeness(feat.price_features(hourly(spark, d)), cols), "symbol", "completeness")


def reconcile_quotes(spark, d):
    e = table(spark, d, "events")
    quotes = ranks.quantiles(e.select(F.col("event_type").alias("symbol"), (F.col("user_id") % 3).alias("source"), "value"), ["symbol", "source"], "value", {"price": 0.5})
    return show(ql.reconcile_quotes(quotes), "symbol", "sources", "status", "spread_percent", "conflict")


def universe_version(spark, d):
    s = table(spark, d, "supplier")
    members = s.select(F.col("s_name").alias("symbol"), (F.col("s_nationkey") % 4 != 0).alias("active"), F.lit("1995-01-01").alias("effective_from"),
                       F.when(F.col("s_nationkey") % 4 == 0, "2001-01-01").alias("effective_to"))
    return ql.universe_version(members, "US", "2024-01-31").select("version", "members", "as_of", "market")


def universe_top(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("quote_volume"))
    tick = li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "-BTC").otherwise("-USDT")).alias("instrument"),
                     F.round("quote_volume", 2).alias("quote_volume"))
    return ql.select_universe(tick, 100, 50)


def news_eligibility(spark, d):
    doc, e = table(spark, d, "documents"), table(spark, d, "events").agg(F.min("ts").alias("t0"))
    i = F.col("doc_id")
    when = F.date_format(F.timestamp_seconds(F.unix_seconds("t0") + F.pmod(i, F.lit(720)) * 3600), "yyyy-MM-dd HH:mm:ss")
    news = doc.crossJoin(F.broadcast(e)).select("doc_id", F.when(i % 11 == 0, None).when(i % 13 == 0, "yesterday").otherwise(when).alias("published_raw"),
                                                F.lit(NOW).cast("timestamp").alias("prediction_ts"), (i % 7).cast("double").alias("sentiment"))
    return ql.news_eligibility(news).select("doc_id", "reason", "eligible", "value")


def production_gate(spark, d):
    s = table(spark, d, "supplier")
    marks = {g: F.when(F.pmod(F.col("s_suppkey"), F.lit(i + 9)) == 0, F.lit(None).cast("boolean")).otherwise(F.pmod(F.col("s_suppkey"), F.lit(i + 5)) != 1) for i, g in enumerate(ql.GATES)}
    out = ql.production_gate(s.select("s_suppkey", *[v.alias(k) for k, v in marks.items()]))
    return out.select("s_suppkey", F.array_join("failed_gates", "|").alias("failed_gates"), "qualified", "decision")


def feature_availability(spark, d):
    bars = ind.volatility(ind.returns(ind.atr_sma(hourly(spark, d)), (1, 5)))
    groups = {"market": ["open", "high", "low", "close", "volume"], "technical": ["atr", "volatility"], "flow": ["volume"], "sentiment": ["return_5"]}
    return show(ql.availability(bars, groups, absent=3).drop("interval"), "symbol", *[f"{g}_available" for g in groups], "coverage", "data_status")


def model_fingerprint(spark, d):
    return ql.model_fingerprint(hourly(spark, d), "4H", "BTC", "v1").select("symbol", "ts", "fingerprint")


# --- calendar -----------------------------------------------------------------


def trading_minutes(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_trunc("minute", "ts").alias("ts"), F.col("user_id").alias("add"))
    add = (F.col("add") * 7) % 700
    return e.select("event_id", add.alias("minutes"), cal.add_trading_minutes(F.col("ts"), add, "CN").alias("cn"), cal.add_trading_minutes(F.col("ts"), add, "US").alias("us"))


def future_stamps(spark, d):
    bars = hourly(spark, d).select("symbol", "interval", "ts")
    market = F.when(F.col("symbol").isin("view", "click"), "CRYPTO").when(F.col("symbol") == "signup", "US").otherwise("CN")
    return cal.future_stamp(bars.withColumn("market", market).join(F.broadcast(cal.horizons(spark)), "interval")).select("symbol", "market", "ts", "horizon", "bars", "target_ts")


def target_alignment(spark, d):
    return show(cal.align_targets(hourly(spark, d).select("symbol", "interval", "ts", "close"), "CRYPTO", "1h", 4, 240), "symbol", "ts", "close", "target_time", "target_close")


def target_alignment_daily(spark, d):
    return show(cal.align_targets(daily(spark, d).select("symbol", "interval", "ts", "close"), "CN", "1d", 5, 7200), "symbol", "ts", "close", "target_time", "target_close")


def session_status(spark, d):
    e = table(spark, d, "events")
    market = F.when(F.col("event_id") % 3 == 0, "CRYPTO").when(F.col("event_id") % 3 == 1, "US").otherwise("CN")
    return e.select("event_id", market.alias("market"), cal.market_open(F.col("ts"), market).alias("open"), cal.session_status(F.col("ts"), market).alias("status"))


def utc_parsing(spark, d):
    e = table(spark, d, "events")
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("+00:00"))).when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("-05:00"))).otherwise(base)
    return e.select("event_id", cal.utc_of_text(text).alias("utc"))


# --- identity -----------------------------------------------------------------

def _symbols(spark, d):
    s = table(spark, d, "customer")
    six = F.lpad((F.col("c_custkey") * 613 % 1000000).cast("string"), 6, "0")
    i = F.col("c_custkey") % 9
    raw = (F.when(i == 0, six).when(i == 1, F.concat(six, F.lit(".SS"))).when(i == 2, F.concat(F.lit("sz"), six)).when(i == 3, F.concat(F.lit("NASDAQ:"), F.col("c_mktsegment")))
           .when(i == 4, F.concat(F.col("c_mktsegment"), F.lit("/USDT"))).when(i == 5, F.concat(F.lit(" coin"), F.col("c_nationkey"), F.lit("-usdt")))
           .when(i == 6, F.concat(six, F.lit(".SZ"))).when(i == 7, F.concat(F.lit("SH"), six)).otherwise(F.concat(F.lit("NYSE:"), F.lower("c_mktsegment"))))
    return s.select("c_custkey", raw.alias("raw"), F.when(i.isin(4, 5), "crypto").otherwise("stock").alias("asset_type"))


def symbol_identity(spark, d):
    out = idn.identity(_symbols(spark, d))
    return out.select("c_custkey", "canonical_symbol", "market", "exchange", "currency", "timezone", "provider_symbol", "aliases",
                      F.when(F.col("market") == "CN", idn.security_id(F.col("raw"))).alias("security_id"), idn.paper_currency(F.col("canonical_symbol")).alias("paper_currency"),
                      idn.backfill_market(F.col("canonical_symbol"), F.col("asset_type")).alias("backfilled"))


def _registry(spark, d):
    part = table(spark, d, "part")
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.concat_ws("|", "p_brand", "p_type").alias("aliases"),
                       F.col("p_type").alias("base_asset"), F.when(F.col("p_partkey") % 2 == 0, "stock").otherwise("crypto").alias("asset_type"),
                       F.when(F.col("p_size") > 5, "TRADING").otherwise("halted").alias("status"), F.lit("US").alias("market"),
                       F.concat(F.lit("src"), (F.col("p_size") % 3).cast("string")).alias("source"), F.col("p_size").alias("updated_at"))


def registry_search(spark, d):
    asked = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("query")).unionByName(
        table(spark, d, "supplier").select(F.concat(F.lit("p1"), F.col("s_suppkey").cast("string")).alias("query"))).unionByName(
        table(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("query"))).distinct()
    return idn.search(asked, _registry(spark, d), 20).select("query", "symbol", "match", "rank")


def registry_alias_search(spark, d):
    asked = table(spark, d, "supplier").select(F.concat(F.lit("p1"), F.col("s_suppkey").cast("string")).alias("query"))
    return idn.alias_search(asked, _registry(spark, d), 5)


def registry_members(spark, d):
    return idn.members(_registry(spark, d), "US", 1000).select("symbol", "status")


def registry_status(spark, d):
    return idn.registry_status(_registry(spark, d))


RAW = """raw AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id AS seq, value AS open, CASE WHEN k % 17 = 0 THEN value - 2 ELSE value + 1 END AS high, value - 1 AS low,
  CASE WHEN k % 29 = 0 THEN NULL ELSE value END AS close, CASE WHEN k % 13 = 0 THEN NULL ELSE k - 3 END AS volume, k % 29 = 0 AS miss, k % 13 = 0 AS badtype
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
VAL = [RAW, "v0 AS (SELECT *, coalesce(least(open, high, low, close) <= 0 OR high < greatest(open, close) OR low > least(open, close) OR high < low, TRUE) AS bad, coalesce(volume < 0, FALSE) AS neg FROM raw)",
       "v1 AS (SELECT *, NOT miss AND NOT badtype AND NOT bad AND NOT neg AS ok FROM v0)",
       "v2 AS (SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v1)",
       "v3 AS (SELECT *, ok AND (top IS NULL OR ts > top) AS acc FROM v2)", "acc AS (SELECT symbol, ts, min(seq) AS s FROM v3 WHERE acc GROUP BY 1, 2)",
       """v4 AS (SELECT v3.symbol, seq, CASE WHEN miss THEN 'MISSING_FIELDS' WHEN badtype THEN 'INVALID_TYPE' WHEN s < seq THEN 'DUPLICATE_TIMESTAMP' WHEN v3.ts <= top THEN 'OUT_OF_ORDER' WHEN bad THEN 'BAD_OHLC'
  WHEN neg THEN 'NEGATIVE_VOLUME' END AS code FROM v3 LEFT JOIN acc ON acc.symbol = v3.symbol AND acc.ts = v3.ts)"""]
AUD = [RAW, """a0 AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS g, CAST(close IS NULL AS INT) + CAST(volume IS NULL AS INT) AS m FROM raw)""",
       f"""au AS (SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS "end", CAST(sum(m) AS BIGINT) AS missing_values, count(*) - count(DISTINCT ts) AS duplicate_timestamps,
  count(*) FILTER (least(open, high, low, close) <= 0 OR high < greatest(open, close) OR low > least(open, close) OR high < low) AS ohlc_invalid, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE) AS future_rows, count(*) FILTER (g > 7560) AS gap_rows, 'FAILED' AS status FROM a0 GROUP BY 1)"""]
FLAT = "symbol || ',' || rows || ',' || missing_values || ',' || duplicate_timestamps || ',' || ohlc_invalid || ',' || negative_volume || ',' || future_rows || ',' || gap_rows"

CN_CTE = """x AS (SELECT event_id, date_trunc('minute', ts) AS ts, (user_id * 7) % 700 AS a FROM events),
 l AS (SELECT *, ts + INTERVAL 8 HOUR AS c, ts - INTERVAL 5 HOUR AS u FROM x),
 n AS (SELECT *, date_diff('day', DATE '1970-01-05', CAST(c AS DATE)) AS cd, date_diff('day', DATE '1970-01-05', CAST(u AS DATE)) AS ud, hour(c) * 60 + minute(c) AS cm, hour(u) * 60 + minute(u) AS um FROM l),
 o AS (SELECT *, (cd // 7 * 5 + least(cd % 7, 4)) * 240 + CASE WHEN cd % 7 >= 5 THEN 240 WHEN cm < 570 THEN 0 WHEN cm <= 690 THEN cm - 570 WHEN cm <= 780 THEN 120 WHEN cm < 900 THEN cm - 660 ELSE 240 END + a AS ct,
   (ud // 7 * 5 + least(ud % 7, 4)) * 390 + CASE WHEN ud % 7 >= 5 THEN 390 WHEN um < 570 THEN 0 WHEN um < 960 THEN um - 570 ELSE 390 END + a AS ut FROM n)"""


def _wd(day: str) -> str:
    return f"(CAST(DATE '1970-01-05' AS TIMESTAMP) + to_days(CAST(({day}) // 5 * 7 + ({day}) % 5 AS INTEGER)))"


MIN_SQL = f"""WITH {CN_CTE} SELECT event_id, a AS minutes,
  CASE WHEN a = 0 THEN ts ELSE {_wd('(ct - 1) // 240')} + to_minutes(CASE WHEN (ct - 1) % 240 + 1 <= 120 THEN 570 ELSE 660 END + (ct - 1) % 240 + 1) - INTERVAL 8 HOUR END AS cn,
  CASE WHEN a = 0 THEN ts ELSE {_wd('(ut - 1) // 390')} + to_minutes(570 + (ut - 1) % 390 + 1) + INTERVAL 5 HOUR END AS us FROM o"""

FUT_SQL = f"""WITH {HOURLY_SQL}, m AS (SELECT symbol, ts, CASE WHEN symbol IN ('view','click') THEN 'CRYPTO' WHEN symbol = 'signup' THEN 'US' ELSE 'CN' END AS market FROM c),
 h AS (SELECT * FROM (VALUES ('1H', 1, 60), ('4H', 4, 240), ('1D', 24, 1440)) v(horizon, bars, a)),
 l AS (SELECT *, CASE market WHEN 'US' THEN ts - INTERVAL 5 HOUR ELSE ts + INTERVAL 8 HOUR END AS z, CASE market WHEN 'US' THEN 390 ELSE 240 END AS len FROM m, h),
 n AS (SELECT *, date_diff('day', DATE '1970-01-05', CAST(z AS DATE)) AS dd, hour(z) * 60 + minute(z) AS mm FROM l),
 o AS (SELECT *, dd // 7 * 5 + least(dd % 7, 4) AS wn, CASE WHEN dd % 7 >= 5 THEN len WHEN mm < 570 THEN 0 WHEN market = 'US' THEN least(mm - 570, 390) WHEN mm <= 690 THEN mm - 570 WHEN mm <= 780 THEN 120 WHEN mm < 900 THEN mm - 660 ELSE 240 END AS off FROM n),
 p AS (SELECT *, wn * len + off + a AS t FROM o)
 SELECT symbol, market, ts, horizon, CAST(bars AS BIGINT) AS bars, CASE WHEN market = 'CRYPTO' THEN ts + to_minutes(a) WHEN horizon = '1D' THEN {_wd('wn + 1')} + to_minutes(mm) + to_hours(CASE market WHEN 'US' THEN 5 ELSE -8 END)
   ELSE {_wd('(t - 1) // len')} + to_minutes(CASE WHEN market = 'CN' AND (t - 1) % len + 1 > 120 THEN 660 ELSE 570 END + (t - 1) % len + 1) + to_hours(CASE market WHEN 'US' THEN 5 ELSE -8 END) END AS target_ts FROM p"""

STATUS_SQL = """WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CRYPTO' WHEN 1 THEN 'US' ELSE 'CN' END AS market, CASE event_id % 3 WHEN 1 THEN ts - INTERVAL 5 HOUR ELSE ts + INTERVAL 8 HOUR END AS z FROM events),
 m AS (SELECT *, hour(z) * 60 + minute(z) AS mm, isodow(z) < 6 AS wk FROM l),
 o AS (SELECT *, CASE market WHEN 'CRYPTO' THEN TRUE WHEN 'US' THEN wk AND mm >= 570 AND mm < 960 ELSE wk AND (mm >= 570 AND mm < 690 OR mm >= 780 AND mm < 900) END AS open FROM m)
 SELECT event_id, market, open, CASE WHEN open THEN 'OPEN' WHEN market = 'US' AND wk AND mm >= 240 AND mm < 570 THEN 'PRE_MARKET' ELSE 'CLOSED' END AS status FROM o"""

SYM_CTE = """s AS (SELECT c_custkey, c_custkey % 9 AS i, lpad(CAST(c_custkey * 613 % 1000000 AS VARCHAR), 6, '0') AS six, c_mktsegment AS seg, c_nationkey AS nk FROM customer),
 k AS (SELECT c_custkey, i, six, CASE WHEN i IN (4, 5) THEN 'CRYPTO' WHEN i IN (3, 8) THEN 'US' ELSE 'CN' END AS market,
  CASE WHEN i IN (3, 8) THEN seg WHEN i = 4 THEN seg WHEN i = 5 THEN 'COIN' || nk WHEN i IN (1, 7) THEN six || '.SH' WHEN i IN (2, 6) THEN six || '.SZ' WHEN left(six, 1) IN ('5','6','9') THEN six || '.SH' ELSE six || '.SZ' END AS can FROM s)"""
ID_SQL = f"""WITH {SYM_CTE}, p AS (SELECT *, CASE WHEN market = 'CN' THEN six ELSE can END AS code, can LIKE '%.SH' AS sh FROM k)
 SELECT c_custkey, can AS canonical_symbol, market, CASE WHEN market = 'CRYPTO' THEN 'OKX' WHEN market = 'US' THEN 'US' WHEN sh THEN 'SSE' ELSE 'SZSE' END AS exchange,
  CASE market WHEN 'CRYPTO' THEN 'USDT' WHEN 'CN' THEN 'CNY' ELSE 'USD' END AS currency, CASE market WHEN 'CRYPTO' THEN 'UTC' WHEN 'CN' THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS timezone,
  CASE WHEN market = 'CRYPTO' THEN can || '-USDT' ELSE code END AS provider_symbol,
  CASE market WHEN 'CRYPTO' THEN can || 'USDT|' || can || '/USDT|' || can || '-USDT' WHEN 'CN' THEN code || '|' || code || CASE WHEN sh THEN '.SS' ELSE '.SZ' END ELSE code || '|NASDAQ:' || code || '|NYSE:' || code END AS aliases,
  CASE WHEN market = 'CN' THEN CASE WHEN sh THEN '1.' ELSE '0.' END || code END AS security_id, CASE market WHEN 'CN' THEN 'CNY' ELSE 'USD' END AS paper_currency, market AS backfilled FROM p"""

REG_CTE = "rg AS (SELECT 'P' || p_partkey AS symbol, p_name AS name, p_brand || '|' || p_type AS aliases, p_type AS base, p_partkey % 2 = 0 AS stock, p_size FROM part)"
SEARCH_SQL = f"""WITH {REG_CTE}, qs AS (SELECT lower(left(n_name, 3)) AS query FROM nation UNION SELECT 'p1' || s_suppkey FROM supplier UNION SELECT split_part(p_name, ' ', 1) FROM part),
 m AS (SELECT query, symbol, CASE WHEN lower(symbol) = query THEN 0 WHEN lower(base) = query THEN 1 WHEN lower(name) = query THEN 2 WHEN starts_with(lower(symbol), query) THEN 3 ELSE 4 END AS match
   FROM rg, qs WHERE contains(lower(symbol), query) OR contains(lower(name), query) OR contains(lower(aliases), query) OR contains(lower(base), query)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match, length(symbol), symbol) AS rank FROM m) SELECT query, symbol, match, rank FROM k WHERE rank <= 20"""
ALIAS_SQL = f"""WITH {REG_CTE}, qs AS (SELECT 'p1' || s_suppkey AS query FROM supplier),
 m AS (SELECT query, symbol, stock, row_number() OVER (PARTITION BY query, stock ORDER BY CASE WHEN lower(symbol) = query THEN 0 WHEN starts_with(lower(symbol), query) THEN 3 ELSE 4 END, length(symbol), symbol) AS rank FROM rg, qs
   WHERE contains(lower(symbol), query) OR contains(lower(name), query) OR contains(lower(aliases), query) OR contains(lower(base), query))
 SELECT query, symbol AS canonical_symbol, CASE WHEN stock THEN 'US' ELSE 'CRYPTO' END AS market, CASE WHEN stock THEN 'US' ELSE 'OKX' END AS exchange FROM m WHERE rank <= 5"""

GATE_LIST = ", ".join(f"CASE WHEN s_suppkey % {i + 9} = 0 OR s_suppkey % {i + 5} = 1 THEN '{g}' END" for i, g in enumerate(ql.GATES))

def tree(order, line, source):
    """Digest tree of any number of rows: runs of 64 digests, and runs of runs until one is left; equal places by the row's digest."""
    places = ", ".join(f"{x} NULLS FIRST" for x in order.split(", "))
    return f"""(WITH RECURSIVE leaf AS (SELECT *, sha256({line}) AS h_ FROM {source}),
    lv AS (SELECT 0 AS depth, row_number() OVER (ORDER BY {places}, h_) - 1 AS at_, h_ AS h, count(*) OVER () AS n_, count(*) OVER () AS k FROM leaf
      UNION ALL SELECT depth + 1, at_ // 64, sha256(string_agg(h, '' ORDER BY at_)), (n_ + 63) // 64, k FROM lv WHERE depth = 0 OR n_ > 1 GROUP BY depth, at_ // 64, n_, k)
    SELECT max(h) AS digest, CAST(coalesce(max(k), 0) AS BIGINT) AS members FROM lv WHERE depth > 0 AND n_ = 1)"""


QUERIES = {
    "validate_codes": (validate_codes, q(*VAL, final="SELECT symbol, coalesce(code, 'OK') AS code, count(*) AS rows FROM v4 GROUP BY 1, 2")),
    "validate_rejects": (validate_rejects, q(*VAL, final="SELECT symbol, seq, code FROM v4 WHERE code IS NOT NULL")),
    "audit_dataset": (audit_dataset, q(*AUD, final="SELECT * FROM au")),
    "audit_totals": (audit_totals, q(*AUD, final="SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("rows", "missing_values", "duplicate_timestamps", "ohlc_invalid", "negative_volume", "future_rows", "gap_rows")) + ", FALSE AS passed FROM au")),
    "audit_version": (audit_version, q(*AUD, final=f"SELECT 'CRYPTO-1h-' || left(digest, 16) AS version, members FROM {tree('symbol', FLAT, 'au')}")),
    "coverage_hash": (coverage_hash, f"""WITH t1 AS (WITH {HOURLY_SQL} SELECT 'CRYPTO' AS market, symbol, '1h' AS i, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS a, CAST(epoch(max(ts)) AS BIGINT) AS b FROM c GROUP BY 2),
  t2 AS (WITH {DAILY_SQL} SELECT 'US' AS market, symbol, '1d' AS i, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS a, CAST(epoch(max(ts)) AS BIGINT) AS b FROM c GROUP BY 2), u AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)
  SELECT digest, members FROM """ + tree("market, symbol, i", "market || ',' || symbol || ',' || i || ',' || n || ',' || a || ',' || b", "u")),
    "coverage_matrix": (coverage_matrix, q(HOURLY_SQL, "l AS (SELECT 'CRYPTO' AS market, symbol, count(*) AS candles FROM c GROUP BY 2)",
                                           "p AS (SELECT 'CRYPTO' AS market, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN '1H' ELSE '4H' END AS h, count(*) AS k FROM events GROUP BY 2, 3 UNION ALL SELECT 'US', s_name, '1D', count(*) FROM supplier GROUP BY 2)",
                                           "g AS (SELECT market, symbol, CAST(sum(k) AS BIGINT) AS predictions, string_agg(h || ':' || k, '|' ORDER BY h || ':' || k) AS by_horizon FROM p GROUP BY 1, 2)",
                                           final="SELECT market, symbol, coalesce(candles, 0) AS candles, CAST(CASE WHEN candles IS NULL THEN 0 ELSE 1 END AS BIGINT) AS intervals, coalesce(predictions, 0) AS predictions, coalesce(by_horizon, '') AS by_horizon FROM l FULL JOIN g USING (market, symbol)")),
    "leakage_audit": (leakage_audit, q(HOURLY_SQL, f"f AS (SELECT symbol, ts, lead(ts, 4) {W} AS t FROM c)", f"k AS (SELECT count(*) FILTER (ts >= t) AS a, count(*) FILTER (ts > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE) AS b, count(*) - count(DISTINCT (symbol, ts)) AS d FROM f WHERE t IS NOT NULL)",
                                       final="SELECT a AS invalid_feature_label_order, b AS future_feature_rows, d AS duplicate_asset_timestamps, CASE WHEN a + b + d = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM k")),
    "strategy_quality": (strategy_quality, q(HOURLY_SQL, f"g AS (SELECT symbol, ts, epoch(ts) - epoch(lag(ts) {W}) AS g, high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0 AS ok FROM c)", "m AS (SELECT symbol, median(g) AS m FROM g GROUP BY 1)",
                                             "k AS (SELECT symbol, avg(CASE WHEN g <= m * 3 THEN 1.0 WHEN g IS NOT NULL THEN 0 END) AS cont, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS v, greatest(0, 1 - (epoch(TIMESTAMP '2024-01-31 02:00:00') - epoch(max(ts))) / greatest(any_value(m) * 20, 1)) AS f FROM g JOIN m USING (symbol) GROUP BY 1)",
                                             final=f"SELECT symbol, {R('1.0')} AS completeness, {R('cont')} AS continuity, {R('v')} AS validity, {R('f')} AS freshness, {R('round_even(100 * (0.5 + 0.2 * cont + 0.2 * v + 0.1 * f), 0)')} AS score, 'AVAILABLE' AS status FROM k")),
    "research_quality": (research_quality, q(HOURLY_SQL, f"p AS (SELECT symbol, ts, row_number() {W} - 1 AS n FROM c)",
                                             "b AS (SELECT symbol, avg((CAST(n >= 1 AS INT) + CAST(n >= 20 AS INT) + CAST(n >= 119 AS INT) + CAST(n >= 60 AS INT)) / 4.0) AS fa, max(ts) AS e FROM p GROUP BY 1)",
                                             "x AS (SELECT event_type AS symbol, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id % 3 AS s FROM events)",
                                             "y AS (SELECT symbol, avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END) AS ec, count(DISTINCT s) + 1 AS sc, count(*) FILTER (k = 99) AS cc FROM x WHERE k % 3 <> 2 GROUP BY 1)",
                                             "z AS (SELECT *, 100 * (0.28 + 0.22 * fa + 0.18 * ec + 0.12 * least(1, sc / 4.0) + 0.12 * greatest(0, 1 - (epoch(TIMESTAMP '2024-01-31 02:00:00') - epoch(e)) / 3600 / 72) + 0.08 * greatest(0, 1 - cc * 0.2)) AS score FROM b JOIN y USING (symbol))",
                                             final=f"SELECT symbol, {R('1.0')} AS completeness, {R('fa')} AS feature_alignment, {R('ec')} AS external_coverage, sc AS source_count, cc AS conflict_count, {R('score')} AS score, CASE WHEN score >= 85 THEN 'HIGH' WHEN score >= 65 THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM z")),
    "prediction_completeness": (prediction_completeness, q(HOURLY_SQL, f"p AS (SELECT symbol, row_number() {W} - 1 AS n, epoch(ts) - epoch(lag(ts) {W}) AS g FROM c)",
                                                           final=f"SELECT symbol, {R('0.65 * avg((CAST(n >= 1 AS INT) + CAST(n >= 20 AS INT) + CAST(n >= 119 AS INT)) / 3.0) + 0.35 * avg(CASE WHEN g <= 3960 THEN 1.0 WHEN g IS NOT NULL THEN 0 END)')} AS completeness FROM p GROUP BY 1")),
    "reconcile_quotes": (reconcile_quotes, q("p AS (SELECT event_type AS symbol, user_id % 3 AS s, median(value) AS price FROM events GROUP BY 1, 2)", "k AS (SELECT symbol, count(*) AS n, (max(price) - min(price)) / avg(price) AS sp FROM p GROUP BY 1)",
                                             final=f"SELECT symbol, n AS sources, 'AVAILABLE' AS status, {R('sp * 100')} AS spread_percent, sp > 0.005 AS conflict FROM k")),
    "universe_version": (universe_version, "SELECT 'US-2024-01-31-' || left(digest, 16) AS version, members, '2024-01-31' AS as_of, 'US' AS market FROM "
                         + tree("s_name", "s_name || ',' || CASE WHEN s_nationkey % 4 <> 0 THEN 'true' ELSE 'false' END || ',1995-01-01,' || CASE WHEN s_nationkey % 4 = 0 THEN '2001-01-01' ELSE '-' END", "supplier")),
    "universe_top": (universe_top, "SELECT 'P' || l_partkey AS symbol, round(sum(l_extendedprice), 2) AS quote_volume, TRUE AS meets_minimum FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_partkey ORDER BY 2 DESC, 1 DESC LIMIT 100"),
    "news_eligibility": (news_eligibility, f"""WITH t AS (SELECT min(ts) AS t0 FROM events), k AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'UNKNOWN_PUBLISHED_AT' WHEN doc_id % 13 = 0 THEN 'INVALID_TIMESTAMP' WHEN date_trunc('second', t0) + to_hours(doc_id % 720) > TIMESTAMP '{NOW}' THEN 'FUTURE_NEWS' ELSE 'POINT_IN_TIME' END AS reason FROM documents, t)
  SELECT doc_id, reason, reason = 'POINT_IN_TIME' AS eligible, CASE WHEN reason = 'POINT_IN_TIME' THEN CAST(doc_id % 7 AS DOUBLE) END AS value FROM k"""),
    "production_gate": (production_gate, f"WITH g AS (SELECT s_suppkey, concat_ws('|', {GATE_LIST}) AS failed_gates FROM supplier) SELECT s_suppkey, failed_gates, failed_gates = '' AS qualified, CASE WHEN failed_gates = '' THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'NO_EDGE' END AS decision FROM g"),
    "feature_availability": (feature_availability, q(HOURLY_SQL, final=f"SELECT symbol, count(*) > 0 AS market_available, count(*) >= 21 AS technical_available, count(*) > 0 AS flow_available, count(*) > 5 AS sentiment_available, {R('4.0 / 7')} AS coverage, 'PARTIAL_DATA' AS data_status FROM c GROUP BY 1")),
    "model_fingerprint": (model_fingerprint, q(HOURLY_SQL, final="SELECT symbol, max(ts) AS ts, sha256('v1|BTC|1h|4H|' || CAST(CAST(floor(epoch(max(ts)) / 14400) * 14400 AS BIGINT) AS VARCHAR)) AS fingerprint FROM c GROUP BY 1")),
    "trading_minutes": (trading_minutes, MIN_SQL),
    "future_stamps": (future_stamps, FUT_SQL),
    "target_alignment": (target_alignment, q(HOURLY_SQL, "a AS (SELECT x.symbol, x.ts, x.close, y.ts AS t, y.close AS tc FROM c x ASOF LEFT JOIN c y ON x.symbol = y.symbol AND x.ts + INTERVAL 4 HOUR <= y.ts)",
                                             final=f"SELECT symbol, ts, {R('close')} AS close, CASE WHEN t - (ts + INTERVAL 4 HOUR) <= INTERVAL 66 MINUTE THEN t END AS target_time, CASE WHEN t - (ts + INTERVAL 4 HOUR) <= INTERVAL 66 MINUTE THEN {R('tc')} END AS target_close FROM a")),
    "target_alignment_daily": (target_alignment_daily, q(DAILY_SQL, final=f"SELECT symbol, ts, {R('close')} AS close, lead(ts, 5) {W} AS target_time, {R(f'lead(close, 5) {W}')} AS target_close FROM c")),
    "session_status": (session_status, STATUS_SQL),
    "utc_parsing": (utc_parsing, "SELECT event_id, date_trunc('second', ts) + to_hours(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE -8 END) AS utc FROM events"),
    "symbol_identity": (symbol_identity, ID_SQL),
    "registry_search": (registry_search, SEARCH_SQL),
    "registry_alias_search": (registry_alias_search, ALIAS_SQL),
    "registry_members": (registry_members, "SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size > 5 THEN 'TRADING' ELSE 'halted' END AS status FROM part ORDER BY p_size <= 5, 1 LIMIT 1000"),
    "registry_status": (registry_status, "SELECT 'src' || p_size % 3 AS source, count(*) AS symbols, max(p_size) AS updated_at FROM part GROUP BY 1"),
}
