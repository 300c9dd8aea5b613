"""Streaming, source and sink queries.

Payload files are written by Spark from the given tables and read back through
the source operators, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeline.operators import features as feat, indicators as ind, ledger as ld, signals as sg, structure as st
from tapeline.plans.bars import BAR_SELECT, FAN_SQL, q
from tapeline.plans.base import HOURLY_SQL, R, W, hourly, r, show, table, trades
from tapeline.plans.ledger import SET, _predictions
from tapeline.session import cut, scratch
from tapeline.sources import payloads as pl, sinks
from tapeline.streaming import live, settle

INTERVALS = ("1m", "5m", "15m", "30m", "1h", "4h", "1d")


def _trade_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return raw.select(F.col("event_type").alias("symbol"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("trade_id"), F.col("value").alias("px"),
                      F.get_json_object("props", "$.k").try_cast("double").alias("sz"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("ts").cast("timestamp").alias("ts"))


def _run(spark, stream, mode: str, keys: list[str]):
    """Drive a stream over everything there is now; the newest version of each key is the result."""
    out = scratch(spark)
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
             .foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/rows/batch={i:06d}")).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows/*")
    if not keys:
        return rows.drop("_batch")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*keys, "_v.*")


def stream_candles(spark, d):
    out = _run(spark, live.live_bars(live.unique_trades(_trade_stream(spark, d)), INTERVALS, None), "update", ["symbol", "interval", "bar_ts"])
    return show(out.withColumnRenamed("bar_ts", "ts"), "symbol", "interval", "ts", "open", "high", "low", "close", "volume", "amount", volume=4, amount=2)


def stream_order_flow(spark, d):
    out = _run(spark, live.order_flow(_trade_stream(spark, d)), "update", ["symbol"])
    return show(out, "symbol", "buy_volume", "sell_volume", "cumulative_delta", "trade_count")


def _feeds(spark, d):
    """Quotes and books as two feeds that land in two drops.

    Some rows land twice, some come again two weeks late, and each feed ends with a heartbeat far ahead that closes its state.
    """
    folder = scratch(spark)
    e = table(spark, d, "events").withColumnRenamed("event_type", "symbol")
    price = F.col("value").cast("string")
    feeds = {"quotes": ("event_id % 2 = 0", ["symbol", "ts", F.col("value").alias("price"), F.col("user_id").cast("double").alias("volume")]),
             "books": ("event_id % 2 = 1", ["symbol", "ts", F.array(F.array(price, F.lit("1"))).alias("bids"),
                                            F.when(F.col("user_id") % 5 != 0, F.array(F.array((F.col("value") + 1).cast("string"), F.lit("2")))).alias("asks")])}
    first, second = "ts < '2024-01-15'", "ts >= '2024-01-15'"
    for name, (mine, columns) in feeds.items():
        rows = e.filter(mine)
        beat = rows.agg(F.max(F.struct(*rows.columns)).alias("_r")).select("_r.*").withColumns({"symbol": F.lit("~heartbeat"), "ts": F.lit("2034-01-01").cast("timestamp")})
        late = rows.filter("ts < '2024-01-10' and event_id % 50 < 2").withColumn("value", F.col("value") + 1000)
        drops = (rows.filter(first), rows.filter(second).unionByName(rows.filter(f"{second} and event_id % 7 = 0")).unionByName(late), beat)
        for i, drop in enumerate(drops):
            yield name, i, drop.select(*columns), f"{folder}/{name}"


def stream_quotes(spark, d):
    out = scratch(spark)
    landed = list(_feeds(spark, d))
    folders, schemas = ({name: x for name, _, x in rows} for rows in (((n, 0, f) for n, _, _, f in landed), ((n, 0, df.schema) for n, _, df, _ in landed)))
    feed = {name: spark.readStream.schema(schemas[name]).option("pathGlobFilter", "*.parquet").parquet(f"{folders[name]}/*") for name in folders}
    stream = live.quotes_with_books(feed["quotes"], feed["books"], "1 hour")
    for drop in range(3):
        for name, i, df, folder in landed:
            if i == drop:
                df.write.parquet(f"{folder}/{i}")
        (stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
         .format("parquet").option("path", f"{out}/rows").start().awaitTermination())
    return show(spark.read.parquet(f"{out}/rows").filter("symbol <> '~heartbeat'"), "symbol", "ts", "price", "volume", "book_ts", "bid", "ask")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _watch(spark, d, watch):
    """Run a watcher over the trades, which land in two drops; a heartbeat far ahead closes the state."""
    out, landed = scratch(spark), scratch(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    beat = rows.agg(F.lit("~heartbeat").alias("symbol"), F.lit("2034-01-01").cast("timestamp").alias("ts"), F.max("price").alias("price"))
    stream = watch(spark.readStream.schema(rows.schema).parquet(f"{landed}/*"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        for i, drop in enumerate((rows.filter("ts < '2024-01-15'"), rows.filter("ts >= '2024-01-15'"), beat)):
            drop.write.parquet(f"{landed}/{i}")
            (stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
             .format("parquet").option("path", f"{out}/rows").start().awaitTermination())
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{out}/rows").filter("symbol <> '~heartbeat'")


def known_states(spark, d):
    """Of each hourly bar what its last complete predecessor said: trend side and structure digest."""
    bars = st.structure_state(ind.sx_atr(hourly(spark, d)))
    sides = ind.compose(hourly(spark, d), ind._ma((5, 20))).select("symbol", "ts", F.when(F.col("ma5") > F.col("ma20"), "UP").when(F.col("ma5") < F.col("ma20"), "DOWN").alias("_side"))
    before = Window.partitionBy("symbol").orderBy("ts")
    return bars.join(sides, ["symbol", "ts"]).select("symbol", F.col("n").alias("bar"), F.col("ts").alias("bar_ts"), F.lag("_side").over(before).alias("signal"), F.lag("fingerprint").over(before).alias("structure"))


def stream_triggers(spark, d):
    known = cut(known_states(spark, d))
    hour = F.date_trunc("hour", "ts").alias("bar_ts")
    out = _watch(spark, d, lambda s: live.triggers(s.select("*", hour).join(known, ["symbol", "bar_ts"], "left")))
    return out.select("symbol", "ts", r("price").alias("price"), "reasons")


def stream_silence(spark, d):
    return _watch(spark, d, lambda s: live.silence(s, 600.0))


def settle_stream(spark, d):
    """Bars land in two drops; each is settled by its own run of the job, which goes on where the last one ended."""
    folder = scratch(spark)
    bars = hourly(spark, d)
    said = _predictions(bars)
    arrivals = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed/*")
    for drop, rows in enumerate(("ts < '2024-01-15'", "ts >= '2024-01-15'")):
        bars.filter(rows).repartition("symbol").write.parquet(f"{folder}/landed/{drop}")
        settle.settle_available(arrivals, said, folder).awaitTermination()
    return show(settle.settlements(spark, folder), "id", "actual", "actual_return", "correct")


def settle_one_asset(spark, d):
    bars = hourly(spark, d)
    said = _predictions(bars)
    assets = bars.filter("symbol = 'purchase'").select("symbol", "interval").distinct()
    return show(ld.settle_assets(said, said.filter("prediction_time < '2024-01-08'").select("id"), bars, assets), "id", "actual", "actual_return")


def bar_confirmation(spark, d):
    bars = live.confirm(live.live_bars(trades(spark, d).withColumn("trade_id", F.lpad(F.col("id").cast("string"), 20, "0")), ("1h",)))
    return bars.groupBy("symbol", "confirmed").agg(F.count(F.lit(1)).alias("bars"))


def feed_health(spark, d):
    seen = trades(spark, d).groupBy("symbol").agg(F.max("ts").alias("last_ts")).withColumn("open", F.col("symbol") != "error")
    return live.health(seen, "2024-01-31 00:00:00", 600.0).select("symbol", "status")


def event_latency(spark, d):
    rows = live.latency(trades(spark, d).select("symbol", "ts"), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rows.groupBy("symbol").agg(F.min("latency_ms").alias("best"), F.max("latency_ms").alias("worst"))


def candle_upsert(spark, d):
    bars = live.live_bars(trades(spark, d).withColumn("trade_id", F.lpad(F.col("id").cast("string"), 20, "0")), ("1h",)).drop("last_trade_ts")
    stored = bars.filter("bar_ts <= '2024-01-20'")
    fresh = bars.filter("bar_ts >= '2024-01-19'").withColumn("close", F.col("close") + 1)
    return show(live.upsert_bars(stored, fresh, 400), "symbol", "bar_ts", "close")


BAR = ("symbol", "ts", "open", "high", "low", "close", "volume")


def source_text_klines(spark, d):
    out = scratch(spark)
    bars = hourly(spark, d)
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "open", "close", "high", "low", "volume", "amount")
    day = bars.groupBy("symbol", "interval", F.to_date("ts").alias("d")).agg(F.collect_list(line).alias("klines"))
    day.select("symbol", "interval", F.struct("klines").alias("data")).write.json(out)
    return show(pl.text_klines(spark, out), *BAR)


def source_array_klines(spark, d):
    out = scratch(spark)
    row = F.array(F.unix_millis("ts").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], F.lit("0"), F.col("amount").cast("string"))
    bars = hourly(spark, d).groupBy("symbol", "interval", F.to_date("ts").alias("d")).agg(F.collect_list(row).alias("data"))
    bars.drop("d").write.json(out)
    return show(pl.array_klines(spark, out), *BAR)


def source_low_first(spark, d):
    out = scratch(spark)
    row = F.array(F.unix_seconds("ts").cast("string"), *[F.col(c).cast("string") for c in ("low", "high", "open", "close", "volume")])
    bars = hourly(spark, d).groupBy("symbol", "interval", F.to_date("ts").alias("d")).agg(F.collect_list(row).alias("data"))
    bars.drop("d").write.json(out)
    return show(pl.array_klines(spark, out, "low_first", millis=False).withColumn("made", F.col("amount")), *BAR, "made", made=3)


def source_columnar_quotes(spark, d):
    out = scratch(spark)
    c = F.col
    bars = hourly(spark, d).withColumn("open", F.when(F.hour("ts") == 3, None).otherwise(c("open")))
    item = F.sort_array(F.collect_list(F.struct(F.unix_seconds("ts").alias("t"), "open", "high", "low", "close", "volume")))
    day = bars.groupBy("symbol", "interval", F.to_date("ts").alias("d")).agg(item.alias("x"))
    part = lambda n: F.transform("x", lambda e: e[n])
    day.select("symbol", "interval", part("t").alias("timestamp"), F.struct(*[part(n).alias(n) for n in ("open", "high", "low", "close", "volume")]).alias("quote")).write.option("ignoreNullFields", "false").json(out)
    return show(pl.columnar_quotes(spark, out), *BAR)


def source_spaced_rows(spark, d):
    c = F.col
    line = F.when(F.hour("ts") == 5, F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), "open", "close")).otherwise(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "open", "close", "high", "low", "volume"))
    return show(pl.spaced_rows(hourly(spark, d).select("symbol", line.alias("line"))), *BAR)


def source_rss(spark, d):
    out = scratch(spark)
    clean = F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z0-9 .,]", "")
    doc = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, "").otherwise(clean).alias("title"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("link"),
                                              F.lit("Mon, 01 Jan 2024 10:00:00 GMT").alias("pubDate"), "source")
    doc.write.option("rootTag", "channel").option("rowTag", "item").xml(out)
    return pl.rss(spark, out, "p", "m").select("url", F.sha2("title", 256).alias("title"), "source", "published_at")


def provider_fallback(spark, d):
    bars = hourly(spark, d).select("symbol", "interval", "ts", "close")
    rows = bars.filter("symbol <> 'view'").withColumn("provider", F.lit("a")).unionByName(bars.withColumn("provider", F.lit("b"))).unionByName(bars.withColumn("provider", F.lit("zz")))
    return pl.first_available(rows, ["a", "b"]).groupBy("symbol", "provider").agg(F.count(F.lit(1)).alias("rows"))


def quote_records(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("symbol"), F.col("value").alias("price"), (F.col("user_id") % 10).cast("double").alias("prev_close"))
    return show(pl.quotes(e), "symbol", "price", "change", "change_percent")


def derivative_fields(spark, d):
    e = table(spark, d, "events")
    oi = e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("open_interest"))
    fund = e.select(F.col("event_type").alias("symbol"), "ts", (F.col("user_id") / 1000 - 0.3).alias("funding_rate"))
    return show(pl.derivatives(oi, fund), "symbol", "open_interest", "open_interest_change", "funding_rate", "funding_percentile")


def statements_point_in_time(spark, d):
    bars = hourly(spark, d).select("symbol", "ts", "close")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("announcement_date")).agg(F.max("value").alias("eps"))
    return show(pl.point_in_time(bars, e, ["eps"]), "symbol", "ts", "announced_at", "eps")


def sink_append(spark, d):
    bars = hourly(spark, d).withColumn("market", F.lit("CRYPTO")).select("market", "symbol", "interval", "ts", "open", "high", "low", "close", "volume", "amount")
    out = scratch(spark)
    first = sinks.append_new(bars.filter("ts < '2024-01-20'"), out, ["market", "symbol", "interval", "ts"], ["market", "interval"]).withColumn("run", F.lit(1))
    again = sinks.append_new(bars, out, ["market", "symbol", "interval", "ts"], ["market", "interval"]).withColumn("run", F.lit(2))
    return first.unionByName(again)


def sink_feature_observations(spark, d):
    return show(sinks.feature_observations(feat.price_features(hourly(spark, d)), ["return_1", "gap", "high_position_60", "historical_volatility"]), "symbol", "ts", "feature_name", "value")


def sink_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("sector"))
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("sector"))
    return sinks.upsert(c.filter("c_custkey % 5 <> 0"), new, ["c_custkey"], ["sector"])


def cut_sql(extra: str = "") -> str:
    return f"SELECT symbol, ts, {R('open')} AS open, {R('high')} AS high, {R('low')} AS low, {R('close')} AS close, {R('volume')} AS volume{extra} FROM c"


QUERIES = {
    "settle_stream": (settle_stream, q(*SET, final=f"SELECT id, actual, {R('ar')} AS actual_return, actual = prediction AS correct FROM se WHERE status = 'SETTLED'")),
    "settle_one_asset": (settle_one_asset, q(*SET, final=f"SELECT id, actual, {R('ar')} AS actual_return FROM se WHERE status = 'SETTLED' AND symbol = 'purchase' AND pt >= TIMESTAMP '2024-01-08'")),
    "stream_candles": (stream_candles, FAN_SQL),
    "stream_order_flow": (stream_order_flow, f"WITH t AS (SELECT event_type AS symbol, event_id % 2 = 0 AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sz FROM events) SELECT symbol, {R('sum(CASE WHEN b THEN sz ELSE 0 END)')} AS buy_volume, {R('sum(CASE WHEN b THEN 0 ELSE sz END)')} AS sell_volume, {R('sum(CASE WHEN b THEN sz ELSE -sz END)')} AS cumulative_delta, count(*) AS trade_count FROM t GROUP BY 1"),
    "stream_quotes": (stream_quotes, f"""WITH t AS (SELECT DISTINCT event_type AS symbol, ts, value AS price, CAST(user_id AS DOUBLE) AS volume FROM events WHERE event_id % 2 = 0),
  b AS (SELECT event_type AS symbol, ts AS book_ts, value AS bid, CASE WHEN user_id % 5 <> 0 THEN value + 1 END AS ask FROM events WHERE event_id % 2 = 1)
  SELECT t.symbol, ts, {R('price')} AS price, volume, book_ts, {R('bid')} AS bid, {R('ask')} AS ask FROM t LEFT JOIN b ON b.symbol = t.symbol AND book_ts <= ts AND book_ts > ts - INTERVAL 1 HOUR
  QUALIFY row_number() OVER (PARTITION BY t.symbol, ts, price, volume ORDER BY book_ts DESC NULLS LAST, bid DESC NULLS LAST, ask DESC NULLS LAST) = 1"""),
    "stream_triggers": (stream_triggers, None),
    "stream_silence": (stream_silence, """WITH k AS (SELECT DISTINCT event_type AS symbol, date_trunc('second', ts) AS s FROM events), l AS (SELECT *, lead(s) OVER w AS nxt, lag(s) OVER w AS old FROM k WINDOW w AS (PARTITION BY symbol ORDER BY s)),
  m AS (SELECT unnest([2, 4, 8]) AS f, unnest(['WARNING', 'STALE', 'DISCONNECTED']) AS status)
  SELECT symbol, s + to_seconds(600 * f) AS ts, status FROM l, m WHERE nxt IS NULL OR nxt > s + to_seconds(600 * f)
  UNION ALL SELECT symbol, s, 'CONNECTED' FROM l WHERE old IS NULL OR s > old + to_seconds(1200)"""),
    "bar_confirmation": (bar_confirmation, q(HOURLY_SQL, f"k AS (SELECT symbol, lead(ts) {W} IS NOT NULL AS confirmed FROM c)", final="SELECT symbol, confirmed, count(*) AS bars FROM k GROUP BY 1, 2")),
    "feed_health": (feed_health, "WITH k AS (SELECT event_type AS symbol, epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) AS a FROM events GROUP BY 1) SELECT symbol, CASE WHEN symbol = 'error' THEN 'MARKET_CLOSED' WHEN a > 4800 THEN 'DISCONNECTED' WHEN a > 2400 THEN 'STALE' WHEN a > 1200 THEN 'WARNING' ELSE 'CONNECTED' END AS status FROM k"),
    "event_latency": (event_latency, "SELECT event_type AS symbol, min(epoch_ms(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000) AS best, max(epoch_ms(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000) AS worst FROM events GROUP BY 1"),
    "candle_upsert": (candle_upsert, q(HOURLY_SQL, "s AS (SELECT symbol, max(ts) AS top FROM c WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)", "k AS (SELECT symbol, ts, CASE WHEN ts >= top THEN close + 1 ELSE close END AS close FROM c JOIN s USING (symbol))",
                                       final=f"SELECT symbol, ts AS bar_ts, {R('close')} AS close FROM k QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 400")),
    "source_text_klines": (source_text_klines, f"WITH {HOURLY_SQL} {cut_sql()}"),
    "source_array_klines": (source_array_klines, f"WITH {HOURLY_SQL} {cut_sql()}"),
    "source_low_first": (source_low_first, f"WITH {HOURLY_SQL} {cut_sql(', ' + R('volume * close', 3) + ' AS made')}"),
    "source_columnar_quotes": (source_columnar_quotes, f"WITH {HOURLY_SQL} {cut_sql()} WHERE hour(ts) <> 3"),
    "source_spaced_rows": (source_spaced_rows, f"WITH {HOURLY_SQL} {cut_sql()} WHERE hour(ts) <> 5"),
    "source_rss": (source_rss, "WITH k AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 .,]', '', 'g'), ' +', ' ', 'g'), ' ') AS title FROM documents WHERE doc_id % 10 <> 0) SELECT 'http://x/' || doc_id AS url, sha256(title) AS title, source, TIMESTAMP '2024-01-01 10:00:00' AS published_at FROM k WHERE title <> ''"),
    "provider_fallback": (provider_fallback, q(HOURLY_SQL, final="SELECT symbol, CASE WHEN symbol = 'view' THEN 'b' ELSE 'a' END AS provider, count(*) AS rows FROM c GROUP BY 1, 2")),
    "quote_records": (quote_records, f"SELECT event_id AS symbol, {R('value')} AS price, {R('value - user_id % 10')} AS change, {R('(value / nullif(user_id % 10, 0) - 1) * 100')} AS change_percent FROM events"),
    "derivative_fields": (derivative_fields, f"""WITH k AS (SELECT event_type AS symbol, value, user_id / 1000 - 0.3 AS f, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events), n AS (SELECT symbol, f AS now FROM k WHERE r = 1)
  SELECT symbol, {R('max(value) FILTER (r = 1)')} AS open_interest, {R('max(value) FILTER (r = 1) / max(value) FILTER (r = 2) - 1')} AS open_interest_change, {R('any_value(now)')} AS funding_rate, {R('avg(CASE WHEN f <= now THEN 1.0 ELSE 0 END)')} AS funding_percentile FROM k JOIN n USING (symbol) GROUP BY 1"""),
    "statements_point_in_time": (statements_point_in_time, q(HOURLY_SQL, "s AS (SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS a, max(value) AS eps FROM events GROUP BY 1, 2)",
                                                             final=f"SELECT c.symbol, c.ts, s.a AS announced_at, {R('s.eps')} AS eps FROM c ASOF LEFT JOIN s ON c.symbol = s.symbol AND c.ts >= s.a")),
    "sink_append": (sink_append, q(HOURLY_SQL, "k AS (SELECT count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS m FROM c)", final="SELECT m AS received, m AS inserted, 0 AS duplicates, m AS stored, 1 AS run FROM k UNION ALL SELECT n, n - m, m, n, 2 FROM k")),
    "sink_feature_observations": (sink_feature_observations, None),
    "sink_upsert": (sink_upsert, "WITH o AS (SELECT c_custkey, c_name, c_mktsegment AS sector FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS sector FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.sector, o.sector) AS sector FROM o FULL JOIN n USING (c_custkey)"),
}
