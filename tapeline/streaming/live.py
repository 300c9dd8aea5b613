"""Live trades, tickers and headlines with Structured Streaming.

Every function takes and returns a DataFrame and works on a stream or on a
table, so batch and live results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tapeline.functions.watchers import SILENCE, TRIGGERS, Silence, Triggers, newest_before
from tapeline.schema import INTERVAL_MINUTES

INTERVALS = tuple(INTERVAL_MINUTES)


def trades_of_payload(raw: DataFrame) -> DataFrame:
    """Exchange trade rows (numbers and epoch milliseconds as text) to typed trades; rows without an id are refused."""
    c = F.col
    return raw.select(
        "symbol", c("tradeId").alias("trade_id"), c("px").try_cast("double").alias("px"), c("sz").try_cast("double").alias("sz"), F.lower("side").alias("side"),
        F.timestamp_millis(c("ts").try_cast("long")).alias("ts")).filter((F.coalesce("trade_id", F.lit("")) != "") & c("px").isNotNull() & c("ts").isNotNull())


def unique_trades(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each trade once; state is bounded by the watermark instead of a fixed-length memory."""
    if trades.isStreaming:
        return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "trade_id"])
    return trades.dropDuplicates(["symbol", "trade_id"])


def unique_tickers(tickers: DataFrame, delay: str = "10 minutes") -> DataFrame:
    keys = ["symbol", "ts", "price", "volume"]
    if tickers.isStreaming:
        return tickers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return tickers.dropDuplicates(keys)


def unique_headlines(items: DataFrame, delay: str = "7 days") -> DataFrame:
    if items.isStreaming:
        return items.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["symbol", "link"])
    return items.dropDuplicates(["symbol", "link"])


def live_bars(trades: DataFrame, intervals: tuple[str, ...] = INTERVALS, delay: str | None = "10 minutes") -> DataFrame:
    """Tumbling bars of several intervals; in update mode the open bar changes in place.

    Open and close use (ts, trade_id) order rather than arrival.  Late trades beyond the watermark are dropped;
    ``delay=None`` keeps the watermark that the stream already has.
    """
    c = F.col
    if trades.isStreaming and delay:
        trades = trades.withWatermark("ts", delay)
    table = F.array(*[F.struct(F.lit(k).alias("interval"), F.lit(INTERVAL_MINUTES[k] * 60).alias("seconds")) for k in intervals])
    spread = trades.select("*", F.inline(table)).withColumn("bar_ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / c("seconds")) * c("seconds")))
    order = F.struct("ts", "trade_id")
    return spread.groupBy("symbol", "interval", "bar_ts").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("sz").alias("volume"),
        F.sum(c("px") * c("sz")).alias("amount"), F.count(F.lit(1)).alias("tick_count"), F.max("ts").alias("last_trade_ts"))


def confirm(bars: DataFrame) -> DataFrame:
    """A bar is confirmed once its series has a later one (batch form; append mode gives the same on a stream)."""
    later = F.lead("bar_ts").over(Window.partitionBy("symbol", "interval").orderBy("bar_ts"))
    return bars.withColumn("confirmed", later.isNotNull())


def order_flow(trades: DataFrame) -> DataFrame:
    """Running aggressor volumes per symbol."""
    c = F.col
    buy, sell = F.when(c("side") == "buy", c("sz")).otherwise(0.0), F.when(c("side") == "sell", c("sz")).otherwise(0.0)
    return trades.groupBy("symbol").agg(F.sum(buy).alias("buy_volume"), F.sum(sell).alias("sell_volume"), F.sum(buy - sell).alias("cumulative_delta"), F.count(F.lit(1)).alias("trade_count"))


def candle_messages(raw: DataFrame) -> DataFrame:
    """Candle rows ``[ts, o, h, l, c, v, _, amount, confirmed]`` to typed bars; needs symbol, interval, row (array of text)."""
    at = lambda i: F.get("row", F.lit(i)).try_cast("double")
    return raw.select("symbol", "interval", F.timestamp_millis(F.get("row", F.lit(0)).try_cast("long")).alias("bar_ts"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"),
                      at(5).alias("volume"), F.coalesce(at(7), at(6)).alias("amount"), (F.get("row", F.lit(8)) == "1").alias("confirmed"))


def ticker_rows(raw: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Ticker payload to typed quotes, with the best bid and ask joined where a book table is given."""
    c = F.col
    quotes = raw.select("symbol", c("last").try_cast("double").alias("price"), c("vol24h").try_cast("double").alias("volume"), c("open24h").try_cast("double").alias("_o"), F.timestamp_millis(c("ts").try_cast("long")).alias("ts"))
    quotes = quotes.withColumn("change_percent", F.when(c("_o") != 0, (c("price") / c("_o") - 1) * 100)).drop("_o").filter("price is not null")
    if books is None:
        return quotes
    best = books.select("symbol", F.get(F.get("bids", F.lit(0)), F.lit(0)).try_cast("double").alias("bid"), F.get(F.get("asks", F.lit(0)), F.lit(0)).try_cast("double").alias("ask"))
    return quotes.join(best, "symbol", "left")


def quotes_with_books(quotes: DataFrame, books: DataFrame, within: str = "5 seconds", delay: str = "10 minutes") -> DataFrame:
    """Each distinct quote with the best bid and ask of the newest book at most ``within`` older than it; NULL where none came.

    Needs symbol, ts, price, volume (more columns stay) and symbol, ts, bids, asks (lists of [price, size] as text).  On
    streams both sides keep state for ``delay`` and ``within`` only, and a quote leaves once both watermarks have passed it;
    later rows are dropped.  Of books with one stamp the higher bid, then the higher ask, counts; a side without a number is NULL.

    Both feeds meet in spans of ``within``: a quote needs the books of its own span and the newest of the span before, so a
    book is sent to two spans, of which the second keeps one book.  No quote is paired with more than one book.
    """
    c = F.col
    kept = [x for x in quotes.columns if x not in ("symbol", "ts")]
    best = lambda side: F.get(F.get(side, F.lit(0)), F.lit(0)).try_cast("double")
    asked = unique_tickers(quotes, delay)
    none = [F.lit(None).cast(quotes.schema[x].dataType).alias(f"q_{x}") for x in kept]
    step = F.expr(f"INTERVAL {within}")
    both = asked.select("symbol", c("ts").alias("_at"), c("ts").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_bid"), F.lit(None).cast("double").alias("_ask"), *[c(x).alias(f"q_{x}") for x in kept])
    seen = books.filter("symbol is not null").select("symbol", F.explode(F.array("ts", c("ts") + step)).alias("_at"), c("ts").alias("_t"), F.lit(0).alias("_kind"), best("bids").alias("_bid"), best("asks").alias("_ask"), *none)
    # The later of a book's two stamps must not hasten the watermark.
    both = both.unionByName(seen.withWatermark("_at", f"{delay} {within}"))
    row = F.struct("_t", "_kind", "_bid", "_ask", *[f"q_{x}" for x in kept])
    spans = both.groupBy("symbol", F.window("_at", within)).agg(F.collect_list(F.when(c("_at") == c("_t"), row)).alias("_own"), F.max(F.when(c("_at") > c("_t"), row)).alias("_old"))
    rows = spans.select("symbol", F.posexplode(F.sort_array(F.concat("_own", F.filter(F.array("_old"), lambda x: x.isNotNull())))).alias("_place", "_row")).select("symbol", "_place", "_row.*")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = {x: (x, types[x]) for x in ("symbol", *[f"q_{x}" for x in kept])} | {"ts": ("_t", types["_t"])}
    filled = rows.mapInArrow(newest_before(columns), ", ".join(f"`{k}` {t}" for k, (_, t) in columns.items()) + f", book_ts {types['_t']}, bid double, ask double")
    near = c("book_ts") > c("ts") - step
    return filled.select("symbol", *[c(f"q_{x}").alias(x) for x in kept], "ts", *[F.when(near, c(x)).alias(x) for x in ("book_ts", "bid", "ask")])


def latency(rows: DataFrame, now: F.Column | None = None) -> DataFrame:
    """Milliseconds from event to processing; on a stream ``now`` defaults to the batch's clock."""
    return rows.withColumn("latency_ms", F.unix_millis(now if now is not None else F.current_timestamp()) - F.unix_millis("ts"))


def health(last_seen: DataFrame, now, period: float = 2.0) -> DataFrame:
    """Connection state by silence: 2, 4 and 8 periods; needs symbol, last_ts, open (market hours)."""
    c = F.col
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("last_ts")) / 1000
    state = (F.when(~c("open"), "MARKET_CLOSED").when(c("last_ts").isNull(), "CONNECTING").when(age > 8 * period, "DISCONNECTED").when(age > 4 * period, "STALE")
             .when(age > 2 * period, "WARNING").otherwise("CONNECTED"))
    return last_seen.withColumn("status", state)


def per_second(updates: DataFrame, *columns: str, delay: str = "10 minutes") -> DataFrame:
    """The newest values of each symbol's seconds, the pace at which anything downstream looks; later rows are dropped.

    On a stream in append mode a second leaves once the watermark has passed it, so state functions see a symbol's seconds
    in order from batch to batch and at most one row each, whatever the number of trades.  Equal stamps: greatest values.
    """
    c = F.col
    spread = updates.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 second").alias("_second")).agg(F.max(F.struct("ts", *columns)).alias("_last"))
    return spread.select("symbol", F.window_time("_second").alias("event_ts"), c("_second.start").alias("second"), *[c(f"_last.{x}").alias(x) for x in columns])


def triggers(updates: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Recomputation triggers per symbol; needs symbol, ts, bar (number of its bar), price, signal, structure."""
    steps = per_second(updates, "price", "bar", "signal", "structure", delay=delay)
    return steps.groupBy("symbol").transformWithState(Triggers(), TRIGGERS, "Append", "None")


def silence(updates: DataFrame, period: float = 2.0, delay: str = "10 minutes") -> DataFrame:
    """Changes of a feed's state: CONNECTED at its first row and after silence, WARNING, STALE and DISCONNECTED by timer."""
    return per_second(updates, delay=delay).groupBy("symbol").transformWithState(Silence(int(period * 1000)), SILENCE, "Append", "EventTime")


def upsert_bars(stored: DataFrame, fresh: DataFrame, keep: int = 1200) -> DataFrame:
    """Same stamp replaces unless the stored bar is confirmed, newer appends, older than the stored newest is ignored; the newest ``keep`` remain."""
    c = F.col
    newest = stored.groupBy("symbol", "interval").agg(F.max("bar_ts").alias("_top"))
    usable = fresh.join(newest, ["symbol", "interval"], "left").filter(c("_top").isNull() | (c("bar_ts") >= c("_top"))).drop("_top")
    both = stored.withColumn("_v", F.lit(0)).unionByName(usable.withColumn("_v", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("symbol", "interval", "bar_ts").orderBy(*([F.desc((c("_v") == 0) & F.coalesce("confirmed", F.lit(False)))] if "confirmed" in stored.columns else []), F.desc("_v")))
    place = F.row_number().over(Window.partitionBy("symbol", "interval").orderBy(F.desc("bar_ts")))
    return both.withColumn("_r", rank).filter("_r = 1").withColumn("_p", place).filter(c("_p") <= keep).drop("_v", "_r", "_p")


def recompute(changed: DataFrame, stored: DataFrame, transform: Callable[[DataFrame], DataFrame], least: int = 60) -> DataFrame:
    """Run a batch transform over the stored bars of the series a micro-batch touched (for foreachBatch)."""
    keys = changed.select("symbol", "interval").distinct()
    rows = stored.join(keys, ["symbol", "interval"], "left_semi").withColumnRenamed("bar_ts", "ts")
    sized = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol", "interval"))).filter(F.col("_n") >= least).drop("_n")
    return transform(sized)
