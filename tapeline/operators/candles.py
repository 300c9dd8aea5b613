"""Trades to bars, and bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions.series import KEYS, by_time, whole
from tapeline.schema import INTERVAL_MINUTES

OHLCV = ("open", "high", "low", "close", "volume", "amount")


def trades_of_events(events: DataFrame) -> DataFrame:
    """The event stream read as trades: one instrument per event type."""
    return events.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").try_cast("double").alias("sz"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"))


def trades_of_lineitem(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines read as trades of the part's brand, at the unit price."""
    return (lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"),
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
                    F.col("l_quantity").alias("sz")))


def bucket(ts: Column, minutes: int) -> Column:
    seconds = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def bars_of_trades(trades: DataFrame, interval: str) -> DataFrame:
    """OHLCV bars.

    Open and close take the trade with the least and greatest (time, id); both
    are packed into one decimal so that every aggregation buffer is fixed-width
    and Spark keeps hash aggregation with map-side combining.  A hot instrument
    leaves each map task as one row per bucket.
    """
    order = F.expr("cast(unix_micros(ts) as decimal(19,0)) * 1000000000000000000BD + cast(id as decimal(19,0))")
    return (trades.withColumn("_o", order)
            .groupBy("symbol", F.lit(interval).alias("interval"), bucket(F.col("ts"), INTERVAL_MINUTES[interval]).alias("ts"))
            .agg(F.min_by("px", "_o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                 F.max_by("px", "_o").alias("close"), F.sum("sz").alias("volume"),
                 F.sum(F.col("px") * F.col("sz")).alias("amount"), F.count(F.lit(1)).alias("ticks")))


def roll_up(bars: DataFrame, label: str, key: Column) -> DataFrame:
    """Merge bars that share ``key``; empty buckets never arise."""
    aggregates = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                  F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
                  F.sum("amount").alias("amount")]
    if "ticks" in bars.columns:
        aggregates.append(F.sum("ticks").alias("ticks"))
    return (bars.groupBy("symbol", F.lit(label).alias("interval"), key.alias("bucket")).agg(*aggregates)
            .withColumnRenamed("bucket", "ts"))


def resample(bars: DataFrame, interval: str) -> DataFrame:
    return roll_up(bars, interval, bucket(F.col("ts"), INTERVAL_MINUTES[interval]))


def weekly(daily: DataFrame, week_end: str = "FRI") -> DataFrame:
    """Weeks labelled by their closing weekday; the open week carries its last daily stamp."""
    end = F.next_day(F.date_sub(F.to_date("ts"), 1), week_end).cast("timestamp")
    merged = daily.withColumn("_week", end)
    out = (merged.groupBy("symbol", F.lit("1w").alias("interval"), "_week")
           .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
                F.sum("amount").alias("amount"), F.max("ts").alias("_last")))
    newest = F.max("_week").over(Window.partitionBy("symbol"))
    return (out.withColumn("ts", F.when(F.col("_week") == newest, F.col("_last")).otherwise(F.col("_week")))
            .select("symbol", "interval", "ts", *OHLCV))


def fan_out(trades: DataFrame, intervals: list[str]) -> DataFrame:
    """Bars of several intervals at once.

    Trades are reduced to the finest interval first; only those bars are
    multiplied, never the trades.
    """
    finest = min(intervals, key=INTERVAL_MINUTES.get)
    base = bars_of_trades(trades, finest)
    table = F.create_map(*[F.lit(x) for k in intervals for x in (k, INTERVAL_MINUTES[k] * 60)])
    spread = base.drop("interval").withColumn("interval", F.explode(F.array(*[F.lit(k) for k in intervals])))
    seconds = table[F.col("interval")]
    key = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    return (spread.groupBy("symbol", "interval", key.alias("bucket"))
            .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
                 F.sum("amount").alias("amount"), F.sum("ticks").alias("ticks"))
            .withColumnRenamed("bucket", "ts"))


def clean_frame(rows: DataFrame) -> DataFrame:
    """Numeric coercion and one row per (series, ts): the first to arrive by ``seq``."""
    typed = rows.withColumns({c: F.col(c).try_cast("double") for c in OHLCV if c in rows.columns})
    rank = F.row_number().over(Window.partitionBy(*KEYS, "ts").orderBy("seq"))
    return typed.withColumn("_r", rank).filter("_r = 1").drop("_r")


def newest(bars: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ts")))
    return bars.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def between(bars: DataFrame, start, end, least: int = 200) -> DataFrame:
    """Bars within [start, end] of the series that hold at least ``least`` of them."""
    cut = bars.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return cut.withColumn("_c", F.count(F.lit(1)).over(whole())).filter(F.col("_c") >= least).drop("_c")


def quotes_or_last_bar(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """A live quote where there is one, else price and change of the last two bars."""
    w = by_time()
    last = (bars.withColumns({"_prev": F.lag("close").over(w), "_max": F.max("ts").over(whole())})
            .filter(F.col("ts") == F.col("_max"))
            .select("symbol", F.col("close").alias("bar_price"), F.col("_prev").alias("bar_prev"), F.col("ts").alias("bar_ts")))
    joined = last.join(quotes.select("symbol", "price", "prev_price"), "symbol", "left")
    price = F.coalesce("price", "bar_price")
    prev = F.when(F.col("price").isNotNull(), F.col("prev_price")).otherwise(F.coalesce("bar_prev", "bar_price"))
    return joined.select("symbol", price.alias("price"), (price - prev).alias("change"),
                         (F.when(prev != 0, price / prev) * 100 - 100).alias("change_percent"),
                         F.when(F.col("price").isNotNull(), "quote").otherwise("last_bar").alias("origin"), "bar_ts")


def volume_profile(bars: DataFrame, top: int = 6) -> DataFrame:
    """Turnover by price bin; min(30, max(10, n div 20)) bins per series, the ``top`` heaviest."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    turnover = F.greatest(F.when(F.col("amount") > 0, F.col("amount")).otherwise(typical * F.col("volume")), F.lit(0.0))
    base = bars.select(*KEYS, typical.alias("price"), turnover.alias("weight"))
    stats = base.groupBy(*KEYS).agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count(F.lit(1)).alias("rows"))
    stats = stats.withColumn("bins", F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.col("rows") / 20))))
    binned = base.join(stats, list(KEYS)).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins")).withColumn(
        "bin", F.least(F.col("bins") - 1, F.floor((F.col("price") - F.col("lo")) / F.when(F.col("step") != 0, F.col("step")))))
    hist = binned.groupBy(*KEYS, "bin").agg(F.sum("weight").alias("weight"),
                                            F.first("lo").alias("lo"), F.first("step").alias("step"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("weight"), "bin"))
    return (hist.withColumn("rank", rank).filter(F.col("rank") <= top)
            .select(*KEYS, "bin", "rank", (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("price"), "weight"))
