"""Trading calendars, horizons and target alignment as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeline.functions.series import as_of, by_time, ratio
from tapeline.schema import HORIZON_MINUTES, INTERVAL_MINUTES

MONDAY = "1970-01-05"
# Zone, trading minutes a day and session starts in minutes of the day.
SESSIONS = {"CN": ("Asia/Shanghai", 240), "US": ("America/New_York", 390)}


def utc_of_text(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """Stamps with an offset as they are, naive ones in the market's zone."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    naive = F.to_utc_timestamp(text.try_cast("timestamp_ntz").cast("string").try_cast("timestamp"), zone)
    return F.when(has_zone, text.try_cast("timestamp")).otherwise(naive)


def _workday(local: Column) -> tuple[Column, Column]:
    """(workday number since a Monday with weekends as the Friday before, weekday 0-6)."""
    days = F.datediff(local, F.lit(MONDAY).cast("date"))
    week = F.floor(days / 7)
    weekday = days - week * 7
    return week * 5 + F.least(weekday, F.lit(4)), weekday


def _date_of_workday(number: Column) -> Column:
    return F.date_add(F.lit(MONDAY).cast("date"), (F.floor(number / 5) * 7 + F.pmod(number, F.lit(5))).cast("int"))


def _minute(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def add_trading_minutes(ts: Column, minutes: Column, market: str) -> Column:
    """The stamp ``minutes`` of trading later, skipping breaks, nights and weekends.

    A stamp becomes a running number of trading minutes, the minutes are added,
    and the sum is turned back; session ends count as inside.  No loop, no UDF.
    """
    zone, length = SESSIONS[market]
    local = F.from_utc_timestamp(ts, zone)
    number, weekday = _workday(local)
    m = _minute(local)
    if market == "CN":
        offset = F.when(m < 570, 0).when(m < 690, m - 570).when(m < 780, 120).when(m < 900, m - 660).otherwise(240)
    else:
        offset = F.when(m < 570, 0).when(m < 960, m - 570).otherwise(390)
    total = number * length + F.when(weekday >= 5, length).otherwise(offset) + minutes
    day = F.floor((total - 1) / length)
    rest = total - day * length
    clock = F.when(rest <= 120, 570 + rest).otherwise(660 + rest) if market == "CN" else 570 + rest
    seconds = F.unix_seconds(_date_of_workday(day).cast("timestamp")) + clock * 60
    return F.when(minutes > 0, F.to_utc_timestamp(F.timestamp_seconds(seconds), zone)).otherwise(ts)


def add_workdays(ts: Column, days: Column, market: str) -> Column:
    """Same local clock time, ``days`` weekdays later."""
    zone = SESSIONS[market][0]
    local = F.from_utc_timestamp(ts, zone)
    number, _ = _workday(local)
    midnight = F.unix_micros(_date_of_workday(number + days).cast("timestamp"))
    clock = F.unix_micros(local) - F.unix_micros(F.date_trunc("day", local))
    return F.to_utc_timestamp(F.timestamp_micros(midnight + clock), zone)


def horizons(spark: SparkSession) -> DataFrame:
    """Which horizons an interval can express, in bars and minutes."""
    rows = []
    for interval, bar in INTERVAL_MINUTES.items():
        for horizon, minutes in HORIZON_MINUTES.items():
            daily_only = horizon in ("T+5", "T+20", "7D")
            if daily_only and interval != "1d" or minutes < bar or minutes % bar:
                continue
            bars = 7 if horizon == "7D" else minutes // bar
            nominal = 240 // bar if horizon == "1D" and interval != "1d" and bar <= 240 else minutes // bar
            rows.append((interval, horizon, bars, minutes, nominal, minutes // bar))
    return spark.createDataFrame(rows, "interval string, horizon string, bars long, minutes long, nominal_stock long, nominal_crypto long")


def future_stamp(df: DataFrame) -> DataFrame:
    """Add target_ts; needs ts, market, interval, horizon, bars and minutes."""
    c = F.col
    daily = c("interval") == "1d"
    plus = F.timestamp_micros(F.unix_micros("ts") + c("minutes").cast("long") * 60000000)
    stock = None
    for market in ("US", "CN"):
        value = (F.when(daily, add_workdays(c("ts"), c("bars"), market)).when(c("horizon") == "1D", add_workdays(c("ts"), F.lit(1), market))
                 .otherwise(add_trading_minutes(c("ts"), c("minutes"), market)))
        stock = F.when(c("market") == market, value) if stock is None else stock.when(c("market") == market, value)
    return df.withColumn("target_ts", F.when(c("market") == "CRYPTO", plus).otherwise(stock.otherwise(plus)))


def align_targets(bars: DataFrame, market: str, interval: str, steps: int, minutes: int) -> DataFrame:
    """Observed target bar of every bar: the k-th next on daily stock series, else the first at or after the stamp."""
    c = F.col
    if interval == "1d" and market != "CRYPTO":
        return bars.withColumns({"target_time": F.lead("ts", steps).over(by_time()), "target_close": F.lead("close", steps).over(by_time())})
    spec = bars.withColumns({"market": F.lit(market), "horizon": F.lit(""), "bars": F.lit(steps), "minutes": F.lit(minutes)})
    wanted = future_stamp(spec).drop("market", "horizon", "bars", "minutes")
    hit = as_of(wanted.withColumnRenamed("target_ts", "event_ts"), bars, ["close"], strict=False)
    ok = c("bar_ts") > c("ts")
    if market == "CRYPTO":
        ok = ok & ((F.unix_seconds("bar_ts") - F.unix_seconds("event_ts")) <= INTERVAL_MINUTES[interval] * 66)
    return hit.select(*bars.columns, F.when(ok, c("bar_ts")).alias("target_time"), F.when(ok, c("bar_close")).alias("target_close"))


def market_open(ts: Column, market: Column) -> Column:
    """Regular session test, closing minute excluded."""
    tests = {}
    for name, spans in (("CN", ((570, 690), (780, 900))), ("US", ((570, 960),))):
        local = F.from_utc_timestamp(ts, SESSIONS[name][0])
        m = _minute(local)
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((m >= a) & (m < b))
        tests[name] = inside & (F.weekday(local) < 5)
    return F.when(market == "CRYPTO", True).when(market == "US", tests["US"]).otherwise(tests["CN"])


def session_status(ts: Column, market: Column) -> Column:
    local = F.from_utc_timestamp(ts, SESSIONS["US"][0])
    pre = (F.weekday(local) < 5) & (_minute(local) >= 240) & (_minute(local) < 570)
    return F.when(market_open(ts, market), "OPEN").when((market == "US") & pre, "PRE_MARKET").otherwise("CLOSED")


def display_horizon(asset_type: Column, horizon: Column) -> Column:
    return F.when(horizon == "1D", F.when(asset_type == "stock", "T+1").otherwise("24H")).otherwise(horizon)
