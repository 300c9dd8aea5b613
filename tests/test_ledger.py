import pandas as pd
from pyspark.sql import functions as F

from tapeline.operators import calendar as cal, identity as idn, ledger as ld, ml, quality as ql
from tapeline.sources import sinks


def ramp(symbol, interval, start, n, freq, skip_weekend=False):
    days = pd.bdate_range(start, periods=n) if skip_weekend else pd.date_range(start, periods=n, freq=freq)
    stamps = days + pd.Timedelta(hours=20) if skip_weekend else days
    return pd.DataFrame({"symbol": symbol, "interval": interval, "ts": stamps, "open": [100.0 + i for i in range(n)], "high": [102.0 + i for i in range(n)], "low": [99.0 + i for i in range(n)],
                         "close": [101.0 + i for i in range(n)], "volume": 1000.0})


def prediction(i, symbol, market, interval, horizon, when):
    return (i, symbol, market, interval, horizon, pd.Timestamp(when).to_pydatetime(), 100.0, "UP", 0.0, 90.0, 103.0)


SCHEMA = "id long, symbol string, market string, interval string, horizon string, prediction_time timestamp, entry_price double, prediction string, threshold double, stop_loss double, tp1 double"


def test_settlement_calendar_goldens(spark):
    bars = pd.concat([ramp("NVDA", "1d", "2026-09-03", 20, None, True), ramp("BTC", "1h", "2026-09-04 20:00", 48, "1h")])
    said = [prediction(1, "NVDA", "US", "1d", "1D", "2026-09-04 20:00"), prediction(2, "NVDA", "US", "1d", "T+5", "2026-09-04 20:00"), prediction(3, "BTC", "CRYPTO", "1h", "4H", "2026-09-04 21:00"),
            prediction(4, "BTC", "CRYPTO", "1h", "T+5", "2026-09-04 21:00"), prediction(5, "BTC", "CRYPTO", "1h", "7D", "2026-09-04 21:00"), prediction(6, "XXX", "US", "1d", "1D", "2026-09-04 20:00")]
    got = {r.id: r for r in ld.settle(spark.createDataFrame(said, SCHEMA), spark.createDataFrame(bars)).collect()}
    assert got[1].end_ts == pd.Timestamp("2026-09-07 20:00") and got[1].status == "SETTLED"
    assert got[2].end_ts == pd.Timestamp("2026-09-11 20:00")
    assert got[3].end_ts == pd.Timestamp("2026-09-05 01:00") and got[3].actual == "UP" and got[3].target_hit
    assert got[4].reason == "UNSUPPORTED_HORIZON" and got[5].status == "PENDING" and got[6].reason == "MISSING_CANDLES"


def test_settling_twice_appends_nothing(spark):
    bars = spark.createDataFrame(ramp("BTC", "1h", "2026-09-04 20:00", 48, "1h"))
    said = spark.createDataFrame([prediction(3, "BTC", "CRYPTO", "1h", "4H", "2026-09-04 21:00")], SCHEMA)
    none = said.limit(0).select("id")
    first = ld.settle_new(said, none, bars)
    assert first.count() == 1 and ld.settle_new(said, first, bars).count() == 0


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame(ramp("BTC", "1h", "2026-01-01", 3, "1h")).withColumn("market", F.lit("CRYPTO"))
    path = str(tmp_path / "candles")
    keys = ["market", "symbol", "interval", "ts"]
    assert sinks.append_new(rows, path, keys, ["market", "interval"]).first().inserted == 3
    again = sinks.append_new(rows, path, keys, ["market", "interval"]).first()
    assert (again.inserted, again.duplicates, again.stored) == (0, 3, 3)


def test_symbols(spark):
    df = spark.createDataFrame([("600000.SS", "stock", "600000.SH"), ("NASDAQ:NVDA", "stock", "NVDA"), ("BTCUSDT", "crypto", "BTC"), ("SH600519", "stock", "600519.SH"), ("000001", "stock", "000001.SZ"),
                                ("000001.SH", "stock", "000001.SH")], "raw string, asset_type string, want string")
    assert df.filter(idn.canonical(F.col("raw"), F.col("asset_type")) != F.col("want")).count() == 0


def test_trading_minutes_against_a_minute_walk(spark):
    zone = "Asia/Shanghai"
    start = pd.Timestamp("2024-01-05 01:00", tz="UTC")
    rows = [(start + pd.Timedelta(minutes=37 * i), 1 + (i * 61) % 500) for i in range(150)]

    def walk(ts, minutes):
        local = ts.tz_convert(zone)
        while minutes:
            m = local.hour * 60 + local.minute
            if local.weekday() < 5 and (570 <= m < 690 or 780 <= m < 900):
                minutes -= 1
            local += pd.Timedelta(minutes=1)
        return local.tz_convert("UTC").tz_localize(None)

    df = spark.createDataFrame([(i, t.tz_localize(None).to_pydatetime(), m) for i, (t, m) in enumerate(rows)], "i int, ts timestamp, m long")
    got = {r.i: r.t for r in df.select("i", cal.add_trading_minutes(F.col("ts"), F.col("m"), "CN").alias("t")).collect()}
    assert all(got[i] == walk(t, m) for i, (t, m) in enumerate(rows))


def test_gate_fails_closed_and_news_must_be_known(spark):
    ok = {g: True for g in ql.GATES}
    df = spark.createDataFrame([{**ok, "id": 1}, {**ok, "id": 2, "calibrated": None}])
    assert {r.id: r.qualified for r in ql.production_gate(df).collect()} == {1: True, 2: False}


def test_drift_flags_a_recent_collapse(spark):
    rows = [("A", (pd.Timestamp("2026-01-01") + pd.Timedelta(days=i)).to_pydatetime(), i < 189, 0.1, 0.2, 0.7) for i in range(220)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, correct boolean, prob_down double, prob_flat double, prob_up double")
    assert ml.drift(df, "2026-08-09 00:00:00").first().action == "DOWNGRADE_TO_EXPERIMENTAL"
