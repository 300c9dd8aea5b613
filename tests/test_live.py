import json

from pyspark.sql import functions as F

from tapeline.plans.live import _run
from tapeline.sources import payloads as pl
from tapeline.streaming import live

T0 = 1767225665000
SCHEMA = "symbol string, tradeId string, px string, sz string, side string, ts string"


def land(path, rows):
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(dict(zip(("symbol", "tradeId", "px", "sz", "side", "ts"), r))) for r in rows))
    return str(path)


def test_stream_bars_golden_and_equal_to_batch(spark, tmp_path):
    rows = [("BTC", "a", "100", "2", "buy", str(T0)), ("BTC", "b", "103", "1", "sell", str(T0 + 5000)), ("BTC", "c", "99", "4", "buy", str(T0 + 10000)), ("BTC", "c", "99", "4", "buy", str(T0 + 10000)),
            ("BTC", "", "1", "1", "buy", str(T0 + 11000)), ("BTC", "d", "101", ".5", "sell", str(T0 + 60000))]
    path = land(tmp_path / "in", rows)
    stream = live.unique_trades(live.trades_of_payload(spark.readStream.schema(SCHEMA).json(path)))
    got = _run(spark, live.live_bars(stream, delay=None), "update", ["symbol", "interval", "bar_ts"])
    batch = live.live_bars(live.unique_trades(live.trades_of_payload(spark.read.schema(SCHEMA).json(path))))
    cols = ["symbol", "interval", "bar_ts", "open", "high", "low", "close", "volume", "amount", "tick_count"]
    a, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (got, batch))
    assert a == b
    first = [r for r in batch.filter("interval = '1m'").orderBy("bar_ts").collect()]
    assert tuple(first[0][c] for c in cols[3:]) == (100, 103, 99, 99, 7, 699, 3) and first[1].open == 101
    flow = live.order_flow(live.unique_trades(live.trades_of_payload(spark.read.schema(SCHEMA).json(path)))).first()
    assert (flow.buy_volume, flow.sell_volume, flow.trade_count) == (6, 1.5, 4)


def test_health_by_silence(spark):
    df = spark.createDataFrame([(s, True) for s in "abcd"], "symbol string, open boolean").withColumn("last_ts", F.timestamp_seconds(F.lit(100)))
    want = {103: "CONNECTED", 105: "WARNING", 109: "STALE", 117: "DISCONNECTED"}
    for now, status in want.items():
        stamp = f"1970-01-01 00:0{now // 60}:{now % 60:02d}"
        assert live.health(df, stamp).first().status == status


def test_jsonp_calendar_and_fundamentals(spark, tmp_path):
    (tmp_path / "sh600000.txt").write_text('var x=([{"day":"2024-01-02","open":"1","high":"3","low":"0.5","close":"2","volume":"10"}]);')
    row = pl.wrapped_rows(spark, str(tmp_path / "sh600000.txt")).first()
    assert (row.symbol, row.open, row.close, row.volume) == ("sh600000", 1.0, 2.0, 10.0)
    (tmp_path / "cal.json").write_text('{"title":"a","country":"US","impact":"High","date":"2024-01-03T00:00:00Z"}\n{"title":"b","country":"US","impact":"Low","date":"2024-01-02T12:00:00Z"}')
    assert pl.calendar_risk(spark, str(tmp_path / "cal.json"), "2024-01-02 00:00:00").first().risk == "HIGH"
    assert pl.calendar_risk(spark, str(tmp_path / "cal.json"), "2024-01-01 00:00:00").first().risk == "MEDIUM"
    line = "~".join(["x", "NAME", "600000", "9.5"] + ["0"] * 34 + ["1.5", "12.0", "", "", "", "", "100", "120", "1.1"])
    got = pl.fundamentals(spark.createDataFrame([("600000", line)], "symbol string, line string")).first()
    assert (got.name, got.price, got.turnover_rate, got.pe, got.total_cap, got.pb) == ("NAME", 9.5, 1.5, 12.0, 120.0, 1.1)


def test_announcements_registry_macro_onchain(spark, tmp_path):
    (tmp_path / "ann.json").write_text('{"data":{"list":[{"title":"<b>Report</b>","art_code":"A1","notice_date":"2024-01-02 03:04:05","codes":[{"stock_code":"600000"},{"stock_code":null}]},{"title":"","codes":[]}]}}')
    rows = pl.announcements(spark, str(tmp_path / "ann.json")).collect()
    assert len(rows) == 1 and rows[0].title == "Report" and rows[0].symbols == ["600000"]
    (tmp_path / "list.json").write_text('{"code":"600000","name":"P"}\n{"code":"12","name":"Q"}\n{"base":"BTC","quote":"USDT"}\n{"base":"ETH","quote":"USD"}')
    assert [r.symbol for r in pl.symbol_list(spark, str(tmp_path / "list.json"), "s", "stock").collect()] == ["600000.SH"]
    assert [r.symbol for r in pl.symbol_list(spark, str(tmp_path / "list.json"), "s", "crypto").collect()] == ["BTC"]
    (tmp_path / "macro.json").write_text('{"label":"SPX","timestamp":[1,2,3],"close":[1.0,null,3.0]}')
    assert pl.macro_series(spark, str(tmp_path / "macro.json")).count() == 2
    (tmp_path / "chain.json").write_text('{"timestamp":1704164645000,"n_tx":5,"hash_rate":1.5,"other":3}')
    assert pl.onchain(spark, str(tmp_path / "chain.json")).count() == 2
