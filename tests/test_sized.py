"""Queries beside their SQL on what larger tables bring: many rows, zero prices, scores on a threshold."""

import datetime as dt

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeline.operators import identity, ledger, news as nw
from tapeline.streaming import live
from tools.check import compare, rows_of


def beside_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = entry.queries()[name](spark, str(folder)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    return got, compare(rows_of(got), rows_of(want))[0]


def events(values, symbol="view", step="1h"):
    return pd.DataFrame({"event_id": range(len(values)), "ts": pd.date_range("2024-01-01 00:00:10", periods=len(values), freq=step), "user_id": [i % 7 for i in range(len(values))],
                         "event_type": symbol, "value": [float(v) for v in values], "props": '{"k": 3}'})


def test_large_factor_shares_are_plain_numbers(spark):
    said = spark.createDataFrame([("A", "4H", "UP", 80.0, 300)], "symbol string, horizon string, prediction string, confidence double, samples int")
    factors = spark.createDataFrame([("A", "f0", 30.258, True), ("A", "f1", 0.5, False)], "symbol string, feature string, importance double, positive boolean")
    news = spark.createDataFrame([("A", 1.0, 50.0)], "symbol string, sentiment double, impact double")
    assert ledger.intelligence_snapshot(said, factors, news).first().contributions == "f0:3025.8000|f1:-50.0000"


def test_excursions_from_a_zero_price_are_null_on_both_sides(spark, tmp_path):
    got, note = beside_sql(spark, tmp_path, "resolve_predictions", events=events([0 if i in (1, 7, 8, 9) else 10 + i for i in range(30)]))
    assert note is None, note
    assert got.mae.isna().any() and got.mfe.isna().any()


def test_member_list_beyond_two_levels_of_digests(spark, tmp_path):
    rows = pd.DataFrame({"s_suppkey": range(5000), "s_name": [f"S{i % 900:04d}" for i in range(5000)], "s_nationkey": [i % 25 for i in range(5000)]})
    got, note = beside_sql(spark, tmp_path, "universe_version", supplier=rows)
    assert note is None, note
    assert got.members[0] == 5000


def test_scores_on_a_threshold_are_sums_of_doubles_on_both_sides(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [171698, 172602, 45702, 1], "text": ["was are", "with", "with", "x"], "lang": "en", "source": "src1", "n_chars": 7})
    got, note = beside_sql(spark, tmp_path, "news_decisions", documents=docs, events=events([1, 2]))
    assert note is None, note
    assert len(got) == 12


def test_no_quote_meets_more_than_one_book(spark):
    """Every second a book, every second a quote: no pairs, also over the border of two spans."""
    stamp = (F.lit(1704067200) + F.col("id")).cast("timestamp")
    quotes = spark.range(9000).select(F.lit("A").alias("symbol"), stamp.alias("ts"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("volume"))
    books = spark.range(3599, 5000).select(F.lit("A").alias("symbol"), stamp.alias("ts"), F.array(F.array(F.col("id").cast("string"), F.lit("1"))).alias("bids"), F.lit(None).cast("array<array<string>>").alias("asks"))
    paired = live.quotes_with_books(quotes, books, "1 hour")
    assert "Join" not in paired._jdf.queryExecution().executedPlan().toString()
    assert {int(r.price): r.bid for r in paired.collect()} == {i: None if i < 3599 or i > 8598 else float(min(i, 4999)) for i in range(9000)}


def test_events_of_one_stamp_are_looked_up_once(spark):
    """A thousand events at three stamps, one NULL: outcomes are those of three events, and the look-up sees three."""
    start = dt.datetime(2024, 1, 1)
    bars = spark.createDataFrame([("A", "1h", start + dt.timedelta(hours=i), 10.0 + i, 11.0 + i) for i in range(12)], "symbol string, interval string, ts timestamp, open double, close double")
    at = {0: start, 1: start + dt.timedelta(hours=2, minutes=5), 2: start + dt.timedelta(hours=30), 3: None}
    events = spark.createDataFrame([(i, "A", "bullish", at[i % 4]) for i in range(1000)], "id long, symbol string, label string, published_at timestamp")
    out = nw.event_outcomes(events, bars, (1, 3), benchmark=bars)
    got = {(r.id, r.h): (r.entry, round(r.ret, 9), r.abnormal) for r in out.collect()}
    assert got == {(i, h): (e := (11.0, 13.0)[i % 4], round((e + h) / e - 1, 9), 0.0) for i in range(1000) if i % 4 < 2 for h in (1, 3)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    before = [x for x in plan.split("\n") if "_ev" in x and "Project" in x and " AS _ev" in x]
    assert before and not any("label" in x or "id#" in x for x in before)


def test_registry_search_tells_queries_that_begin_alike_and_takes_empty_ones(spark):
    """Codes that share their first characters are keyed by longer ones; what is left empty is contained in every symbol."""
    codes = [f"P10000{i}" for i in range(30)] + ["P1000001234567"]
    registry = spark.createDataFrame([(x, f"name {x[-1]}", "brand|type", "steel", "stock") for x in codes], "symbol string, name string, aliases string, base_asset string, asset_type string")
    asked = ["p100001", "p1000001234567", "p10000012345", "p1000019", "steel", "USDT", "nothing"]
    got = {(r.query, r.symbol) for r in identity.search(spark.createDataFrame([(x,) for x in asked], "query string"), registry, 100).collect()}
    want = {(x, s) for x in asked for s in codes if x.replace("USDT", "") in s.lower() or x == "steel"}
    assert got == want
    keys = spark.range(1).select(identity._grams(F.lit("p1000012"), 8).alias("k")).first().k
    assert "p1000012" in keys and "" in keys


def test_registry_search_sends_no_growing_side_through_the_driver(spark):
    """Files of few bytes may hold many rows, so their size decides nothing: no broadcast, only the lengths asked for are indexed."""
    registry = spark.range(20000).select(F.concat(F.lit("P"), "id").alias("symbol"), *[F.concat(F.lit(x), F.col("id") % 6).alias(x) for x in ("name", "aliases", "base_asset")], F.lit("stock").alias("asset_type"))
    found = identity.search(spark.range(50).select(F.concat(F.lit("p1"), "id").alias("query")), registry, 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query, r.symbol) for r in found.filter("query = 'p17'").collect()} == {("p17", "P17"), ("p17", "P170"), ("p17", "P171")}
    assert set(spark.range(1).select(identity._grams(F.lit("p123"), 8, {0, 2}).alias("k")).first().k) == {"", "p1", "12", "23"}
