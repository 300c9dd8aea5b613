from pyspark.sql import functions as F

from tapeline.plans import live as plan
from tapeline.plans.base import table
from tapeline.streaming import live


def fired(rows):
    """The rule as a plain loop over one symbol's seconds."""
    out, bar, signal, structure, last, at = [], None, None, None, None, None
    for second, price, now_bar, now_signal, now_structure in rows:
        reasons = []
        if bar is not None and now_bar != bar:
            reasons.append("NEW_BAR")
        if last and abs(price / last - 1) >= 0.003:
            reasons.append("PRICE_MOVE")
        if signal and now_signal and now_signal != signal:
            reasons.append("STRATEGY_STATE")
        if structure and now_structure and now_structure != structure:
            reasons.append("STRUCTURE")
        bar, signal, structure = now_bar, now_signal or signal, now_structure or structure
        if reasons and (at is None or (second - at).total_seconds() >= 300):
            at, last = second, price
            out.append((second, round(price, 6), "|".join(reasons)))
    return out


def test_triggers_equal_a_plain_loop_over_the_whole_feed(spark, sf):
    known = plan.known_states(spark, sf)
    rows = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    rows = rows.withColumn("bar_ts", F.date_trunc("hour", "ts")).join(known, ["symbol", "bar_ts"])
    rows = live.per_second(rows, "price", "bar", "signal", "structure").toPandas().sort_values("second")
    rows = rows.astype(object).where(rows.notna(), None)
    want = {(s, *f) for s, part in rows.groupby("symbol") for f in fired(list(zip(part.second, part.price, part.bar, part.signal, part.structure)))}
    got = [tuple(r) for r in plan.stream_triggers(spark, sf).select("symbol", "ts", "price", "reasons").collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, t.to_pydatetime(), p, why) for s, t, p, why in want}
    said = {x for r in got for x in r[3].split("|")}
    assert said == {"NEW_BAR", "PRICE_MOVE", "STRATEGY_STATE", "STRUCTURE"}


def test_a_second_keeps_its_newest_values(spark):
    rows = spark.createDataFrame([("A", 1.2, 5.0), ("A", 1.9, 7.0), ("A", 1.9, 6.0), ("A", 2.0, None), ("B", 1.0, 1.0)], "symbol string, at double, price double")
    got = live.per_second(rows.select("symbol", F.col("at").cast("timestamp").alias("ts"), "price"), "price")
    assert sorted((r.symbol, r.second.timestamp(), r.price or 0.0) for r in got.collect()) == [("A", 1.0, 7.0), ("A", 2.0, 0.0), ("B", 1.0, 1.0)]


def test_quotes_take_the_newest_book_in_reach(spark):
    at = lambda rows, *names: spark.createDataFrame(rows, f"symbol string, s double, {', '.join(names)}").withColumn("ts", F.col("s").cast("timestamp")).drop("s")
    quotes = at([("A", 10.0, 1.0, 1.0), ("A", 10.0, 1.0, 1.0), ("A", 20.0, 2.0, 1.0), ("B", 10.0, 3.0, None), (None, 10.0, 4.0, 1.0)], "price double", "volume double")
    books = at([("A", 5.0, [["9", "1"]], [["8", "1"]]), ("A", 5.1, [["1", "1"]], [["2", "1"]]), ("A", 9.0, [["3", "1"]], None), ("A", 9.0, [["2", "1"]], [["7", "1"]]), ("A", 10.1, [["5", "1"]], []), ("B", 9.0, [], [["x", "1"]])],
               "bids array<array<string>>", "asks array<array<string>>")
    got = live.quotes_with_books(quotes, books).collect()
    assert sorted(((r.symbol or "", r.ts.timestamp(), r.book_ts and r.book_ts.timestamp(), r.bid, r.ask) for r in got), key=str) == sorted(
        [("A", 10.0, 9.0, 3.0, None), ("A", 20.0, None, None, None), ("B", 10.0, 9.0, None, None), ("", 10.0, None, None, None)], key=str)
