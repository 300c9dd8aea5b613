"""Causal market structure: swings, breaks, price gaps, retracement levels, patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tapeline.functions.kernels import structure_breaks
from tapeline.functions.series import (KEYS, ahead, back, before_now, by_time, clip, numbered, ratio, trail, upto_now,
                                       whole)
from tapeline.operators.features import swing_marks

# Retracement and extension ratios of the level ladder.
FIB_RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618, 2.0)
FIB_ENTRY = (0.382, 0.5, 0.618, 0.786)


def swings(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Mark pivot bars; a pivot is one kind only (HIGH first) and is known ``right`` bars later."""
    bars = swing_marks(numbered(bars), left, right)
    kind = F.when(F.col("is_high"), "HIGH").when(F.col("is_low"), "LOW")
    return bars.withColumns({
        "swing_kind": kind,
        "swing_price": F.round(F.when(F.col("is_high"), F.col("high")).when(F.col("is_low"), F.col("low")), 6),
        "swing_known_at": F.when(kind.isNotNull(), F.lead("ts", right).over(by_time())),
    }).drop("is_high", "is_low")


def swing_table(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    return (swings(bars, left, right).filter("swing_kind is not null")
            .select(*KEYS, "swing_kind", "swing_price", F.col("n").alias("pivot"), F.col("ts").alias("formed_at"),
                    (F.col("n") + right).alias("known_from"), F.col("swing_known_at").alias("known_at")))


def with_breaks(swung: DataFrame, right: int = 3) -> DataFrame:
    """Add break_type / break_up / break_price / break_pivot on bars that break a swing.

    Needs swing marks and sx_atr.  The set of unbroken swings is a stack, so this
    is one kernel per series; the bar columns pass through unchanged.
    """
    schema = T.StructType([*swung.schema.fields, T.StructField("break_type", T.StringType()),
                           T.StructField("break_up", T.BooleanType()), T.StructField("break_price", T.DoubleType()),
                           T.StructField("break_pivot", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n").reset_index(drop=True)
        pivots = frame.index[frame["swing_kind"].notna()]
        kinds = frame["swing_kind"].to_numpy()[pivots]
        prices = frame["swing_price"].to_numpy(float)[pivots]
        events = structure_breaks(frame["close"].to_numpy(float), frame["sx_atr"].to_numpy(float), list(kinds), list(prices),
                                  [p + right for p in pivots])
        types, ups, levels, where = [None] * len(frame), [None] * len(frame), [None] * len(frame), [None] * len(frame)
        for bar, swing, up, kind in events:
            types[bar], ups[bar], levels[bar], where[bar] = kind, up, float(prices[swing]), int(pivots[swing])
        return frame.assign(break_type=types, break_up=pd.array(ups, dtype="boolean"), break_price=levels,
                            break_pivot=pd.array(where, dtype="Int64"))

    return swung.groupBy(*KEYS).applyInPandas(run, schema)


def breaks(bars: DataFrame) -> DataFrame:
    """Structure events with their confirmation; needs sx_atr and sx_volume_ratio."""
    slim = bars.select(*KEYS, "ts", "high", "low", "close", "volume", "sx_atr", "sx_volume_ratio")
    found = with_breaks(swings(slim)).filter("break_type is not null")
    volume_ratio = F.coalesce("sx_volume_ratio", F.lit(1.0))
    return found.select(*KEYS, "ts", "n", "break_type", F.when(F.col("break_up"), "BULLISH").otherwise("BEARISH").alias("direction"),
                        "break_price", "break_pivot", "volume", volume_ratio.alias("volume_ratio"),
                        F.when(volume_ratio >= 1.2, "VOLUME_CONFIRMED").otherwise("CLOSE_CONFIRMED").alias("confirmation"))


def structure_state(bars: DataFrame) -> DataFrame:
    """Per bar what is known of the structure so far, its digest, and whether that differs from the bar before.

    Three streams of events (breaks of structure, changes of character, gaps) are carried on by their last-known bars;
    needs sx_atr. The first bar of a series counts as changed. How far gaps are filled is not part of the state.
    """
    c = F.col
    found = with_breaks(swings(bars.select(*KEYS, "ts", "high", "low", "close", "sx_atr")))
    gap = (back("high", 2) < c("low")) | (back("low", 2) > c("high"))
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda hit: F.max(F.when(hit, c("n"))).over(upto)
    out = found.select(*KEYS, "ts", "n", last(c("break_type") == "BOS").alias("bos_at"), last(c("break_type") == "CHOCH").alias("choch_at"), last(gap).alias("gap_at"))
    out = out.withColumn("fingerprint", F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("-")) for x in ("bos_at", "choch_at", "gap_at")]), 256))
    return out.withColumn("changed", ~F.coalesce(F.lag("fingerprint").over(by_time()) == c("fingerprint"), F.lit(False)))


def price_gaps(bars: DataFrame) -> DataFrame:
    """Three-bar gaps with how far later bars filled them; needs sx_atr for the ATR size."""
    bars = numbered(bars)
    h2, l2 = back("high", 2), back("low", 2)
    up, down = h2 < F.col("low"), l2 > F.col("high")
    rest = by_time().rowsBetween(1, Window.unboundedFollowing)
    bars = bars.withColumns({
        "gap_up": F.when(up, True).when(down, False),
        "bottom": F.when(up, h2).when(down, F.col("high")),
        "top": F.when(up, F.col("low")).when(down, l2),
        "_min": F.min("low").over(rest), "_max": F.max("high").over(rest),
        "_rows": F.max("n").over(whole())})
    size = F.col("top") - F.col("bottom")
    deep = F.when(F.col("gap_up"), F.col("top") - F.col("_min")).otherwise(F.col("_max") - F.col("bottom"))
    filled = F.coalesce(clip(deep / F.greatest(size, F.lit(1e-12)), 0.0, 1.0), F.lit(0.0))
    return bars.filter("gap_up is not null").select(
        *KEYS, "ts", "n", F.when(F.col("gap_up"), "BULLISH").otherwise("BEARISH").alias("direction"), "bottom", "top",
        size.alias("size"), (size / F.greatest(F.coalesce("sx_atr", size), F.lit(1e-12))).alias("size_atr"),
        (F.col("_rows") - F.col("n")).alias("age"), (filled * 100).alias("filled_percent"),
        F.when(filled >= 0.999, "FILLED").when(filled > 0, "PARTIALLY_FILLED").otherwise("OPEN").alias("status"))


def price_gaps_as_of(bars: DataFrame, cutoff) -> DataFrame:
    """The same gaps as an observer at ``cutoff`` saw them."""
    return price_gaps(bars.filter(F.col("ts") <= F.lit(cutoff).cast("timestamp")))


def fib_level(ratio_value: float, low: Column, high: Column, up: Column) -> Column:
    span = F.greatest(high - low, F.lit(1e-12))
    inner = ratio_value <= 1
    rise = high - span * ratio_value if inner else low + span * ratio_value
    fall = low + span * ratio_value if inner else high - span * ratio_value
    return F.round(F.when(up, rise).otherwise(fall), 6)


def with_fib(swung: DataFrame, right: int = 3) -> DataFrame:
    """As of each bar: the latest adjacent pair of opposite known swings (fib_low, fib_high, fib_up)."""
    point = F.when(F.col("swing_kind").isNotNull(),
                   F.struct(F.col("swing_kind").alias("kind"), F.col("swing_price").alias("price"), F.col("n").alias("n")))
    swung = swung.withColumn("_pt", point)
    swung = swung.withColumn("_prev", F.last("_pt", ignorenulls=True).over(before_now()))
    pair = F.when(F.col("_prev.kind") != F.col("_pt.kind"), F.struct(
        F.when(F.col("_pt.kind") == "LOW", F.col("_pt")).otherwise(F.col("_prev")).alias("lo"),
        F.when(F.col("_pt.kind") == "HIGH", F.col("_pt")).otherwise(F.col("_prev")).alias("hi")))
    swung = swung.withColumn("_pair", back(pair, right))
    swung = swung.withColumn("_pair", F.last("_pair", ignorenulls=True).over(upto_now()))
    return swung.withColumns({"fib_low": F.col("_pair.lo.price"), "fib_high": F.col("_pair.hi.price"),
                              "fib_up": F.col("_pair.hi.n") > F.col("_pair.lo.n")}).drop("_pt", "_prev", "_pair")


def fib_ladder(bars: DataFrame) -> DataFrame:
    """Level ladder of each series at its last bar."""
    out = with_fib(swings(bars))
    out = out.withColumn("_end", F.max("n").over(whole())).filter("n = _end")
    levels = F.map_from_arrays(F.array(*[F.lit(str(x)) for x in FIB_RATIOS]),
                               F.array(*[fib_level(x, F.col("fib_low"), F.col("fib_high"), F.col("fib_up")) for x in FIB_RATIOS]))
    return out.select(*KEYS, "ts", F.when(F.col("fib_low").isNull(), "INSUFFICIENT_EVIDENCE").otherwise("AVAILABLE").alias("status"),
                      F.when(F.col("fib_up"), "UP").when(~F.col("fib_up"), "DOWN").alias("direction"), "fib_low", "fib_high",
                      F.when(F.col("fib_low").isNotNull(), levels).alias("levels"))


def divergence(price: str, indicator: str) -> Column:
    """BULLISH/BEARISH/NONE from the two halves of the last 30 bars."""
    new, old = trail(15), trail(15, -15)
    enough = F.count(price).over(trail(30)) >= 30
    bull = (F.min(price).over(new) < F.min(price).over(old)) & (F.min(indicator).over(new) > F.min(indicator).over(old))
    bear = (F.max(price).over(new) > F.max(price).over(old)) & (F.max(indicator).over(new) < F.max(indicator).over(old))
    return F.when(enough & bull, "BULLISH").when(enough & bear, "BEARISH").otherwise("NONE")


def with_recent_swings(swung: DataFrame, right: int = 3) -> DataFrame:
    """As of each bar the last three known highs and lows (h1 newest) and the extremes between the last two."""
    for kind, other, tag, edge in (("HIGH", "LOW", "h", F.min), ("LOW", "HIGH", "l", F.max)):
        mine = F.col("swing_kind") == kind
        swung = swung.withColumn("_p1", F.when(mine, F.struct(F.col("n").alias("n"), F.col("swing_price").alias("price"))))
        swung = swung.withColumns({"_p2": F.last("_p1", ignorenulls=True).over(before_now()),
                                   "_run": F.count("_p1").over(before_now())})
        swung = swung.withColumns({
            "_p3": F.last(F.when(mine, F.col("_p2")), ignorenulls=True).over(before_now()),
            "_between": edge(F.when(F.col("swing_kind") == other, F.col("swing_price"))).over(
                Window.partitionBy(*KEYS, "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))})
        known = back(F.when(mine, F.struct("_p1", "_p2", "_p3", "_between")), right)
        swung = swung.withColumn("_known", known)
        swung = swung.withColumn("_known", F.last("_known", ignorenulls=True).over(upto_now()))
        swung = swung.withColumns({**{f"{tag}{i}": F.col(f"_known._p{i}") for i in (1, 2, 3)}, f"{tag}_between": F.col("_known._between")})
    return swung.drop("_p1", "_p2", "_p3", "_run", "_between", "_known")


def slope3(tag: str) -> Column:
    """Least-squares slope through the last three swings of a kind."""
    xs, ys = [F.col(f"{tag}{i}.n").cast("double") for i in (1, 2, 3)], [F.col(f"{tag}{i}.price") for i in (1, 2, 3)]
    mx, my = (xs[0] + xs[1] + xs[2]) / 3, (ys[0] + ys[1] + ys[2]) / 3
    top = sum(((x - mx) * (y - my) for x, y in zip(xs[1:], ys[1:])), (xs[0] - mx) * (ys[0] - my))
    return ratio(top, sum(((x - mx) * (x - mx) for x in xs[1:]), (xs[0] - mx) * (xs[0] - mx)))
