"""Thirty strategy rules evaluated at every bar of every series, their confluence and risk plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tapeline.functions.kernels import (expanding_regularity, expanding_share, open_gaps, stop_and_reverse,
                                        structure_breaks)
from tapeline.functions.series import (KEYS, ahead, back, before_now, by_time, clip, corr, crossed_down, crossed_up, max_n,
                                       min_n, ratio, trail, upto_now, whole)
from tapeline.operators import indicators as ind, structure as st

# Strategy keys and the information family each votes in.
FAMILIES = {
    "trend": "trend", "breakout": "breakout", "pullback": "trend", "reversal": "reversal", "range": "range",
    "moving_average": "trend", "bollinger": "volatility", "rsi_breakout": "momentum", "rsi_reversal": "reversal",
    "macd": "momentum", "fibonacci": "structure", "gann": "geometry", "stochastic": "momentum", "psar": "trend",
    "momentum": "momentum", "mfi": "flow_proxy", "double_top_bottom": "pattern", "head_shoulders": "pattern",
    "triangle": "pattern", "donchian": "breakout", "wedge": "pattern", "flag": "pattern", "order_flow": "order_flow",
    "atr": "volatility", "options": "options", "ict_smc": "structure", "fvg": "structure", "bos": "structure",
    "choch": "structure", "fib_fvg_bos": "structure",
}


def _slope(name: str, bars: int) -> Column:
    return F.coalesce(ratio(F.col(name), back(name, bars)) - 1, F.lit(0.0))


def _sign(value: Column) -> Column:
    return F.signum(value)


def _vote(up: Column, down: Column) -> Column:
    return F.when(up, 1.0).when(down, -1.0).otherwise(0.0)


def measures(bars: DataFrame, swing: int = 3) -> DataFrame:
    """Window measures that rules share: slopes, crosses, divergences, ranges, swings and levels."""
    bars = st.with_recent_swings(st.with_fib(st.swings(ind.strategy(bars, with_sar=False), swing, swing), swing), swing)
    bars = bars.withColumns({f"{t}{i}_{f}": F.col(f"{t}{i}.{f}") for t in "hl" for i in (1, 2, 3) for f in ("n", "price")})
    high_slope, low_slope = st.slope3("h"), st.slope3("l")
    close = F.col("close")
    unit = F.greatest(F.coalesce("sx_atr", F.lit(0.0)), close * 0.001)
    levels = [st.fib_level(x, F.col("fib_low"), F.col("fib_high"), F.col("fib_up")) for x in st.FIB_ENTRY]
    nearest = F.array_min(F.array(*[F.struct((F.abs(close - v) / unit).alias("d"), v.alias("v")) for v in levels]))
    before = by_time().rowsBetween(-11, -1)
    bars = bars.withColumns({
        "unit": unit,
        "_near": F.when(F.col("fib_low").isNotNull(), nearest),
        "ema20_slope5": _slope("sx_ema20", 5), "ema20_slope8": _slope("sx_ema20", 8), "ema50_slope12": _slope("sx_ema50", 12),
        "obv_slope5": _slope("sx_obv", 5),
        "hist_step": F.coalesce(_sign(F.col("sx_macd_hist") - back("sx_macd_hist")), F.lit(0.0)),
        "ema_cross": _vote(crossed_up(F.col("sx_ema20"), F.col("sx_ema50")), crossed_down(F.col("sx_ema20"), F.col("sx_ema50"))),
        "rsi_cross": _vote(crossed_up(F.col("sx_rsi") - 50, F.lit(0.0) * close), crossed_down(F.col("sx_rsi") - 50, F.lit(0.0) * close)),
        "macd_cross": _vote(crossed_up(F.col("sx_macd"), F.col("sx_macd_signal")), crossed_down(F.col("sx_macd"), F.col("sx_macd_signal"))),
        "zero_cross": _vote(crossed_up(F.col("sx_macd"), F.lit(0.0) * close), crossed_down(F.col("sx_macd"), F.lit(0.0) * close)),
        "k_up": crossed_up(F.col("sx_stoch_k"), F.col("sx_stoch_d")), "k_down": crossed_down(F.col("sx_stoch_k"), F.col("sx_stoch_d")),
        "rsi_div": st.divergence("close", "sx_rsi"), "macd_div": st.divergence("close", "sx_macd"),
        "roc_div": st.divergence("close", "sx_roc"), "mfi_div": st.divergence("close", "sx_mfi"),
        "range_high": F.max("high").over(trail(40, -1)), "range_low": F.min("low").over(trail(40, -1)),
        "pole": ratio(back("close", 11), back("close", 24)) - 1,
        "tight": ratio(max_n(F.col("high"), 12), min_n(F.col("low"), 12)) - 1,
        "flag_high": F.max("high").over(before), "flag_low": F.min("low").over(before),
        "high_slope": high_slope, "low_slope": low_slope,
        "neck_low": F.least("l1_price", "l2_price", F.coalesce("l3_price", "l2_price")),
        "gap_up_bottom": F.last(F.when(back("high", 2) < F.col("low"), back("high", 2)), ignorenulls=True).over(upto_now()),
        "gap_down_top": F.last(F.when(back("low", 2) > F.col("high"), back("low", 2)), ignorenulls=True).over(upto_now()),
        "nulls": F.avg(sum((F.col(c).isNull().cast("double") for c in ("high", "low", "close", "volume")), F.col("open").isNull().cast("double")) / 5).over(upto_now()),
        "valid": F.avg(((F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)).cast("double")).over(upto_now()),
        "gap_seconds": (F.unix_seconds("ts") - F.unix_seconds(back("ts"))).cast("double"),
    })
    return bars.withColumns({"fib_near": F.col("_near.v"), "fib_distance": F.col("_near.d")}).drop("_near", "h1", "h2", "h3", "l1", "l2", "l3")


STATE = [("sx_psar", T.DoubleType()), ("psar_trend", T.DoubleType()), ("psar_flip", T.DoubleType()), ("vol_rank", T.DoubleType()),
         ("width_rank", T.DoubleType()), ("regularity", T.DoubleType()), ("trend", T.DoubleType()), ("bos", T.DoubleType()),
         ("bos_n", T.DoubleType()), ("bos_volume_ratio", T.DoubleType()), ("choch", T.DoubleType()), ("choch_n", T.DoubleType()),
         ("gap_side", T.DoubleType()), ("gap_bottom", T.DoubleType()), ("gap_top", T.DoubleType()), ("gap_meets", T.DoubleType())]


def states(measured: DataFrame, right: int = 3) -> DataFrame:
    """Path-dependent columns (stops, breaks, ranks, open gaps): one kernel pass per series."""
    schema = T.StructType([*measured.schema.fields, *[T.StructField(n, t) for n, t in STATE]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n").reset_index(drop=True)
        num = lambda c: frame[c].to_numpy(float)
        close, high, low = num("close"), num("high"), num("low")
        sar = pd.Series(stop_and_reverse(high, low, 0.02, 0.2))
        turn = pd.Series(1.0, index=frame.index).where(close >= sar.to_numpy(), -1.0)
        pivots = frame.index[frame["swing_kind"].notna()]
        events = structure_breaks(close, num("sx_atr"), list(frame["swing_kind"].to_numpy()[pivots]),
                                  list(num("swing_price")[pivots]), [p + right for p in pivots])
        volume_ratio = frame["sx_volume_ratio"].astype(float).fillna(1.0).to_numpy()
        cols = {c: pd.Series(float("nan"), index=frame.index) for c in ("trend", "bos", "bos_n", "bos_volume_ratio", "choch", "choch_n")}
        for bar, _, up, kind in events:
            side = 1.0 if up else -1.0
            cols["trend"].iat[bar] = side
            tag = kind.lower()
            cols[tag].iat[bar], cols[f"{tag}_n"].iat[bar] = side, float(bar)
            if tag == "bos":
                cols["bos_volume_ratio"].iat[bar] = volume_ratio[bar]
        fib_side = frame["fib_up"].map({True: 1, False: -1}).fillna(0).to_numpy()
        sides, bottoms, tops, meets = open_gaps(high, low, num("fib_near"), 0.35 * num("unit"), fib_side)
        return frame.assign(
            sx_psar=sar, psar_trend=turn, psar_flip=(turn != turn.shift(1, fill_value=turn.iloc[0])).astype(float),
            vol_rank=expanding_share(num("sx_atr_percent")), width_rank=expanding_share(num("sx_boll_width")),
            regularity=expanding_regularity(num("gap_seconds")),
            gap_side=pd.Series(sides, dtype=float), gap_bottom=bottoms, gap_top=tops, gap_meets=pd.Series(meets, dtype=float),
            **{c: s.ffill() for c, s in cols.items()})

    return measured.groupBy(*KEYS).applyInPandas(run, schema)


def context(bars: DataFrame, flow: DataFrame | None = None, swing: int = 3) -> DataFrame:
    """Every column the rules read, at every bar.  ``flow`` adds bid_volume and ask_volume per symbol."""
    out = states(measures(bars, swing), swing)
    trend_score = F.tanh((F.col("ema20_slope8") + F.col("ema50_slope12")) / F.greatest(F.coalesce("sx_atr_percent", F.lit(0.0)), F.lit(1e-6)))
    adx = F.coalesce("sx_adx", F.lit(0.0))
    rank = F.coalesce("vol_rank", F.lit(0.5))
    out = out.withColumns({
        "trend_score": trend_score,
        "regime": F.when((trend_score > 0.35) & (adx >= 18), "TREND_UP").when((trend_score < -0.35) & (adx >= 18), "TREND_DOWN").otherwise("RANGE"),
        "volatility_regime": F.when(rank >= 0.8, "HIGH_VOLATILITY").when(rank <= 0.2, "LOW_VOLATILITY").otherwise("NORMAL_VOLATILITY"),
        "quality": F.bround(100 * (0.3 * (1 - F.col("nulls")) + 0.2 + 0.2 * F.col("regularity") + 0.2 * F.col("valid") + 0.1)),
        "trend": F.coalesce("trend", F.lit(0.0))})
    if flow is not None:
        return out.join(flow.select("symbol", "bid_volume", "ask_volume"), "symbol", "left")
    return out.withColumns({"bid_volume": F.lit(None).cast("double"), "ask_volume": F.lit(None).cast("double")})


def rules() -> dict[str, tuple[Column, Column, Column]]:
    """key -> (raw score, status, may trade).  Pure projections over ``context``."""
    c = F.col
    price, unit, zero = c("close"), c("unit"), F.lit(0.0)
    volume = F.coalesce("sx_volume_ratio", zero)
    volume_or_one = F.coalesce("sx_volume_ratio", F.lit(1.0))
    ranging = c("regime") == "RANGE"
    adx = F.coalesce("sx_adx", zero)
    ok = F.lit("AVAILABLE")
    yes = F.lit(True)
    out: dict[str, tuple[Column, Column, Column]] = {}

    def side_of(name: str) -> Column:
        return F.when(c(name) == "BULLISH", 1.0).when(c(name) == "BEARISH", -1.0).otherwise(zero)

    above = F.when(c("sx_ema20") > c("sx_ema50"), 1.0).otherwise(-1.0)
    out["trend"] = (28 * _sign(c("ema20_slope5")) + 25 * above + F.when(adx >= 20, 18.0).otherwise(5.0) * _sign(price - c("sx_ema50")), ok, yes)

    upper, lower = c("sx_donchian_upper_20"), c("sx_donchian_lower_20")
    margin = F.coalesce((price - upper) / unit, zero)
    way = _vote(price > upper, price < lower)
    out["breakout"] = (35 * way + F.when(volume >= 1.2, 22 * way).otherwise(-12 * way) + F.when(F.abs(margin) >= 0.1, 18 * way).otherwise(-8 * way), ok, yes)

    stretch = (price - c("sx_ema20")) / unit
    has_fib = c("fib_near").isNotNull()
    fib_side = F.when(c("fib_up"), 1.0).otherwise(-1.0)
    out["pullback"] = (30 * above + F.when(F.abs(stretch) <= 0.65, 24 * above).otherwise(-10 * above) + 18 * c("hist_step")
                       + F.when(has_fib & (c("fib_distance") <= 0.5), 18 * above).otherwise(zero), ok, yes)

    turn = F.coalesce(c("choch"), zero)
    out["reversal"] = ((20 * side_of("rsi_div") + 18 * side_of("macd_div") + 34 * turn) * F.when(ranging, 1.0).otherwise(0.7), ok, yes)

    place = (price - c("range_low")) / F.greatest(c("range_high") - c("range_low"), F.lit(1e-12))
    way = _vote(place < 0.2, place > 0.8)
    out["range"] = (38 * way + F.when(adx < 20, 22 * way).otherwise(-20 * way), ok, yes)

    up4 = (c("sx_ema20") > c("sx_ema50")) & (c("sx_ema50") > c("sx_ema100")) & (c("sx_ema100") > c("sx_ema200"))
    down4 = (c("sx_ema20") < c("sx_ema50")) & (c("sx_ema50") < c("sx_ema100")) & (c("sx_ema100") < c("sx_ema200"))
    out["moving_average"] = (28 * c("ema_cross") + 32 * _vote(up4, down4) + 18 * _sign(c("ema20_slope5")), ok, yes)

    b = F.coalesce("sx_boll_percent_b", F.lit(0.5))
    way = (F.when((b > 1) & (volume >= 1.15), 1.0).when((b < 0) & (volume >= 1.15), -1.0)
           .when((b < 0.05) & ranging, 1.0).when((b > 0.95) & ranging, -1.0).otherwise(zero))
    out["bollinger"] = (32 * way + F.when(F.coalesce("width_rank", zero) > 0.35, 18 * way).otherwise(8 * way) + F.when(volume >= 1.15, 16 * way).otherwise(-8 * way), ok, yes)

    way = c("rsi_cross")
    fits = F.when((way > 0) & (c("regime") == "TREND_UP"), 25.0).when((way < 0) & (c("regime") == "TREND_DOWN"), -25.0).otherwise(-8 * way)
    out["rsi_breakout"] = (36 * way + fits, ok, yes)
    way = side_of("rsi_div")
    out["rsi_reversal"] = (38 * way + F.when(c("sx_rsi") < 35, 18.0).when(c("sx_rsi") > 65, -18.0).otherwise(zero)
                           + F.when(ranging, 16 * way).otherwise(-10 * way), ok, yes)
    out["macd"] = (32 * c("macd_cross") + 25 * c("zero_cross") + 15 * c("hist_step"), ok, yes)

    agree = ((c("trend") > 0) & c("fib_up")) | ((c("trend") < 0) & ~c("fib_up"))
    out["fibonacci"] = (F.when(c("fib_distance") <= 0.5, 42 * fib_side).otherwise(5 * fib_side) + F.when(agree, 25 * fib_side).otherwise(-12 * fib_side),
                        F.when(has_fib, "AVAILABLE").otherwise("INSUFFICIENT_EVIDENCE"), yes)
    out["gann"] = (zero, F.lit("INSUFFICIENT_EVIDENCE"), yes)

    way = _vote(c("k_up") & (c("sx_stoch_k") < 35), c("k_down") & (c("sx_stoch_k") > 65))
    out["stochastic"] = (38 * way + F.when(ranging, 20 * way).otherwise(-10 * way), ok, yes)
    way = c("psar_trend")
    out["psar"] = (F.when(c("psar_flip") > 0, 38 * way).otherwise(18 * way) + F.when(adx >= 20, 20 * way).otherwise(-15 * way), ok, yes)
    out["momentum"] = (30 * F.coalesce(_sign(c("sx_roc")), zero) + 22 * F.coalesce(_sign(c("sx_acceleration")), zero) + 15 * side_of("roc_div"), ok, yes)
    bent = side_of("mfi_div")
    way = F.when(bent != 0, bent).otherwise(_vote(c("sx_mfi") < 25, c("sx_mfi") > 75))
    out["mfi"] = (28 * way + 28 * bent + 15 * _sign(c("obv_slope5")), ok, yes)

    two_each = c("h2_price").isNotNull() & c("l2_price").isNotNull()
    alike_tops = F.abs(c("h1_price") - c("h2_price")) / unit <= 0.8
    alike_floors = F.abs(c("l1_price") - c("l2_price")) / unit <= 0.8
    score = (F.when(two_each & alike_tops, F.when(price < c("h_between"), -65.0).otherwise(zero))
             .when(two_each & alike_floors, F.when(price > c("l_between"), 65.0).otherwise(zero)).otherwise(zero))
    out["double_top_bottom"] = (score, ok, yes)
    head = ((c("h2_price") > F.greatest("h1_price", "h3_price") + 0.3 * unit) & (F.abs(c("h3_price") - c("h1_price")) / unit <= 1.2)
            & (price < c("neck_low")))
    out["head_shoulders"] = (F.when(c("h3_price").isNotNull() & c("l2_price").isNotNull() & head, -70.0).otherwise(zero), ok, yes)

    hs, ls = c("high_slope"), c("low_slope")
    three_each = c("h3_price").isNotNull() & c("l3_price").isNotNull()
    way = _vote(price > c("h1_price"), price < c("l1_price"))
    triangle = ((F.abs(hs) < F.abs(ls) * 0.3) & (ls > 0)) | ((F.abs(ls) < F.abs(hs) * 0.3) & (hs < 0)) | ((hs < 0) & (ls > 0))
    wedge = ((hs > 0) & (ls > hs)) | ((hs < 0) & (ls < 0) & (hs < ls))
    for key, shape in (("triangle", triangle), ("wedge", wedge)):
        done = three_each & shape & (way != 0) & (volume_or_one >= 1.1)
        out[key] = (F.when(done, 62 * way).otherwise(zero), ok, F.coalesce(done, F.lit(False)) if key == "wedge" else yes)
    way = _vote(c("pole") > 3 * c("tight"), c("pole") < -3 * c("tight"))
    through = F.when(way > 0, price > c("flag_high")).when(way < 0, price < c("flag_low")).otherwise(False)
    out["flag"] = (F.when(through & (volume_or_one >= 1.15), 65 * way).otherwise(zero), ok, yes)

    score = zero
    for period, vote in ((20, 24), (55, 22), (100, 18)):
        score = score + vote * _vote(price > c(f"sx_donchian_upper_{period}"), price < c(f"sx_donchian_lower_{period}"))
    out["donchian"] = (score, ok, yes)

    delta, total = c("ask_volume") - c("bid_volume"), c("ask_volume") + c("bid_volume")
    out["order_flow"] = (F.coalesce(60 * _sign(delta) * F.least(F.abs(delta) / F.greatest(total, F.lit(1.0)), F.lit(1.0)), zero),
                         F.when(total.isNotNull(), "AVAILABLE").otherwise("ORDER_FLOW_DATA_UNAVAILABLE"), yes)
    way = _sign(price - c("open"))
    out["atr"] = (F.when(F.coalesce("vol_rank", zero) >= 0.55, 25 * way).otherwise(5 * way) + F.when(c("sx_tr") > c("sx_atr"), 25 * way).otherwise(zero), ok, F.lit(False))
    out["options"] = (zero, F.lit("OPTIONS_DATA_UNAVAILABLE"), yes)

    part = components()
    inside = (price >= c("gap_bottom")) & (price <= c("gap_top"))
    out["fvg"] = (F.when(inside, 42 * c("gap_side")).otherwise(zero), ok, yes)
    out["bos"] = (part["bos"] + part["volume"], ok, yes)
    out["choch"] = (part["choch"] + part["momentum"], ok, yes)
    out["ict_smc"] = (part["structure"] + part["bos"] + part["choch"] + part["fvg"] + part["volume"], ok, yes)
    out["fib_fvg_bos"] = (sum(part.values(), zero), ok, yes)
    return out


def components() -> dict[str, Column]:
    """Parts of the structure confluence score."""
    c, zero = F.col, F.lit(0.0)
    bos, choch, way = c("bos"), c("choch"), c("trend")
    fib_side = F.when(c("fib_up"), 1.0).when(~c("fib_up"), -1.0).otherwise(zero)
    newer = choch.isNotNull() & (bos.isNull() | (c("choch_n") > c("bos_n")))
    return {"structure": 12 * way, "bos": F.coalesce(18 * bos, zero), "choch": F.when(newer, 10 * choch).otherwise(zero),
            "fibonacci": F.when(c("fib_distance") <= 0.65, 14 * fib_side).otherwise(zero),
            "fvg": F.when(c("gap_meets") > 0, 16 * fib_side).otherwise(zero),
            "volume": F.coalesce(F.when(c("bos_volume_ratio") >= 1.2, 7.0).otherwise(2.0) * bos, zero),
            "momentum": 7 * c("hist_step"), "regime": F.when(c("regime") != "RANGE", 6 * way).otherwise(zero)}


def setup_status(score: Column) -> Column:
    a = F.abs(score)
    return F.when(a >= 85, "HIGH_CONFLUENCE").when(a >= 75, "VALID_SETUP").when(a >= 60, "WATCH").when(a >= 40, "WEAK").otherwise("NO_TRADE")


def signals(ctx: DataFrame, keys: list[str] | None = None, threshold: float | str = 24.0) -> DataFrame:
    """One row per bar and strategy: signal, strength and confidence after the quality discount."""
    table = rules()
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(FAMILIES[k]).alias("family"), table[k][0].cast("double").alias("score"),
                              table[k][1].alias("status"), table[k][2].alias("may_trade")) for k in (keys or FAMILIES)])
    keep = [f for f in ctx.columns]
    out = ctx.select(*keep, F.inline(rows))
    adjusted = clip(F.col("score") * F.col("quality") / 100, -100.0, 100.0)
    live = F.col("status") == "AVAILABLE"
    out = out.withColumn("adjusted", F.when(live, adjusted))
    return out.withColumns({
        "signal": F.when(live & F.col("may_trade") & (F.col("adjusted") >= limit), "BUY")
        .when(live & F.col("may_trade") & (F.col("adjusted") <= -limit), "SELL").otherwise("HOLD"),
        "strength": F.when(live, F.round(F.abs("adjusted"), 2)).otherwise(0.0),
        "confidence": F.when(live, F.round(F.least(F.lit(100.0), F.abs("adjusted") * 0.7 + F.col("quality") * 0.3), 2)).otherwise(0.0)})


def last_bar(ctx: DataFrame) -> DataFrame:
    return ctx.withColumn("_end", F.max("n").over(whole())).filter("n = _end").drop("_end")


def confluence(found: DataFrame, by: tuple[str, ...] = (*KEYS, "ts")) -> DataFrame:
    """Mean within an information family first, then an equal-weight mean of families."""
    signed = F.col("strength") * F.when(F.col("signal") == "BUY", 1.0).when(F.col("signal") == "SELL", -1.0).otherwise(0.0)
    live = F.col("status") == "AVAILABLE"
    per_family = (found.groupBy(*by, "family").agg(F.avg(F.when(live, signed)).alias("family_score"), F.count(F.when(live, 1)).alias("_a"),
                                                   F.count(F.when(~live, 1)).alias("_u")))
    out = per_family.groupBy(*by).agg(F.coalesce(F.avg("family_score"), F.lit(0.0)).alias("raw"), F.sum("_a").alias("available"),
                                      F.sum("_u").alias("unavailable"),
                                      F.map_from_entries(F.collect_list(F.when(F.col("family_score").isNotNull(), F.struct("family", F.round("family_score", 2))))).alias("family_scores"))
    raw = F.col("raw")
    return out.withColumns({"score": F.round(F.abs("raw"), 2),
                            "direction": F.when(raw >= 15, "UP").when(raw <= -15, "DOWN").otherwise("RANGE"),
                            "signal": F.when(raw >= 24, "BUY").when(raw <= -24, "SELL").otherwise("HOLD")})


def long_enough(bars: DataFrame, least: int = 60) -> DataFrame:
    """Bars of the series that have ``least`` bars; shorter ones say nothing about their timeframe."""
    held = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_bars")).filter(F.col("_bars") >= least).drop("_bars")
    return bars.join(held, list(KEYS), "left_semi")


def multi_timeframe(per_frame: DataFrame, by: str = "symbol") -> DataFrame:
    """Agreement of confluence directions across a symbol's intervals."""
    up, down = F.count(F.when(F.col("direction") == "UP", 1)), F.count(F.when(F.col("direction") == "DOWN", 1))
    out = per_frame.groupBy(by).agg(up.alias("up"), down.alias("down"), F.count(F.lit(1)).alias("frames"))
    share = F.coalesce(ratio(F.greatest("up", "down").cast("double"), (F.col("up") + F.col("down")).cast("double")), F.lit(0.0))
    conflict = (F.col("up") > 0) & (F.col("down") > 0)
    return out.withColumns({"alignment": F.round(share, 4), "conflict": conflict,
                            "confidence_factor": F.when(conflict, 0.65).when(share < 0.6, 0.85).otherwise(1.0)})


def risk_plan(ctx: DataFrame, agreed: DataFrame, horizon: int = 8) -> DataFrame:
    """Stop, three targets, their empirical hit rates and expected value, at each series' last bar."""
    c = F.col
    end = last_bar(ctx).join(agreed.select(*KEYS, "direction"), list(KEYS))
    way = F.when(c("direction") == "UP", 1).when(c("direction") == "DOWN", -1).otherwise(0)
    price, unit = c("close"), c("unit")
    anchor = F.coalesce(F.when(way > 0, c("l1_price")).otherwise(c("h1_price")), price - way * 1.5 * unit)
    gap_level = F.coalesce(F.when(way > 0, c("gap_up_bottom")).otherwise(c("gap_down_top")), anchor)
    stop = (F.when(way == 0, price - 1.5 * unit).when(way > 0, F.least(anchor, gap_level) - 0.2 * unit)
            .otherwise(F.greatest(anchor, gap_level) + 0.2 * unit))
    end = end.withColumns({"side": F.when(way < 0, -1).otherwise(1), "stop": stop, "anchor": anchor})
    end = end.withColumn("risk", F.greatest(F.abs(price - c("stop")), 0.5 * unit))
    plans = {}
    for i, rr in enumerate((1.0, 2.0, 3.0), 1):
        target = price + c("side") * c("risk") * rr
        if i > 1:
            level = st.fib_level((1.272, 1.618)[i - 2], c("fib_low"), c("fib_high"), c("fib_up"))
            target = F.when((level - price) * c("side") > 0.5 * c("risk"), level).otherwise(target)
        plans[f"tp{i}"] = target
    end = end.withColumns(plans).withColumns({f"rr{i}": F.round(F.abs(c(f"tp{i}") - price) / c("risk"), 3) for i in (1, 2, 3)})
    end = end.select(*KEYS, "ts", price.alias("entry"), "side", "stop", "risk", unit.alias("end_unit"), *plans, "rr1", "rr2", "rr3")
    w = ahead(1, horizon)
    past = (ctx.withColumns({"_hi": F.max("high").over(w), "_lo": F.min("low").over(w), "_k": F.count("close").over(w)})
            .filter((c("n") >= 60) & (c("_k") == horizon))
            .select(*KEYS, c("close").alias("_c"), F.greatest(F.coalesce("sx_atr", F.lit(0.0)), c("close") * 0.001).alias("_u"), "_hi", "_lo"))
    seen = past.join(end.select(*KEYS, "side", "rr1", "rr2", "rr3", (c("risk") / c("end_unit")).alias("_stop_r")), list(KEYS))
    good = F.when(c("side") > 0, c("_hi") - c("_c")).otherwise(c("_c") - c("_lo")) / c("_u")
    bad = F.when(c("side") > 0, c("_c") - c("_lo")).otherwise(c("_hi") - c("_c")) / c("_u")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    odds = seen.groupBy(*KEYS).agg(*[share(good >= c(f"rr{i}")).alias(f"p{i}") for i in (1, 2, 3)],
                                   share(bad >= c("_stop_r")).alias("p_stop"), F.count(F.lit(1)).alias("samples"))
    out = end.join(odds, list(KEYS), "left").withColumns({"p_stop": F.coalesce("p_stop", F.lit(0.5)), "samples": F.coalesce("samples", F.lit(0))})
    value = sum((F.coalesce(c(f"p{i}"), F.lit(0.0)) * c(f"rr{i}") * w for i, w in ((2, 0.3), (3, 0.2))), F.coalesce(c("p1"), F.lit(0.0)) * c("rr1") * 0.5)
    return out.withColumn("expected_value", value - c("p_stop") - 0.0015 * c("entry") / c("risk")).drop("end_unit")


def evidence(found: DataFrame, top: int = 20) -> DataFrame:
    """Per series the strongest rules for, against and undecided, at most ``top`` of each."""
    item = F.struct((-F.col("strength")).alias("order"), "strategy", "signal", "strength", "status")
    gathered = found.groupBy(*KEYS, "ts").agg(F.array_sort(F.collect_list(item)).alias("items"))
    pick = lambda cond: F.slice(F.filter("items", cond), 1, top)
    return gathered.select(*KEYS, "ts", pick(lambda x: x["signal"] == "BUY").alias("bullish"), pick(lambda x: x["signal"] == "SELL").alias("bearish"),
                           pick(lambda x: x["signal"] == "HOLD").alias("neutral"))


def all_strategies(ctx: DataFrame) -> DataFrame:
    """Full pass at the last bar: every rule with the series' stop, target and expected value."""
    found = signals(last_bar(ctx))
    plan = risk_plan(ctx, confluence(found))
    slim = found.select(*KEYS, "ts", "strategy", "family", "status", "signal", "strength", "confidence", "regime")
    live = F.col("status") == "AVAILABLE"
    joined = slim.join(plan.select(*KEYS, "stop", "tp1", "rr1", "expected_value"), list(KEYS), "left")
    return joined.select(*slim.columns, *[F.when(live, F.col(a)).alias(b) for a, b in
                                          (("stop", "stop_loss"), ("tp1", "take_profit"), ("rr1", "risk_reward"), ("expected_value", "expected_value"))])


def final_action(joined: DataFrame) -> DataFrame:
    """Fuse a model's direction with the strategies'.

    Reads signal (confluence), model_direction, actionable, expected_value and conflict.
    """
    c = F.col
    aligned = ((c("signal") == "BUY") & (c("model_direction") == "UP")) | ((c("signal") == "SELL") & (c("model_direction") == "DOWN"))
    go = aligned & (F.coalesce("expected_value", F.lit(0.0)) > 0) & ~c("conflict") & c("actionable")
    return joined.withColumns({
        "action": F.when(go, c("signal")).when(c("conflict"), "WATCH").otherwise("HOLD"),
        "reason": F.when(go, "MODEL_AND_STRATEGIES_ALIGNED").when(c("conflict"), "HIGHER_TIMEFRAME_CONFLICT")
        .when(~c("actionable"), "MODEL_NOT_VALIDATED").otherwise("MISMATCH_OR_NON_POSITIVE_EV")})


def correlation_matrix(bars: DataFrame) -> DataFrame:
    """Pairwise correlation of eight normalised signals per series, complete rows only."""
    c = F.col
    atr, close = F.when(c("sx_atr") != 0, c("sx_atr")), F.when(c("close") != 0, c("close"))
    prior_high, prior_low = max_n(c("high"), 40, upto=-1), min_n(c("low"), 40, upto=-1)
    named = {"RSI": (c("sx_rsi") - 50) / 50, "MACD": c("sx_macd_hist") / atr, "Momentum": c("sx_roc"),
             "MA": (c("sx_ema20") - c("sx_ema50")) / close, "Bollinger": c("sx_boll_percent_b") - 0.5,
             "Breakout": _vote(c("close") > c("sx_donchian_upper_20"), c("close") < c("sx_donchian_lower_20")),
             "BOS": _vote(c("close") > prior_high, c("close") < prior_low),
             "FVG": _vote(back("high", 2) < c("low"), back("low", 2) > c("high"))}
    rows = bars.select(*KEYS, *[v.alias(k) for k, v in named.items()]).dropna()
    names = list(named)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    wide = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("samples"), *[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return (wide.filter("samples >= 30").unpivot([*KEYS, "samples"], [f"`{a}|{b}`" for a, b in pairs], "pair", "correlation")
            .withColumns({"left": F.split("pair", r"\|")[0], "right": F.split("pair", r"\|")[1]}).drop("pair"))
