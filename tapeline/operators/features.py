"""The 57-column feature frame, cross-sectional panels and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import ranks
from tapeline.functions.series import (KEYS, ahead, avg_n, back, change, clip, corr, ewm, finite, full, max_n, min_n, numbered,
                                       quantile_n, ratio, span_alpha, std_n, sum_n, trail, upto_now, whole, by_time)
from tapeline.operators import indicators as ind
from tapeline.schema import FEATURES

ANNUAL = math.sqrt(252.0)


def price_features(bars: DataFrame) -> DataFrame:
    close, open_, high, low = (F.col(c) for c in ("close", "open", "high", "low"))
    prev = back("close")
    bars = ind.returns(bars, (1, 3, 5, 10, 20)).withColumns({
        "log_return": F.when((prev > 0) & (close > 0), F.ln(close / prev)),
        "gap": ratio(open_, prev) - 1,
        "high_low_range": ratio(high - low, prev),
        "close_open": ratio(close, open_) - 1,
        "true_range": ratio(ind.true_range(), prev)})
    bars = bars.withColumns({
        "realized_volatility": std_n(F.col("log_return"), 20) * ANNUAL,
        "historical_volatility": std_n(F.col("return_1"), 60) * ANNUAL})
    for n in (20, 60, 120):
        bottom, top = min_n(low, n), max_n(high, n)
        bars = bars.withColumn(f"high_position_{n}", ratio(close - bottom, top - bottom))
    return bars


def technical_features(bars: DataFrame) -> DataFrame:
    """On top of the chart set (needs rsi, macd, atr, boll_*, ma*)."""
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    width = F.col("boll_upper") - F.col("boll_lower")
    bars = ewm(bars, {f"ema{n}": ("close", span_alpha(n)) for n in (5, 10, 20, 50, 100, 200)})
    low14, high14 = min_n(low, 14), max_n(high, 14)
    bars = bars.withColumns({
        "ma5_gap": ratio(close, F.col("ma5")) - 1, "ma20_gap": ratio(close, F.col("ma20")) - 1,
        "boll_position": ratio(close - F.col("boll_lower"), width),
        "boll_width": ratio(width, F.col("boll_mid")),
        **{f"ema{n}_gap": ratio(close, F.col(f"ema{n}")) - 1 for n in (5, 10, 20, 50, 100, 200)},
        "rsi_slope": (F.col("rsi") - back("rsi", 3)) / 3,
        "macd_slope": (F.col("macd") - back("macd", 3)) / 3,
        "ema20_slope": change(F.col("ema20"), 5) / 5,
        "stoch_k": ratio(close - low14, high14 - low14) * 100,
        "williams_r": ratio(high14 - close, high14 - low14) * -100,
        "roc": change(close, 12) * 100,
        "_tp": ind.typical()})
    bars = bars.withColumns({"_tp20": F.collect_list("_tp").over(trail(20)), "_tpm": avg_n(F.col("_tp"), 20),
                             "_flow": F.col("_tp") * volume * F.coalesce(F.signum(F.col("_tp") - back("_tp")), F.lit(0.0))})
    deviation = F.aggregate("_tp20", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tpm"))) / 20
    inflow = sum_n(F.greatest(F.col("_flow"), F.lit(0.0)), 14)
    outflow = sum_n(-F.least(F.col("_flow"), F.lit(0.0)), 14)
    bars = bars.withColumns({
        "cci": ratio(F.col("_tp") - F.col("_tpm"), 0.015 * F.when(F.size("_tp20") == 20, deviation)),
        "mfi": 100 - 100 / (1 + ratio(inflow, outflow))})
    return bars.drop("_tp", "_tp20", "_tpm", "_flow")


def volume_features(bars: DataFrame) -> DataFrame:
    """Needs obv and return_1."""
    close, volume = F.col("close"), F.col("volume")
    bars = bars.withColumns({"_tv": ind.typical() * volume, "_vr": change(volume, 1),
                             "_sv": F.coalesce(F.signum(close - back("close")), F.lit(0.0)) * volume})
    old = back("volume", 5)
    volume_sign = F.when((old != 0) | (volume != 0), F.signum(volume - old))
    paired = F.when(F.col("return_1").isNotNull() & F.col("_vr").isNotNull(), F.col("_vr"))
    bars = bars.withColumns({
        "volume_zscore": ratio(volume - avg_n(volume, 20), std_n(volume, 20)),
        "relative_volume": ratio(volume, quantile_n(volume, 60, 0.5)),
        "obv_change": change(F.col("obv"), 5),
        "money_flow": change(F.col("_tv"), 5),
        "price_volume_corr": finite(F.when(F.count(paired).over(trail(20)) >= 20, corr("return_1", "_vr", trail(20)))),
        "vwap_deviation": ratio(close, ratio(sum_n(F.col("_tv"), 20), sum_n(volume, 20))) - 1,
        "volume_trend": ratio(avg_n(volume, 5), avg_n(volume, 20)) - 1,
        "volume_divergence": -F.signum(change(close, 5)) * volume_sign,
        "flow_pressure": ratio(sum_n(F.col("_sv"), 20, least=5), sum_n(volume, 20, least=5))})
    return bars.withColumn("abnormal_volume", F.when(F.abs("volume_zscore") > 2, 1.0).otherwise(0.0)).drop("_tv", "_vr", "_sv")


def swing_marks(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Raw pivot tests; a HIGH and a LOW may fall on one bar."""
    high, low = F.col("high"), F.col("low")
    past, later = by_time().rowsBetween(-left, -1), ahead(1, right)
    complete = (F.count(high).over(past) == left) & (F.count(high).over(later) == right)
    return bars.withColumns({
        "is_high": complete & (high > F.max(high).over(past)) & (high >= F.max(high).over(later)),
        "is_low": complete & (low < F.min(low).over(past)) & (low <= F.min(low).over(later))})


def structure_features(bars: DataFrame, right: int = 3) -> DataFrame:
    """Needs atr.  A pivot counts from ``right`` bars after it."""
    bars = swing_marks(numbered(bars), 3, right)
    point = lambda flag, price: F.when(F.col(flag), F.struct(F.col("n").alias("n"), F.col(price).alias("price")))
    bars = bars.withColumns({"_ph": back(point("is_high", "high"), right), "_pl": back(point("is_low", "low"), right)})
    bars = bars.withColumns({"_h": F.last("_ph", ignorenulls=True).over(upto_now()),
                             "_l": F.last("_pl", ignorenulls=True).over(upto_now())})
    close, prev = F.col("close"), back("close")
    top, bottom = F.col("_h.price"), F.col("_l.price")
    span = top - bottom
    level = F.when(F.col("_h.n") > F.col("_l.n"), top - 0.618 * span).otherwise(bottom + 0.618 * span)
    bars = bars.withColumns({
        "causal_bos": F.when((prev <= top) & (top < close), 1.0).when((prev >= bottom) & (bottom > close), -1.0).otherwise(0.0),
        "fvg_imbalance": F.when(back("high", 2) < F.col("low"), 1.0).when(back("low", 2) > F.col("high"), -1.0).otherwise(0.0),
        "fib_0618_distance": F.when(top > bottom, ratio(close - level, F.col("atr")))})
    return bars.drop("is_high", "is_low", "_ph", "_pl", "_h", "_l")


def regime_features(bars: DataFrame) -> DataFrame:
    """Needs volatility, ema20_slope, ema20_gap, return_5 and return_20."""
    cut = quantile_n(F.col("volatility"), 120, 0.75, upto=-1, least=30)
    mood = ratio(avg_n(F.col("return_5"), 20, least=5), F.col("volatility"))
    gap, drift = F.col("ema20_gap"), F.col("return_20")
    return bars.withColumns({
        "regime_trend": F.tanh(F.col("ema20_slope") * 100),
        "regime_high_vol": F.when(F.col("volatility") > cut, 1.0).otherwise(0.0),
        "regime_risk_on": F.when((gap > 0) & (drift > 0), 1.0).when((gap < 0) & (drift < 0), -1.0).otherwise(0.0),
        "sentiment_score": F.coalesce(clip(mood, -3.0, 3.0), F.lit(0.0)) / 3})


def features(bars: DataFrame) -> DataFrame:
    """Chart set plus all 57 features; non-finite values become NULL."""
    bars = ind.chart(bars)
    bars = price_features(bars.drop("return_1", "return_3", "return_5"))
    for step in (technical_features, volume_features, structure_features, regime_features):
        bars = step(bars)
    return bars.withColumns({name: finite(F.col(name)) for name in FEATURES if name in bars.columns})


def catalogue(frame: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Long feature store: one row per (series, ts, feature) with its group; finite values only."""
    names = [c for group in groups.values() for c in group]
    group_of = F.create_map(*[F.lit(x) for g, cols in groups.items() for c in cols for x in (c, g)])
    long = frame.select(*KEYS, "ts", *[finite(F.col(c)).alias(c) for c in names]).unpivot(
        [*KEYS, "ts"], names, "feature_name", "value")
    return long.filter("value is not null").withColumn("feature_group", group_of[F.col("feature_name")])


# --- targets, panel and labels -------------------------------------------------


def future_path(bars: DataFrame, steps: int) -> DataFrame:
    """Return and worst low over the next ``steps`` bars, and when they end."""
    target = F.lead("close", steps).over(by_time())
    return bars.withColumns({
        "target_time": F.lead("ts", steps).over(by_time()),
        "future_return": ratio(target, F.col("close")) - 1,
        "future_max_drawdown": F.when(target.isNotNull(), ratio(F.min("low").over(ahead(1, steps)), F.col("close")) - 1)})


def panel(frame: DataFrame, steps: int, columns: list[str] = FEATURES, session: Column | None = None) -> DataFrame:
    """Complete rows of all symbols with same-session z-scores and relative targets."""
    frame = future_path(frame, steps).withColumn("session_date", session if session is not None else F.to_date("ts"))
    frame = frame.dropna(subset=[*columns, "future_return", "future_max_drawdown", "target_time"])
    x = Window.partitionBy("session_date")
    scores = {}
    for name in columns:
        z = ratio(F.col(name) - F.avg(name).over(x), F.stddev_samp(name).over(x))
        scores[f"z_{name}"] = clip(F.coalesce(z, F.lit(0.0)), -5.0, 5.0)
    for name in ("return_5", "return_20"):
        if name in frame.columns:
            scores[f"relative_{name}"] = F.col(name) - F.percentile(name, F.lit(0.5)).over(x)
    scores["alpha_target"] = F.col("future_return") - F.avg("future_return").over(x)
    return frame.withColumns(scores)


def three_class_label(frame: DataFrame, steps: int) -> DataFrame:
    """UP/FLAT/DOWN against a threshold known before the bar: scaled median of earlier ATR shares."""
    share = ratio(F.col("atr"), F.col("close"))
    frame = future_path(frame, steps).withColumn("_share", share)
    threshold = clip(quantile_n(F.col("_share"), 180, 0.5, upto=-1, least=30) * 0.28, 0.001, 0.018)
    frame = frame.withColumn("threshold", threshold).drop("_share")
    move = F.col("future_return")
    return frame.withColumn("label", F.when(F.col("threshold").isNotNull() & move.isNotNull(),
                                            F.when(move > F.col("threshold"), 1).when(move < -F.col("threshold"), -1).otherwise(0)))


def asset_profile(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """Model and cost profile per asset; ``assets`` holds (symbol, asset_type, code)."""
    recent = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ts")))
    turnover = (bars.withColumn("_r", recent).filter("_r <= 100").groupBy("symbol")
                .agg(F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("median_turnover")))
    code = F.upper(F.regexp_replace("code", r"[/-]USDT$", ""))
    stock = F.col("asset_type") == "stock"
    # The coins that count as major.
    major = code.isin("SOL", "BNB", "XRP", "ADA", "DOGE", "AVAX", "LINK", "DOT")
    name = (F.when(stock & F.split(code, r"\.")[0].rlike("^[0-9]+$"), "CN_EQUITY").when(stock, "US_EQUITY")
            .when(code == "BTC", "BTC").when(code == "ETH", "ETH").when(major, "MAJOR_ALTCOIN").otherwise("LOW_LIQUIDITY_TOKEN"))
    core = F.col("profile").isin("BTC", "ETH")
    return (assets.join(turnover, "symbol").withColumn("profile", name).select(
        "symbol", "profile",
        F.when(core, 8).otherwise(7).alias("max_depth"),
        F.when(stock, 5).when(core, 3).otherwise(6).alias("min_leaf"),
        F.when(stock, 0.82).when(core, 0.85).otherwise(0.75).alias("subsample"),
        F.when(stock | (F.col("profile") == "BTC"), 1.0).when(F.col("profile") == "ETH", 0.97)
        .when(F.col("profile") == "MAJOR_ALTCOIN", 0.9).otherwise(0.75).alias("confidence_factor"),
        F.when(stock | core, 1.0).when(F.col("profile") == "MAJOR_ALTCOIN", 1.5).otherwise(2.5).alias("slippage_factor"),
        F.when(~stock, F.round("median_turnover", 2)).alias("median_turnover")))


def regime_labels(frame: DataFrame, reference: DataFrame) -> DataFrame:
    """HIGH_VOL/BULL/BEAR/SIDEWAYS against the reference rows' upper volatility quartile."""
    cut = reference.groupBy("symbol").agg(F.percentile("volatility", F.lit(0.75)).alias("vol_cut"))
    gap = F.col("ma20_gap")
    return frame.join(cut, "symbol").withColumn(
        "regime", F.when(F.col("volatility") >= F.col("vol_cut"), "HIGH_VOL").when(gap > 0.005, "BULL")
        .when(gap < -0.005, "BEAR").otherwise("SIDEWAYS"))


def research_regime(frame: DataFrame, reference: DataFrame) -> DataFrame:
    """Five-way regime of research reports; LOW_VOL against the reference rows' lower quartile."""
    # One row even where no reference row has a volatility.
    cut = ranks.quantiles(reference, [], "volatility", {"vol_low": 0.25})
    trend = F.col("regime_trend")
    return frame.crossJoin(F.broadcast(cut)).withColumn(
        "research_regime", F.when(F.col("regime_high_vol") > 0.5, "HIGH_VOL").when(trend > 0.15, "BULL")
        .when(trend < -0.15, "BEAR").when(F.col("volatility") < F.col("vol_low"), "LOW_VOL").otherwise("SIDEWAYS"))
