"""Technical indicators over bar series.

Two sets share names but not formulas, so they live apart: ``chart`` (what a
chart panel shows) and ``strategy`` (what signal rules read, prefix ``sx_``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeline.functions.kernels import stop_and_reverse
from tapeline.functions.series import (KEYS, Ewm, avg_n, back, change, compose, finite, latest, max_n, min_n, numbered,
                                       quantile_n, ratio, span_alpha, std_n, sum_n, trail, upto_now)

WILDER = 1.0 / 14.0


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range() -> Column:
    prev = back("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def _ma(windows=(5, 10, 20, 60)) -> list[dict]:
    return [{f"ma{n}": avg_n(F.col("close"), n) for n in windows}]


def _macd(scale: float, prefix: str) -> list[dict]:
    return [{}, Ewm({f"{prefix}ema12": ("close", span_alpha(12)), f"{prefix}ema26": ("close", span_alpha(26))}),
            {f"{prefix}macd": F.col(f"{prefix}ema12") - F.col(f"{prefix}ema26")},
            Ewm({f"{prefix}macd_signal": (f"{prefix}macd", span_alpha(9))}),
            {f"{prefix}macd_hist": (F.col(f"{prefix}macd") - F.col(f"{prefix}macd_signal")) * scale}]


def _rsi(out: str = "rsi") -> list[dict]:
    delta = F.col("close") - back("close")
    value = 100 - 100 / (1 + ratio(F.col("_rg"), F.col("_rl")))
    return [{"_gain": F.when(delta > 0, delta).when(delta.isNotNull(), 0.0), "_loss": F.when(delta < 0, -delta).when(delta.isNotNull(), 0.0)},
            Ewm({"_rg": ("_gain", WILDER, 1), "_rl": ("_loss", WILDER, 1)}),
            {out: F.coalesce(value, F.lit(50.0))}]


def _kdj() -> list[dict]:
    low, high = min_n(F.col("low"), 9), max_n(F.col("high"), 9)
    return [{"_rsv": F.coalesce(ratio(F.col("close") - low, high - low) * 100, F.lit(50.0))},
            Ewm({"kdj_k": ("_rsv", 1 / 3)}), {}, Ewm({"kdj_d": ("kdj_k", 1 / 3)}),
            {"kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")}]


def _bollinger(prefix: str = "") -> list[dict]:
    mid, dev = avg_n(F.col("close"), 20), std_n(F.col("close"), 20)
    return [{f"{prefix}boll_mid": mid, f"{prefix}boll_upper": mid + 2 * dev, f"{prefix}boll_lower": mid - 2 * dev}]


def _atr_sma() -> list[dict]:
    return [{"tr": true_range()}, {}, {"atr": avg_n(F.col("tr"), 14)}]


def _vwap() -> list[dict]:
    w = upto_now()
    return [{"vwap": ratio(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w))}]


def _adx(out: str) -> list[dict]:
    up, down = F.col("high") - back("high"), back("low") - F.col("low")
    plus, minus = ratio(100 * F.col("_pu"), F.col("_atr")), ratio(100 * F.col("_pd"), F.col("_atr"))
    return [{"_tr": true_range(), "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
             "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)},
            Ewm({"_atr": ("_tr", WILDER), "_pu": ("_up", WILDER), "_pd": ("_dn", WILDER)}),
            {"_dx": ratio(100 * F.abs(plus - minus), plus + minus)},
            Ewm({out: ("_dx", WILDER, None)})]


def _volume() -> list[dict]:
    signed = F.coalesce(F.signum(F.col("close") - back("close")), F.lit(0.0)) * F.col("volume")
    mean = avg_n(F.col("volume"), 20)
    return [{"volume_ma20": mean, "_signed": signed, "volume_ratio": ratio(F.col("volume"), mean), "volume_change": change(F.col("volume"), 1) * 100},
            {}, {"obv": F.sum("_signed").over(upto_now())}]


def _returns(lags=(1, 3, 5)) -> list[dict]:
    return [{f"return_{n}": change(F.col("close"), n) for n in lags}]


def _volatility() -> list[dict]:
    return [{}, {}, {"volatility": std_n(F.col("return_1"), 20)}]


def moving_averages(bars: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    return compose(bars, _ma(windows))


def macd(bars: DataFrame, hist_scale: float = 2.0, prefix: str = "") -> DataFrame:
    return compose(bars, _macd(hist_scale, prefix))


def rsi(bars: DataFrame) -> DataFrame:
    """Wilder's strength index; 50 where losses are zero or unknown."""
    return compose(bars, _rsi())


def kdj(bars: DataFrame) -> DataFrame:
    return compose(bars, _kdj())


def bollinger(bars: DataFrame) -> DataFrame:
    return compose(bars, _bollinger())


def atr_sma(bars: DataFrame) -> DataFrame:
    return compose(bars, _atr_sma())


def vwap(bars: DataFrame) -> DataFrame:
    return compose(bars, _vwap())


def adx(bars: DataFrame, out: str = "adx") -> DataFrame:
    """Directional index.  DX is NULL until a first directional move; later gaps
    would need over 9,500 bars in a row without any change of high or low."""
    return compose(bars, _adx(out))


def volume_set(bars: DataFrame) -> DataFrame:
    """Volume mean and ratio, on-balance volume, volume change."""
    return compose(bars, _volume())


def returns(bars: DataFrame, lags=(1, 3, 5)) -> DataFrame:
    return compose(bars, _returns(lags))


def volatility(bars: DataFrame) -> DataFrame:
    return compose(bars, _volatility())


def chart(bars: DataFrame) -> DataFrame:
    """The whole chart set; Catalyst drops what a query does not select."""
    return compose(numbered(bars), _ma(), _macd(2.0, ""), _rsi(), _kdj(), _bollinger(), _atr_sma(), _vwap(), _adx("adx"), _volume(),
                   _returns(), _volatility())


CHART_COLUMNS = ["ma5", "ma10", "ma20", "ma60", "ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi",
                 "kdj_k", "kdj_d", "kdj_j", "boll_mid", "boll_upper", "boll_lower", "atr", "adx", "vwap", "obv",
                 "volume_change", "volume_ma20", "volume_ratio"]


def payload(charted: DataFrame, columns: list[str] = CHART_COLUMNS) -> DataFrame:
    """Series as published: finite values, eight places, half-even."""
    return charted.select(*KEYS, "ts", *[F.bround(finite(F.col(c)), 8).alias(c) for c in columns])


def indicator_score(charted: DataFrame) -> DataFrame:
    """0-100 score of the newest bar."""
    zero = F.lit(0)
    points = (F.lit(50)
              + F.when((F.col("ma20") != 0) & (F.col("close") > F.col("ma20")), 12).otherwise(zero)
              + F.when(F.col("macd") > F.col("macd_signal"), 12).otherwise(zero)
              + F.when(F.col("rsi").between(45, 65), 8).when(F.col("rsi") > 75, -8).otherwise(zero)
              + F.when(F.col("volume_change") > 10, 6).otherwise(zero))
    return latest(charted).withColumn("score", F.greatest(zero, F.least(F.lit(100), points)))


# --- strategy set -----------------------------------------------------------


def _sx_averages() -> list[dict]:
    spans = (20, 50, 100, 200)
    weighted = F.expr("aggregate(_c20, named_struct('s', 0D, 'k', 1), "
                      "(a, x) -> named_struct('s', a.s + x * a.k, 'k', a.k + 1), a -> a.s / 210)")
    return [{**{f"sx_sma{n}": avg_n(F.col("close"), n) for n in spans}, "_c20": F.collect_list("close").over(trail(20))},
            Ewm({f"sx_ema{n}": ("close", span_alpha(n)) for n in spans}),
            {"sx_wma20": F.when(F.size("_c20") == 20, weighted)}]


def _sx_atr() -> list[dict]:
    return [{"sx_tr": true_range()}, Ewm({"sx_atr": ("sx_tr", WILDER)}), {"sx_atr_percent": ratio(F.col("sx_atr"), F.col("close"))}]


def _sx_bands() -> list[dict]:
    width = F.col("sx_boll_upper") - F.col("sx_boll_lower")
    return [*_bollinger("sx_"), {}, {"sx_boll_width": ratio(width, F.col("sx_boll_mid")),
                                     "sx_boll_percent_b": ratio(F.col("close") - F.col("sx_boll_lower"), width)}]


def _sx_stochastic() -> list[dict]:
    low, high = min_n(F.col("low"), 14), max_n(F.col("high"), 14)
    return [{"sx_stoch_k": F.coalesce(ratio(100 * (F.col("close") - low), high - low), F.lit(50.0))}, {},
            {"sx_stoch_d": avg_n(F.col("sx_stoch_k"), 3)}]


def _sx_mfi() -> list[dict]:
    flow = typical() * F.greatest(F.col("volume"), F.lit(0.0))
    move = typical() - back(typical())
    value = 100 - 100 / (1 + ratio(sum_n(F.col("_pos"), 14), sum_n(F.col("_neg"), 14)))
    return [{"_pos": F.when(move > 0, flow).otherwise(0.0), "_neg": F.when(move < 0, flow).otherwise(0.0)}, {},
            {"sx_mfi": F.coalesce(value, F.lit(50.0))}]


def _sx_momentum() -> list[dict]:
    return [{"sx_roc": change(F.col("close"), 10), "sx_momentum": F.col("close") - back("close", 10)}, {},
            {"sx_acceleration": F.col("sx_roc") - back("sx_roc", 3)}]


def _sx_volume() -> list[dict]:
    signed = F.coalesce(F.signum(F.col("close") - back("close")), F.lit(0.0)) * F.greatest(F.col("volume"), F.lit(0.0))
    return [{"_ssigned": signed, "sx_volume_ratio": ratio(F.col("volume"), quantile_n(F.col("volume"), 30, 0.5))}, {},
            {"sx_obv": F.sum("_ssigned").over(upto_now())}]


def _sx_channels() -> list[dict]:
    return [{name: value for n in (20, 55, 100) for name, value in (
        (f"sx_donchian_upper_{n}", max_n(F.col("high"), n, upto=-1)), (f"sx_donchian_lower_{n}", min_n(F.col("low"), n, upto=-1)))}]


def sx_averages(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_averages())


def sx_atr(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_atr())


def sx_bands(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_bands())


def sx_stochastic(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_stochastic())


def sx_mfi(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_mfi())


def sx_momentum(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_momentum())


def sx_volume(bars: DataFrame) -> DataFrame:
    return compose(bars, _sx_volume())


def sx_channels(bars: DataFrame) -> DataFrame:
    """Donchian channels that leave out the current bar."""
    return compose(bars, _sx_channels())


def parabolic_sar(bars: DataFrame, step: float = 0.02, top: float = 0.2) -> DataFrame:
    """Parabolic stop-and-reverse: a state machine, so one small kernel per series."""
    schema = T.StructType([*bars.schema.fields, T.StructField("sx_psar", T.DoubleType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        return frame.assign(sx_psar=stop_and_reverse(frame["high"].to_numpy(float), frame["low"].to_numpy(float), step, top))

    out = bars.groupBy(*KEYS).applyInPandas(run, schema)
    return out.withColumn("sx_psar_trend", F.when(F.col("close") >= F.col("sx_psar"), 1).otherwise(-1))


def strategy(bars: DataFrame, with_sar: bool = True) -> DataFrame:
    """The whole strategy set."""
    if with_sar:
        bars = parabolic_sar(bars)
    return compose(numbered(bars), _sx_averages(), _rsi("sx_rsi"), _sx_atr(), _sx_bands(), _sx_stochastic(), _sx_mfi(), _sx_momentum(),
                   _sx_volume(), _sx_channels(), _macd(1.0, "sx_"), _adx("sx_adx"), _vwap(), _returns((1,)), _volatility())
