"""Table schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Bar lengths in minutes, horizons in minutes, horizons in daily bars.
INTERVAL_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}
HORIZON_MINUTES = {"1H": 60, "4H": 240, "1D": 1440, "7D": 10080, "T+5": 7200, "T+20": 28800}
SETTLEMENT_STEPS = {"1D": 1, "T+1": 1, "5D": 5, "T+5": 5, "20D": 20, "T+20": 20, "7D": 7}
SETTLEMENT_MINUTES = {"1H": 60, "4H": 240, "24H": 1440, "1D": 1440, "7D": 10080}
MARKET_COSTS = {
    "CN": {"commission": 0.0003, "stamp_duty_sell": 0.0005, "slippage": 0.0005},
    "US": {"commission": 0.0001, "stamp_duty_sell": 0.0, "slippage": 0.0005},
    "CRYPTO": {"commission": 0.0006, "stamp_duty_sell": 0.0, "slippage": 0.0005},
}

FEATURE_GROUPS = {
    "price": ["return_1", "return_3", "return_5", "return_10", "return_20", "log_return", "gap",
              "high_low_range", "close_open", "true_range", "realized_volatility", "historical_volatility",
              "high_position_20", "high_position_60", "high_position_120"],
    "technical": ["rsi", "rsi_slope", "macd", "macd_signal", "macd_hist", "macd_slope", "atr", "adx",
                  "cci", "stoch_k", "williams_r", "roc", "mfi", "boll_position", "boll_width",
                  "ema5_gap", "ema10_gap", "ma20_gap", "ema50_gap", "ema100_gap", "ema200_gap", "ema20_slope"],
    "volume": ["volume_change", "volume_ratio", "volume_zscore", "relative_volume", "obv_change",
               "money_flow", "price_volume_corr", "vwap_deviation", "volume_trend", "volume_divergence",
               "abnormal_volume", "flow_pressure"],
    "structure": ["causal_bos", "fvg_imbalance", "fib_0618_distance"],
    "regime": ["volatility", "regime_trend", "regime_high_vol", "regime_risk_on", "sentiment_score"],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]

TRADES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("px", T.DoubleType()),
    T.StructField("sz", T.DoubleType()),
    T.StructField("side", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
])

NEWS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("collected_at", T.TimestampType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("sectors", T.ArrayType(T.StringType())),
])
