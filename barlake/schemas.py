"""Fixed schemas of the bar, news, fundamentals, order-book and run tables."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("ingestion_time", T.TimestampType()),
    ]
)
BAR_COLUMNS = [f.name for f in BAR.fields]
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]

NEWS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_date", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("ingestion_time", T.TimestampType()),
    ]
)

LEVEL = T.StructType(
    [
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("orders", T.LongType()),
    ]
)

# Model and report columns that callers rely on by name.
FUNDAMENTAL_METRICS = [
    "market_cap", "pe_ratio", "pb_ratio", "ps_ratio", "peg_ratio", "ev_ebitda", "dividend_yield",
    "roe", "roa", "roic", "gross_margin", "operating_margin", "net_margin",
    "revenue_growth_yoy", "profit_growth_yoy", "eps_growth_yoy",
    "debt_equity", "current_ratio", "quick_ratio", "eps", "bvps", "dps",
]
FORECAST_FEATURES = [
    "close", "volume", "return", "sma_5", "sma_10", "sma_20", "sma_50", "ema_12", "ema_26",
    "rsi_14", "macd", "macd_signal", "macd_hist", "bb_middle", "bb_upper", "bb_lower",
    "rolling_std_20", "close_lag_1", "close_lag_2", "return_lag_1", "volume_lag_1",
]
INTERVALS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}
BARS_PER_YEAR = {"1d": 252.0, "1h": 252 * 6.5, "15m": 252 * 26.0, "5m": 252 * 78.0}
