"""Resampling, indicators and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog import sqlparts
from barlake.catalog.base import query
from barlake.catalog.sqlparts import roll, windows
from barlake.operators import features, indicators
from barlake.operators.indicators import SENTENCES
from barlake.operators.resample import resample, ticks_to_bars
from barlake.plans.gold import gold
from barlake.plans.series import series
from barlake.plans.views import NEEDS, SQL

_RESAMPLE = "symbol interval timestamp:t open:4 high:4 low:4 close:4 volume:i"


@query(
    "a_resample",
    _RESAMPLE,
    " UNION ALL ".join(
        f"""SELECT symbol, '{name}' AS interval, time_bucket(INTERVAL '{width}', timestamp, TIMESTAMP '1970-01-01') AS timestamp,
        min_by(price, row(timestamp, tick_id)) AS open, max(price) AS high, min(price) AS low,
        max_by(price, row(timestamp, tick_id)) AS close, count(*) AS volume FROM ticks GROUP BY ALL"""
        for name, width in (("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour"), ("1d", "1 day"))
    ).replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
    "ticks",
)
def a_resample(t):
    return resample(ticks_to_bars(t.ticks))


@query("o_pq", "symbol timestamp:t open:4 high:4 low:4 close:4 volume:i", "SELECT * FROM f1", "f1")
def o_pq(t):
    return t.f1


@query(
    "f_interval",
    "symbol interval bucket bars_per_year:2 timestamp:t",
    """SELECT symbol, interval, timestamp, CASE interval WHEN '5m' THEN '5 minutes' WHEN '15m' THEN '15 minutes'
       WHEN '1h' THEN '1 hour' ELSE '1 day' END AS bucket, CASE interval WHEN '5m' THEN 19656.0 WHEN '15m' THEN 6552.0
       WHEN '1h' THEN 1638.0 ELSE 252.0 END AS bars_per_year
       FROM f1, (VALUES ('5m'), ('15m'), ('1h'), ('1d')) AS i(interval)""",
    "f1",
)
def f_interval(t):
    from barlake.functions.calendar import bars_per_year, bucket_width
    from barlake.schemas import INTERVALS

    each = F.explode(F.array(*map(F.lit, INTERVALS))).alias("interval")
    rows = t.f1.select("symbol", "timestamp", each)
    return rows.withColumns({"bucket": bucket_width("interval"), "bars_per_year": bars_per_year("interval")})


@query(
    "w_sma",
    "symbol timestamp:t sma_5:6 sma_10:6 sma_20:6 sma_50:6",
    f"SELECT symbol, timestamp, {', '.join(roll('avg', 'close', n, f'sma_{n}') for n in (5, 10, 20, 50))} FROM f1 {windows()}",
    "f1",
)
def w_sma(t):
    return indicators.add_sma(series(t.f1, before=50), (5, 10, 20, 50)).rows()


@query("w_ema", "symbol timestamp:t ema_12:6 ema_26:6", "SELECT * FROM f1ind", "f1ind")
def w_ema(t):
    return indicators.indicators(t.f1, families=["ema"])


@query("w_rsi", "symbol timestamp:t rsi_14:6", "SELECT * FROM f1ind", "f1ind")
def w_rsi(t):
    return indicators.indicators(t.f1, families=["rsi"])


@query("w_macd", "symbol timestamp:t macd:6 macd_signal:6 macd_hist:6", "SELECT * FROM f1ind", "f1ind")
def w_macd(t):
    return indicators.indicators(t.f1, families=["macd"])


@query("w_bb", "symbol timestamp:t bb_middle:6 bb_upper:6 bb_lower:6", "SELECT * FROM f1ind", "f1ind")
def w_bb(t):
    return indicators.indicators(t.f1, families=["bollinger"])


_IND = (
    "sma_5:6 sma_10:6 sma_20:6 sma_50:6 ema_12:6 ema_26:6 rsi_14:6 macd:6 macd_signal:6 macd_hist:6 "
    "bb_middle:6 bb_upper:6 bb_lower:6"
)


@query("w_allind", f"symbol timestamp:t close:4 {_IND}", "SELECT * FROM f1ind", "f1ind")
def w_allind(t):
    return indicators.indicators(t.f1)


@query("p_family", "symbol timestamp:t sma_8:6 rsi_14:6", f"SELECT *, {roll('avg', 'close', 8, 'sma_8')} FROM f1ind {windows()}", "f1ind")
def p_family(t):
    return indicators.indicators(t.f1, {"sma": (8,)}, ["sma", "rsi"])


def _priced(t):
    return features.add_price_features(series(t.f1, before=22)).rows()


for _key, _spec in {
    "w_ret": "return:8 price_change:6 volume_change:8",
    "w_logret": "log_return:8",
    "w_rstd": "rolling_std_20:8",
    "w_rminmax": "rolling_min_20:6 rolling_max_20:6",
    "w_vma": "volume_ma_20:6",
    "w_lag": "close_lag_1:4 close_lag_2:4 return_lag_1:8 volume_lag_1:4",
}.items():
    query(_key, f"symbol timestamp:t {_spec}", "SELECT * FROM f1feat", "f1feat")(_priced)


@query(
    "w_target",
    "symbol timestamp:t target_close_next:4 target_return_next:8 target_direction_next:i",
    "SELECT * FROM f1feat",
    "f1feat",
)
def w_target(t):
    return features.add_target_features(series(t.f1, after=1)).rows()


@query(
    "f_volratio",
    "symbol timestamp:t volume_ratio:6 price_range:6 return_5d:6",
    f"""SELECT symbol, timestamp, volume / {roll('avg', 'volume', 20)} AS volume_ratio, (high - low) / close AS price_range,
        lead(close, 5) OVER w / close - 1 AS return_5d FROM f1 {windows()}""",
    "f1",
)
def f_volratio(t):
    return features.add_declared_ratios(series(t.f1, before=20, after=5)).rows()


@query("a_quant", "symbol quantile:8", "SELECT symbol, q75 AS quantile FROM f1q", "f1q")
def a_quant(t):
    rows = features.add_regime_inputs(series(t.f1, before=50)).rows()
    return features.volatility_threshold(rows)


_REG = (
    "returns:8 volatility_20d:8 volatility_actual sma_20:6 sma_50:6 trend_bull trend_strong volume_ma20:6 volume_spike "
    "regime regime_numeric:i"
)


@query("w_regime", f"symbol timestamp:t {_REG}", "SELECT * FROM f1reg", "f1reg")
def w_regime(t):
    return features.market_regime(t.f1)


@query(
    "w_regime_expanding",
    "symbol timestamp:t volatility_actual regime",
    """SELECT symbol, timestamp, CASE WHEN volatility_actual IS NOT NULL THEN coalesce(volatility_20d > q, false) END AS volatility_actual,
       CASE WHEN volatility_actual IS NULL THEN NULL WHEN NOT trend_bull AND volatility_20d > q THEN 'bear_high_vol' WHEN NOT trend_bull THEN 'bear_low_vol'
       WHEN trend_strong AND volatility_20d > q THEN 'bull_high_vol' WHEN trend_strong THEN 'bull_low_vol' ELSE 'neutral' END AS regime
       FROM (SELECT *, quantile_cont(volatility_20d, 0.75) OVER (PARTITION BY symbol ORDER BY timestamp) AS q FROM f1reg)""",
    "f1reg",
)
def w_regime_expanding(t):
    """The threshold of each bar is the quantile of the bars up to it."""
    return features.market_regime(t.f1, mode="expanding")


@query(
    "j_macro_gaps",
    "symbol timestamp:t usd_vnd:2 gold_usd_oz:2",
    """SELECT symbol, b.timestamp, usd_vnd, gold_usd_oz FROM f2 b ASOF LEFT JOIN (
       SELECT timestamp, last_value(u IGNORE NULLS) OVER w AS usd_vnd, last_value(g IGNORE NULLS) OVER w AS gold_usd_oz FROM (
       SELECT timestamp, CASE WHEN month(timestamp) % 3 <> 0 THEN usd_vnd END AS u, CASE WHEN month(timestamp) % 2 = 0 THEN gold_usd_oz END AS g FROM macro)
       WINDOW w AS (ORDER BY timestamp)) m ON b.timestamp >= m.timestamp""",
    "f2 macro",
)
def j_macro_gaps(t):
    """Macro rows with gaps: a missing newest value takes the one before it."""
    month = F.month("timestamp")
    gaps = t.macro.withColumns({"usd_vnd": F.when(month % 3 != 0, F.col("usd_vnd")), "gold_usd_oz": F.when(month % 2 == 0, F.col("gold_usd_oz"))})
    return features.add_macro(t.f2, gaps)


@query(
    "j_macro",
    "symbol timestamp:t usd_vnd:2 gold_usd_oz:2 wti_usd_barrel:2 fx_adjusted_close:4 macro_normalized:4",
    """SELECT symbol, b.timestamp, usd_vnd, gold_usd_oz, wti_usd_barrel, close / usd_vnd * 10000 AS fx_adjusted_close,
       close / usd_vnd * 1000 AS macro_normalized FROM f2 b ASOF LEFT JOIN macro m ON b.timestamp >= m.timestamp""",
    "f2 macro",
)
def j_macro(t):
    return features.add_macro(t.f2, t.macro)


@query(
    "j_sector",
    "symbol timestamp:t close:2 sector sector_performance:6 sector_momentum:2",
    """SELECT b.symbol, b.timestamp, close, s.sector, last / first - 1 AS sector_performance,
       last - first AS sector_momentum FROM f2 b JOIN sector_of s USING (symbol) LEFT JOIN (
       SELECT sector, strftime(timestamp, '%Y-%m') AS ym, min_by(close, row(timestamp, symbol)) AS first,
       max_by(close, row(timestamp, symbol)) AS last FROM f2 JOIN sector_of USING (symbol) GROUP BY ALL) m
       ON m.sector = s.sector AND m.ym = strftime(b.timestamp, '%Y-%m')""",
    "f2 sector_of",
)
def j_sector(t):
    return features.add_sector(t.f2, t.sector_of, features.sector_months(t.f2, t.sector_of))


@query(
    "j_index",
    "symbol timestamp:t index_close:2 market_returns:8",
    "SELECT symbol, b.timestamp, i.close AS index_close, i.returns AS market_returns FROM f2 b LEFT JOIN idx i USING (timestamp)",
    "f2 idx",
)
def j_index(t):
    return features.add_index(t.f2, t.index)


_CORR = f"""SELECT symbol, timestamp, CASE WHEN count(r * m) OVER w20 >= 20 THEN corr(r, m) OVER w20 END AS correlation_20d,
    CASE WHEN count(r * m) OVER w20 >= 20 THEN covar_samp(r, m) OVER w20 / var_samp(m) OVER w20 END AS beta_20d
    FROM (SELECT symbol, b.timestamp, b.close / lag(b.close) OVER (PARTITION BY symbol ORDER BY b.timestamp) - 1 AS r,
    i.returns AS m FROM f2 b LEFT JOIN idx i USING (timestamp)) {windows()}"""


def _correlated(t):
    return features.index_correlation(t.f2, t.index)


query("w_corr", "symbol timestamp:t correlation_20d:6", _CORR, "f2 idx")(_correlated)
query("w_beta", "symbol timestamp:t beta_20d:6", _CORR, "f2 idx")(_correlated)


_GOLD = (
    f"symbol timestamp:t open:4 high:4 low:4 close:4 volume:4 {_IND} return:8 log_return:8 price_change:6 volume_change:8 "
    "rolling_std_20:8 rolling_min_20:4 rolling_max_20:4 volume_ma_20:6 close_lag_1:4 close_lag_2:4 return_lag_1:8 "
    "volume_lag_1:4 target_close_next:4 target_return_next:8 target_direction_next:i returns:8 volatility_20d:8 "
    "volatility_actual trend_bull trend_strong volume_ma20:6 volume_spike regime regime_numeric:i usd_vnd:2 "
    "gold_usd_oz:2 wti_usd_barrel:2 macro_normalized:6"
)


@query(
    "o_gld",
    _GOLD,
    """SELECT i.*, f.* EXCLUDE (symbol, timestamp, open, high, low, close, volume, rn, n),
       r.* EXCLUDE (symbol, timestamp, open, high, low, close, volume, rn, n, sma_20, sma_50),
       25000.0 AS usd_vnd, 2000.0 AS gold_usd_oz, 80.0 AS wti_usd_barrel, i.close / 25000 * 1000 AS macro_normalized
       FROM f1ind i JOIN f1feat f USING (symbol, timestamp) JOIN f1reg r USING (symbol, timestamp)""",
    "f1ind f1feat f1reg",
)
def o_gld(t):
    return gold(t.f1)


_SAY = {name: f"'{text}'" for name, text in SENTENCES.items()}
SQL["described"] = f"""SELECT *, CASE WHEN sma_20 IS NULL OR sma_50 IS NULL THEN {_SAY['none']}
       WHEN close > sma_20 AND sma_20 > sma_50 THEN {_SAY['up']}
       WHEN close < sma_20 AND sma_20 < sma_50 THEN {_SAY['down']}
       ELSE {_SAY['mixed']} END AS trend,
       CASE WHEN rsi_14 IS NULL THEN {_SAY['none']}
       WHEN rsi_14 >= 70 THEN printf({_SAY['elevated']}, rsi_14)
       WHEN rsi_14 <= 30 THEN printf({_SAY['depressed']}, rsi_14)
       ELSE printf({_SAY['middle']}, rsi_14) END AS momentum,
       CASE WHEN bb_upper IS NULL THEN {_SAY['none']}
       WHEN close > bb_upper THEN {_SAY['over']}
       WHEN close < bb_lower THEN {_SAY['under']}
       ELSE printf({_SAY['inside']}, bb_upper - bb_lower) END AS volatility
       FROM f1ind"""
NEEDS["described"] = [*NEEDS["f1ind"], "f1ind"]


@query("f_desc", "symbol timestamp:t trend momentum volatility", "SELECT * FROM described", "described")
def f_desc(t):
    rows = indicators.indicators(t.f1, families=["sma", "rsi", "bollinger"])
    return rows.withColumns(indicators.describe())


@query(
    "f_math",
    "symbol timestamp:t ln_close:6 root:6 distance:6 direction:i clipped:6",
    """SELECT symbol, timestamp, ln(close) AS ln_close, sqrt(volume) AS root, abs(close - open) AS distance,
       sign(close - open) AS direction, greatest(least(close, 300), 100) AS clipped FROM f1""",
    "f1",
)
def f_math(t):
    gap = F.col("close") - F.col("open")
    return t.f1.select(
        "symbol",
        "timestamp",
        F.ln("close").alias("ln_close"),
        F.sqrt("volume").alias("root"),
        F.abs(gap).alias("distance"),
        F.signum(gap).alias("direction"),
        F.greatest(F.least("close", F.lit(300.0)), F.lit(100.0)).alias("clipped"),
    )


@query(
    "w_seq",
    "symbol timestamp:t first_close:4 last_close:4 length:i target:4",
    """SELECT symbol, timestamp, lag(close, 29) OVER w AS first_close, close AS last_close, 30 AS length,
       lead(close) OVER w AS target FROM f1n WHERE rn >= 0 WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)
       QUALIFY rn >= 29 AND rn < n - 1""",
    "f1n",
)
def w_seq(t):
    from barlake.operators.forecast import sequences

    rows = sequences(t.f1, ["close", "volume"], "target_close_next", 30)
    return rows.select(
        "symbol",
        "timestamp",
        F.element_at("sequence", 1)["close"].alias("first_close"),
        F.element_at("sequence", -1)["close"].alias("last_close"),
        F.size("sequence").alias("length"),
        F.col("target_close_next").alias("target"),
    )


@query(
    "q_dash",
    "symbol timestamp:t current_price:4 change_pct:6 volume:2 rsi:6 trend momentum volatility bronze_count:i silver_count:i gold_count:i",
    """SELECT symbol, timestamp, close AS current_price, (close - p) / p AS change_pct, volume, rsi_14 AS rsi, trend, momentum,
       volatility, n AS bronze_count, n AS silver_count, n AS gold_count FROM (SELECT *, lag(close) OVER
       (PARTITION BY symbol ORDER BY timestamp) AS p FROM described) WHERE rn = n - 1""",
    "described",
)
def q_dash(t):
    from barlake.plans.dashboard import overview
    from barlake.sources.tables import layer_counts

    rows = indicators.indicators(t.f1, families=["sma", "rsi", "bollinger"])
    return overview(rows, layer_counts({"bronze": t.f1, "silver": t.f1, "gold": t.f1}))
