"""Price, target, regime, macro, sector and index features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.plans.quantile import exact_quantile
from barlake.plans.running import running_quantile
from barlake.plans.series import POS, TOTAL, Blocks, as_of, series

# Macro inputs used where no macro table is given.
MACRO_DEFAULTS = {"usd_vnd": 25000.0, "gold_usd_oz": 2000.0, "wti_usd_barrel": 80.0}

# Numeric code of each market regime.
REGIME_CODES = {"bull_low_vol": 1, "bull_high_vol": 2, "neutral": 0, "bear_low_vol": -1, "bear_high_vol": -2}


def change(b: Blocks, column: str) -> Column:
    """Relative change against the previous row; null on a zero base."""
    return F.try_divide(F.col(column), b.lag(column)) - 1


def add_price_features(b: Blocks) -> Blocks:
    """Returns, rolling statistics and lags; needs 22 rows in front."""
    b = b.add_rolling(
        {
            "rolling_min_20": (F.min, "close", 20),
            "rolling_max_20": (F.max, "close", 20),
            "volume_ma_20": (F.avg, "volume", 20),
        },
        {"close_lag_1": b.lag("close"), "close_lag_2": b.lag("close", 2), "volume_lag_1": b.lag("volume")},
    )
    ratio = F.try_divide("close", "close_lag_1")
    b = b.add(
        {
            "return": ratio - 1,
            "log_return": F.when(ratio > 0, F.ln(ratio)),
            "price_change": F.col("close") - F.col("close_lag_1"),
            "volume_change": F.try_divide("volume", "volume_lag_1") - 1,
        }
    )
    return b.add_rolling({"rolling_std_20": (F.stddev_samp, "return", 20)}, {"return_lag_1": b.lag("return")})


def add_target_features(b: Blocks) -> Blocks:
    """Next close, next return and its direction; needs one row behind."""
    b = b.add({"target_close_next": b.lead("close")})
    step = F.try_divide("target_close_next", "close") - 1
    return b.add(
        {
            "target_return_next": step,
            "target_direction_next": F.when(step > 0, 1).when(step.isNotNull(), 0),
        }
    )


def add_declared_ratios(b: Blocks) -> Blocks:
    """volume_ratio, price_range and the five-bar forward return; needs 20 in front, 5 behind."""
    return b.add(
        {
            "volume_ratio": F.try_divide(F.col("volume"), b.rolling(F.avg, "volume", 20)),
            "price_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
            "return_5d": F.try_divide(b.lead("close", 5), F.col("close")) - 1,
        }
    )


def add_regime_inputs(b: Blocks, lookback: int = 20) -> Blocks:
    """Row-level inputs of the regime columns; series shorter than `lookback` stay null."""
    enough = F.col(TOTAL) >= lookback
    have = set(b.df.columns)

    def known(column: str, otherwise: Column) -> Column:
        """A column that an earlier step has already computed, or the expression for it."""
        return F.col(column) if column in have else otherwise

    b = b.add({"returns": F.when(enough, known("return", change(b, "close")))})
    # Only series of fewer than 50 rows use it; those lie in one block, so the running mean is the whole mean.
    short_mean = F.when(F.col(POS) == F.col(TOTAL) - 1, F.avg("close").over(b.running()))
    long_mean = known("sma_50", b.rolling(F.avg, "close", 50))
    inputs = {
        "volatility_20d": F.when(enough, known("rolling_std_20", b.rolling(F.stddev_samp, "returns", lookback)))
        if lookback == 20
        else b.rolling(F.stddev_samp, "returns", lookback),
        "sma_20": known("sma_20", b.rolling(F.avg, "close", 20)),
        "sma_50": F.when(F.col(TOTAL) >= 50, long_mean).when(enough, short_mean),
        "volume_ma20": F.when(
            enough, known("volume_ma_20", b.rolling(F.avg, "volume", 20)) if lookback == 20 else b.rolling(F.avg, "volume", lookback)
        ),
        "_enough": enough,
    }
    return b.add(inputs)


def add_regime(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """Regime flags and labels; `threshold` holds the volatility quantile (`quantile`) per symbol, or per symbol and time."""
    enough = F.col("_enough")
    flag = lambda c: F.when(enough, F.coalesce(c, F.lit(False)))
    close, sma20, sma50 = F.col("close"), F.col("sma_20"), F.col("sma_50")
    on = [c for c in threshold.columns if c != "quantile"]
    rows = rows.join(threshold.withColumnRenamed("quantile", "_q75"), on, "left").withColumns(
        {
            "volatility_actual": flag(F.col("volatility_20d") > F.col("_q75")),
            "trend_bull": flag(close > sma20),
            "trend_strong": flag((close > sma20) & (sma20 > sma50)),
            "volume_spike": flag(F.col("volume") > F.col("volume_ma20") * 1.5),
        }
    )
    high = F.col("volatility_actual")
    regime = (
        F.when(~enough, F.lit(None))
        .when(~F.col("trend_bull") & high, "bear_high_vol")
        .when(~F.col("trend_bull"), "bear_low_vol")
        .when(F.col("trend_strong") & high, "bull_high_vol")
        .when(F.col("trend_strong"), "bull_low_vol")
        .otherwise("neutral")
    )
    code = F.create_map(*[F.lit(x) for pair in REGIME_CODES.items() for x in pair])
    return rows.withColumn("regime", regime).withColumn("regime_numeric", code[F.col("regime")]).drop("_q75", "_enough")


def volatility_threshold(rows: DataFrame) -> DataFrame:
    return exact_quantile(rows, "volatility_20d", 0.75)


def market_regime(bars: DataFrame, lookback: int = 20, mode: str = "full_sample", **cut) -> DataFrame:
    """Regime columns of all symbols.

    The volatility threshold is the 0.75 quantile of the full sample, which looks ahead, or with mode="expanding" that
    of the bars up to each bar.
    """
    rows = add_regime_inputs(series(bars, before=max(lookback + 1, 50), **cut), lookback).rows()
    if mode == "full_sample":
        return add_regime(rows, volatility_threshold(rows))
    if mode != "expanding":
        raise ValueError(f"unknown mode {mode}")
    return add_regime(rows, running_quantile(rows, "volatility_20d", 0.75, bucket=cut.get("bucket", "day")))


def add_macro(bars: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """Macro columns: newest published value not after the bar, or the fixed defaults."""
    names = list(MACRO_DEFAULTS)
    if macro is None:
        bars = bars.withColumns({n: F.lit(v) for n, v in MACRO_DEFAULTS.items()})
    else:
        bars = as_of(bars, macro.select("timestamp", *names), names)
        bars = bars.withColumn("fx_adjusted_close", F.try_divide("close", "usd_vnd") * 10000)
    return bars.withColumn("macro_normalized", F.try_divide("close", "usd_vnd") * 1000)


def add_sector(bars: DataFrame, sector_of: DataFrame, sector: DataFrame) -> DataFrame:
    """Sector performance and momentum of the bar's month."""
    keyed = bars.withColumn("year_month", F.date_format("timestamp", "yyyy-MM")).join(sector_of, "symbol", "left")
    return keyed.join(sector, ["sector", "year_month"], "left")


def sector_months(bars: DataFrame, sector_of: DataFrame) -> DataFrame:
    """Sector performance (last/first close - 1) and momentum (mean of both) per month."""
    month = F.date_format("timestamp", "yyyy-MM").alias("year_month")
    order = F.struct("timestamp", "symbol")
    ends = bars.join(sector_of, "symbol").groupBy("sector", month).agg(
        F.min_by("close", order).alias("first"), F.max_by("close", order).alias("last")
    )
    return ends.select(
        "sector",
        "year_month",
        (F.try_divide("last", "first") - 1).alias("sector_performance"),
        (F.col("last") - F.col("first")).alias("sector_momentum"),
    )


def add_index(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Index close and returns at the bar's time."""
    side = index.select("timestamp", F.col("close").alias("index_close"), F.col("returns").alias("market_returns"))
    return bars.join(side, "timestamp", "left")


def index_correlation(bars: DataFrame, index: DataFrame, n: int = 20, **cut) -> DataFrame:
    """Rolling correlation with, and beta against, the index returns."""
    b = series(add_index(bars, index), before=n + 1, **cut)
    b = b.add({"returns": change(b, "close")})
    both = F.col("returns").isNotNull() & F.col("market_returns").isNotNull()
    full = F.count(F.when(both, 1)).over(b.trailing(n)) >= n
    over = b.trailing(n)
    spread = F.var_samp("market_returns").over(over)
    moving = F.stddev_samp("returns").over(over)
    return b.add(
        {
            "correlation_20d": F.when(
                full & (spread > 0) & (moving > 0), F.corr("returns", "market_returns").over(over)
            ),
            "beta_20d": F.when(full, F.try_divide(F.covar_samp("returns", "market_returns").over(over), spread)),
        }
    ).rows()
