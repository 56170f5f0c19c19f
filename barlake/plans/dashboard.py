"""Per-symbol overview: latest bar, indicator sentences, layer counts, latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.indicators import describe
from barlake.operators.select import latest, latest_change
from barlake.plans.series import tail_n


def overview(history: DataFrame, counts: DataFrame, runs: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per symbol.

    `history` has the indicator columns, `counts` is (layer, symbol, record_count), `runs` maps a name to
    a run table with (symbol, created_at, …); its latest row becomes the struct `latest_<name>`.
    """
    last = latest_change(history).withColumns(describe()).select(
        "symbol", "timestamp", F.col("close").alias("current_price"), "change_pct", "volume",
        F.col("rsi_14").alias("rsi"), "trend", "momentum", "volatility",
    )
    layers = counts.groupBy("symbol").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("layer") == name, F.col("record_count"))), F.lit(0)).alias(f"{name}_count")
            for name in ("bronze", "silver", "gold")
        ]
    )
    out = last.join(layers, "symbol", "left")
    for name, table in (runs or {}).items():
        newest = latest(table, ("symbol",), "created_at")
        rest = [c for c in newest.columns if c != "symbol"]
        out = out.join(newest.select("symbol", F.struct(*rest).alias(f"latest_{name}")), "symbol", "left")
    return out


def candles(history: DataFrame, limit: int = 250) -> DataFrame:
    """The bars a chart shows."""
    return tail_n(history, limit).select("symbol", "timestamp", "open", "high", "low", "close", "volume")
