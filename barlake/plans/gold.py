"""Gold: indicator, price, target, regime and macro columns of all symbols in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.features import (
    MACRO_DEFAULTS,
    add_macro,
    add_price_features,
    add_regime,
    add_regime_inputs,
    add_target_features,
    volatility_threshold,
)
from barlake.operators.indicators import add_indicators, halo
from barlake.plans.materialize import materialize
from barlake.plans.series import HELPERS, TOTAL, series

REQUIRED = {"symbol", "timestamp", "open", "high", "low", "close", "volume"}


def gold_rows(bars: DataFrame, lengths: Mapping[str, tuple] | None = None, **cut) -> DataFrame:
    """All columns that need only neighbouring bars: one shuffle by (symbol, block)."""
    missing = REQUIRED - set(bars.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    b = series(bars, before=max(halo(lengths), 51), after=1, **cut)
    b = add_indicators(b, lengths)
    b = add_price_features(b)
    b = add_target_features(b)
    return add_regime_inputs(b).core().df


def gold(
    bars: DataFrame,
    lengths: Mapping[str, tuple] | None = None,
    macro: DataFrame | None = None,
    include_macro: bool = True,
    rows: DataFrame | None = None,
    store: bool = False,
    **cut,
) -> DataFrame:
    """Feature and target table. `rows` may hold `gold_rows` already written to storage.

    The regime threshold reads the volatility column twice; with `store` that column is written once
    (see `materialize`) instead of being computed again.
    """
    rows = gold_rows(bars, lengths, **cut) if rows is None else rows
    volatility = rows.select("symbol", "volatility_20d")
    out = add_regime(rows, volatility_threshold(materialize(volatility, "volatility") if store else volatility))
    if include_macro:
        long_enough = F.col(TOTAL) > 50
        out = add_macro(out, macro)
        added = [*MACRO_DEFAULTS, "macro_normalized", *(["fx_adjusted_close"] if macro is not None else [])]
        out = out.withColumns({c: F.when(long_enough, F.col(c)) for c in added})
    return out.drop(*HELPERS)


def drop_warmup(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose features are all present."""
    return frame.dropna(subset=columns)
