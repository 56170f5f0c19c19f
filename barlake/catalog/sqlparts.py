"""SQL text shared by the checks of ordered-series queries."""

from __future__ import annotations

from barlake.plans.views import NEEDS, SQL

FRAMES = (2, 3, 5, 8, 10, 20, 50)


def windows(extra: str = "") -> str:
    w = "PARTITION BY symbol ORDER BY timestamp"
    named = [f"w AS ({w})"] + [f"w{n} AS ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in FRAMES]
    return "WINDOW " + ", ".join(named) + extra


def roll(fn: str, column: str, n: int, alias: str | None = None) -> str:
    text = f"CASE WHEN count({column}) OVER w{n} >= {n} THEN {fn}({column}) OVER w{n} END"
    return f"{text} AS {alias}" if alias else text


def _state(src: str) -> str:
    a = lambda n: f"CAST({2 / (n + 1)!r} AS DOUBLE)"
    step = lambda name, x, alpha: f"(1 - {alpha}) * s.{name} + {alpha} * {x}"
    r = f"CAST({1 / 14!r} AS DOUBLE)"
    gain, loss = "greatest(b.close - s.c, 0)", "greatest(s.c - b.close, 0)"
    line = f"(({step('e12', 'b.close', a(12))}) - ({step('e26', 'b.close', a(26))}))"
    return f"""SELECT symbol, timestamp, rn, close AS c, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS g,
        CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS sig FROM {src}n WHERE rn = 0
        UNION ALL SELECT b.symbol, b.timestamp, b.rn, b.close, {step('e12', 'b.close', a(12))},
        {step('e26', 'b.close', a(26))},
        CASE WHEN b.rn = 1 THEN {gain} ELSE {step('g', gain, r)} END,
        CASE WHEN b.rn = 1 THEN {loss} ELSE {step('l', loss, r)} END,
        CASE WHEN b.rn = 25 THEN {line} WHEN b.rn > 25 THEN {step('sig', line, a(9))} END
        FROM {src}st s JOIN {src}n b ON b.symbol = s.symbol AND b.rn = s.rn + 1"""


def _indicators(src: str) -> str:
    return f"""SELECT b.*, {', '.join(roll('avg', 'b.close', n, f'sma_{n}') for n in (5, 10, 20, 50))},
        CASE WHEN b.rn >= 11 THEN e12 END AS ema_12, CASE WHEN b.rn >= 25 THEN e26 END AS ema_26,
        CASE WHEN b.rn < 14 THEN NULL WHEN l = 0 AND g > 0 THEN 100 WHEN g = 0 AND l > 0 THEN 0
             WHEN l <> 0 THEN 100 - 100 / (1 + g / l) END AS rsi_14,
        CASE WHEN b.rn >= 25 THEN e12 - e26 END AS macd, CASE WHEN b.rn >= 33 THEN sig END AS macd_signal,
        CASE WHEN b.rn >= 33 THEN e12 - e26 - sig END AS macd_hist,
        {roll('avg', 'b.close', 20, 'bb_middle')},
        {roll('avg', 'b.close', 20)} + 2 * {roll('stddev_samp', 'b.close', 20)} AS bb_upper,
        {roll('avg', 'b.close', 20)} - 2 * {roll('stddev_samp', 'b.close', 20)} AS bb_lower
        FROM {src}n b JOIN {src}st s ON b.symbol = s.symbol AND b.rn = s.rn
        {windows().replace('PARTITION BY symbol ORDER BY timestamp', 'PARTITION BY b.symbol ORDER BY b.rn')}"""


def _features(src: str) -> str:
    return f"""SELECT *, {roll('stddev_samp', '"return"', 20, 'rolling_std_20')}, lag("return") OVER w AS return_lag_1,
        target_return AS target_return_next,
        CASE WHEN target_return > 0 THEN 1 WHEN target_return IS NOT NULL THEN 0 END AS target_direction_next
        FROM (SELECT *, close / lag(close) OVER w - 1 AS "return", ln(close / lag(close) OVER w) AS log_return,
          close - lag(close) OVER w AS price_change, volume / lag(volume) OVER w - 1 AS volume_change,
          {roll('min', 'close', 20, 'rolling_min_20')}, {roll('max', 'close', 20, 'rolling_max_20')},
          {roll('avg', 'volume', 20, 'volume_ma_20')}, lag(close) OVER w AS close_lag_1,
          lag(close, 2) OVER w AS close_lag_2, lag(volume) OVER w AS volume_lag_1,
          lead(close) OVER w AS target_close_next, lead(close) OVER w / close - 1 AS target_return
          FROM {src}n {windows()}) {windows()}"""


def _regime(src: str) -> str:
    return f"""SELECT *, CASE WHEN NOT trend_bull AND volatility_actual THEN 'bear_high_vol'
          WHEN NOT trend_bull THEN 'bear_low_vol' WHEN trend_strong AND volatility_actual THEN 'bull_high_vol'
          WHEN trend_strong THEN 'bull_low_vol' ELSE 'neutral' END AS regime,
        CASE WHEN NOT trend_bull AND volatility_actual THEN -2 WHEN NOT trend_bull THEN -1
          WHEN trend_strong AND volatility_actual THEN 2 WHEN trend_strong THEN 1 ELSE 0 END AS regime_numeric
        FROM (SELECT v.*, q75, coalesce(volatility_20d > q75, false) AS volatility_actual,
          coalesce(close > sma_20, false) AS trend_bull,
          coalesce(close > sma_20 AND sma_20 > sma_50, false) AS trend_strong,
          coalesce(volume > volume_ma20 * 1.5, false) AS volume_spike
          FROM {src}vol v JOIN {src}q q ON q.symbol = v.symbol)"""


for src in ("f1", "f2"):
    SQL[f"{src}n"] = f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS rn,
        count(*) OVER (PARTITION BY symbol) AS n FROM {src}"""
    SQL[f"{src}st"] = _state(src)
    SQL[f"{src}ind"] = _indicators(src)
    SQL[f"{src}feat"] = _features(src)
    SQL[f"{src}vol"] = f"""SELECT *, {roll('stddev_samp', 'returns', 20, 'volatility_20d')},
        {roll('avg', 'close', 20, 'sma_20')}, {roll('avg', 'close', 50, 'sma_50')},
        {roll('avg', 'volume', 20, 'volume_ma20')}
        FROM (SELECT *, close / lag(close) OVER w - 1 AS returns FROM {src}n {windows()}) {windows()}"""
    SQL[f"{src}q"] = f"SELECT symbol, quantile_cont(volatility_20d, 0.75) AS q75 FROM {src}vol GROUP BY ALL"
    SQL[f"{src}reg"] = _regime(src)
    NEEDS[f"{src}n"] = [src]
    NEEDS[f"{src}st"] = [src, f"{src}n"]
    NEEDS[f"{src}ind"] = [src, f"{src}n", f"{src}st"]
    NEEDS[f"{src}feat"] = [src, f"{src}n"]
    NEEDS[f"{src}vol"] = [src, f"{src}n"]
    NEEDS[f"{src}q"] = [src, f"{src}n", f"{src}vol"]
    NEEDS[f"{src}reg"] = [src, f"{src}n", f"{src}vol", f"{src}q"]
