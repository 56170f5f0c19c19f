"""Chronological splits, scaling, least-squares forecasts and their metrics, all symbols at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.features import add_target_features
from barlake.plans.materialize import materialize
from barlake.plans.series import HELPERS, POS, TOTAL, number_rows, series, tail_n
from barlake.schemas import FORECAST_FEATURES

# Columns that are linear combinations of others (macd = ema_12 - ema_26,
# macd_hist = macd - macd_signal, bb_middle = sma_20, bb_lower = 2 bb_middle - bb_upper).
DEPENDENT = ("macd", "macd_hist", "bb_middle", "bb_lower")


def chronological_split(
    rows: DataFrame, train: float = 0.7, validation: float = 0.15, test: float = 0.15, minimum: int = 30
) -> DataFrame:
    """Add `split`, cut by position in each symbol; symbols with fewer than `minimum` rows raise."""
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    numbered = rows if POS in rows.columns else number_rows(rows)
    n = F.col(TOTAL)
    train_end = F.floor(n * F.lit(train))
    valid_end = train_end + F.floor(n * F.lit(validation))
    split = (
        F.when(n < minimum, F.raise_error(F.lit(f"need at least {minimum} rows per symbol")))
        .when(F.col(POS) < train_end, "train")
        .when(F.col(POS) < valid_end, "validation")
        .otherwise("test")
    )
    return numbered.withColumn("split", split)


def standard_stats(train_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every column, per symbol."""
    aggs = [fn(c).alias(f"{c}_{name}") for c in columns for name, fn in (("mean", F.avg), ("std", F.stddev_pop))]
    return train_rows.groupBy("symbol").agg(*aggs)


def standard_scale(rows: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation; a constant column becomes 0."""
    joined = rows.join(stats, "symbol")
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{c}_{x}" for c in columns for x in ("mean", "std")])


def minmax_stats(train_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [fn(c).alias(f"{c}_{name}") for c in columns for name, fn in (("min", F.min), ("max", F.max))]
    return train_rows.groupBy("symbol").agg(*aggs)


def minmax_scale(rows: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); the statistics stay on the row for `minmax_inverse`."""
    joined = rows.join(stats, "symbol")
    span = lambda c: F.col(f"{c}_max") - F.col(f"{c}_min")
    scaled = {f"{c}_scaled": F.try_divide(F.col(c) - F.col(f"{c}_min"), span(c)) for c in columns}
    return joined.withColumns(scaled)


def minmax_inverse(scaled: str | Column, column: str) -> Column:
    scaled = F.col(scaled) if isinstance(scaled, str) else scaled
    return scaled * (F.col(f"{column}_max") - F.col(f"{column}_min")) + F.col(f"{column}_min")


def sequences(bars: DataFrame, features: Sequence[str], target: str, length: int, **cut) -> DataFrame:
    """The last `length` feature vectors of every row with its target: n - length per symbol."""
    b = series(bars, before=length, after=1, **cut)
    if target == "target_close_next":
        b = add_target_features(b)
    vectors = F.collect_list(F.struct(*features)).over(b.trailing(length))
    b = b.add({"sequence": vectors}).core()
    whole = (F.col(POS) >= length - 1) & (F.col(POS) < F.col(TOTAL) - 1)
    return b.df.filter(whole).select("symbol", "timestamp", "sequence", target)


# --- least squares ---------------------------------------------------------------------------


def gram(rows: DataFrame, features: Sequence[str], target: str, weight: Column | None = None) -> DataFrame:
    """Per symbol: row count, sums, cross products of features and target.

    The sums are plain aggregates with map-side combine; what leaves the executors is one
    (p+1) x (p+1) triangle per symbol, whatever the number of rows.
    """
    names = [*features, target]
    values = [F.col(f"`{c}`") for c in names]
    pairs = [values[i] * values[j] for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.sum(v) for v in values]).alias("sums"),
        F.array(*[F.sum(p) for p in pairs]).alias("products"),
    )


def solve(grams: DataFrame, p: int, intercept: bool = True) -> DataFrame:
    """Coefficients per symbol from the triangle of `gram`; one small dense solve per row."""

    def fit(batches):
        for batch in batches:
            weights, constants = [], []
            for rows, sums, products in zip(batch["rows"], batch["sums"], batch["products"]):
                full = np.zeros((p + 1, p + 1))
                full[np.triu_indices(p + 1)] = products
                full = full + np.triu(full, 1).T
                s = np.asarray(sums, dtype=float)
                if intercept:
                    full = full - np.outer(s, s) / rows
                w = np.linalg.lstsq(full[:p, :p], full[:p, p], rcond=1e-12)[0]
                weights.append(w.tolist())
                constants.append(float((s[p] - w @ s[:p]) / rows) if intercept else 0.0)
            yield pd.DataFrame(
                {"symbol": batch["symbol"], "rows": batch["rows"], "weights": weights, "intercept": constants}
            )

    return grams.mapInPandas(fit, "symbol string, rows long, weights array<double>, intercept double")


def dot(weights: str, features: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for i, name in enumerate(features):
        total = total + F.col(weights)[i] * F.col(f"`{name}`")
    return total


def supervised(gold: DataFrame, features: Sequence[str] = FORECAST_FEATURES) -> DataFrame:
    """Rows with all features and a known next close."""
    return gold.select("symbol", "timestamp", *features, "target_close_next").dropna()


def ols_fit(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(scaling statistics, coefficients) from the train rows of a split frame.

    Columns that depend linearly on others are left out: predictions do not change, and the
    Gram matrix keeps full rank.
    """
    train = rows.filter(F.col("split") == "train")
    stats = standard_stats(train, features)
    scaled = standard_scale(train, stats, features)
    return stats, solve(gram(scaled, features, "target_close_next"), len(features))


def ols_predict(rows: DataFrame, stats: DataFrame, coefficients: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `predicted`; the unscaled features stay as they are."""
    joined = rows.join(stats, "symbol").join(coefficients.select("symbol", "weights", "intercept"), "symbol")
    total = F.col("intercept")
    for i, c in enumerate(features):
        z = F.try_divide(F.col(f"`{c}`") - F.col(f"{c}_mean"), F.col(f"{c}_std"))
        total = total + F.col("weights")[i] * F.coalesce(z, F.lit(0.0))
    return joined.withColumn("predicted", total).drop(
        "weights", "intercept", *[f"{c}_{x}" for c in features for x in ("mean", "std")]
    )


def independent(features: Sequence[str]) -> list[str]:
    return [c for c in features if c not in DEPENDENT]


# --- metrics ---------------------------------------------------------------------------------


def forecast_metrics(
    rows: DataFrame, keys: Sequence[str] = ("symbol",), actual: str = "actual", predicted: str = "predicted",
    previous: str = "previous",
) -> DataFrame:
    """MAE, RMSE, MAPE and directional accuracy (rows with an actual move only)."""
    y, f, before = F.col(actual), F.col(predicted), F.col(previous)
    moved = F.signum(y - before) != 0
    hit = F.when(F.signum(y - before) == F.signum(f - before), 1.0).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(y - f)).alias("mae"),
        F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"),
        (F.avg(F.abs(y - f) / F.greatest(F.abs(y), F.lit(1e-8))) * 100).alias("mape"),
        F.coalesce(F.avg(F.when(moved, hit)), F.lit(0.0)).alias("directional_accuracy"),
    )


# --- training and prediction jobs ----------------------------------------------------------------


def split_ranges(rows: DataFrame) -> DataFrame:
    """First and last time of each split per symbol, as one row."""
    ends = []
    for name in ("train", "validation", "test"):
        at = F.when(F.col("split") == name, F.col("timestamp"))
        ends += [F.min(at).alias(f"{name}_start"), F.max(at).alias(f"{name}_end")]
    return rows.groupBy("symbol").agg(*ends)


def train_linear(gold: DataFrame, features: Sequence[str] = FORECAST_FEATURES) -> dict[str, DataFrame]:
    """Fit, score and evaluate the least-squares model of every symbol.

    Returns `coefficients`, `stats`, `predictions` (test rows) and `runs` (one record per symbol).
    """
    used = independent(features)
    # Statistics, Gram matrix, ranges and scores all read the split rows.
    rows = materialize(chronological_split(supervised(gold, features)), "supervised")
    stats, coefficients = ols_fit(rows, used)
    scored = ols_predict(rows.filter(F.col("split") == "test"), stats, coefficients, used)
    predictions = scored.select(
        "symbol", "timestamp", F.col("target_close_next").alias("actual"), "predicted", F.col("close").alias("previous")
    )
    runs = (
        forecast_metrics(predictions)
        .join(split_ranges(rows), "symbol")
        .withColumns({"model_name": F.lit("linear_regression"), "features": F.array(*map(F.lit, features))})
    )
    return {"coefficients": coefficients, "stats": stats, "predictions": predictions, "runs": runs}


def predict_linear(
    gold: DataFrame, stats: DataFrame, coefficients: DataFrame, last: int = 120,
    features: Sequence[str] = FORECAST_FEATURES,
) -> DataFrame:
    """The last fitted points of every symbol from stored coefficients."""
    used = independent(features)
    recent = tail_n(gold.dropna(subset=list(features)), last)
    scored = ols_predict(recent, stats, coefficients, used)
    return scored.select("symbol", "timestamp", F.col("close").alias("actual"), "predicted")


# --- autoregression ------------------------------------------------------------------------------

PATH_STEPS = 1024


def ar_frame(bars: DataFrame, lags: int = 5, differences: int = 1, column: str = "close", **cut) -> DataFrame:
    """Differenced series `y`, its lags `y1 … yp`, and the level of each difference order before it."""
    b = series(bars.select("symbol", "timestamp", column), before=lags + differences + 1, **cut)
    b = b.add({"y": F.col(column)})
    for d in range(differences):
        b = b.add({f"before{d}": b.lag("y"), "y": F.col("y") - b.lag("y")})
    b = b.add({f"y{i}": b.lag("y", i) for i in range(1, lags + 1)})
    return b.core().df.drop(*[h for h in HELPERS if h not in (POS, TOTAL)])


def _lag_names(lags: int) -> list[str]:
    return [f"y{i}" for i in range(1, lags + 1)]


def ar_fit(frame: DataFrame, lags: int = 5) -> DataFrame:
    """Conditional least squares of y on its lags over the train rows, without a constant."""
    names = _lag_names(lags)
    rows = chronological_split(frame).filter(F.col("split") == "train").dropna(subset=[*names, "y"])
    return solve(gram(rows, names, "y"), lags, intercept=False)


def ar_fitted(frame: DataFrame, coefficients: DataFrame, lags: int = 5) -> DataFrame:
    """One-step fitted value of every train row that has its lags."""
    rows = chronological_split(frame).filter(F.col("split") == "train").join(coefficients, "symbol")
    step = dot("weights", _lag_names(lags))
    for c in [c for c in frame.columns if c.startswith("before")]:
        step = step + F.col(c)
    return rows.withColumn("fitted", step).dropna(subset=["fitted"])


def ar_path(frame: DataFrame, coefficients: DataFrame, horizon: int | None = None, lags: int = 5,
            differences: int = 1, column: str = "close") -> DataFrame:
    """Forecasts (symbol, step, predicted) after the train rows.

    With `horizon` None the path covers the validation and test rows' count of test rows, as an
    evaluation needs; else 1 … horizon. The state of a symbol is its last differences and levels. A
    long path is cut into pieces of `PATH_STEPS` steps: powers of the transition matrix jump to the
    start of each piece, so the pieces are independent short tasks.
    """
    rows = chronological_split(frame)
    levels = [f"level{d}" for d in range(differences)]
    # level{d} is the d-times differenced series at the row: before{d} plus the next difference.
    at_row = F.col("y")
    exact = {}
    for d in reversed(range(differences)):
        at_row = at_row + F.col(f"before{d}")
        exact[f"level{d}"] = at_row
    train = rows.withColumns(exact).filter(F.col("split") == "train")
    recent = ["y", *_lag_names(lags)[:-1]]
    state = train.groupBy("symbol").agg(
        F.max_by(F.array(*recent, *levels), POS).alias("state"), F.max(TOTAL).alias("_n")
    )
    if horizon is None:
        n = F.col("_n")
        train_end = F.floor(n * F.lit(0.7))
        steps = n - (train_end + F.floor(n * F.lit(0.15)))
    else:
        steps = F.lit(horizon).cast("long")
    pieces = (
        state.withColumn("steps", steps)
        .join(coefficients.select("symbol", "weights"), "symbol")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / PATH_STEPS))))
        .select("symbol", "state", "weights", "steps", "piece")
        .repartition("symbol", "piece")
    )

    def walk(batches):
        for batch in batches:
            out = []
            for symbol, s, w, total, piece in batch.itertuples(index=False):
                p = len(w)
                move = np.zeros((len(s), len(s)))
                move[0, :p] = w
                move[1:p, : p - 1] = np.eye(p - 1)
                for d in range(differences):
                    # A level moves by the next value of the level above it.
                    move[p + d, :p] = w
                    for e in range(d, differences):
                        move[p + d, p + e] = 1.0
                now = np.linalg.matrix_power(move, int(piece) * PATH_STEPS) @ np.asarray(s, dtype=float)
                last = min(int(total), (int(piece) + 1) * PATH_STEPS)
                for step in range(int(piece) * PATH_STEPS + 1, last + 1):
                    now = move @ now
                    out.append((symbol, step, float(now[p] if differences else now[0])))
            yield pd.DataFrame(out, columns=["symbol", "step", "predicted"])

    return pieces.mapInPandas(walk, "symbol string, step long, predicted double")


def ar_predictions(frame: DataFrame, coefficients: DataFrame, lags: int = 5, differences: int = 1,
                   column: str = "close") -> DataFrame:
    """Test rows with the multi-step forecast of their step and the previous actual value."""
    rows = chronological_split(frame)
    n = F.col(TOTAL)
    first = F.floor(n * F.lit(0.7)) + F.floor(n * F.lit(0.15))
    test = rows.filter(F.col("split") == "test").withColumn("step", F.col(POS) - first + 1)
    last_train = rows.filter(F.col("split") == "train").groupBy("symbol").agg(F.max_by(column, POS).alias("_last"))
    # The first test row is compared with the last train value, every other one with the row before.
    previous = F.when(F.col("step") == 1, F.col("_last")).otherwise(_level_before(differences))
    path = ar_path(frame, coefficients, None, lags, differences, column)
    return (
        test.join(path, ["symbol", "step"])
        .join(last_train, "symbol")
        .select("symbol", "timestamp", "step", F.col(column).alias("actual"), "predicted", previous.alias("previous"))
    )


def _level_before(differences: int) -> Column:
    return F.col("before0") if differences else F.lit(None).cast("double")


def train_ar(bars: DataFrame, lags: int = 5, differences: int = 1, **cut) -> dict[str, DataFrame]:
    """Fit, score and evaluate the autoregression of every symbol; `runs` has one record per symbol."""
    frame = materialize(ar_frame(bars, lags, differences, **cut), "ar")
    coefficients = ar_fit(frame, lags)
    predictions = ar_predictions(frame, coefficients, lags, differences)
    runs = (
        forecast_metrics(predictions)
        .join(split_ranges(chronological_split(frame)), "symbol")
        .withColumns({"model_name": F.lit("arima"), "features": F.array(F.lit("close"))})
    )
    return {"frame": frame, "coefficients": coefficients, "predictions": predictions, "runs": runs}


def predict_ar(bars: DataFrame, coefficients: DataFrame, horizon: int = 5, lags: int = 5, differences: int = 1) -> DataFrame:
    """Forecasts after the train rows placed on the times that follow the last bar."""
    path = ar_path(ar_frame(bars, lags, differences), coefficients, horizon, lags, differences)
    return path.join(future_times(bars, horizon), ["symbol", "step"])


def future_times(bars: DataFrame, horizon: int) -> DataFrame:
    """The next `horizon` times of every symbol at its most frequent gap.

    A daily series continues on business days, as does one without a dominant gap.
    """
    b = series(bars.select("symbol", "timestamp"), before=1)
    gaps = b.add({"gap": F.unix_seconds("timestamp") - F.unix_seconds(b.lag("timestamp"))}).rows()
    counted = gaps.filter(F.col("gap").isNotNull()).groupBy("symbol", "gap").agg(
        F.count(F.lit(1)).alias("c"), F.max("timestamp").alias("last")
    )
    modal = counted.groupBy("symbol").agg(
        F.max_by("gap", F.struct("c", -F.col("gap"))).alias("gap"), F.max("last").alias("last")
    )
    day = 86400
    weekday = lambda d: F.weekday(d) < 5
    days = F.slice(
        F.filter(
            F.sequence(F.to_date("last") + 1, F.to_date("last") + 2 * horizon + 7), lambda d: weekday(d)
        ),
        1,
        horizon,
    )
    business = F.transform(days, lambda d: d.cast("timestamp"))
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.timestamp_seconds(F.unix_seconds("last") + i * F.col("gap"))
    )
    future = F.when(F.col("gap") == day, business).otherwise(steps)
    return modal.select("symbol", F.posexplode(future).alias("step", "timestamp")).withColumn("step", F.col("step") + 1)
