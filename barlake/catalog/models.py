"""Splits, scaling, least squares, autoregression, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog import sqlparts  # noqa: F401  (defines the views used below)
from barlake.catalog.base import query, scratch
from barlake.operators import forecast as fc
from barlake.plans import jobs
from barlake.plans.gold import gold_rows
from barlake.plans.series import series
from barlake.plans.views import NEEDS, SQL
from barlake.schemas import FORECAST_FEATURES
from barlake.sources.tables import Lake

SQL["sp"] = """SELECT *, CASE WHEN rn < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN rn < CAST(floor(n * 0.7) AS BIGINT)
    + CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM f2n"""
SQL["sp"] = SQL["sp"].replace("n * 0.7", "n * CAST(0.7 AS DOUBLE)")
NEEDS["sp"] = ["f2", "f2n"]
query("m_split", "symbol timestamp:t split", "SELECT * FROM sp", "sp")(lambda t: fc.chronological_split(t.f2))
query(
    "m_std",
    "symbol timestamp:t close:6 volume:6",
    """SELECT symbol, timestamp, (close - cm) / cs AS close, (volume - vm) / vs AS volume FROM sp JOIN (SELECT symbol,
       avg(close) AS cm, stddev_pop(close) AS cs, avg(volume) AS vm, stddev_pop(volume) AS vs FROM sp
       WHERE split = 'train' GROUP BY ALL) USING (symbol)""",
    "sp",
)(
    lambda t: (lambda rows: fc.standard_scale(
        rows, fc.standard_stats(rows.filter("split = 'train'"), ["close", "volume"]), ["close", "volume"]
    ))(fc.chronological_split(t.f2))
)
query(
    "m_minmax",
    "symbol timestamp:t close_scaled:6 again:2",
    """SELECT symbol, timestamp, (close - lo) / (hi - lo) AS close_scaled, close AS again FROM sp JOIN (SELECT symbol,
       min(close) AS lo, max(close) AS hi FROM sp WHERE split = 'train' GROUP BY ALL) USING (symbol)""",
    "sp",
)(
    lambda t: (lambda rows: fc.minmax_scale(rows, fc.minmax_stats(rows.filter("split = 'train'"), ["close"]), ["close"]))(
        fc.chronological_split(t.f2)
    ).withColumn("again", fc.minmax_inverse("close_scaled", "close"))
)

_METRICS = "mae:4 rmse:4 mape:3 directional_accuracy:6"
_EVAL = """SELECT {keys}, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
    avg(abs(actual - predicted) / greatest(abs(actual), 1e-8)) * 100 AS mape,
    coalesce(avg(CASE WHEN actual <> previous THEN CASE WHEN sign(actual - previous) = sign(predicted - previous)
    THEN 1.0 ELSE 0.0 END END), 0) AS directional_accuracy FROM ({rows}) GROUP BY {keys}"""
_NAIVE = """SELECT symbol, split, close AS actual, predicted, previous FROM (SELECT *, lag(close) OVER w AS previous,
    (lag(close) OVER w + lag(close, 2) OVER w) / 2 AS predicted FROM sp
    WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) WHERE rn >= 2"""


def _naive(t):
    b = series(t.f2, before=2)
    b = b.add({"previous": b.lag("close"), "predicted": (b.lag("close") + b.lag("close", 2)) / 2, "actual": F.col("close")})
    return fc.chronological_split(b.core().df).dropna(subset=["predicted"])


query("a_fcmet", f"symbol split {_METRICS}", _EVAL.format(keys="symbol, split", rows=_NAIVE), "sp")(
    lambda t: fc.forecast_metrics(_naive(t), ["symbol", "split"])
)
query("m_eval", f"symbol {_METRICS}", _EVAL.format(keys="symbol", rows=_NAIVE + " AND split = 'test'"), "sp")(
    lambda t: fc.forecast_metrics(_naive(t).filter("split = 'test'"))
)
query("j_cmp", "symbol actual:2 predicted:3 previous:2", _NAIVE, "sp")(_naive)


def _gold(t):
    return gold_rows(t.f2)


# --- SQL side of the least-squares models: Gauss-Jordan elimination on the normal equations ----------------


def _solver(name: str, source: str, xs: list[str], y: str) -> None:
    """View `{name}` with (symbol, w): the weights of `y` on `xs` over the rows of `source`."""
    p = len(xs)
    rows = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in [*xs, y]) + "]" for a in xs)
    SQL[f"{name}g"] = f"SELECT symbol, [{rows}] AS m FROM {source} GROUP BY symbol"
    SQL[f"{name}j"] = f"""SELECT symbol, 1 AS k, m FROM {name}g UNION ALL SELECT symbol, k + 1,
        list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j:
        CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
        FROM {name}j WHERE k <= {p}"""
    SQL[name] = f"SELECT symbol, list_transform(m, lambda r: r[{p + 1}]) AS w FROM {name}j WHERE k = {p + 1}"
    need = [*NEEDS.get(source, []), source]
    NEEDS[f"{name}g"], NEEDS[f"{name}j"], NEEDS[name] = need, [*need, f"{name}g"], [*need, f"{name}g", f"{name}j"]


_quoted = lambda c: f'"{c}"'
_SPLIT = """CASE WHEN rn < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train' WHEN rn < CAST(floor(n * CAST(0.7 AS DOUBLE))
    AS BIGINT) + CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END"""
_USED = fc.independent(FORECAST_FEATURES)
SQL["sup"] = f"""SELECT *, {_SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS rn,
    count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT i.* EXCLUDE (rn, n), f."return", f.rolling_std_20, f.close_lag_1,
    f.close_lag_2, f.return_lag_1, f.volume_lag_1, f.target_close_next FROM f2ind i JOIN f2feat f USING (symbol, timestamp))
    WHERE {' AND '.join(f'{_quoted(c)} IS NOT NULL' for c in FORECAST_FEATURES)} AND target_close_next IS NOT NULL)"""
NEEDS["sup"] = [*NEEDS["f2ind"], "f2ind", "f2feat"]
SQL["moments"] = "SELECT symbol, avg(target_close_next) AS ybar, count(*) AS rows, " + ", ".join(
    f"avg({_quoted(c)}) AS m_{c}, stddev_pop({_quoted(c)}) AS s_{c}" for c in _USED
) + " FROM sup WHERE split = 'train' GROUP BY symbol"
NEEDS["moments"] = [*NEEDS["sup"], "sup"]
SQL["zs"] = "SELECT s.symbol, timestamp, close, target_close_next, split, rn, n, ybar, target_close_next - ybar AS yc, " + ", ".join(
    f"({_quoted(c)} - m_{c}) / s_{c} AS z_{c}" for c in _USED
) + " FROM sup s JOIN moments m ON s.symbol = m.symbol"
NEEDS["zs"] = [*NEEDS["moments"], "moments"]
SQL["ztrain"] = "SELECT * FROM zs WHERE split = 'train'"
NEEDS["ztrain"] = [*NEEDS["zs"], "zs"]
_solver("olsw", "ztrain", [f"z_{c}" for c in _USED], "yc")
SQL["ols"] = "SELECT zs.*, ybar + " + " + ".join(f"w[{i}] * z_{c}" for i, c in enumerate(_USED, 1)) + """ AS predicted
    FROM zs JOIN olsw ON zs.symbol = olsw.symbol"""
NEEDS["ols"] = [*NEEDS["olsw"], "olsw"]

_AR = [f"y{i}" for i in range(1, 6)]
SQL["ar0"] = f"""SELECT symbol, timestamp, rn, n, close, {_SPLIT} AS split, lag(close) OVER w AS before,
    close - lag(close) OVER w AS y FROM f2n WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""
SQL["ar1"] = f"""SELECT *, {', '.join(f'lag(y, {i}) OVER w AS y{i}' for i in range(1, 6))} FROM ar0
    WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""
SQL["artrain"] = "SELECT * FROM ar1 WHERE split = 'train' AND y5 IS NOT NULL"
NEEDS["ar0"] = ["f2", "f2n"]
NEEDS["ar1"] = [*NEEDS["ar0"], "ar0"]
NEEDS["artrain"] = [*NEEDS["ar1"], "ar1"]
_solver("arw", "artrain", _AR, "y")
SQL["arpath"] = f"""SELECT a.symbol, 0 AS step, close AS level, [y, y1, y2, y3, y4] AS ys, w, n - floor(n * CAST(0.7 AS DOUBLE)) AS steps FROM ar1 a JOIN arw ON a.symbol = arw.symbol
    WHERE rn = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) - 1
    UNION ALL SELECT symbol, step + 1, level + {' + '.join(f'w[{i}] * ys[{i}]' for i in range(1, 6))},
    [{' + '.join(f'w[{i}] * ys[{i}]' for i in range(1, 6))}, ys[1], ys[2], ys[3], ys[4]], w, steps FROM arpath WHERE step <= steps"""
SQL["artest"] = """SELECT t.symbol, t.timestamp, t.close AS actual, p.level AS predicted,
    CASE WHEN p.step = 1 THEN s.close ELSE t.before END AS previous
    FROM ar1 t JOIN ar1 s ON s.symbol = t.symbol AND s.rn = CAST(floor(t.n * CAST(0.7 AS DOUBLE)) AS BIGINT) - 1
    JOIN arpath p ON p.symbol = t.symbol AND p.step = t.rn + 1 - CAST(floor(t.n * CAST(0.7 AS DOUBLE)) AS BIGINT)
      - CAST(floor(t.n * CAST(0.15 AS DOUBLE)) AS BIGINT) WHERE t.split = 'test'"""
NEEDS["arpath"] = [*NEEDS["arw"], "arw"]
NEEDS["artest"] = [*NEEDS["arpath"], "arpath"]

_RUN = (
    "symbol model_name mae:e5 rmse:e5 mape:e5 directional_accuracy:6 train_start:t train_end:t validation_start:t "
    "validation_end:t test_start:t test_end:t"
)


def _run_sql(model: str, scored: str, rows: str) -> str:
    ends = ", ".join(
        f"{fn}(timestamp) FILTER (split = '{s}') AS {s}_{end}"
        for s in ("train", "validation", "test") for fn, end in (("min", "start"), ("max", "end"))
    )
    return f"""SELECT *, '{model}' AS model_name FROM ({_EVAL.format(keys='symbol', rows=scored)})
        JOIN (SELECT symbol, {ends} FROM {rows} GROUP BY symbol) USING (symbol)"""


query("m_ols", "symbol rows:i intercept:2", "SELECT symbol, rows, ybar AS intercept FROM moments", "moments")(
    lambda t: fc.train_linear(_gold(t))["coefficients"]
)
query(
    "m_train",
    _RUN,
    _run_sql(
        "linear_regression",
        "SELECT symbol, target_close_next AS actual, predicted, close AS previous FROM ols WHERE split = 'test'",
        "sup",
    ),
    "ols",
)(lambda t: fc.train_linear(_gold(t))["runs"])


@query(
    "m_reg",
    _RUN + " run_id",
    "SELECT *, 'second' AS run_id FROM (" + _run_sql(
        "linear_regression",
        "SELECT symbol, target_close_next AS actual, predicted, close AS previous FROM ols WHERE split = 'test'",
        "sup",
    ) + ")",
    "ols",
)
def m_reg(t):
    """The newest stored run of each model after two trainings."""
    lake = Lake(t.spark, scratch(t.spark, "lake"))
    lake.write_layer("gold", _gold(t))
    for run in ("first", "second"):
        jobs.train(lake, run)
    return jobs.trained_models(lake)


@query(
    "m_pred",
    "symbol timestamp:t actual:2 predicted:e5",
    f"""SELECT symbol, timestamp, close AS actual, ybar + {' + '.join(f'w[{i}] * ({_quoted(c)} - m_{c}) / s_{c}' for i, c in enumerate(_USED, 1))}
        AS predicted FROM (SELECT i.* EXCLUDE (rn, n), f."return", f.rolling_std_20, f.close_lag_1, f.close_lag_2, f.return_lag_1,
        f.volume_lag_1 FROM f2ind i JOIN f2feat f USING (symbol, timestamp)) JOIN moments USING (symbol) JOIN olsw USING (symbol)
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 120""",
    "olsw",
)
def m_pred(t):
    rows = _gold(t)
    model = fc.train_linear(rows)
    return fc.predict_linear(rows, model["stats"], model["coefficients"])


query("m_ar", _RUN, _run_sql("arima", "SELECT * FROM artest", "ar0"), "artest")(lambda t: fc.train_ar(t.f2)["runs"])


@query(
    "m_fitted",
    "symbol timestamp:t close:2 fitted:2",
    f"""SELECT a.symbol, timestamp, close, before + {' + '.join(f'w[{i}] * y{i}' for i in range(1, 6))} AS fitted
        FROM ar1 a JOIN arw ON a.symbol = arw.symbol WHERE split = 'train' AND y5 IS NOT NULL""",
    "arw",
)
def m_fitted(t):
    frame = fc.ar_frame(t.f2)
    return fc.ar_fitted(frame, fc.ar_fit(frame))


query(
    "f_bday",
    "symbol step:i timestamp:t",
    """SELECT symbol, k AS step, last + to_hours(CAST(k AS INTEGER)) AS timestamp
       FROM (SELECT symbol, max(timestamp) AS last FROM f1 GROUP BY symbol), range(1, 6) r(k)
       UNION ALL SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY d) AS step, d AS timestamp
       FROM (SELECT symbol, last + to_days(CAST(k AS INTEGER)) AS d FROM (SELECT symbol, max(timestamp) AS last FROM f2 GROUP BY symbol),
       range(1, 20) r(k)) WHERE isodow(d) < 6 QUALIFY step <= 5""",
    "f1 f2",
)(lambda t: fc.future_times(t.f1, 5).unionByName(fc.future_times(t.f2, 5)))
