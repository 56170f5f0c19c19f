"""Shared session and synthetic bars."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlake.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "local[4]", 4,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(rows: int = 180, start: float = 100.0, seed: int = 42, symbols=("AAPL",)) -> pd.DataFrame:
    """Business-day bars: random-walk close, open = previous close, high and low one percent outside."""
    parts = []
    for i, symbol in enumerate(symbols):
        rng = np.random.default_rng(seed + i)
        close = start * np.exp(np.cumsum(rng.normal(0.0004, 0.015, rows)))
        open_ = np.concatenate([[start], close[:-1]])
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "timestamp": pd.bdate_range("2024-01-02", periods=rows),
                    "open": open_,
                    "high": np.maximum(open_, close) * 1.01,
                    "low": np.minimum(open_, close) * 0.99,
                    "close": close,
                    "adj_close": close,
                    "volume": rng.integers(1_000_000, 5_000_000, rows).astype(float),
                    "source": "test",
                    "ingestion_time": pd.Timestamp("2024-12-31"),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(make_bars(220, symbols=("AAPL", "MSFT", "TSLA")))


def collect(df, *sort):
    """Pandas rows in a fixed order with a fresh index."""
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)
