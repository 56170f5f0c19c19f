"""Keyed state inside a stream: last seen time per symbol, and bars of closed buckets that are revised by late rows.

State is kept by the streaming engine in the query's checkpoint, one entry per symbol, so its size depends on the number
of symbols and not on the number of batches, and a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def newer_only(bars: DataFrame, expiry_days: int | None = None) -> DataFrame:
    """Rows of a stream that are newer than the last time of their symbol in all earlier batches.

    Rows of the same batch do not hide each other. The first batch of a symbol passes whole; a row without timestamp
    passes only there. With `expiry_days` a symbol that brings nothing for so long is forgotten; the engine then runs batches
    without data to find such symbols, so a query that is to end by itself (available now) takes no expiry.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else None
        high = seen
        for rows in frames:
            times = rows["timestamp"].astype("datetime64[us]")
            newest = times.max()
            if newest is not pd.NaT and (high is None or newest.value // 1000 > high):
                high = newest.value // 1000
            yield rows if seen is None else rows[times > pd.Timestamp(seen, unit="us")]
        if high is not None:
            state.update((high,))
            if expiry_days:
                state.setTimeoutDuration(expiry_days * DAY_MS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expiry_days else GroupStateTimeout.NoTimeout
    return bars.groupBy("symbol").applyInPandasWithState(step, bars.schema, "high long", "append", timeout)


_PART = ["bucket", "first", "open", "high", "low", "last", "close", "volume"]
_PARTIAL = "symbol string, bucket long, first long, open double, high double, low double, last long, close double, volume double"
_STATE = (
    "clock long, bucket array<long>, first array<long>, open array<double>, high array<double>, low array<double>, "
    "last array<long>, close array<double>, volume array<double>, revision array<int>"
)
#: op: '+' a bar of a closed bucket, '-' the bar that it replaces, 'late' rows of a bucket that is no longer kept.
CHANGES = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, revision int, op string"


def _partials(width: int):
    """Bars of one task summed per symbol and bucket, so that a busy symbol sends one row per bucket and task."""

    def sum_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows = rows[rows["timestamp"].notna() & rows["symbol"].notna()]
            time = rows["timestamp"].astype("datetime64[us]").astype("int64")
            rows = rows.assign(first=time, last=time, bucket=time // width * width).sort_values(["first"], kind="stable")
            kinds = {"first": "first", "open": "first", "high": "max", "low": "min", "last": "last", "close": "last", "volume": "sum"}
            yield rows.groupby(["symbol", "bucket"], as_index=False).agg(kinds)[["symbol", *_PART]]

    return sum_up


def _joined(a: list, b: list) -> list:
    """Two partial bars of one bucket."""
    (bucket, f1, o1, h1, l1, t1, c1, v1), (_, f2, o2, h2, l2, t2, c2, v2) = a, b
    first, last = (f1, o1) if f1 <= f2 else (f2, o2), (t1, c1) if t1 >= t2 else (t2, c2)
    return [bucket, *first, np.fmax(h1, h2), np.fmin(l1, l2), *last, v1 + v2]


def revised_bars(bars: DataFrame, width: str, delay: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """Changes (`CHANGES`) of the bars of one width: nothing that arrives late is dropped in silence.

    A bucket is closed, and its bar published as revision 0, once its symbol has brought a row `delay` after the
    bucket's end; each symbol has its own clock, so a symbol that lags behind is not cut off by the others. Rows that
    come later for a closed bucket publish its old bar with op '-' and the new one with the next revision and '+'.
    Buckets that ended `keep` before the clock are forgotten; rows for them come out with op 'late', summed per bucket, for
    a side table. Bars must be unique per symbol and time (see `bars.once`).
    """
    size, wait, horizon = (int(pd.Timedelta(x).value // 1000) for x in (width, delay, keep))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, held, revision = None, {}, {}
        if state.exists:
            clock, *columns, revisions = state.get
            held = {row[0]: list(row) for row in zip(*columns)}
            revision = dict(zip(columns[0], revisions))
        old, late = {}, []
        limit = None if clock is None else clock - horizon
        for rows in frames:
            for row in rows[_PART].itertuples(index=False):
                row = list(row)
                bucket = row[0]
                if limit is not None and bucket + size <= limit:
                    late.append(row)
                    continue
                if bucket in held:
                    old.setdefault(bucket, held[bucket])
                    held[bucket] = _joined(held[bucket], row)
                else:
                    held[bucket], revision[bucket] = row, -1
                    old[bucket] = None
                clock = row[5] if clock is None else max(clock, row[5])
        out = [(*row, 0, "late") for row in late]
        for bucket in sorted(held):
            if bucket + size + wait > clock:
                continue
            if revision[bucket] < 0:
                revision[bucket] = 0
                out.append((*held[bucket], 0, "+"))
            elif bucket in old:
                out.append((*old[bucket], revision[bucket], "-"))
                revision[bucket] += 1
                out.append((*held[bucket], revision[bucket], "+"))
        if clock is not None:
            kept = [b for b in sorted(held) if b + size > clock - horizon]
            plain = [int if c in ("bucket", "first", "last") else float for c in _PART]
            state.update((int(clock), *([kind(held[b][i]) for b in kept] for i, kind in enumerate(plain)), [revision[b] for b in kept]))
        frame = pd.DataFrame(out, columns=[*_PART, "revision", "op"])
        frame["timestamp"] = pd.to_datetime(frame["bucket"].astype("int64"), unit="us")
        yield frame.assign(symbol=key[0])[[c.split()[0] for c in CHANGES.split(", ")]]

    parts = bars.select("symbol", "timestamp", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    parts = parts.mapInPandas(_partials(size), _PARTIAL)
    return parts.groupBy("symbol").applyInPandasWithState(step, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def current_bars(changes: DataFrame) -> DataFrame:
    """The newest revision of every published bar."""
    bars = changes.filter("op = '+'")
    newest = bars.groupBy("symbol", "timestamp").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "revision"), "revision").alias("b"))
    return newest.select("symbol", "timestamp", "b.*")
