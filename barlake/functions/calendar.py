"""Calendar and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.schemas import BARS_PER_YEAR, INTERVALS


def _lookup(column: str, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(column)]


def bucket_width(interval: str) -> Column:
    return _lookup(interval, INTERVALS)


def bars_per_year(interval: str) -> Column:
    return _lookup(interval, BARS_PER_YEAR)


def calendar_parts(ts: str) -> dict[str, Column]:
    """year, month, quarter, year-month text and date of a timestamp."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year_month": F.date_format(ts, "yyyy-MM"),
        "date": F.to_date(ts),
    }
