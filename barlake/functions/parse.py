"""Numbers, dates and relative times from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats tried in this order, and clock formats of trade times.
DATE_FORMATS = ["dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
TIME_FORMATS = ["HH:mm:ss", "HH:mm", "yyyy-MM-dd HH:mm:ss"]


def local_number(text: str | Column) -> Column:
    """Number with currency marks; without commas, dots before a last group of three digits are thousands."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(text, r"₫|\$|VND|USD| ", "")
    thousands = ~F.contains(plain, F.lit(",")) & plain.rlike(r"\.[^.]{3}$")
    plain = F.when(thousands, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)
    return F.replace(plain, F.lit(","), F.lit("")).try_cast("double")


def percent_number(text: str | Column) -> Column:
    """Number without `%` and thousands commas."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(text, "[%,]", "")).try_cast("double")


def comma_number(text: str | Column, empty: float | None = 0.0) -> Column:
    """Number with thousands commas; an empty or missing text gives `empty`."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(empty)).otherwise(number)


def date_time(text: str | Column, now: str | Column, formats: list[str] = DATE_FORMATS) -> Column:
    """First format that fits; `now` for empty or unknown text."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], now)


def clock_time(text: str | Column, now: str | Column) -> Column:
    """Clock or full time of a trade; a bare clock time lies on 1900-01-01."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    dated = [F.try_to_timestamp(F.concat(F.lit("1900-01-01 "), text), F.lit(f"yyyy-MM-dd {f}")) for f in TIME_FORMATS[:2]]
    return F.coalesce(*dated, F.try_to_timestamp(text, F.lit(TIME_FORMATS[2])), now)


def relative_time(text: str | Column, now: str | Column) -> Column:
    """`3d`, `1w`, `2h` before `now`; `now` itself for other text."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    n = F.regexp_extract(text, r"^(\d+)([dwh])", 1).try_cast("int")
    unit = F.regexp_extract(text, r"^(\d+)([dwh])", 2)
    hours = n * F.when(unit == "d", 24).when(unit == "w", 168).otherwise(1)
    return F.when(n.isNull(), now).otherwise(now - F.make_interval(hours=hours))
