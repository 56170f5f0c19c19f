"""Landed JSON payloads to typed rows.

A payload table has one document per row (`symbol`, `payload`). Fetching is not done here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.parse import clock_time, comma_number
from barlake.operators.market import top_of_book
from barlake.schemas import FUNDAMENTAL_METRICS

_QUOTE = "open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>"
CHART = (
    "struct<chart: struct<result: array<struct<timestamp: array<bigint>, indicators: struct<"
    f"quote: array<struct<{_QUOTE}>>, adjclose: array<struct<adjclose: array<double>>>>>>>>"
)


def chart_rows(payloads: DataFrame, drop_empty_close: bool = False) -> DataFrame:
    """Parallel-array chart payload to bars; `adj_close` falls back to close.

    Index and commodity payloads drop rows without a close, price payloads keep them.
    """
    result = F.get(F.from_json("payload", CHART)["chart"]["result"], F.lit(0))
    rows = payloads.select("symbol", result.alias("r")).select(
        "symbol",
        F.col("r.timestamp").alias("at"),
        F.get(F.col("r.indicators.quote"), F.lit(0)).alias("q"),
        F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"].alias("adjusted"),
    )
    names = ["open", "high", "low", "close", "volume"]
    adjusted = F.coalesce("adjusted", F.col("q.close")).alias("adj_close")
    zipped = F.arrays_zip(F.col("at"), *[F.col(f"q.{c}").alias(c) for c in names], adjusted)
    out = rows.select("symbol", F.explode(zipped).alias("z")).select(
        F.upper("symbol").alias("symbol"),
        F.timestamp_seconds("z.at").alias("timestamp"),
        *[F.col(f"z.{c}").alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")],
    )
    return out.filter(F.coalesce(F.col("close"), F.lit(0.0)) != 0) if drop_empty_close else out


def history_rows(payloads: DataFrame) -> DataFrame:
    """Item-list payload with text numbers and day-first dates; rows without a date are skipped."""
    names = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "AdjustPrice": "adj_close", "Volume": "volume"}
    item = "struct<Date: string, " + ", ".join(f"{n}: string" for n in names) + ">"
    rows = payloads.select("symbol", F.explode(F.from_json("payload", f"struct<data: array<{item}>>")["data"]).alias("i"))
    at = F.try_to_timestamp("i.Date", F.lit("dd/MM/yyyy HH:mm:ss"))
    values = [comma_number(F.col(f"i.{source}")).alias(c) for source, c in names.items()]
    readable = F.lit(True)
    for c in names.values():
        readable = readable & F.col(c).isNotNull()
    return rows.select(F.upper("symbol").alias("symbol"), at.alias("timestamp"), *values).filter(
        F.col("timestamp").isNotNull() & readable
    )


def series_rows(payloads: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date-keyed payload (`… Time Series …`) to bars strictly between start and end."""
    top = F.from_json("payload", "map<string, string>")
    entries = F.filter(F.map_entries(top), lambda e: F.contains(e["key"], F.lit("Time Series")) | F.contains(e["key"], F.lit("TimeSeries")))
    days = F.from_json(F.get(entries, F.lit(0))["value"], "map<string, map<string, string>>")
    rows = payloads.select("symbol", F.explode(days).alias("at", "v"))
    value = lambda key, default: F.coalesce(F.try_element_at("v", F.lit(key)).try_cast("double"), default)
    zero = F.lit(0.0)
    close = value("4. close", zero)
    out = rows.select(
        F.upper("symbol").alias("symbol"),
        F.col("at").try_cast("timestamp").alias("timestamp"),
        value("1. open", zero).alias("open"),
        value("2. high", zero).alias("high"),
        value("3. low", zero).alias("low"),
        close.alias("close"),
        value("5. adjusted close", close).alias("adj_close"),
        value("6. volume", zero).alias("volume"),
    ).filter(F.col("timestamp").isNotNull())
    if start:
        out = out.filter(F.col("timestamp") > F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return out


def vendor_bars(frame: DataFrame, source: str) -> DataFrame:
    """Vendor column names to bar names; `adj_close` defaults to close."""
    names = {
        "Datetime": "timestamp", "Date": "timestamp", "Open": "open", "High": "high", "Low": "low", "Close": "close",
        "Adj Close": "adj_close", "Volume": "volume",
    }
    present = {old: new for old, new in names.items() if old in frame.columns}
    if "Datetime" in present:
        present.pop("Date", None)
    out = frame.withColumnsRenamed(present)
    if "adj_close" not in out.columns:
        out = out.withColumn("adj_close", F.col("close"))
    if "ingestion_time" not in out.columns:
        out = out.withColumn("ingestion_time", F.current_timestamp())
    return out.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "source": F.lit(source)})


# --- order books and trades --------------------------------------------------------------------------

_LEVELS = {
    "first": ("Buy", "Sell", "Price", "Volume", "Orders"),
    "second": ("bids", "asks", "price", "vol", "orders"),
}


def book_snapshots(payloads: DataFrame, layout: str = "first", depth: int | None = None) -> DataFrame:
    """Order-book payload to a nested snapshot; `depth` keeps the best levels per side if given."""
    bid, ask, price, volume, orders = _LEVELS[layout]
    level = f"struct<{price}: double, {volume}: bigint, {orders}: bigint>"
    parsed = F.from_json("payload", f"struct<{bid}: array<{level}>, {ask}: array<{level}>>")

    def side(name: str) -> Column:
        cut = F.coalesce(parsed[name], F.array().cast(f"array<{level}>"))
        cut = cut if depth is None else F.slice(cut, 1, depth)
        return F.transform(
            cut,
            lambda x: F.struct(
                F.coalesce(x[price], F.lit(0.0)).alias("price"),
                F.coalesce(x[volume], F.lit(0).cast("long")).alias("volume"),
                F.coalesce(x[orders], F.lit(1).cast("long")).alias("orders"),
            ),
        )

    return top_of_book(payloads.select(F.upper("symbol").alias("symbol"), "timestamp", side(bid).alias("bids"), side(ask).alias("asks")))


def trade_rows(payloads: DataFrame, now: str | Column, limit: int | None = None) -> DataFrame:
    """Trades payload to rows; type `KL` is a buy; `limit` keeps the first trades of each payload if given."""
    item = "struct<Time: string, Price: double, Volume: bigint, Type: string>"
    data = F.from_json("payload", f"struct<Data: array<{item}>>")["Data"]
    data = data if limit is None else F.slice(data, 1, limit)
    return payloads.select("symbol", F.explode(data).alias("d")).select(
        F.upper("symbol").alias("symbol"),
        clock_time(F.coalesce("d.Time", F.lit("")), now).alias("timestamp"),
        F.coalesce("d.Price", F.lit(0.0)).alias("price"),
        F.coalesce("d.Volume", F.lit(0).cast("long")).alias("volume"),
        F.when(F.col("d.Type") == "KL", "buy").otherwise("sell").alias("side"),
        F.lit("regular").alias("trade_type"),
    )


# --- statements and ratios -----------------------------------------------------------------------------

# Payload fields of the three statements and of the ratio payload.
STATEMENTS = {
    "income": (
        "incomeStatementHistory", "incomeStatementHistory",
        {"totalRevenue": "total_revenue", "grossProfit": "gross_profit", "operatingIncome": "operating_income",
         "netIncome": "net_income", "ebit": "ebit", "netIncomeCommonStockholders": "eps"},
    ),
    "balance": (
        "balanceSheetHistory", "balanceSheetStatements",
        {"totalAssets": "total_assets", "totalLiab": "total_liabilities", "totalStockholderEquity": "total_equity",
         "cash": "cash", "shortLongTermDebt": "short_term_debt", "longTermDebt": "long_term_debt"},
    ),
    "cash_flow": (
        "cashflowStatementHistory", "cashflowStatements",
        {"totalCashFromOperatingActivities": "operating_cashflow", "capitalExpenditures": "capital_expenditure",
         "freeCashFlow": "free_cashflow", "dividendsPaid": "dividends_paid", "commonStockRepurchased": "share_repurchase"},
    ),
}
RATIO_FIELDS = {
    "market_cap": ("summaryDetail", "marketCap"),
    "pe_ratio": ("summaryDetail", "trailingPE"),
    "pb_ratio": ("defaultKeyStatistics", "priceBook"),
    "ps_ratio": ("summaryDetail", "priceToSalesTrailing12Months"),
    "peg_ratio": ("defaultKeyStatistics", "pegRatio"),
    "ev_ebitda": ("financialData", "enterpriseToEbitda"),
    "dividend_yield": ("summaryDetail", "dividendYield"),
    "roe": ("financialData", "returnOnEquity"),
    "roa": ("financialData", "returnOnAssets"),
    "gross_margin": ("financialData", "grossMargins"),
    "operating_margin": ("financialData", "operatingMargins"),
    "net_margin": ("financialData", "netMargins"),
    "revenue_growth_yoy": ("financialData", "revenueGrowth"),
    "profit_growth_yoy": ("financialData", "profitGrowth"),
    "eps_growth_yoy": ("defaultKeyStatistics", "earningsQuarterlyGrowth"),
    "debt_equity": ("financialData", "debtToEquity"),
    "current_ratio": ("financialData", "currentRatio"),
    "quick_ratio": ("financialData", "quickRatio"),
    "eps": ("defaultKeyStatistics", "trailingEps"),
    "bvps": ("defaultKeyStatistics", "bookValue"),
    "dps": ("defaultKeyStatistics", "dividendRate"),
}


def statement_rows(payloads: DataFrame, kind: str, periods: int | None = None) -> DataFrame:
    """Statement payload to one row per (symbol, period); `periods` keeps the first ones if given."""
    outer, inner, fields = STATEMENTS[kind]
    values = "map<string, struct<raw: double>>"
    schema = f"struct<chart: struct<result: array<struct<{outer}: struct<{inner}: array<map<string, {values}>>>>>>>"
    listed = F.get(F.from_json("payload", schema)["chart"]["result"], F.lit(0))[outer][inner]
    rows = payloads.select("symbol", F.explode(listed if periods is None else F.slice(listed, 1, periods)).alias("m"))
    rows = rows.select("symbol", F.explode("m").alias("period", "v"))
    return rows.select(
        F.upper("symbol").alias("symbol"),
        "period",
        F.col("period").try_cast("timestamp").alias("timestamp"),
        *[F.try_element_at("v", F.lit(name))["raw"].alias(c) for name, c in fields.items()],
    )


def ratio_rows(payloads: DataFrame) -> DataFrame:
    """Ratio payload to one typed row; ratios that are absent stay null."""
    groups = "summaryDetail", "defaultKeyStatistics", "financialData"
    values = "map<string, struct<raw: double>>"
    schema = "struct<quoteSummary: struct<result: array<struct<" + ", ".join(f"{g}: {values}" for g in groups) + ">>>>"
    first = F.get(F.from_json("payload", schema)["quoteSummary"]["result"], F.lit(0))
    rows = payloads.select("symbol", first.alias("r"))

    def value(metric: str) -> Column:
        if metric not in RATIO_FIELDS:
            return F.lit(None).cast("double").alias(metric)
        group, name = RATIO_FIELDS[metric]
        return F.try_element_at(F.col(f"r.{group}"), F.lit(name))["raw"].alias(metric)

    return rows.select(F.upper("symbol").alias("symbol"), *map(value, FUNDAMENTAL_METRICS))


def fundamentals(records: DataFrame) -> DataFrame:
    """Fundamental records with upper-case symbol, time, and year and quarter of their period."""
    out = records.withColumn("symbol", F.upper("symbol"))
    if "timestamp" not in out.columns:
        out = out.withColumn("timestamp", F.current_timestamp())
    out = out.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if "period" in out.columns:
        period = F.col("period").cast("timestamp")
        out = out.withColumns({"period": period, "year": F.year(period), "quarter": F.quarter(period)})
    return out


# --- macro series ----------------------------------------------------------------------------------------

# Interest rates and price index used when no source row was read.
FALLBACK_RATES = [("OMO", 0.045), ("REPO", 0.04), ("DEPOSIT_12M", 0.055)]
FALLBACK_CPI = (100.0, 0.035, 0.002)


def fx_rows(cells: DataFrame, pair: str = "USD/VND") -> DataFrame:
    """(label, first, second) cells to exchange rates; mid = mean of both when both are there."""
    keep = F.contains(F.col("label"), F.lit(pair)) | F.contains(F.col("label"), F.lit("USD"))
    buy, sell = F.col("first"), F.col("second")
    mid = F.when((buy != 0) & (sell != 0), (buy + sell) / 2)
    return cells.filter(keep).select(
        "timestamp", F.lit(pair).alias("currency_pair"), buy.alias("buy_rate"), sell.alias("sell_rate"), mid.alias("mid_rate")
    )


def gold_rows(cells: DataFrame, world: DataFrame | None = None) -> DataFrame:
    """Local gold prices by place, and the world price from chart bars."""
    both = F.coalesce((F.col("first") != 0) & (F.col("second") != 0), F.lit(False))
    local = cells.filter(both).select(
        "timestamp", F.lit("SJC_GOLD").alias("commodity"), F.col("label").alias("location"),
        F.col("first").alias("buy_price"), F.col("second").alias("sell_price"), F.lit("VND/luong").alias("unit"),
    )
    if world is None:
        return local
    return local.unionByName(
        world.select(
            "timestamp", F.lit("GOLD").alias("commodity"), F.lit("WORLD").alias("location"),
            F.col("close").alias("buy_price"), F.col("close").alias("sell_price"), F.lit("USD/oz").alias("unit"),
        )
    )


def oil_rows(bars: DataFrame) -> DataFrame:
    """Oil prices from chart bars whose symbol is the futures name."""
    name = F.when(F.col("symbol") == "CL=F", "WTI_OIL").when(F.col("symbol") == "BZ=F", "BRENT_OIL").otherwise(F.col("symbol"))
    return bars.select("timestamp", name.alias("commodity"), F.col("close").alias("price"), F.lit("USD/barrel").alias("unit"))


def _or_default(rows: DataFrame, default: DataFrame | None) -> DataFrame:
    """`default` rows, if any are given, only where `rows` is empty; `is_default` tells which they are."""
    rows = rows.withColumn("is_default", F.lit(False))
    if default is None:
        return rows
    empty = rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty")).scalar()
    return rows.unionByName(default.withColumn("is_default", F.lit(True)).filter(empty), allowMissingColumns=True)


def rate_rows(cells: DataFrame, now: str | Column, defaults: bool = False) -> DataFrame:
    """(label, first) cells to interest rates as fractions; with `defaults` the fixed rates, marked, when there are none."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    rows = cells.filter(F.coalesce("first", F.lit(0.0)) != 0).select(
        "timestamp", F.col("label").alias("rate_type"), (F.col("first") / 100).alias("rate_value"), F.lit("percent").alias("unit")
    )
    if not defaults:
        return _or_default(rows, None)
    fixed = cells.sparkSession.createDataFrame(FALLBACK_RATES, "rate_type string, rate_value double")
    return _or_default(rows, fixed.select(now.alias("timestamp"), "rate_type", "rate_value", F.lit("percent").alias("unit")))


def cpi_rows(cells: DataFrame, now: str | Column, defaults: bool = False) -> DataFrame:
    """(label, first) cells to price-index rows; with `defaults` one fixed row, marked, when there are none."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    rows = cells.filter(F.coalesce("first", F.lit(0.0)) != 0).select(
        "timestamp", F.lit("CPI").alias("indicator"), F.col("label").alias("period"), F.col("first").alias("value"), F.lit("index").alias("unit")
    ).withColumns({"yoy_change": F.lit(None).cast("double"), "mom_change": F.lit(None).cast("double")})
    if not defaults:
        return _or_default(rows, None)
    fixed = cells.sparkSession.createDataFrame([FALLBACK_CPI], "value double, yoy_change double, mom_change double")
    return _or_default(
        rows,
        fixed.select(
            now.alias("timestamp"), F.lit("CPI").alias("indicator"), F.date_format(now, "yyyy-MM").alias("period"),
            "value", F.lit("index").alias("unit"), "yoy_change", "mom_change",
        ),
    )


def macro_long(families: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One long table (series, timestamp, value, source) from {source: (frame, name column, value column)}."""
    out = None
    for source, (df, name, value) in families.items():
        part = df.select(
            F.col(name).alias("series"), "timestamp", F.col(value).cast("double").alias("value"), F.lit(source).alias("source")
        )
        out = part if out is None else out.unionByName(part)
    return out
