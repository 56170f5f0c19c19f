"""Keyed stream state over many micro-batches with a restart after each one."""

import pandas as pd
import pytest

from barlake.operators.resample import resample_one
from barlake.sources.tables import Lake
from barlake.streaming import sources, state
from tests.conftest import collect, make_bars


def hourly(rows, symbols=("AAPL", "MSFT")):
    pdf = make_bars(rows, symbols=symbols)
    pdf["timestamp"] = pdf.groupby("symbol").cumcount().map(lambda i: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i))
    return pdf


class Runs:
    """Lands one frame after another; every landing is a restart of the query from its checkpoint."""

    def __init__(self, spark, tmp, build):
        self.spark, self.tmp, self.build, self.kept = spark, tmp, build, []

    def land(self, pdf):
        self.spark.createDataFrame(pdf).select(sources.BAR.names).write.mode("append").parquet(f"{self.tmp}/in")
        out = self.build(sources.bar_files(self.spark, f"{self.tmp}/in", per_batch=sources.WHOLE_LANDING))
        writer = out.writeStream.format("parquet").option("path", f"{self.tmp}/out").option("checkpointLocation", f"{self.tmp}/cp")
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination(120)
        assert running.exception() is None
        self.kept += [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
        self.schema = out.schema

    def rows(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.tmp}/out")


def test_newer_only_over_six_batches(spark, tmp_path):
    pdf = hourly(120)
    runs, seen, want = Runs(spark, tmp_path, state.newer_only), {}, []
    for k in range(6):
        # the landing before once more, an old bar of one symbol, and from the third on a new symbol
        part = pdf[pdf.groupby("symbol").cumcount().between((k - 1) * 20, (k + 1) * 20 - 1)]
        if k >= 2:
            part = pd.concat([part, pdf.iloc[[k]].assign(symbol="LATE"), pdf.iloc[[k]].assign(symbol="LATE")])
        runs.land(part)
        before = dict(seen)
        for s, t in zip(part["symbol"], part["timestamp"]):
            if s not in before or t > before[s]:
                want.append((s, t))
            seen[s] = max(t, seen.get(s, t))
    got = runs.rows().toPandas()
    assert sorted(zip(got["symbol"], got["timestamp"])) == sorted(want)
    assert max(runs.kept) == 3  # one entry per symbol, however many batches


@pytest.mark.parametrize("keep", ["30 days", "12 hours"])
def test_late_rows_revise_closed_buckets(spark, tmp_path, keep):
    pdf = hourly(96)
    # four-hour buckets; every ninth bar comes two landings late
    place = pdf.groupby("symbol").cumcount()
    landing = (place // 16 + (place % 9 == 4) * 2).clip(upper=5)
    runs = Runs(spark, tmp_path, lambda bars: state.revised_bars(bars, "4 hours", "1 hour", keep))
    for k in range(6):
        runs.land(pdf[landing == k])
    changes = runs.rows().toPandas()
    bars = changes[changes["op"] == "+"].sort_values("revision").groupby(["symbol", "timestamp"]).last().reset_index()
    whole = collect(resample_one(spark.createDataFrame(pdf), "4 hours"), "symbol", "timestamp")
    late = changes[changes["op"] == "late"]
    closed = whole[whole["timestamp"] + pd.Timedelta("5 hours") <= pdf["timestamp"].max()]
    if keep == "30 days":
        assert late.empty and (bars["revision"] > 0).any()
        both = closed.merge(bars, on=["symbol", "timestamp"], suffixes=("", "_s"))
        assert len(both) == len(closed) == len(bars)
        for c in ("open", "high", "low", "close", "volume"):
            assert (both[c] == both[f"{c}_s"]).all()
        # each revision takes back exactly the bar that was published before
        plus, minus = (changes[changes["op"] == op] for op in "+-")
        taken = minus.merge(plus, on=["symbol", "timestamp", "revision", "open", "high", "low", "close", "volume"])
        assert len(taken) == len(minus) == (plus["revision"] > 0).sum()
    else:
        # nothing is lost: what came too late is in the side rows
        assert len(late)
        assert bars["volume"].sum() + late["volume"].sum() == closed["volume"].sum()


def test_symbols_without_usable_rows(spark, tmp_path):
    pdf = hourly(30)
    pdf.loc[0:4, "timestamp"] = pd.NaT
    runs = Runs(spark, tmp_path, lambda bars: state.revised_bars(bars, "4 hours"))
    runs.land(pdf.iloc[:5])
    assert runs.rows().count() == 0
    runs.land(pdf)
    assert runs.rows().count() > 0
