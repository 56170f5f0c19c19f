"""Registry of named queries: DataFrame callable, check SQL and output columns side by side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.plans.views import Tables, with_views
from barlake.session import checkpoint_dir

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Doubles are cut to a fixed number of decimals on both sides. The offset is not 0.5, so that
# values exactly half way (frequent in means of prices with two decimals) are no ties.
OFFSET = 0.4975


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((item + ":").split(":")[:2]) for item in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    """Project `name[:kind]`: digits round, `eN` keeps N decimals of the mantissa, `i` is a bigint, `t` a timestamp, `d` a date, none is kept."""
    types = dict(df.dtypes)
    out = []
    for name, kind in _columns(spec):
        c = F.col(f"`{name}`")
        if kind.isdigit():
            scale = F.lit(float(10 ** int(kind)))
            c = F.floor(c * scale + F.lit(OFFSET)) / scale
        elif kind[:1] == "e":
            c = F.format_string(f"%.{kind[1:]}e", c).cast("double")
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        elif kind == "i":
            c = c.cast("long")
        elif kind == "t" or types[name].startswith("timestamp"):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(sql: str, spec: str, views: str = "") -> str:
    out = []
    for name, kind in _columns(spec):
        c = f'"{name}"'
        if kind.isdigit():
            scale = f"CAST({10 ** int(kind)} AS DOUBLE)"
            c = f"floor({c} * {scale} + CAST({OFFSET} AS DOUBLE)) / {scale}"
        elif kind[:1] == "e":
            c = f"CAST(printf('%.{kind[1:]}e', CAST({c} AS DOUBLE)) AS DOUBLE)"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "t":
            c = f"CAST({c} AS TIMESTAMP)"
        out.append(f'{c} AS "{name}"')
    ctes = with_views(views)
    ctes = f"{ctes}, " if ctes else ""
    return f"WITH RECURSIVE {ctes}result AS ({sql}) SELECT {', '.join(out)} FROM result"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local session may do without that setting."""
    top = checkpoint_dir(spark)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(key: str, spec: str, sql: str | None = None, views: str = ""):
    """Register the decorated `f(tables)` under `key`."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(fn(Tables(spark, sf_dir)), spec)

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = finish_sql(sql, spec, views)
        return fn

    return register
