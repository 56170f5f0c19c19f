"""Shared helpers: input columns, folders that all executors see, stored intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local session may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "") -> DataFrame:
    """Write a table that several steps read, and read it again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named input columns, absent ones as typed nulls; further columns of the table are left alone."""
    kinds = {"text": "string", "lang": "string", "source": "string", "html": "string", "url": "string"}
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast(kinds.get(n, "long")).alias(n) for n in names])


def release() -> None:
    """Give memory that a task has freed back to the system; Python workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
