"""Cut a plan that several later steps read, through a table in the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from barlake.session import checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the folder named by `spark.checkpoint.dir`; the plan itself where it names none."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As `materialize`, for plans that must be written; only a local session may do without the setting."""
    spark = df.sparkSession
    top = checkpoint_dir(spark)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="barlake-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
