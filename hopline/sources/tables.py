"""Parquet tables with event times as timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; columns without a time zone become UTC timestamps, as watermarks need them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
