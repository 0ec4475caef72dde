"""Tables that a query works off in steps, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.streaming.events import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table and read again; the folder goes when the session ends. A lost executor costs a file's tasks, not the lineage before them."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
