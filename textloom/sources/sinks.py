"""Sinks for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_chunks(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Writes chunks as they are, without a shuffle."""
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
