"""Chunking of streams: documents that arrive in a folder are chunked and appended to a table, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def chunk_stream(spark: SparkSession, source: str, schema, chunk: Callable[[DataFrame], DataFrame], format: str = "parquet") -> DataFrame:
    """A streaming DataFrame of chunks: no state and no watermark, as chunking is local to a row."""
    return chunk(spark.readStream.schema(schema).format(format).load(source))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append mode into a Parquet table; the checkpoint makes each document's chunks arrive once."""
    return chunks.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
