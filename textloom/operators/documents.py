"""Documents: files to Markdown, Markdown to segments and to structure-aware chunks, all local to a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.markdown import DocumentOptions, document_chunks, segment_markdown
from ..sources.formats import PASS_THROUGH, SUPPORTED, DocumentError, convert
from .chunking import expand

_L, _S = T.LongType(), T.StringType()
ERROR = T.StructType([T.StructField("type", _S), T.StructField("message", _S), T.StructField("part", _S), T.StructField("limit", _S)])
SEGMENT = [T.StructField(n, t) for n, t in (("pos", _L), ("kind", _S), ("char_start", _L), ("char_end", _L), ("byte_start", _L), ("byte_end", _L), ("heading_path", T.ArrayType(_S)), ("lang", _S))]
_PIECE = [T.StructField(n, t) for n, t in (("chunk_index", _L), ("text", _S), ("md_start", _L), ("md_end", _L), ("kind", _S), ("heading_path", T.ArrayType(_S)), ("lang", _S), ("token_count", _L), ("is_exact", T.BooleanType()))]
CHUNKED = [T.StructField("chunks", T.ArrayType(T.StructType(_PIECE))), T.StructField("warnings", T.ArrayType(_S))]


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files as path, content, length and modificationTime; missing ones fail as Spark's readers do."""
    return spark.read.format("binaryFile").options(**options).load(path)


def convert_documents(df: DataFrame, content: str = "content", path: str | None = "path", format: str | None = None, on_error: str = "raise") -> DataFrame:
    """Adds markdown, source_format and error (type, message, part, limit).

    ``on_error``: raise fails the job, skip drops the row, collect keeps it with its error. A column ``format`` in ``df`` names
    a row's format if the argument doesn't.
    """
    if on_error not in ("raise", "skip", "collect"):
        raise ValueError("on_error must be raise, skip or collect")
    if format is not None and format.lower().lstrip(".") not in SUPPORTED | PASS_THROUGH:
        raise ValueError(f"unsupported format {format!r}")
    named = F.lit(format) if format is not None else F.col("format") if "format" in df.columns else F.lit(None)
    where = F.col(path) if path and path in df.columns else F.lit(None)
    source = df.select("*", F.struct(F.col(content).alias("content"), named.cast("string").alias("format"), where.cast("string").alias("path")).alias("__source"))
    kind = T.StructType([T.StructField("markdown", _S), T.StructField("format", _S), T.StructField("error", ERROR)])

    @F.pandas_udf(kind)
    def converted(batch):
        import pandas as pd

        rows = []
        for data, name, file in zip(batch["content"], batch["format"], batch["path"]):
            if data is None:
                rows.append((None, None, None))
                continue
            try:
                rows.append((*convert(bytes(data), name, file), None))
            except (DocumentError, ValueError) as error:
                if on_error == "raise":
                    raise
                rows.append((None, None, {"type": type(error).__name__, "message": str(error), "part": getattr(error, "part", None), "limit": getattr(error, "limit", None)}))
        return pd.DataFrame(rows, columns=["markdown", "format", "error"])

    out = source.withColumn("__made", converted("__source"))
    keep = [c for c in df.columns if c not in ("markdown", "source_format", "error")]
    out = out.select(*keep, F.col("__made.markdown").alias("markdown"), F.col("__made.format").alias("source_format"), F.col("__made.error").alias("error"))
    return out.where("error is null") if on_error == "skip" else out


def segment_documents(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """A row for each structural segment, with offsets in code points and bytes and its heading path."""
    return expand(df, markdown, SEGMENT, lambda: lambda data: [(i, s.kind, s.char_start, s.char_end, s.byte_start, s.byte_end, list(s.heading_path), s.lang) for i, s in enumerate(segment_markdown(data.decode()))])


def chunk_markdown(df: DataFrame, markdown: str = "markdown", **options) -> DataFrame:
    """A row for each structure-aware chunk; options are those of ``DocumentOptions``."""
    o = DocumentOptions(**options)
    return expand(df, markdown, _PIECE, lambda: lambda data: [(i, *piece) for i, piece in enumerate(document_chunks(data.decode(), o)[0])])


def chunk_documents(df: DataFrame, content: str = "content", path: str | None = "path", format: str | None = None, on_error: str = "raise", **options) -> DataFrame:
    """Files to chunks: conversion, then ``chunk_markdown``; rows with an error give none (see ``document_table`` for those)."""
    made = convert_documents(df, content, path, format, on_error).drop(content)
    return chunk_markdown(made, **options)


def document_table(df: DataFrame, markdown: str = "markdown", **options) -> DataFrame:
    """A row for each document: its Markdown, its chunks as an array, and warnings."""
    o = DocumentOptions(**options)
    kept = df.select("*", F.col(markdown).alias("__md"))
    names = [f.name for f in _PIECE]

    def made(data: bytes):
        pieces, warnings = document_chunks(data.decode(), o)
        return [([dict(zip(names, (i, *p))) for i, p in enumerate(pieces)], warnings)]

    return expand(kept, "__md", CHUNKED, lambda: made)
