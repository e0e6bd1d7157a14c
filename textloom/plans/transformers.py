"""Chunkers as pyspark.ml transformers, and records for retrieval stores."""

from __future__ import annotations

import json

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking

KINDS = ("token", "sentence", "recursive", "code", "table", "semantic", "sdpm", "late", "bytes")
_BY_NAME = {kind: getattr(chunking, f"chunk_{kind}") for kind in KINDS}


class ChunkTransformer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Rows to a row for each chunk; all other columns (a document's metadata) are copied.

    Semantic, sdpm and late take an ``embedder``, which is not saved with the stage: set ``embedder`` after loading one.
    """

    kind = Param(Params._dummy(), "kind", "the chunker", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "the chunker's options as JSON", TypeConverters.toString)

    def __init__(self, kind: str = "recursive", inputCol: str = "text", outputCol: str = "text", embedder=None, **options):
        super().__init__()
        if kind not in _BY_NAME:
            raise ValueError(f"kind must be one of {sorted(_BY_NAME)}")
        self.embedder = embedder
        self._setDefault(inputCol="text", outputCol="text", kind="recursive", options="{}")
        self._set(inputCol=inputCol, outputCol=outputCol, kind=kind, options=json.dumps(options))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, column, output = self.getOrDefault(self.kind), self.getInputCol(), self.getOutputCol()
        options = json.loads(self.getOrDefault(self.options))
        if kind == "bytes":
            return chunking.chunk_bytes(dataset, column, output=output, **options)
        model = {"embedder": self.embedder} if kind in ("semantic", "sdpm", "late") else {}
        out = _BY_NAME[kind](dataset, text=column, **model, **options)
        return out.withColumnRenamed("text", output) if output != "text" else out


def retrieval_records(df: DataFrame, text: str = "text", id_col: str = "id", metadata: str = "meta_data", kind: str = "recursive", **options) -> DataFrame:
    """A record for each chunk: id "{id}_{i}" (from 1; NULL without an id), and metadata with chunk and chunk_size (code points).

    Documents of empty text stay as they are.
    """
    options = {"chunk_size": 5000, **options} if kind == "recursive" else options
    empty = df.where((F.col(text) == "") | F.col(text).isNull())
    made = _BY_NAME[kind](df.where(F.col(text) != ""), text=text, **options)
    number = F.col("chunk_index") + 1
    plain = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")) if metadata in df.columns else F.create_map().cast("map<string,string>")
    added = F.create_map(F.lit("chunk"), number.cast("string"), F.lit("chunk_size"), F.char_length("text").cast("string"))
    base = F.map_filter(plain.cast("map<string,string>"), lambda k, v: ~k.isin("chunk", "chunk_size"))
    made = made.withColumn(metadata, F.map_concat(base, added)).withColumn(id_col, F.when(F.col(id_col).isNotNull(), F.concat(F.col(id_col).cast("string"), F.lit("_"), number.cast("string"))))
    if text != "text":
        made = made.withColumnRenamed("text", text)
    empty = empty.withColumn(metadata, plain.cast("map<string,string>")).withColumn(id_col, F.col(id_col).cast("string"))
    columns = list(dict.fromkeys([*df.columns, metadata]))
    return made.select(*columns).unionByName(empty.select(*columns))
