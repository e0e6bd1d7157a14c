"""Chunkers over DataFrames: every input row gives a row for each of its chunks, with all other columns kept.

Chunking is local to a row: no operator here shuffles, and each works unchanged on a streaming DataFrame in append mode.  Only
the text (or bytes) and a row number inside the Arrow batch enter the kernels' loops; other columns are repeated by Arrow.
NULL texts give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import chunkers as K
from ..kernels.memory import trim
from ..kernels.spans import counter, encode_all, include_mode, lines, split
from ..kernels.windows import ByteOptions, byte_chunks

MOST_BYTES = 1 << 20
_CHUNK = [T.StructField("chunk_index", T.LongType()), T.StructField("start_index", T.LongType()), T.StructField("end_index", T.LongType()), T.StructField("token_count", T.LongType()), T.StructField("text", T.StringType())]


class _Rows:
    """Collects chunks and makes record batches of a bounded size."""

    def __init__(self, batch: pa.RecordBatch, kept: list[int], fields: list[T.StructField], schema: pa.Schema):
        self.batch, self.kept, self.schema, self.n = batch, kept, schema, len(fields)
        self.clear()

    def clear(self):
        self.row, self.values, self.bytes = [], [], 0

    def add(self, row: int, values: tuple, size: int) -> None:
        self.row.append(row)
        self.values.append(values)
        self.bytes += size

    def flush(self) -> pa.RecordBatch:
        at = pa.array(self.row, pa.int64())
        columns = [self.batch.column(k).take(at) for k in self.kept]
        made = list(zip(*self.values)) if self.values else [()] * self.n
        types = [f.type for f in self.schema][len(self.kept) :]
        columns += [pa.array(m, pa.binary()).cast(t) if pa.types.is_string(t) and m and isinstance(m[0], bytes) else pa.array(m, t) for m, t in zip(made, types)]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def expand(df: DataFrame, column: str, fields: list[T.StructField], kernel: Callable[[], Callable], batched: bool = False) -> DataFrame:
    """Rows of ``df`` repeated for each tuple that the kernel makes of ``column``; ``kernel()`` is built once a task.

    It takes the bytes of a row, or with ``batched`` a list of them (of ``MOST_BYTES`` or one row) and gives the rows' tuples one by one.
    A column of ``df`` with the name of a new one is replaced, ``column`` included.  Whatever the size of Spark's batches, Python objects
    are made of ``MOST_BYTES`` of them (or one row) at a time, as many go out, and free memory is given back as the task goes on.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    new = {f.name for f in fields}
    others = [c for c in df.columns if c not in new and c != column]
    source = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").cast("binary").alias("__data"))
    schema = T.StructType([source.schema[c] for c in others] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, arrow = kernel(), None
        for b in batches:
            if arrow is None:
                arrow = pa.schema([b.schema.field(i) for i in range(len(others))] + [pa.field(f.name, _arrow(f.dataType)) for f in fields])
            for part in _parts(b, len(others)):
                rows = _Rows(part, list(range(len(others))), fields, arrow)
                for i, found in _made(part.column(len(others)).to_pylist(), made, batched):
                    for values in found:
                        rows.add(i, values, 64 + sum(len(v) for v in values if isinstance(v, (bytes, str))))
                        if rows.bytes >= MOST_BYTES:
                            yield rows.flush()
                if rows.row:
                    yield rows.flush()
                del rows, part
                trim()

    return source.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``MOST_BYTES`` of a binary column, or of one row, whose column counts as 64 bytes more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _made(column: list[bytes | None], kernel, batched: bool) -> Iterator[tuple[int, Iterable[tuple]]]:
    """(row, its tuples) of the rows that aren't NULL."""
    known = [(i, data) for i, data in enumerate(column) if data is not None]
    if not batched:
        yield from ((i, kernel(data)) for i, data in known)
    elif known:
        yield from zip((i for i, _ in known), kernel([data for _, data in known]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ensure_parallelism(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread few large input splits over the cluster; streaming and well-spread inputs are left alone."""
    if df.isStreaming:
        return df
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def _texts(pieces):
    def run(data: bytes):
        return [(i, s, e, n, data[s:e]) for i, (s, e, n) in enumerate(pieces(data))]

    return run


def _chunked(df: DataFrame, text: str, options, function) -> DataFrame:
    made = counter(options.tokenizer)
    return expand(df, text, _CHUNK, lambda: _texts(lambda data: function(data, options, made)))


def chunk_token(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Windows of ``chunk_size`` tokens; time and memory are linear in a text's length."""
    return _chunked(df, text, K.TokenOptions(**options), K.token_chunks)


def chunk_sentence(df: DataFrame, text: str = "text", **options) -> DataFrame:
    return _chunked(df, text, K.SentenceOptions(**options), K.sentence_chunks)


def chunk_recursive(df: DataFrame, text: str = "text", **options) -> DataFrame:
    return _chunked(df, text, K.RecursiveOptions(**options), K.recursive_chunks)


def chunk_code(df: DataFrame, text: str = "text", **options) -> DataFrame:
    return _chunked(df, text, K.CodeOptions(**options), K.code_chunks)


def chunk_table(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The text of a chunk repeats the table's header and footer; its offsets are those of its rows."""
    o = K.TableOptions(**options)
    made = counter(o.tokenizer)
    return expand(df, text, _CHUNK, lambda: lambda data: [(i, *piece) for i, piece in enumerate(K.table_chunks(data, o, made))])


def chunk_semantic(df: DataFrame, embedder, text: str = "text", **options) -> DataFrame:
    """Cuts where the similarity of a window of sentences to the next one is least. ``embedder``: see ``adapt``; it is called for many rows at once."""
    from ..functions.embedders import adapt

    o, model = K.SemanticOptions(**options), adapt(embedder)
    made = counter(o.tokenizer)

    def run(texts: list[bytes]):
        return [[(i, s, e, n, data[s:e]) for i, (s, e, n) in enumerate(found)] for data, found in zip(texts, K.semantic_batch(texts, o, made, model))]

    return expand(df, text, _CHUNK, lambda: run, batched=True)


def chunk_sdpm(df: DataFrame, embedder, text: str = "text", **options) -> DataFrame:
    """Semantic chunks, then groups that a short digression parts are joined (``skip_window`` 1 by default)."""
    options = {"skip_window": 1, **options}
    if options["skip_window"] < 1:
        raise ValueError("skip_window must be 1 or more")
    return chunk_semantic(df, embedder, text, **options)


def chunk_late(df: DataFrame, embedder, text: str = "text", **options) -> DataFrame:
    """Recursive chunks with the mean vector of their tokens; token_count is the number of vectors pooled."""
    from ..functions.embedders import adapt_tokens

    o, (tokens, whole) = K.LateOptions(**options), adapt_tokens(embedder)
    made = counter(o.tokenizer)
    fields = [*_CHUNK, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    return expand(df, text, fields, lambda: lambda data: [(i, s, e, n, data[s:e], v.tolist()) for i, (s, e, n, v) in enumerate(K.late_chunks(data, o, made, tokens, whole))])


def chunk_bytes(df: DataFrame, column: str = "text", output: str = "data", **options) -> DataFrame:
    """Size-bounded byte chunks as BINARY rows; a hard cut may part a code point."""
    o = _byte_options(options)
    fields = [*_CHUNK[:3], T.StructField(output, T.BinaryType())]
    return expand(df, column, fields, lambda: lambda data: [(i, s, e, data[s:e]) for i, (s, e) in enumerate(byte_chunks(data, o))])


def chunk_offsets(df: DataFrame, column: str = "text", **options) -> DataFrame:
    """The offsets of ``chunk_bytes`` alone."""
    o = _byte_options(options)
    return expand(df, column, _CHUNK[:3], lambda: lambda data: [(i, s, e) for i, (s, e) in enumerate(byte_chunks(data, o))])


def _byte_options(options: dict) -> ByteOptions:
    for name in ("delimiters", "pattern"):
        if isinstance(options.get(name), str):
            options = {**options, name: options[name].encode()}
    if "patterns" in options:
        options = {**options, "patterns": tuple(options["patterns"] or ())}
    return ByteOptions(**options)


def split_text(df: DataFrame, delimiters: Iterable[str | bytes] = ("\n", ".", "?"), text: str = "text", include_delim: str = "prev", min_chars: int = 0) -> DataFrame:
    """pos, start, end (bytes) and segment of every span between delimiters or patterns (leftmost, then first listed)."""
    if min_chars < 0:
        raise ValueError("min_chars must not be negative")
    marks, include = encode_all(delimiters), include_mode(include_delim, exact=True)
    return _spans(df, text, lambda data: split(data, marks, include, min_chars))


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return _spans(df, text, lines)


def _spans(df: DataFrame, text: str, function) -> DataFrame:
    fields = [T.StructField("pos", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("segment", T.StringType())]
    return expand(df, text, fields, lambda: lambda data: [(i, s, e, data[s:e]) for i, (s, e) in enumerate(function(data))])


def token_spans(df: DataFrame, text: str = "text", tokenizer: str = "character") -> DataFrame:
    """pos, start and end of each token."""
    made = counter(tokenizer)
    fields = [T.StructField("pos", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    return expand(df, text, fields, lambda: lambda data: [(i, s, e) for i, (s, e) in enumerate(made.spans(data))])


