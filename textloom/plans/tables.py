"""Chunkers as SQL table functions: SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_token(d.text, 64, 8) c."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.embedders import adapt, adapt_tokens
from ..kernels import chunkers as K
from ..kernels.spans import counter
from ..kernels.windows import ByteOptions, byte_chunks

RETURNS = "chunk_index bigint, start_index bigint, end_index bigint, token_count bigint, text string"


def _made(function, build, decode: bool = True):
    class Chunks:
        def eval(self, text, *args):
            if text is None:
                return
            if getattr(self, "args", None) != args:
                self.args, self.kernel = args, function(build(*args))
            data = text.encode() if isinstance(text, str) else bytes(text)
            for i, (s, e, n, piece) in enumerate(self.kernel(data)):
                yield i, s, e, n, piece.decode() if decode else piece

    return Chunks


def _pieces(kernel):
    def function(options):
        count = counter(options.tokenizer)

        def run(data):
            for piece in kernel(data, options, count):
                yield piece if len(piece) > 3 else (*piece, data[piece[0] : piece[1]])

        return run

    return function


def _bytes(options):
    return lambda data: ((s, e, e - s, data[s:e]) for s, e in byte_chunks(data, options))


FUNCTIONS = {
    "chunk_token": (_pieces(K.token_chunks), lambda size=2048, overlap=0, tokenizer="character": K.TokenOptions(size, overlap, tokenizer)),
    "chunk_sentence": (_pieces(K.sentence_chunks), lambda size=2048, overlap=0, tokenizer="character": K.SentenceOptions(size, overlap, tokenizer=tokenizer)),
    "chunk_recursive": (_pieces(K.recursive_chunks), lambda size=2048, least=24, tokenizer="character": K.RecursiveOptions(size, least, tokenizer=tokenizer)),
    "chunk_code": (_pieces(K.code_chunks), lambda size=2048, language="auto", tokenizer="character": K.CodeOptions(size, language, tokenizer)),
    "chunk_table": (_pieces(K.table_chunks), lambda size=3, tokenizer="row": K.TableOptions(size, tokenizer)),
    "chunk_bytes": (_bytes, lambda size=4096, delimiters="\n.?": ByteOptions(size, delimiters.encode())),
}


def _embedded(embedder, token_embedder) -> dict:
    """Table functions of chunkers that need a model."""
    found = {}
    if embedder is not None:
        model = adapt(embedder)

        def semantic(options):
            count = counter(options.tokenizer)
            return lambda data: ((s, e, n, data[s:e]) for s, e, n in K.semantic_chunks(data, options, count, model))

        found["chunk_semantic"] = (semantic, lambda threshold=0.8, size=2048: K.SemanticOptions(float(threshold), size))
        found["chunk_sdpm"] = (semantic, lambda threshold=0.8, size=2048, skip=1: K.SemanticOptions(float(threshold), size, skip_window=skip))
    if token_embedder is not None:
        tokens, whole = adapt_tokens(token_embedder)

        def late(options):
            count = counter(options.tokenizer)
            return lambda data: ((s, e, (n, v.tolist()), data[s:e]) for s, e, n, v in K.late_chunks(data, options, count, tokens, whole))

        found["chunk_late"] = (late, lambda size=2048, least=24: K.LateOptions(size, least))
    return found


def _late(function, build):
    made = _made(function, build)

    class Chunks(made):
        def eval(self, text, *args):
            for i, s, e, (n, v), piece in made.eval(self, text, *args):
                yield i, s, e, n, piece, v

    return Chunks


def register(spark: SparkSession, embedder=None, token_embedder=None) -> list[str]:
    """Registers the table functions in a session, those with a model if one is given; returns their names. Rows travel as Arrow batches."""
    functions = FUNCTIONS | _embedded(embedder, token_embedder)
    for name, (function, build) in functions.items():
        if name == "chunk_late":
            made, kind = _late(function, build), RETURNS + ", embedding array<float>"
        elif name == "chunk_bytes":
            made, kind = _made(function, build, decode=False), RETURNS.replace("text string", "data binary")
        else:
            made, kind = _made(function, build), RETURNS
        spark.udtf.register(name, udtf(made, returnType=kind, useArrow=True))
    return list(functions)
