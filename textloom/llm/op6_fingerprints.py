"""Document fingerprints: a threshold-scaled sketch keeps every shingle hash below a fixed fraction of the hash range.

Shingles are runs of ``size`` WORD tokens (a shorter text is one shingle), hashed to 64 bits; a document's sketch is
the sorted set of its hashes below 2**64 / scale.  Since the threshold is the same for all, sketches of a union are
unions of sketches, and |A and B| / |A| of the sketches estimates how much of A is contained in B, however unequal
the two are.

Defined cases: NULL and token-less texts have no shingle and an empty sketch; a row gives a row, so repeated rows
repeat; an empty table gives none; a NULL doc_id stays NULL; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import lean
from .text import WORD, shingle_hashes, slices

SIZE, SCALE = 5, 20
RESULT = "doc_id long, n_shingles long, sketch array<long>"


def _sketches(size: int, scale: int):
    limit = np.uint64(((1 << 64) - 1) // scale)

    def run(batches):
        for b in batches:
            for s in slices(b.column(1), WORD, lower=True, target=1 << 19):
                rows = len(s.first) - 1
                h, row = shingle_hashes(s, size)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                total = np.bincount(row, minlength=rows)
                kept = h <= limit
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.rows.start, rows), pa.array(total, pa.int64()), lists], names=["doc_id", "n_shingles", "sketch"])

    return run


def sketch(docs: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of distinct shingles, and the sketch. No shuffle."""
    if size < 1 or scale < 1:
        raise ValueError("size and scale must be positive")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_sketches(size, scale)), RESULT)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of a's shingles that b has; NULL where a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketch of each group's union, by a partial set aggregation."""
    hashes = sketches.select(*keys, F.explode("sketch").alias("h")).distinct()
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def contained(small: DataFrame, large: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (small_id, large_id, shared, containment) where at least so much of the small sketch is in the large one; a join on hashes."""
    a = small.select(F.col("doc_id").alias("small_id"), F.size("sketch").alias("n"), F.explode("sketch").alias("h"))
    b = large.select(F.col("doc_id").alias("large_id"), F.explode("sketch").alias("h"))
    return a.join(b, "h").groupBy("small_id", "large_id").agg(F.count("*").alias("shared"), F.first("n").alias("n")).select("small_id", "large_id", "shared", (F.col("shared") / F.col("n")).alias("containment")).where(F.col("containment") >= least)
