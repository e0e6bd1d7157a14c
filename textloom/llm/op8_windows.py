"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of tokens, counted; repeats merge into intervals.

Tokens are runs without ASCII white space.  Every window of every document is hashed (64 bits) and sent to the
bucket of its hash in a packed exchange; a window that occurs more than once is repeated.  The least
(doc_id, position) among a repeated window's occurrences is its first occurrence, the others are later ones.
Windows that overlap or touch merge to maximal intervals, by document and role.

Occurrences are combined before the exchange: of a window that occurs several times among some 2 million, only the least occurrence
goes to the hash's bucket, marked as one that occurs again; the others are later ones for certain and go past the
count to their document's bucket.  So a window of any number of copies sends a row for each 2 million windows to one place.

Defined cases: a NULL or short text has no window; an empty table gives no rows; rows of one doc_id count as
copies of one document, whose intervals are pooled (at the same position they tie, and all are first); a NULL
doc_id is an id of its own, less than all others (an id of -2**63 is read as NULL); further columns are ignored; a very long text
is read in pieces of 8 MB, in memory by its number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import batch, buckets, combined, gather, lean, lean_table, pack, split, unpack
from .text import RAW, ids_back, ids_of, mix, slices, window_hashes, window_starts

WINDOW = 50
FLUSH = 2_000_000
_SENT = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("again", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary()), ("later", pa.binary())])
RESULT = "doc_id long, start_token long, end_token long, n_tokens long, role string"


def _emit(held: list, n: int, m: int):
    """Packed occurrences: by hash in the buckets from 0, those that are later ones for certain by document in the buckets from n."""
    h, doc, pos = (np.concatenate(x) for x in zip(*held))
    least, again, later = combined(h, doc, pos)
    h, d, p = h[least], doc[least], pos[least]
    rows = [(i, pack(h[at], plain=True), pack(d[at]), pack(p[at]), pack(again[at])) for i, at in split((h >> np.uint64(32)) % np.uint64(n), n)]
    d, p = doc[later], pos[later]
    rows += [(n + i, b"", pack(d[at]), pack(p[at]), b"") for i, at in split(home(d, m), m)]
    for k in range(0, len(rows), 256):
        yield batch(_SENT, rows[k : k + 256])


def hashed_windows(size: int, n: int, m: int):
    """mapInArrow function: (doc_id, text) to packed windows by bucket."""

    def run(batches):
        held, count = [], 0
        for b in batches:
            ids = ids_of(b.column(0))
            for s in slices(b.column(1), RAW):
                at, row = window_starts(s.first, size)
                if not len(at):
                    continue
                h = window_hashes(s.hashes, size)[at]
                held.append((h, ids[s.rows][row], (at - s.first[row]).astype(np.int32)))
                count += len(at)
                if count >= FLUSH:
                    yield from _emit(held, n, m)
                    held, count = [], 0
        if held:
            yield from _emit(held, n, m)

    return run


def home(doc: np.ndarray, m: int) -> np.ndarray:
    return mix(doc.astype(np.uint64)) % np.uint64(m)


def occurrences(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, again: np.ndarray):
    """Of the repeated windows: doc, pos, and whether it is a later occurrence."""
    least, again, later = combined(h, doc, pos, again)
    head = least[again]
    return np.concatenate([doc[head], doc[later]]), np.concatenate([pos[head], pos[later]]), np.arange(len(head) + len(later)) >= len(head)


def send_found(doc, pos, later, n: int) -> pa.Table:
    rows = [(i, pack(doc[at]), pack(pos[at]), pack(later[at])) for i, at in split(home(doc, n), n)]
    return pa.Table.from_batches([batch(_FOUND, rows)])


def merged(doc, pos, size: int):
    """Maximal intervals of the windows at pos, by document: doc, start, end."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    if not len(doc):
        return doc, pos, pos
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > size)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(doc)) - 1
    return doc[start], pos[start], pos[end] + size


def intervals(size: int):
    def run(table: pa.Table) -> pa.Table:
        doc, pos, later = gather(table["doc"]), gather(table["pos"]), gather(table["later"])
        parts = []
        for role, keep in (("first", ~later), ("later", later)):
            d, a, z = merged(doc[keep], pos[keep], size)
            parts.append(pa.table([ids_back(d), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(z - a, pa.int64()), pa.array([role] * len(d), pa.string())], names=["doc_id", "start_token", "end_token", "n_tokens", "role"]))
        return pa.concat_tables(parts)

    return run


def repeated_windows(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """Maximal intervals of windows that occur more than once: doc_id, start_token, end_token, n_tokens, role (first, later)."""
    if size < 1:
        raise ValueError("size must be positive")
    n = n or buckets(docs.sparkSession)
    m = max(4, n // 4)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(lean(hashed_windows(size, n, m)), "bucket int, h binary, doc binary, pos binary, again binary")

    def repeats(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= n:  # later ones for certain
            some = [(bucket - n, d, p, pack(np.ones(len(unpack(p)), bool))) for d, p in ((x.as_py(), y.as_py()) for x, y in zip(table["doc"], table["pos"]))]
            return pa.Table.from_batches([batch(_FOUND, some)])
        return send_found(*occurrences(*(gather(table[k]) for k in ("h", "doc", "pos", "again"))), m)

    found = sent.groupBy("bucket").applyInArrow(lean_table(repeats), "bucket int, doc binary, pos binary, later binary")
    return found.groupBy("bucket").applyInArrow(lean_table(intervals(size)), RESULT)
