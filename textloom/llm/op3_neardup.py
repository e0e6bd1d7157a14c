"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A signature has 64 components of 8 bits: the low byte of a mixed minimum of the document's shingles (runs of 2 WORD
tokens, a shorter text is one shingle) under 64 permutations.  The distance of two documents is the number of
components that differ; 64 * (1 - J) is expected at shingle similarity J.  Signatures are cut into 8 chunks, and the
threshold t = 8 r + a (0 <= a < 8; generalised pigeonhole) leaves a chunk of a close pair with at most r errors among the
first a + 1, or r - 1 among the rest: had none, there would be (a + 1)(r + 1) + (7 - a) r = t + 1 errors at least.  Each chunk is indexed with every choice of allowed errors masked out, so any pair within t meets
under one key at least: the join finds all pairs within the threshold, without a cap.

Equal signatures are collapsed first.  Groups that meet under a key are deduplicated as sets of ids, then verified on
whole signatures by a breadth-first search, which compares a document with the yet unreached ones only, and so finds
the components of the threshold graph without listing a large group's pairs.  Components are joined by alternating
large-star and small-star steps; each step is a table in the shared folder.

Defined cases: NULL and token-less texts have no signature and no partner; a NULL doc_id takes no part (its rows
are kept); rows of one doc_id are one document, which is kept or dropped with all its rows and whose signature
is that of its rows' union; an empty table gives no rows; further columns are ignored; a very long text is read in pieces of 8 MB, in memory by its number of tokens; of ties the least doc_id stays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Stored, batch, buckets, gather, lean, lean_table, pack, split, without
from .text import WORD, ids_back, ids_of, mix, shingle_hashes, slices

SHINGLE, WIDTH, CHUNKS, THRESHOLD = 2, 64, 8, 21
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint32) | np.uint32(1)
_KEYS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary())])
_GROUPS = "bucket int, gid long, doc array<long>"
RESULT = "doc_id long, group_id long, group_size long, kept boolean"


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64 minima of each row's shingles (``first`` are the starts of rows that have any)."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), WIDTH), np.uint32)
    for k in range(WIDTH):
        out[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], first)
    return out


def narrow(minima: np.ndarray) -> np.ndarray:
    """b = 8 bits of each minimum."""
    m = minima ^ (minima >> np.uint32(15))
    return ((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _signed(shingle: int):
    def run(batches):
        for b in batches:
            ids = ids_of(b.column(0))
            for s in slices(b.column(1), WORD, lower=True, target=1 << 18):
                h, row = shingle_hashes(s, shingle)
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                sig = minima(h, first).astype("<u4").tobytes()
                step = 4 * WIDTH
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.rows][row[first]]), pa.array([sig[i : i + step] for i in range(0, len(sig), step)], pa.binary())], names=["doc_id", "minima"])

    return run


def signatures(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig): one signature a row with tokens. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())

    def narrowed(batches):
        for b in _signed(shingle)(batches):
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, WIDTH)
            sig = narrow(m).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sig[i : i + WIDTH] for i in range(0, len(sig), WIDTH)], pa.binary())], names=["doc_id", "sig"])

    return rows.mapInArrow(lean(narrowed), "doc_id long, sig binary")


def masks(threshold: int) -> list[tuple[int, np.ndarray]]:
    """(chunk, kept bytes' mask) for every choice of allowed errors."""
    per = WIDTH // CHUNKS
    r, a = divmod(threshold, CHUNKS)
    found = []
    for c in range(CHUNKS):
        wrong = r if c <= a else r - 1
        if wrong < 0:
            continue
        for off in combinations(range(per), wrong):
            keep = np.full(per, 255, np.uint8)
            keep[list(off)] = 0
            found.append((c, keep.view(np.uint64)[0]))
    return found


def _keys(threshold: int, n: int):
    patterns = masks(threshold)
    salts = mix(np.arange(1, len(patterns) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def emit(ids, sigs):
        chunk = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, WIDTH).view(np.uint64)
        h = np.empty((len(patterns), len(ids)), np.uint64)
        for k, (c, keep) in enumerate(patterns):
            h[k] = mix((chunk[:, c] & keep) ^ salts[k])
        h, doc = h.reshape(-1), np.tile(ids, len(patterns))
        rows = [(i, pack((h[at] & np.uint64(0xFFFFFFFFFF)), plain=False), pack(doc[at])) for i, at in split((h >> np.uint64(40)) % np.uint64(n), n)]
        for k in range(0, len(rows), 256):
            yield batch(_KEYS, rows[k : k + 256])

    def run(batches):
        ids, sigs, have = [], [], 0
        for b in batches:
            ids.append(ids_of(b.column(0)))
            sigs += b.column(1).to_pylist()
            have += b.num_rows
            if have * len(patterns) >= 3_000_000:
                yield from emit(np.concatenate(ids), sigs)
                ids, sigs, have = [], [], 0
        if have:
            yield from emit(np.concatenate(ids), sigs)

    return run


def _sets(h: np.ndarray, doc: np.ndarray, n: int) -> pa.Table:
    """The distinct sets of two or more documents under one key."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    inside = np.zeros(len(s), bool)
    inside[1:] |= same
    inside[:-1] |= same
    h, doc = s[inside], doc[order[inside]]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    if not len(h):
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["bucket", "gid", "doc"])
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    place = (np.arange(len(h)) - np.repeat(first, size)).astype(np.uint64)
    gid = np.add.reduceat(mix(mix(doc.astype(np.uint64)) + place * np.uint64(0xA0761D6478BD642F)), first) + size.astype(np.uint64)
    _, at = np.unique(gid, return_index=True)
    at = at[size[at] > 1]
    total = np.concatenate([[0], np.cumsum(size[at])])
    flat = np.repeat(first[at], size[at]) + np.arange(total[-1]) - np.repeat(total[:-1], size[at])
    lists = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(doc[flat]))
    return pa.table([pa.array((gid[at] % np.uint64(n)).astype(np.int32)), pa.array(gid[at].view(np.int64)), lists], names=["bucket", "gid", "doc"])


def _linked(doc: np.ndarray, sig: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that span the components of one group's threshold graph."""
    left, edges = np.arange(len(doc)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (sig[left] != sig[x]).sum(axis=1) <= threshold
            if near.any():
                hit = left[near]
                edges += [(doc[x], doc[y]) for y in hit]
                queue += hit.tolist()
                left = left[~near]
    return edges


def _verified(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        gid, doc = table["gid"].to_numpy(), table["doc_id"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        order = np.lexsort((doc, gid))
        gid, doc, sig = gid[order], doc[order], sig[order]
        first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.zeros(0, int)
        size = np.diff(np.append(first, len(gid)))
        two = first[size == 2]
        near = (sig[two] != sig[two + 1]).sum(axis=1) <= threshold
        a, b = [doc[two[near]]], [doc[two[near] + 1]]
        for i, n in zip(first[size > 2], size[size > 2]):
            e = _linked(doc[i : i + n], sig[i : i + n], threshold)
            if e:
                x, y = np.array(e).T
                a.append(x), b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every vertex of ``edges`` (a, b): the least id of its component.

    Large-star and small-star in turn, until a round changes nothing; every round is a table in the shared folder.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    old = Stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(old.df)
    while True:
        e = old.df
        both = e.union(e.select("b", "a"))
        large = both.groupBy("a").agg(F.min("b").alias("m"))
        step = both.where("b > a").join(large, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = step.groupBy("a").agg(F.min("b").alias("m"))
        joined = step.join(small, "a")
        new = Stored(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = mark(new.df)
        old.drop()
        old = new
        if before == after:
            return old.df.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))
        before = after


def edges(signed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): edges within the threshold that span the components of the graph of all pairs within it. ``signed`` has distinct (doc_id, sig)."""
    if not 0 <= threshold < WIDTH:
        raise ValueError("threshold must be from 0 to 63")
    n = buckets(signed.sparkSession)
    keyed = signed.mapInArrow(lean(_keys(threshold, n)), "bucket int, h binary, doc binary")
    met = keyed.groupBy("bucket").applyInArrow(lean_table(lambda t: _sets(gather(t["h"]), gather(t["doc"]), n)), _GROUPS)
    groups = met.dropDuplicates(["gid"])
    members = groups.select("bucket", "gid", F.explode("doc").alias("doc_id")).join(signed, "doc_id")
    return members.groupBy("bucket").applyInArrow(lean_table(_verified(threshold)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id (the group's least doc_id), group_size, kept; a row for every document that has a near copy."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    raw = rows.mapInArrow(lean(_signed(shingle)), "doc_id long, minima binary")

    def merged(table: pa.Table) -> pa.Table:
        doc = ids_of(table["doc_id"])
        m = np.frombuffer(b"".join(table["minima"].to_pylist()), "<u4").reshape(-1, WIDTH)
        order = np.argsort(doc, kind="stable")
        doc, m = doc[order], m[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sig = narrow(np.minimum.reduceat(m, first, axis=0)).tobytes()
        return pa.table([ids_back(doc[first]), pa.array([sig[i : i + WIDTH] for i in range(0, len(sig), WIDTH)], pa.binary())], names=["doc_id", "sig"])

    signed = Stored(raw.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(buckets(spark, 1)))).applyInArrow(lean_table(merged), "doc_id long, sig binary"), "signatures")
    one = Stored(signed.df.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "representatives")
    same = signed.df.join(one.df.withColumnRenamed("doc_id", "b"), "sig").where("doc_id <> b").select("doc_id", "b").toDF("a", "b")
    found = components(edges(one.df.select("doc_id", "sig"), threshold).union(same))
    signed.drop(), one.drop()
    ids = found.union(found.select("group_id", "group_id")).distinct()
    size = ids.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return ids.join(size, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those of documents that have a near copy of a lesser id in their group."""
    gone = near_duplicates(docs, threshold, shingle, id_col, text_col).where("not kept")
    return without(docs, gone, id_col)
