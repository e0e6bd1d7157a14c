"""Packed exchanges: numpy arrays that travel through a Spark shuffle as a few binary rows.

A row per (bucket, batch) carries whole arrays instead of a row per element.  Arrays are stored by byte plane
and deflated by zstd, so that ids and positions, which differ in their low bytes only, take a byte or two.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.memory import trim


def lean(run):
    """A mapInArrow function that trims when it ends."""

    def lean_run(batches):
        yield from run(batches)
        trim()

    return lean_run


def lean_table(run):
    """An applyInArrow function of a group that trims when it ends."""

    def lean_run(table):
        out = run(table)
        trim()
        return out

    return lean_run


def lean_pair(run):
    """An applyInArrow function of two co-grouped tables that trims when it ends."""

    def lean_run(left, right):
        out = run(left, right)
        trim()
        return out

    return lean_run


def pack(values: np.ndarray, plain: bool = False) -> bytes:
    """One array as bytes; ``plain`` skips deflation, for hashes."""
    values = np.ascontiguousarray(values)
    head = values.dtype.str.encode().ljust(4) + (b"p" if plain else b"z")
    if plain or not len(values):
        return head + (b"" if not len(values) else values.tobytes())
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    data = memoryview(data)
    kind = np.dtype(bytes(data[:4]).strip().decode())
    if len(data) == 5:
        return np.zeros(0, kind)
    if bytes(data[4:5]) == b"p":
        return np.frombuffer(data[5:], kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its elements' indices in their order) for every bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), order[edges[i] : edges[i + 1]]


def combined(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, marked: np.ndarray | None = None):
    """Of occurrences by key: (places of each key's least (doc, pos), whether it occurs again, places of all that aren't the least).

    All places ascend.  Occurrences at the least one's own (doc, pos) are dropped; they, and ``marked`` ones, make it one that occurs again.
    """
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    least, again = order[first].copy(), size > 1
    many = np.flatnonzero(np.repeat(again, size))  # only groups of several are put in order
    at = order[many]
    at = at[np.lexsort((pos[at], doc[at], key[at]))]
    k = key[at]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = at[np.flatnonzero(new)][np.cumsum(new) - 1] if len(at) else at
    least[again] = at[new]
    if marked is not None and len(first):
        again = again | np.logical_or.reduceat(marked[order], first)
    order = np.argsort(least)  # in the order of occurrence documents and positions deflate well
    return least[order], again[order], np.sort(at[(doc[at] != doc[head]) | (pos[at] != pos[head])])


def gather(column) -> np.ndarray:
    """All arrays of a binary column, joined."""
    parts = [unpack(x.as_buffer()) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def buckets(spark: SparkSession, times: int = 2) -> int:
    """The number of buckets of a packed exchange follows the session's shuffle partitions, which the user scales with the data."""
    return max(8, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one on a local master; an error on a cluster, whose machines share no such folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; the master is {master}")
        where = _own.get("dir")
        if not where:
            where = _own["dir"] = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


_own: dict[str, str] = {}


class Stored:
    """A DataFrame written in the shared folder: its lineage is cut, and any executor may be lost."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.parquet(self.path)

    def drop(self) -> None:
        """Once nothing reads it any more.  Also lets Spark's cleaner free the shuffles that made it."""
        spark = self.df.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (doc_id); NULL ids match NULL.

    ``gone`` is written and counted: up to ``BROADCAST_IDS`` ids are broadcast, so that the texts aren't shuffled; more are joined by a shuffle.
    """
    ids = Stored(gone.select("doc_id").distinct(), "gone").df
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs[id_col].cast("long").eqNullSafe(ids["doc_id"]), "left_anti")


def drawn(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows, those least by the hash column ``order``, ties by the other columns.

    Hashes are counted by their upper 12 bits first, and rows above the first ranges that hold ``most`` are dropped where they
    are, so that what tasks send on stays near ``most`` however many rows there are; equal hashes stay together.
    """
    ranges = rows.groupBy(F.shiftright(order, 52).alias("r")).agg(F.count("*").alias("n")).collect()  # 4096 numbers at most
    have = 0
    for r in sorted(ranges, key=lambda r: (r.r is not None, r.r)):
        have += r.n
        if have >= most:
            rows = rows.where(F.col(order).isNull() | (F.shiftright(order, 52) <= F.lit(r.r if r.r is not None else -(1 << 12))))
            break
    return rows.orderBy(order, *[c for c in rows.columns if c != order]).limit(most)
