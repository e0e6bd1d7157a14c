"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences and answers.

Documents are read once: each WORD token becomes its place in the benchmark's vocabulary (0 for any other word, which
could add nothing to a product with an item), packed in a table in the shared folder with the counts of half-windows that
hold each term.  Passages are windows of 32 tokens, 16 apart.  In the latent space terms weigh ln((1 + N) / (1 + df)); those in more than
``MOST`` of the half-windows weigh nothing there, but for the ``RAREST`` rarest of each item.  A randomised SVD of the passages' TF-IDF
matrix A takes two distributed passes over that table: A'AO for a random sign matrix O, whose QR factor Q spans the range, then A'AQ;
the Rayleigh-Ritz step on Q'A'AQ gives the latent axes.  Partial sums are fixed-point, so their order changes
no digit.  Every passage is compared with every item by cosine in the latent space; an item of more than 64 words is asked for by its own
passages, too, as a whole it would be unlike any of a copy's.  What reaches ``COSINE`` is aligned: an item is leaked
where its longest common subsequence with a stretch of the document covers ``COVER`` of its words, or ``PARTIAL`` of them while
its answer (its last sentence; with a single one its own coverage stands for it) is covered to ``ANSWERED``.  All words count in the alignment, common ones too.  A stretch
that shares fewer words with the item than ``PARTIAL`` asks for is passed over, which is exact.

The benchmark is searched for in blocks of about ``BLOCK_BYTES`` of text, each with a space of its own; only a block is ever on the driver or broadcast.

Defined cases: NULL and empty texts match nothing; items of fewer than ``shortest`` words aren't searched for, as almost any text holds them
(1 searches for all); an empty table or benchmark gives no rows; rows of one doc_id, or of one item_id, pool their matches (the best one
is reported, then the least start); a NULL doc_id is an id of its own; a NULL item_id takes no part; further columns are
ignored; a very long text is read in pieces of 8 MB, in memory by its number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .op2_toxicity import Lookup
from .packed import Stored, batch, gather, lean, lean_table, pack, without
from .text import WORD, buffers, ids_back, ids_of, slices, tokenise

HALF, RANK, EXTRA, SEED, MOST = 16, 64, 8, 20231101, 0.02
COSINE, COVER, PARTIAL, ANSWERED, SHORTEST, RAREST = 0.4, 0.7, 0.55, 0.8, 5, 5
LONG, BLOCK_BYTES = 4 * HALF, 1 << 19
FIXED = float(1 << 16)
_PLACES = pa.schema([("doc", pa.binary()), ("first", pa.binary()), ("place", pa.binary()), ("halves", pa.int64()), ("df", pa.binary())])
_SUMS = pa.schema([("part", pa.int32()), ("halves", pa.int64()), ("sums", pa.binary())])
RESULT = "doc_id long, item_id long, start_token long, end_token long, cosine double, coverage double, answer_coverage double"


class Items:
    """A block of the benchmark's items as places in its vocabulary (from 1); ``tails`` are the answers' numbers of words, 0 without one."""

    def __init__(self, rows: pa.Table, shortest: int = SHORTEST):
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        ids, hashes, tails = [], [], []
        text = pc.utf8_lower(rows["text"].combine_chunks().cast(pa.string())) if rows.num_rows else pa.array([], pa.string())
        buf, offs = buffers(text)
        for i in range(rows.num_rows):
            s = tokenise(buf, offs[i : i + 2], WORD, slice(i, i + 1))
            n = len(s.hashes)
            if n < max(1, shortest):
                continue
            b = s.buf.tobytes()
            cut = n - 1
            while cut > 0 and not any(c in b[s.ends[cut - 1] : s.starts[cut]] for c in b".!?\n"):
                cut -= 1
            ids.append(rows["item_id"][i].as_py()), hashes.append(s.hashes), tails.append(n - cut if cut else 0)
        self.ids = np.array(ids, np.int64)
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.terms, h) + 1 for h in hashes]
        self.tails = tails

    def counts(self) -> np.ndarray:
        """(terms x items) numbers of occurrences."""
        out = np.zeros((len(self.terms), len(self.places)), np.uint16)
        for k, p in enumerate(self.places):
            np.add.at(out[:, k], p - 1, 1)
        return out

    def queries(self, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank x queries) unit vectors of whole items and of long items' passages, and each query's item."""
        made, owner = [], []
        for k, p in enumerate(self.places):
            spans = [p, *(p[a : a + 2 * HALF] for a in range(0, len(p) - HALF, HALF) if len(p) > LONG)]
            made += [latent[x - 1].sum(axis=0) for x in spans]
            owner += [k] * len(spans)
        q = np.array(made, np.float32).T
        return q / np.maximum(np.sqrt((q**2).sum(axis=0)), 1e-9), np.array(owner)


def _placed(shared):
    def run(batches):
        look = Lookup(shared.value)
        terms = len(look.terms)
        kind = np.uint16 if terms < 65535 else np.uint32
        for b in batches:
            ids = ids_of(b.column(0))
            for s in slices(b.column(1), WORD, lower=True):
                place = look(s.hashes) + 1
                p = Passages(s.first, place)
                df = np.bincount(np.unique(p.half * terms + p.term) % terms, minlength=terms)
                yield batch(_PLACES, [(pack(ids[s.rows]), pack(s.first.astype(np.int32)), pack(place.astype(kind)), len(p.start), pack(df.astype(np.int32)))])

    return run


def _unpacked(batches):
    for b in batches:
        for i in range(b.num_rows):
            doc, first, place = (gather(b.column(j).slice(i, 1)) for j in range(3))
            yield doc, first.astype(np.int64), place


class Passages:
    """The half-windows of some documents, and the terms in them (all, or those of which ``keep`` is true)."""

    def __init__(self, first: np.ndarray, place: np.ndarray, keep: np.ndarray | None = None):
        size = np.diff(first)
        count = -(-size // HALF)
        self.row = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.start = first[:-1][self.row] + number * HALF
        self.inner = (number < count[self.row] - 1)[:, None]  # the next half is of the same document
        at = np.flatnonzero(place)
        term = place[at].astype(np.int64) - 1
        if keep is not None:
            some = keep[term]
            at, term = at[some], term[some]
        self.at, self.term = at, term
        self.half = np.searchsorted(self.start, at, side="right") - 1

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """For every half-window, the sum of its terms' rows."""
        out = np.zeros((len(self.start), rows.shape[1]), rows.dtype)
        new = np.flatnonzero(np.concatenate([[True], self.half[1:] != self.half[:-1]])) if len(self.at) else []
        for a in range(0, len(new), 512):
            heads = new[a : a + 512]
            z = new[a + 512] if a + 512 < len(new) else len(self.at)
            out[self.half[heads]] = np.add.reduceat(rows[self.term[heads[0] : z]], heads - heads[0], axis=0)
        return out

    def join(self, halves: np.ndarray) -> np.ndarray:
        """Half-windows to passages: each with the next one of its document, if there is one."""
        out = halves.copy()
        out[:-1] += halves[1:] * self.inner[:-1]
        return out

    def spread(self, passages: np.ndarray, terms: int) -> np.ndarray:
        """The transposed product: each term's sum of the passages that it is in."""
        reach = passages.copy()  # a half is in its own passage and in the one before
        reach[1:] += passages[:-1] * self.inner[:-1]
        out = np.zeros((terms, passages.shape[1]))
        order = np.argsort(self.term.astype(np.uint16) if terms <= 1 << 16 else self.term, kind="stable")
        term, half = self.term[order], self.half[order]
        for a in range(0, len(term), 4096):
            t = term[a : a + 4096]
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            out[t[heads]] += np.add.reduceat(reach[half[a : a + 4096]], heads, axis=0)
        return out


def _product(shared):
    """mapInArrow function: the partial sums of A'(A test) without the weights on the left, in fixed point."""

    def run(batches):
        rows, keep = shared.value
        total, halves = np.zeros(rows.shape, np.int64), 0
        for _, first, place in _unpacked(batches):
            p = Passages(first, place, keep)
            halves += len(p.start)
            if len(p.at):
                total += np.round(p.spread(p.join(p.sums(rows)), len(rows)) * FIXED).astype(np.int64)
        if halves:
            yield batch(_SUMS, [(i, halves, pack(at.reshape(-1))) for i, at in enumerate(np.array_split(total, 8)) if len(at)])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = 0
    for x in table["sums"]:
        total = total + gather([x])
    return pa.Table.from_batches([batch(_SUMS, [(table["part"][0].as_py(), sum(table["halves"].to_pylist()), pack(total))])])


def _summed(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The sums of the packed arrays by part, joined; their size is the vocabulary's, not the corpus's."""
    got = sorted(parts.groupBy("part").applyInArrow(lean_table(_added), "part int, halves long, sums binary").toArrow().to_pylist(), key=lambda r: r["part"])
    if not got:
        return np.zeros(0, np.int64), 0
    return np.concatenate([gather(pa.array([r["sums"]], pa.binary())) for r in got]), got[0]["halves"]


def term_weights(placed: DataFrame, items: Items) -> np.ndarray:
    """By document frequency over all half-windows; 0 for what is too common to tell anything."""
    parts = placed.select(F.pmod(F.xxhash64("df"), F.lit(64)).cast("int").alias("part"), "halves", F.col("df").alias("sums"))
    parts = parts.groupBy("part").applyInArrow(lean_table(_added), "part int, halves long, sums binary")
    df, n = _summed(parts.withColumn("part", F.lit(0)))
    if not n:
        return np.zeros(len(items.terms))
    weight = np.log((1 + n) / (1 + df))
    held = np.zeros(len(df), bool)
    for place in items.places:
        t = np.unique(place - 1)
        held[t[np.argsort(df[t], kind="stable")[:RAREST]]] = True
    weight[(df > MOST * n) & ~held] = 0
    return np.where((df <= MOST * n) | held, np.maximum(weight, 1e-3), 0)


def latent_axes(placed: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Randomised SVD of the TF-IDF matrix of all passages: its right singular vectors, terms x rank."""
    terms = len(weight)
    context = placed.sparkSession.sparkContext

    def product(rows: np.ndarray) -> np.ndarray:
        shared = context.broadcast(((weight[:, None] * rows).astype(np.float32), weight > 0))
        z, _ = _summed(placed.select("doc", "first", "place").mapInArrow(lean(_product(shared)), "part int, halves long, sums binary"))
        shared.unpersist()
        return weight[:, None] * (z.reshape(rows.shape) / FIXED if len(z) else np.zeros(rows.shape))

    signs = np.random.default_rng(SEED).integers(0, 2, (terms, min(terms, rank + EXTRA))) * 2.0 - 1
    q, _ = np.linalg.qr(product(signs))
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def common(masks: dict[int, int], length: int, tokens: list[int]) -> int:
    """Length of the longest common subsequence of an item (its positions' bits by token) and tokens, bit-parallel."""
    full = (1 << length) - 1
    v = full
    for x in tokens:
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _bits(places: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, x in enumerate(places.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _matched(shared, cosine: float):
    def run(batches):
        items, latent, queries, owner, keep = shared.value
        whole = [_bits(p) for p in items.places]
        tail = [_bits(p[len(p) - n :]) for p, n in zip(items.places, items.tails)]
        reach = np.array([len(p) for p in items.places])
        counts = items.counts()
        terms = len(keep)
        for doc, first, place in _unpacked(batches):
            p = Passages(first, place, keep)
            if not len(p.at):
                continue
            at = np.flatnonzero(place)
            term = place[at].astype(np.int64) - 1
            y = p.join(p.sums(latent))
            y /= np.maximum(np.sqrt((y**2).sum(axis=1)), 1e-9)[:, None]
            best: dict[tuple[int, int], tuple] = {}
            for s in range(0, len(y), 2048):
                c = y[s : s + 2048] @ queries
                h, k = np.nonzero(c >= cosine)
                c, k = c[h, k], owner[k]
                order = np.lexsort((-c, k, h))
                h, k, c = h[order], k[order], c[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(h) else np.zeros(0, bool)
                h, k, c = h[new] + s, k[new], c[new]  # the best of an item's queries
                for group in range(0, len(h), 20_000):
                    some = slice(group, group + 20_000)
                    _align(doc, first, at, term, terms, p, h[some], k[some], c[some], reach, counts, whole, tail, items.tails, best)
            if best:
                rows = np.array([row for row, _ in best])
                v = list(best.values())
                found = [
                    ids_back(doc[rows]),
                    pa.array(items.ids[[item for _, item in best]]),
                    pa.array([-x[3] for x in v], pa.int64()),
                    pa.array([x[4] for x in v], pa.int64()),
                    *(pa.array([x[i] for x in v], pa.float64()) for i in (2, 0, 1)),
                ]
                names = ["doc_id", "item_id", "start_token", "end_token", "cosine", "coverage", "answer_coverage"]
                yield pa.RecordBatch.from_arrays(found, names=names)

    return run


def _align(doc, first, at, term, terms, p, h, k, c, reach, counts, whole, tail, tails, best) -> None:
    """Candidates (half-window, item, cosine) to the best match of each row and item."""
    row = p.row[h]
    a, z = np.maximum(first[row], p.start[h] - reach[k]), np.minimum(first[row + 1], p.start[h] + 2 * HALF + reach[k])
    i, j = np.searchsorted(at, a), np.searchsorted(at, z)
    size = j - i
    total = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(i - total[:-1], size) + np.arange(total[-1])
    which, near = np.repeat(np.arange(len(k)), size), term[flat]
    hit = counts[near, k[which]] > 0
    # The words that a stretch and an item share, as often as both have them, bound their common subsequence.
    pair, n = np.unique(which[hit] * terms + near[hit], return_counts=True)
    e, t = np.divmod(pair, terms)
    shared = np.bincount(e, np.minimum(n, counts[t, k[e]]), minlength=len(k))
    for e in np.flatnonzero(shared >= PARTIAL * reach[k]).tolist():
        item, r = int(k[e]), int(row[e])
        words = term[i[e] : j[e]]
        words = (words[counts[words, item] > 0] + 1).tolist()
        cover = common(whole[item], int(reach[item]), words) / int(reach[item])
        if cover < PARTIAL:
            continue
        answer = common(tail[item], tails[item], words) / tails[item] if tails[item] else cover
        if cover >= COVER or answer >= ANSWERED:
            now = (round(cover, 6), round(answer, 6), round(float(c[e]), 3), -int(a[e] - first[r]), int(z[e] - first[r]))
            if (r, item) not in best or now > best[r, item]:
                best[r, item] = now


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best match of each document and item that it leaks: doc_id, item_id, the stretch searched, cosine, coverage, answer_coverage."""
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    blocks = 1 + int(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for i in range(blocks):
        some = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else known
        items = Items(some.toArrow(), shortest)
        if len(items.ids):
            parts.append(_searched(rows, items, cosine, rank).df)
    if not parts:
        return spark.createDataFrame([], RESULT)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    first = W.partitionBy("doc_id", "item_id").orderBy(F.desc("coverage"), F.desc("answer_coverage"), F.desc("cosine"), "start_token", "end_token")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _searched(rows: DataFrame, items: Items, cosine: float, rank: int) -> Stored:
    """All rows' matches with a block of items."""
    context = rows.sparkSession.sparkContext
    placed = Stored(rows.mapInArrow(lean(_placed(context.broadcast(items.terms))), "doc binary, first binary, place binary, halves long, df binary"), "places")
    weight = term_weights(placed.df, items)
    latent = np.ascontiguousarray(weight[:, None] * latent_axes(placed.df, weight, rank), np.float32)
    shared = context.broadcast((items, latent, *items.queries(latent), weight > 0))
    found = Stored(placed.df.select("doc", "first", "place").mapInArrow(lean(_matched(shared, cosine)), RESULT), "leaks")
    placed.drop()
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those of documents that leak an item."""
    return without(docs, leaks(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id"), id_col)
