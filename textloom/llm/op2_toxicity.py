"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

The labelled examples are a bounded sample (``EXAMPLES`` of either class), drawn by hash of the id.  Terms are stems, so that a word's inflected forms meet: each WORD token's first
``STEM`` bytes, or all of it if it is shorter.  The space is spanned by all terms of the
examples, weighted (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), with df and N counted over all documents.  Everything else runs
over all documents and whole texts, every document being a query.  A document's terms that no example has are outside
the space and not in its norm; they would lower all its cosines by one factor, which neither the order nor the vote depends on.

The index keeps the terms' lists in two parts.  Lists of rare terms are added up for every example.  Lists of the
``HEAD`` commonest terms are kept by block of 64 examples with the block's maximum of each term, which bounds the
block's scores: blocks are evaluated from the highest bound on, and those whose bound is below the k-th best score so
far are skipped, which changes no result.  A document is no neighbour of its own id, so an example's vote is one of the others.
Votes, weighted by cosine, become probabilities by isotonic regression on the examples' votes, each class counting as often as it
is among all labels, with steps halfway between neighbouring votes; the nearest examples are the evidence.  The threshold is the
probability at which the share of toxic examples caught, less ``CLEAN_COST`` times the share of clean ones lost, is greatest (the highest
such); k is the one of ``KS`` with which that is greatest (the least such).

Defined cases: a NULL or empty text, or one without a term of the index, has no neighbour, vote NULL, score 0 and is
not toxic; a NULL doc_id stays NULL; each row gives a row, so repeated rows repeat; labels that disagree count as
toxic, NULL labels and labels of absent documents don't count; of a labelled doc_id with several texts the least text counts; an
empty table gives none; without labels of both classes nothing is toxic; ties in cosine (to 6 digits) go to the lesser
example id; very long texts are read in pieces of 8 MB, in memory by their number of tokens; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Stored, batch, buckets, drawn, gather, lean, lean_table, pack
from .text import NULL_ID, WORD, ids_of, mix, slices

EXAMPLES, HEAD, BLOCK, EVIDENCE = 4096, 512, 64, 5
KS, STEM, CLEAN_COST = (5, 11, 21, 51, 101, 201, 401), 4, 3.0
_TERMS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])
RESULT = "doc_id long, vote double, score double, toxic boolean, evidence array<struct<doc_id: long, cosine: double, toxic: boolean>>"


def labelled_sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[Stored, dict[int, int]]:
    """(doc_id, toxic, text) of a bounded sample of labelled documents, drawn by hash, one row a document; all labels' number by class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(present, "doc_id", "left_semi")
    known = known.select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(7)).alias("o"))
    stored = Stored(known, "labels")
    counts = {r.toxic: r.n for r in stored.df.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [drawn(stored.df.where(F.col("toxic") == c), "o", examples) for c in (1, 0)]
    ids = parts[0].union(parts[1]).select(F.col("doc_id").alias("id"), "toxic")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    sample = Stored(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    stored.drop()
    return sample, counts


def stems(s) -> np.ndarray:
    """The hashes of a slice's tokens' stems; the hash is one-to-one."""
    size, last = s.ends - s.starts, max(0, len(s.buf) - 1)
    value = np.zeros(len(size), np.uint64)
    for k in range(STEM):
        value |= np.where(size > k, s.buf[np.minimum(s.starts + k, last)], 0).astype(np.uint64) << np.uint64(8 * k)
    return mix(value)


def _row_terms(s):
    """(row, hash, count) of a slice's distinct terms by row, ascending."""
    row, h = s.row_of(), stems(s)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _terms(batches):
    for b in batches:
        ids, toxic = b.column(0).to_pylist(), b.column(1).to_pylist()
        for s in slices(b.column(2), WORD, lower=True):
            row, h, n = _row_terms(s)
            edge = np.searchsorted(row, np.arange(len(s.first)))
            yield batch(_TERMS, [(ids[s.rows.start + i], toxic[s.rows.start + i], pack(h[edge[i] : edge[i + 1]], plain=True), pack(n[edge[i] : edge[i + 1]])) for i in range(len(edge) - 1)])


class Lookup:
    """Hashes to places in a sorted vocabulary, or -1; by a table over the hashes' upper bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = max(8, int(len(terms)).bit_length() + 3)
        self.table = np.searchsorted(terms, np.arange((1 << self.bits) + 1, dtype=np.uint64)[:-1] << np.uint64(64 - self.bits)).astype(np.int32)
        self.depth = int(np.max(np.diff(np.append(self.table, len(terms))))) if len(terms) else 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(h), -1, np.int64)
        at = self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        found = np.full(len(h), -1, np.int64)
        last = len(self.terms) - 1
        for k in range(self.depth):
            p = np.minimum(at + k, last)
            hit = self.terms[p] == h
            found[hit] = p[hit]
        return found


def _document_frequency(terms, n_parts: int):
    """mapInArrow function: the number of documents with each term, by part of the vocabulary."""

    def run(batches):
        look = Lookup(terms.value)
        count, docs = np.zeros(len(look.terms), np.int64), 0
        for b in batches:
            for s in slices(b.column(0), WORD, lower=True):
                docs += len(s.first) - 1
                t = look(stems(s))
                keep = t >= 0
                pair = np.unique(s.row_of()[keep] * len(look.terms) + t[keep])
                count += np.bincount(pair % max(1, len(look.terms)), minlength=len(look.terms))[: len(look.terms)]
        schema = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])
        if docs:
            yield batch(schema, [(i, docs if i == 0 else 0, pack(c)) for i, c in enumerate(np.array_split(count, n_parts))])

    return run


def document_frequency(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all documents, for a vocabulary of bounded size; partial counts are summed by part of the vocabulary."""
    parts = 8
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(_document_frequency(shared, parts)), "part int, docs long, counts binary")

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table["counts"]:
            c = gather([x])
            total = c if total is None else total + c
        return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([sum(table["docs"].to_pylist())], pa.int64()), pa.array([pack(total)], pa.binary())], names=["part", "docs", "counts"])

    rows = sorted(partial.groupBy("part").applyInArrow(lean_table(add), "part int, docs long, counts binary").toArrow().to_pylist(), key=lambda r: r["part"])
    if not rows:
        return np.zeros(len(terms), np.int64), 0
    return np.concatenate([gather(pa.array([r["counts"]], pa.binary())) for r in rows]), rows[0]["docs"]


class Index:
    """The examples' weights, by term; see the module's text."""

    def __init__(self, ids, toxic, term_lists, counts, terms, idf):
        n = len(ids)
        row = np.repeat(np.arange(n), [len(t) for t in term_lists])
        term = np.concatenate(term_lists) if n else np.zeros(0, np.int64)
        weight = (1 + np.log(np.concatenate(counts))) * idf[term] if n else np.zeros(0)
        norm = np.sqrt(np.bincount(row, weight**2, minlength=n))
        weight = weight / np.maximum(norm, 1e-12)[row]
        df = np.bincount(term, minlength=len(terms))
        common = np.argsort(-df, kind="stable")[:HEAD]
        place = np.full(len(terms), -1, np.int32)
        place[common] = np.arange(len(common))
        dense = np.zeros((n, len(common)), np.float32)
        at = place[term] >= 0
        dense[row[at], place[term[at]]] = weight[at]
        alike = np.lexsort((ids, dense.argmax(axis=1) if dense.size else np.zeros(n))) if n else np.zeros(0, np.int64)
        back = np.argsort(alike)
        self.n = -(-n // BLOCK) * BLOCK
        pad = self.n - n
        self.head = np.pad(dense[alike], ((0, pad), (0, 0)))
        self.peak = self.head.reshape(-1, BLOCK, self.head.shape[1]).max(axis=1) if n else np.zeros((0, self.head.shape[1]), np.float32)
        self.ids, self.toxic = np.pad(ids[alike], (0, pad)), np.pad(toxic[alike], (0, pad)).astype(np.float64)
        order = np.argsort(self.ids[:n], kind="stable")
        self.tie = np.zeros(self.n)
        self.tie[order] = np.arange(n) * 1e-11
        self.by_id, self.at_id = self.ids[order], order
        rare = np.flatnonzero(~at)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.first = np.searchsorted(term[rare], np.arange(len(terms) + 1))
        self.example, self.weight = back[row[rare]].astype(np.int32), weight[rare].astype(np.float32)
        self.place, self.terms, self.idf = place, terms, idf

    def nearest(self, q_row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int, prune: bool = True, own: np.ndarray | None = None):
        """(examples, cosines) of each query row's k best, cosine 0 where fewer share a term. Weights are normalised.

        ``own`` are the queries' ids; an example of that id doesn't count.
        """
        n, blocks = self.n, self.n // BLOCK
        head = np.zeros((rows, self.head.shape[1]), np.float32)
        at = self.place[term] >= 0
        head[q_row[at], self.place[term[at]]] = weight[at]
        r_row, r_term, r_weight = q_row[~at], term[~at], weight[~at]
        size = self.first[r_term + 1] - self.first[r_term]
        total = np.cumsum(size)
        flat = np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[r_term] - (total - size), size)
        rare = np.bincount(np.repeat(r_row, size) * n + self.example[flat], np.repeat(r_weight, size) * self.weight[flat], minlength=rows * n).reshape(rows, n)
        if own is not None:
            at = np.minimum(np.searchsorted(self.by_id, own), len(self.by_id) - 1)
            self_row = np.flatnonzero((self.by_id[at] == own) & (own != NULL_ID))
            self_at = self.at_id[at[self_row]]
        bound = head @ self.peak.T + rare.reshape(rows, blocks, BLOCK).max(axis=2) + 1e-5
        score = np.full((rows, n), -1.0)
        k = min(k, n)
        first = min(blocks, -(-k // BLOCK) + 1)
        best = np.zeros((rows, blocks), bool)
        np.put_along_axis(best, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        if not prune:
            best[:] = True

        def evaluate(chosen):
            for b in np.flatnonzero(chosen.any(axis=0)):
                who = np.flatnonzero(chosen[:, b])
                span = slice(b * BLOCK, (b + 1) * BLOCK)
                score[who, span] = np.round(head[who] @ self.head[span].T + rare[who, span], 6) - self.tie[span]
            if own is not None:
                score[self_row, self_at] = -1.0

        evaluate(best)
        least = np.partition(score, n - k, axis=1)[:, n - k]
        evaluate(~best & (bound >= least[:, None]))
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1), 1)
        return top, np.maximum(np.round(np.take_along_axis(score, top, 1) + self.tie[top], 6), 0)


def _scored(shared, ks: tuple[int, ...]):
    """For each slice of the texts in a column, whose ids are given: (slice, vote or NaN by k, neighbours, cosines)."""

    def run(column, ids):
        index, look = shared.value, None
        look = _lookups.get("last")
        if look is None or look.terms is not index.terms:  # an id would be used again once its index is gone
            look = _lookups["last"] = Lookup(index.terms)
        for s in slices(column, WORD, lower=True, target=1 << 19):
            rows = len(s.first) - 1
            if not index.n:
                yield s, [np.full(rows, np.nan)] * len(ks), np.zeros((rows, 0), np.int64), np.zeros((rows, 0))
                continue
            t = look(stems(s))
            keep = t >= 0
            pair, tf = np.unique(s.row_of()[keep] * len(index.terms) + t[keep], return_counts=True)
            row, term = np.divmod(pair, len(index.terms))
            weight = (1 + np.log(tf)) * index.idf[term]
            weight = weight / np.sqrt(np.maximum(np.bincount(row, weight**2, minlength=rows), 1e-12))[row]
            top, cosine, start = [], [], 0
            while start < rows:
                end = min(rows, start + 128)
                a, z = np.searchsorted(row, [start, end])
                t1, c1 = index.nearest(row[a:z] - start, term[a:z], weight[a:z], end - start, max(ks), own=ids[s.rows][start:end])
                top.append(t1), cosine.append(c1)
                start = end
            top, cosine = np.concatenate(top), np.concatenate(cosine)
            total, toxic = np.cumsum(cosine, axis=1), np.cumsum(cosine * index.toxic[top], axis=1)
            votes = []
            for k in ks:
                k = min(k, cosine.shape[1]) - 1
                votes.append(np.where(total[:, k] > 0, toxic[:, k] / np.where(total[:, k] > 0, total[:, k], 1), np.nan))
            yield s, votes, top, cosine

    return run


_lookups: dict = {}


def isotonic(vote: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the votes at which the probability steps up, and the probabilities."""
    weight = np.ones(len(vote)) if weight is None else weight
    order = np.argsort(vote, kind="stable")
    at, first = np.unique(vote[order], return_index=True)
    y = np.add.reduceat((toxic * weight)[order].astype(float), first) if len(at) else np.zeros(0)
    n = np.add.reduceat(weight[order].astype(float), first) if len(at) else np.zeros(0)
    level: list[list[float]] = []
    for x, a, b in zip(at, y, n):
        level.append([x, a, b])
        while len(level) > 1 and level[-2][1] * level[-1][2] >= level[-1][1] * level[-2][2]:
            _, a, b = level.pop()
            level[-1][1] += a
            level[-1][2] += b
    return np.array([v[0] for v in level]), np.array([v[1] / v[2] for v in level])


def halfway(at: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Steps moved to the middle between their vote and the next lesser one."""
    known = np.unique(vote)
    below = np.searchsorted(known, at) - 1
    return np.where(below >= 0, (at + known[np.maximum(below, 0)]) / 2, at)


def cut(p: np.ndarray, toxic: np.ndarray, clean_cost: float = CLEAN_COST) -> tuple[float, float]:
    """The highest probability from which on calling a document toxic gains most, and the gain; see the module's text."""
    at = np.unique(p[p > 0])
    if not len(at) or not 0 < toxic.sum() < len(toxic):
        return 0.5, 0.0
    gain = [np.mean(p[toxic > 0] >= x) - clean_cost * np.mean(p[toxic == 0] >= x) for x in at]
    best = len(at) - 1 - int(np.argmax(gain[::-1]))
    return float(at[best]), float(gain[best])


class Model:
    """An index (a broadcast), its calibration and its threshold, all of bounded size."""

    def __init__(self, shared, steps, k: int, threshold: float = 0.5):
        self.shared, self.steps, self.k, self.threshold = shared, steps, k, threshold

    def probability(self, vote: np.ndarray) -> np.ndarray:
        at, p = self.steps
        if not len(at):
            return np.zeros(len(vote))
        return np.where(np.isnan(vote), 0.0, p[np.maximum(np.searchsorted(at, np.nan_to_num(vote), side="right") - 1, 0)])


def fit(docs: DataFrame, labels: DataFrame, ks: tuple[int, ...] = KS, examples: int = EXAMPLES, clean_cost: float = CLEAN_COST) -> Model:
    spark = docs.sparkSession
    sample, labelled = labelled_sample(docs, labels, examples)
    rows = sample.df.select("doc_id", "toxic", "text").repartition(buckets(spark, 1), "doc_id")
    got = rows.mapInArrow(lean(_terms), "doc_id long, toxic int, h binary, n binary").toArrow().sort_by("doc_id")
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy()
    hashes = [gather([x]) for x in got["h"]]
    counts = [gather([x]) for x in got["n"]]
    terms = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)).astype(np.uint64)
    if len(terms) and len(set(toxic.tolist())) == 2:
        over, total = document_frequency(docs, terms)
        look = Lookup(terms)
        places = [look(h.astype(np.uint64)) for h in hashes]
        idf = 1 + np.log((1 + total) / (1 + over))
        index = Index(ids, toxic, places, counts, terms, idf)
    else:
        index = Index(np.zeros(0, np.int64), np.zeros(0), [], [], np.zeros(0, np.uint64), np.zeros(0))
    shared = spark.sparkContext.broadcast(index)

    def votes(batches):
        score = _scored(shared, ks)
        for b in batches:
            for s, vote, *_ in score(b.column(2), ids_of(b.column(0))):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(s.rows.start, len(vote[0])), *map(pa.array, vote)], names=["toxic", *(f"v{i}" for i in range(len(ks)))])

    got = rows.mapInArrow(lean(votes), ", ".join(["toxic int", *(f"v{i} double" for i in range(len(ks)))])).toArrow()
    sample.drop()
    y, best = got["toxic"].to_numpy(), None
    weight = np.array([labelled.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)])[y]
    for i, k in enumerate(ks):
        vote = got[f"v{i}"].to_numpy()
        known = ~np.isnan(vote)
        at, p = isotonic(vote[known], y[known], weight[known])
        model = Model(shared, (halfway(at, vote[known]), p), k)
        model.threshold, gain = cut(model.probability(vote), y, clean_cost)
        if best is None or gain > best[0] + 1e-12:
            best = gain, model
    return best[1]


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float | None = None) -> DataFrame:
    """doc_id, vote, score (calibrated), toxic, evidence (the nearest examples); a row for every row. ``threshold``: the model's own by default."""
    model = model or fit(docs, labels)
    threshold = model.threshold if threshold is None else threshold

    def run(batches):
        scored = _scored(model.shared, (model.k,))
        for b in batches:
            for s, (vote,), top, cosine in scored(b.column(1), ids_of(b.column(0))):
                index, rows = model.shared.value, len(vote)
                p = model.probability(vote)
                top, cosine = top[:, :EVIDENCE], cosine[:, :EVIDENCE]
                some = cosine > 0
                ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
                chosen = top[some]
                evidence = pa.StructArray.from_arrays([pa.array(index.ids[chosen], pa.int64()), pa.array(cosine[some]), pa.array(index.toxic[chosen] > 0.5)], names=["doc_id", "cosine", "toxic"])
                columns = [b.column(0).slice(s.rows.start, rows), pa.array(vote, mask=np.isnan(vote)), pa.array(p), pa.array(p >= threshold)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), evidence))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "vote", "score", "toxic", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), RESULT)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` but for the toxic ones; one pass over the rows, no shuffle."""
    model = fit(docs, labels)
    threshold = model.threshold if threshold is None else threshold
    at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        scored = _scored(model.shared, (model.k,))
        for b in batches:
            text = b.column(at).cast(pa.string())
            keep = [model.probability(vote) < threshold for _, (vote,), *_ in scored(text, ids_of(b.column(id_at)))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(lean(run), docs.schema)
