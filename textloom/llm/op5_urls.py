"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs.

Features: length, path depth, digit ratio, byte entropy, numbers of parameters, hyphens, host labels and so on, and statistics of the
host's suffixes (last label, last two labels): their smoothed share of bad URLs among the labelled ones, out of fold in training.
Trees are grown on quantile bins by second-order gains of the logistic loss, on a bounded sample of labelled URLs
(``SAMPLE`` distinct URLs, drawn by hash; each counts once, with the share of its labels that are bad); scoring covers every URL in one pass without a shuffle.

Defined cases: a NULL or empty URL has the features of the empty string, and score NULL; repeated rows repeat (and count once in training); NULL labels
don't count; labels of one class give that class's share for all; an empty table gives no rows; NULL ids stay NULL;
URLs without a scheme are read as host and path; further columns are ignored; a URL of any length is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import drawn, lean
from .text import buffers

SAMPLE, ROUNDS, DEPTH, RATE, BINS, LAMBDA, SMOOTH, FOLDS = 20_000, 40, 3, 0.3, 32, 1.0, 20.0, 5
FEATURES = ["length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "hyphens", "host_labels", "query_length", "fragment", "upper", "host_digits", "longest_label", "secure", "escapes"]
RESULT = "page_id long, url string, score double, blocked boolean"
_PARTS = r"^(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*)://)?(?:[^/?#@]*@)?(?P<host>[^/?#:]*)(?::[0-9]*)?(?P<path>[^?#]*)(?P<query>\?[^#]*)?(?P<fragment>#(?:.|\n)*)?"


def _counts(column: pa.Array, table: np.ndarray) -> np.ndarray:
    data, offs = buffers(column)
    total = np.concatenate([[0], np.cumsum(table[data[offs[0] : offs[-1]]])])
    return total[offs[1:] - offs[0]] - total[offs[:-1] - offs[0]]


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


def features(urls: pa.Array) -> tuple[np.ndarray, list, list]:
    """(rows x FEATURES, last host label, last two)."""
    urls = pc.fill_null(urls.cast(pa.string()), "")
    n = len(urls)
    if not n:
        return np.zeros((0, len(FEATURES))), [], []
    parts = pc.extract_regex(urls, _PARTS)
    host, path, query, fragment, scheme = (pc.fill_null(pc.struct_field(parts, k), "") for k in ("host", "path", "query", "fragment", "scheme"))
    host = pc.utf8_lower(host)
    size = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False).astype(float)
    digit = _bytes(b"0123456789")
    data, offs = buffers(urls)
    row = np.repeat(np.arange(n), np.diff(offs))
    pair, count = np.unique(row * 256 + data[offs[0] : offs[-1]], return_counts=True)
    length = np.maximum(np.diff(offs), 1)
    p = count / length[pair >> 8]
    entropy = np.bincount(pair >> 8, -p * np.log2(p), minlength=n)
    q = _counts(query, _bytes(b"&;")) + (size(query) > 1)
    labels = pc.split_pattern(host, ".")
    longest = np.array([max(map(len, x)) for x in labels.to_pylist()], float)
    words = labels.to_pylist()
    secure = np.array(pc.equal(pc.utf8_lower(scheme), "https")).astype(float)
    columns = [size(urls), size(host), size(path), _counts(path, _bytes(b"/")), _counts(urls, digit) / length, entropy, q]
    columns += [_counts(host, _bytes(b"-")), _counts(host, _bytes(b".")) + 1, size(query), size(fragment)]
    columns += [_counts(urls, _bytes(bytes(range(65, 91)))), _counts(host, digit), longest, secure, _counts(urls, _bytes(b"%"))]
    return np.stack([np.asarray(c, float) for c in columns], axis=1), [w[-1] for w in words], [".".join(w[-2:]) for w in words]


def _rates(suffix: list, y: np.ndarray, base: float) -> dict:
    total: dict[str, list[float]] = {}
    for s, v in zip(suffix, y):
        t = total.setdefault(s, [0.0, 0.0])
        t[0] += v
        t[1] += 1
    return {s: (a + SMOOTH * base) / (n + SMOOTH) for s, (a, n) in total.items()}


class Trees:
    """Boosted trees over binned features, and the suffixes' statistics."""

    def __init__(self, urls: list, y: np.ndarray):
        y = np.asarray(y, float)
        self.base = float(y.mean()) if len(y) else 0.0
        self.trees: list[list[tuple]] = []
        x, one, two = features(pa.array(urls, pa.string()))
        self.rates = [_rates(one, y, self.base), _rates(two, y, self.base)]
        if len(set(y.tolist())) < 2:
            self.edges, self.start = [], None
            return
        fold = np.arange(len(y)) % FOLDS
        stats = np.zeros((len(y), 2))
        for f in range(FOLDS):
            held = fold == f
            for k, s in enumerate((one, two)):
                known = _rates([v for v, h in zip(s, held) if not h], y[~held], self.base)
                stats[held, k] = [known.get(v, self.base) for v, h in zip(s, held) if h]
        x = np.concatenate([x, stats], axis=1)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.start = float(np.log(self.base / (1 - self.base)))
        b = self._binned(x)
        margin = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(b, p - y, np.maximum(p * (1 - p), 1e-9))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        node, levels = np.zeros(len(b), np.int64), []
        for depth in range(DEPTH):
            n = 1 << depth
            best = np.full(n, 1e-9)
            where = np.zeros((n, 2), np.int64)
            where[:, 1] = BINS  # all go left
            for j in range(b.shape[1]):
                at = node * BINS + b[:, j]
                gl = np.bincount(at, g, minlength=n * BINS).reshape(n, BINS).cumsum(axis=1)
                hl = np.bincount(at, h, minlength=n * BINS).reshape(n, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(n), cut]
                better = top > best + 1e-12
                best[better] = top[better]
                where[better] = np.stack([np.full(n, j), cut], axis=1)[better]
            levels.append(where)
            node = node * 2 + (b[np.arange(len(b)), where[node, 0]] > where[node, 1])
        leaves = 1 << DEPTH
        value = -RATE * np.bincount(node, g, minlength=leaves) / (np.bincount(node, h, minlength=leaves) + LAMBDA)
        self.trees.append((levels, value))
        return value[node]

    def __call__(self, urls: pa.Array) -> np.ndarray:
        """The probability that each URL is bad."""
        x, one, two = features(urls)
        if self.start is None:
            return np.full(len(x), self.base)
        stats = [[self.rates[k].get(s, self.base) for s in (one, two)[k]] for k in (0, 1)]
        b = self._binned(np.concatenate([x, np.array(stats).T.reshape(-1, 2)], axis=1))
        margin = np.full(len(b), self.start)
        for levels, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for where in levels:
                node = node * 2 + (b[np.arange(len(b)), where[node, 0]] > where[node, 1])
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """From (url, label); rows with NULLs don't count. At most ``sample`` distinct URLs, drawn by hash, reach the driver."""
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).dropna()
    known = rows.groupBy("url").agg(F.avg((F.col("label") != 0).cast("double")).alias("label")).withColumn("o", F.xxhash64("url", F.lit(3)))
    rows = drawn(known, "o", sample).toArrow()
    return Trees(rows["url"].to_pylist(), rows["label"].to_numpy())


def seeds(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(url, label) of the pages: 1 where the host has one of a block list's words. The words themselves are no features."""
    host: Column = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hit = F.lit(False)
    for w in words:
        hit = hit | host.contains(w.lower())
    return pages.where("url is not null").select("url", hit.cast("int").alias("label"))


def score(pages: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """page_id, url, score, blocked; the model's size is bounded by the training sample."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            url = b.column(1)
            p = shared.value(url)
            none = np.array(pc.fill_null(pc.equal(pc.binary_length(url), 0), True))
            yield pa.RecordBatch.from_arrays([b.column(0), url, pa.array(p, mask=none), pa.array((p >= threshold) & ~none)], names=["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(lean(run), RESULT)
