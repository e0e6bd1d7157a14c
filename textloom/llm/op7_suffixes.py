"""Suffix-array dedup: a distributed difference-cover (mod 3) suffix array over the text that can hold repeats.

Tokens are runs without ASCII white space; a repeat is a run of ``length`` tokens that occurs more than once.

1. Candidates.  In every run of ``length - ANCHOR + 1`` shingles of ``ANCHOR`` tokens the least hash is an anchor, so two copies of a
   repeat share an anchor.  Anchors that occur once are dropped; what lies within ``length`` of the others are the
   candidate regions.  No repeat lies outside them.  Equal regions are kept once, with a mark; their other copies are later
   occurrences as a whole.  (``whole`` takes all texts as regions instead, with the same result.)
2. Sampled triples.  The triples of tokens at the positions 1 and 2 modulo 3 of each region are sorted, range-partitioned by sampled splitters, and
   named by rank.  The names' triples are sorted and named in turn (3, 9, 27, ... tokens), until a name covers ``length``
   tokens, which is as deep as the order is needed; names that are unique need no further round.
3. The remaining suffixes (position 0 modulo 3) are sorted by token and the next suffix's name, and merged with the sampled ones
   by comparing (token, name) with those at 1 and (token, token, name) with those at 2.
4. Adjacent suffixes whose first ``length`` tokens agree are occurrences of one repeat: the least (doc_id, position) is its first, the
   others are later ones; positions merge to maximal intervals by document and role.  A chunk of regions merges and compares its own suffixes
   first, token by token, and sends one for each that differ; between chunks, neighbours are compared by 64-bit hashes of the tokens.

Anchors, regions and suffixes that many texts share are combined where they are before they are sent, so a passage of any number of
copies sends a row for each batch or chunk.  Between rounds the state is a table in the shared folder.

Defined cases: a NULL or short text has no repeat; an empty table gives no rows; rows of one doc_id count as
copies of one document, whose intervals are pooled (at the same position they tie, and all are first); a NULL
doc_id is an id of its own, less than all others (an id of -2**63 is read as NULL); further columns are ignored; a very long text is
read in pieces of 8 MB, in memory by its number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .op8_windows import _FOUND, RESULT, home, intervals, send_found
from .packed import Stored, batch, buckets, combined, gather, lean, lean_pair, lean_table, pack, split, unpack
from .text import NULL_ID, RAW, buffers, ids_of, mix, slices, window_hashes, window_starts

LENGTH, ANCHOR, FLUSH, SPLITTERS = 50, 25, 1_000_000, 32
U64 = np.uint64
_SENT = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("again", pa.binary())])
_NEAR = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary())])
_REGION = pa.schema([("chunk", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("twice", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])
_TRIPLE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("at", pa.binary())])
_NAMED = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("name", pa.binary()), ("open", pa.binary())])
_SUFFIX = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("words", "t0", "t1", "r0", "r1", "r2", "kind", "h", "doc", "pos", "twice"))])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, rows)], schema)


def anchors(h: np.ndarray, first: np.ndarray, wide: int) -> np.ndarray:
    """Places of the least hash in every run of ``wide`` shingles of a row (the leftmost of equal ones); ``first`` are the rows' edges."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    found = np.zeros(n, bool)
    size = np.diff(first)
    full = np.repeat(np.maximum(first[1:] - wide + 1, first[:-1]), size)  # a run that starts here stays in its row
    start = np.flatnonzero((np.arange(n) < full) & (np.repeat(size, size) >= wide))
    if len(start):
        step, least = 1, np.arange(n)
        while step * 2 <= wide:
            left, right = least[: n - step], least[step:]
            least[: n - step] = np.where(h[left] <= h[right], left, right)
            step *= 2
        left, right = least[start], least[start + wide - step]
        found[np.where(h[left] <= h[right], left, right)] = True
    return np.flatnonzero(found)


def _anchored(length: int, size: int, n: int):
    """mapInArrow function: a batch's anchors; of equal ones the least by hash in the buckets from 0, the others by document in those from n."""

    def emit(held):
        h, doc, pos = (np.concatenate(x) for x in zip(*held))
        least, again, later = combined(h, doc, pos)
        h, d, p = h[least], doc[least], pos[least]
        rows = [(i, pack(h[at], plain=True), pack(d[at]), pack(p[at]), pack(again[at])) for i, at in split((h >> U64(32)) % U64(n), n)]
        d, p = doc[later], pos[later]
        rows += [(n + i, b"", pack(d[at]), pack(p[at]), b"") for i, at in split(_home(d, n), n)]
        for k in range(0, len(rows), 256):
            yield batch(_SENT, rows[k : k + 256])

    def run(batches):
        held, count = [], 0
        for b in batches:
            ids = ids_of(b.column(0))
            for s in slices(b.column(1), RAW):
                at, row = window_starts(s.first, size)
                if not len(at):
                    continue
                h = window_hashes(s.hashes, size)[at]
                edges = np.searchsorted(row, np.arange(len(s.first)))
                got = anchors(h, edges, length - size + 1)
                held.append((h[got], ids[s.rows][row[got]], (at[got] - s.first[row[got]]).astype(np.int32)))
                count += len(got)
                if count >= FLUSH:
                    yield from emit(held)
                    held, count = [], 0
        if held:
            yield from emit(held)

    return run


def _repeated(n: int):
    """A bucket's anchors that occur again, by document."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= n:
            return _rows(_NEAR, [(bucket - n, d.as_py(), p.as_py()) for d, p in zip(table["doc"], table["pos"])])
        doc, pos = gather(table["doc"]), gather(table["pos"])
        least, again, later = combined(gather(table["h"]), doc, pos, gather(table["again"]))
        keep = np.concatenate([least[again], later])
        doc, pos = doc[keep], pos[keep]
        return _rows(_NEAR, [(i, pack(doc[at]), pack(pos[at])) for i, at in split(_home(doc, n), n)])

    return run


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    """A document's bucket; ``_home_column`` gives the same in the JVM, so that texts need not pass through Python for it."""
    return (doc ^ (doc >> 20)) % n


def _home_column(doc: str, n: int):
    c = F.coalesce(F.col(doc), F.lit(NULL_ID))
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 20)), F.lit(n)).cast("int")


def _sent_regions(doc, start, span, words, n: int, m: int) -> list[tuple]:
    """Regions (their words one after the other) by hash: of equal ones the least, with its words and a mark; the others by document."""
    edge = np.concatenate([[0], np.cumsum(span)])
    place = np.arange(len(words)) - np.repeat(edge[:-1], span)
    h = mix(np.add.reduceat(mix(words + mix(place.astype(U64) * U64(0xA0761D6478BD642F))), edge[:-1]) + span.astype(U64))
    least, again, later = combined(h, doc, start)
    rows = []
    for i, k in split((h[least] >> U64(32)) % U64(m), m):
        at = least[k]
        flat = np.repeat(edge[at] - (np.cumsum(span[at]) - span[at]), span[at]) + np.arange(span[at].sum())
        known, codes = np.unique(words[flat], return_inverse=True)
        rows.append((i, pack(h[at], plain=True), pack(doc[at]), pack(start[at]), pack(span[at].astype(np.int32)), pack(again[k]), pack(known, plain=True), pack(codes.astype(np.uint32))))
    return rows + _copy_rows(doc[later], start[later], span[later], n)


def _copy_rows(doc, start, span, n: int) -> list[tuple]:
    return [(-1 - i, b"", pack(doc[k]), pack(start[k]), pack(span[k].astype(np.int32)), b"", b"", b"") for i, k in split(_home(doc, n), n)]


def _regions(length: int, size: int, n: int, m: int):
    """cogroup function: (bucket's documents, their repeated anchors) to candidate regions by hash of their words."""

    def run(texts: pa.Table, near: pa.Table) -> pa.Table:
        doc, pos = gather(near["doc"]).astype(np.int64), gather(near["pos"]).astype(np.int64)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        ids = ids_of(texts["doc_id"])
        wanted = np.isin(ids, doc)
        texts, ids = texts.filter(pa.array(wanted)), ids[wanted]
        out = []
        column = texts["text"].combine_chunks() if texts.num_rows else pa.array([], pa.string())
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        for s in slices(column, RAW):
            here = ids[s.rows]
            a, z = np.searchsorted(doc, here, "left"), np.searchsorted(doc, here, "right")
            count = z - a
            row = np.repeat(np.arange(len(here)), count)
            total = np.cumsum(count) - count
            p = pos[np.arange(len(row)) - total[row] + a[row]] if len(row) else np.zeros(0, np.int64)
            tokens = s.counts()
            start, end = np.maximum(p - (length - size), 0), np.minimum(p + length, tokens[row])
            good = start < end
            row, start, end = row[good], start[good], end[good]
            if not len(row):
                continue
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])])  # starts and ends ascend in a row
            heads = np.flatnonzero(new)
            row, start, end = row[heads], start[heads], end[np.append(heads[1:], len(end)) - 1]
            long = end - start >= length
            row, start, end = row[long], start[long], end[long]
            span = end - start
            if not len(row):
                continue
            flat = np.repeat(s.first[row] + start - (np.cumsum(span) - span), span) + np.arange(span.sum())
            out.append((here[row], start, span, s.hashes[flat]))
        return _rows(_REGION, _sent_regions(*(np.concatenate(x) for x in zip(*out)), n, m) if out else [])

    return run


def _whole(length: int, n: int, m: int):
    """mapInArrow function: whole texts of ``length`` tokens or more as regions."""

    def run(batches):
        for b in batches:
            ids = ids_of(b.column(0))
            for s in slices(b.column(1), RAW, target=1 << 23):
                span = s.counts()
                long = np.flatnonzero(span >= length)
                if len(long):
                    words = s.hashes[np.repeat(span >= length, span)]
                    yield batch(_REGION, _sent_regions(ids[s.rows][long], np.zeros(len(long), np.int64), span[long], words, n, m))

    return run


def _distinct(n: int):
    """A chunk's regions, equal ones once; other copies go by document with chunk -1 - bucket."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        if chunk < 0:
            return table
        hs, docs, starts, spans, marks, texts = [], [], [], [], [], []
        for i in range(table.num_rows):
            h, doc, start, span, twice, known, codes = (unpack(table[k][i].as_buffer()) for k in ("h", "doc", "start", "size", "twice", "words", "codes"))
            edge = np.concatenate([[0], np.cumsum(span)])
            words = known[codes]
            hs.append(h), docs.append(doc), starts.append(start), spans.append(span), marks.append(twice)
            texts += [(words, int(edge[k]), int(edge[k + 1])) for k in range(len(h))]
        h, doc, start, span, marks = (np.concatenate(x) for x in (hs, docs, starts, spans, marks))
        least, twice, later = combined(h, doc, start, marks)
        words = np.concatenate([w[a:z] for w, a, z in (texts[k] for k in least)])
        known, codes = np.unique(words, return_inverse=True)
        row = (chunk, b"", pack(doc[least]), pack(start[least]), pack(span[least].astype(np.int32)), pack(twice.astype(np.int8)), pack(known, plain=True), pack(codes.astype(np.uint32)))
        return _rows(_REGION, [row, *_copy_rows(doc[later], start[later], span[later].astype(np.int64), n)])

    return run


class Chunk:
    """A chunk's regions as flat arrays: words, each word's place in its region, and the number of words left from it on."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.doc, self.start, self.size, self.twice = (unpack(row[k]) for k in ("doc", "start", "size", "twice"))
        self.words = unpack(row["words"])[unpack(row["codes"])]
        self.size = self.size.astype(np.int64)
        first = np.cumsum(self.size) - self.size
        self.region = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.words)) - first[self.region]
        self.left = self.size[self.region] - self.place
        self.sample = np.flatnonzero(self.place % 3)

    def ahead(self, values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """values[at + step], or 0 beyond the region's end."""
        inside = self.left[at] > step
        return np.where(inside, values[np.minimum(at + step, len(values) - 1)], values.dtype.type(0))


def _table_rows(batches):
    for b in batches:
        yield from b.to_pylist()


def _drawn(batches):
    """Triples for the splitters: evenly spaced ones of every chunk."""
    for row in _table_rows(batches):
        c = Chunk(row)
        at = np.unique(np.linspace(0, len(c.words) - 1, SPLITTERS).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (c.words[at], c.ahead(c.words, at, 1), c.ahead(c.words, at, 2))], names=["a", "b", "c"])


def _range(splitters: np.ndarray, a, b, c) -> np.ndarray:
    """Bucket of each triple: the number of splitters that are not above it."""
    out = np.searchsorted(splitters[:, 0], a, "left")
    for lo in np.unique(out[out < len(splitters)]):
        same = np.flatnonzero((out == lo) & (a == splitters[lo, 0]))
        if len(same):
            hi = int(np.searchsorted(splitters[:, 0], splitters[lo, 0], "right"))
            for k in range(lo, hi):
                s = splitters[k]
                x, y = b[same], c[same]
                above = (x > s[1]) | ((x == s[1]) & (y >= s[2]))
                out[same[above]] = k + 1
                same = same[above]
    return out


def _send(c: Chunk, bucket, a, b, z, at, n: int):
    rows = [(i, c.id, pack(a[k]), pack(b[k]), pack(z[k]), pack(at[k].astype(np.uint32))) for i, k in split(bucket, n)]
    for k in range(0, len(rows), 512):
        yield batch(_TRIPLE, rows[k : k + 512])


def _first_triples(shared):
    def run(batches):
        splitters = shared.value
        for row in _table_rows(batches):
            c = Chunk(row)
            t = (c.words[c.sample], c.ahead(c.words, c.sample, 1), c.ahead(c.words, c.sample, 2))
            yield from _send(c, _range(splitters, *t), *t, c.sample, len(splitters) + 1)

    return run


def _named(table: pa.Table, refine: bool) -> pa.Table:
    """Sort a bucket's triples; a name is the bucket and the number of lesser triples in it, so names keep the order."""
    bucket = table["bucket"][0].as_py()
    parts = [unpack(x.as_buffer()) for x in table["at"]]
    a, b, c, at = gather(table["a"]), gather(table["b"]), gather(table["c"]), np.concatenate(parts)
    order = np.lexsort((c, b, a))
    x, y, z = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(a)))
    low = np.repeat(heads, size)
    if refine:  # the name so far, and the number of lesser ones that had the same
        old = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        name = x + (low - np.repeat(old, np.diff(np.append(old, len(x)))))
    else:
        name = (np.int64(bucket) << 32) + low + 1
    names, shared = np.empty(len(a), np.int64), np.empty(len(a), bool)
    names[order], shared[order] = name, np.repeat(size > 1, size)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    rows = []
    for i, chunk in enumerate(table["chunk"].to_pylist()):
        s = slice(edges[i], edges[i + 1])
        rows.append((chunk, pack(at[s]), pack(names[s]), pack(shared[s])))
    return _rows(_NAMED, rows)


def _updated(keep_old: bool):
    """cogroup function: a chunk's state and its new names to its next state."""

    def run(state: pa.Table, new: pa.Table) -> pa.Table:
        if keep_old:
            row = state.to_pylist()[0]
            names, still = unpack(row["name"]).copy(), np.zeros(len(unpack(row["name"])), bool)
        else:
            c = Chunk(state.to_pylist()[0])
            names, still = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), bool)
        chunk = state["chunk"][0].as_py()
        if new.num_rows:
            at = gather(new["at"])
            names[at], still[at] = gather(new["name"]), gather(new["open"])
        return _rows(_NAMED, [(chunk, b"", pack(names), pack(still))])

    return run


def _next_triples(step: int, n: int):
    def run(batches):
        for row in _table_rows(batches):
            c = Chunk(row)
            names, still = unpack(row["name"]), unpack(row["open"])
            at = np.flatnonzero(still)
            if len(at):
                t = (names[at], c.ahead(names, at, step), c.ahead(names, at, 2 * step))
                yield from _send(c, t[0] >> 32, *t, at, n)

    return run


def alike(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at neighbouring places of ``at`` agree in their first ``length`` words, compared word by word."""
    same = np.zeros(max(0, len(at) - 1), bool)
    left = np.arange(len(same))
    for k in range(length):
        left = left[words[at[left] + k] == words[at[left + 1] + k]]
        if not len(left):
            return same
    same[left] = True
    return same


def _suffixes(shared, length: int, m: int):
    """A chunk's suffixes of ``length`` words or more, to the bucket of their first triple.

    The chunk's own suffixes are merged and compared first: of those that agree, the least goes, with a mark, and the others, being later
    occurrences for certain, go by document to the buckets beyond the ranges.
    """

    def run(batches):
        splitters = shared.value
        n = len(splitters) + 1
        for row in _table_rows(batches):
            c = Chunk(row)
            names = unpack(row["name"])
            at = np.flatnonzero(c.left >= length)
            t0, t1, t2 = c.words[at], c.ahead(c.words, at, 1), c.ahead(c.words, at, 2)
            r = [c.ahead(names, at, k) for k in range(3)]
            kind = (c.place[at] % 3).astype(np.int8)
            order = merged_order(t0, t1, *r, kind)
            group = np.empty(len(at), np.int64)
            group[order] = np.cumsum(np.concatenate([[False], ~alike(c.words, at[order], length)])) if len(at) else 0
            doc, pos = c.doc[c.region[at]], (c.start[c.region[at]] + c.place[at]).astype(np.int32)
            least, twice, later = combined(group, doc, pos, c.twice[c.region[at]] > 0)
            h = window_hashes(c.words, length)[at[least]]
            t0, t1, t2, kind, d, p = t0[least], t1[least], t2[least], kind[least], doc[least], pos[least]
            r = [x[least] for x in r]
            rows = []
            for i, k in split(_range(splitters, t0, t1, t2), n):
                words, code = np.unique(np.concatenate([t0[k], t1[k]]), return_inverse=True)
                code = code.astype(np.uint32)
                rows.append((i, pack(words, plain=True), pack(code[: len(k)]), pack(code[len(k) :]), *(pack(x[k]) for x in r), pack(kind[k]), pack(h[k], plain=True), pack(d[k]), pack(p[k]), pack(twice[k].astype(np.int8))))
            d, p = doc[later], pos[later]
            rows += [(n + i, *[b""] * 8, pack(d[k]), pack(p[k]), b"") for i, k in split(home(d, m), m)]
            for k in range(0, len(rows), 256):
                yield batch(_SUFFIX, rows[k : k + 256])

    return run


def merged_order(t0, t1, r0, r1, r2, kind) -> np.ndarray:
    """The suffix array of a bucket: the difference-cover merge of its suffixes by place modulo 3."""
    s, z = np.flatnonzero(kind), np.flatnonzero(kind == 0)
    s = s[np.argsort(r0[s], kind="stable")]
    z = z[np.lexsort((r1[z], t0[z]))]
    rank = np.empty(len(kind), np.int64)
    rank[s], rank[z] = np.arange(len(s)), np.arange(len(z))
    for m, keys in ((1, (r1, t0)), (2, (r2, t1, t0))):
        x = s[kind[s] == m]
        both = np.concatenate([z, x])
        own = np.arange(len(both)) >= len(z)
        order = np.lexsort((own, *(k[both] for k in keys)))  # at a tie the remaining suffix goes first
        is_x = own[order]
        before_x, before_z = np.cumsum(is_x), np.cumsum(~is_x)
        np.add.at(rank, both[order[~is_x]], before_x[~is_x])
        np.add.at(rank, both[order[is_x]], before_z[is_x])
    return np.argsort(rank, kind="stable")


def _adjacent(ranges: int, n: int):
    """Occurrences of a bucket's repeats: neighbours in the suffix array whose first ``length`` words agree, by a 64-bit hash of them."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= ranges:
            some = [(bucket - ranges, d.as_py(), p.as_py(), pack(np.ones(len(unpack(p.as_buffer())), bool))) for d, p in zip(table["doc"], table["pos"])]
            return pa.Table.from_batches([batch(_FOUND, some)])
        t0, t1 = [], []
        for x, a, b in zip(table["words"], table["t0"], table["t1"]):
            words = unpack(x.as_buffer())
            t0.append(words[unpack(a.as_buffer())]), t1.append(words[unpack(b.as_buffer())])
        r0, r1, r2, kind, h, doc, pos, twice = (gather(table[k]) for k in ("r0", "r1", "r2", "kind", "h", "doc", "pos", "twice"))
        order = merged_order(np.concatenate(t0), np.concatenate(t1), r0, r1, r2, kind)
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(np.concatenate([[False], h[order[1:]] != h[order[:-1]]]))
        least, again, later = combined(group, doc, pos, twice > 0)
        head = least[again]
        return send_found(np.concatenate([doc[head], doc[later]]), np.concatenate([pos[head], pos[later]]).astype(np.int32), np.arange(len(head) + len(later)) >= len(head), n)

    return run


def _copies(length: int, n: int):
    def run(batches):
        for row in _table_rows(batches):
            doc, start, size = (unpack(row[k]) for k in ("doc", "start", "size"))
            count = size.astype(np.int64) - length + 1
            which = np.repeat(np.arange(len(doc)), count)
            pos = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            yield from send_found(doc[which], pos.astype(np.int32), np.ones(len(which), bool), n).to_batches()

    return run


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", n: int | None = None, whole: bool = False) -> DataFrame:
    """Maximal intervals of tokens in repeats: doc_id, start_token, end_token, n_tokens, role (first, later).

    ``whole``: the suffix array is that of all texts, not of the candidate regions; the result is the same.
    """
    if length < 4:
        raise ValueError("length must be 4 or more")
    spark = docs.sparkSession
    n = n or buckets(spark)
    size = max(2, length // 2) if length != LENGTH else ANCHOR
    m = max(4, n // 2)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if whole:
        regions = Stored(rows.mapInArrow(lean(_whole(length, n, m)), _ddl(_REGION)).groupBy("chunk").applyInArrow(lean_table(_distinct(n)), _ddl(_REGION)), "regions")
    else:
        near = rows.mapInArrow(lean(_anchored(length, size, n)), _ddl(_SENT)).groupBy("bucket").applyInArrow(lean_table(_repeated(n)), _ddl(_NEAR))
        near = Stored(near, "anchors")
        texts = rows.select(_home_column("doc_id", n).alias("bucket"), "doc_id", "text")
        found = texts.groupBy("bucket").cogroup(near.df.groupBy("bucket")).applyInArrow(lean_pair(_regions(length, size, n, m)), _ddl(_REGION))
        regions = Stored(found.groupBy("chunk").applyInArrow(lean_table(_distinct(n)), _ddl(_REGION)), "regions")
        near.drop()
    chunks, copies = regions.df.where("chunk >= 0"), regions.df.where("chunk < 0")
    drawn = chunks.mapInArrow(lean(_drawn), "a long, b long, c long").toArrow()
    triples = np.stack([drawn[k].to_numpy().view(U64) for k in "abc"], axis=1) if drawn.num_rows else np.zeros((0, 3), U64)
    triples = triples[np.lexsort(triples.T[::-1])]
    splitters = np.unique(triples[np.linspace(0, len(triples) - 1, n + 1).astype(int)[1:-1]], axis=0) if len(triples) else triples
    shared = spark.sparkContext.broadcast(splitters)
    ranges = len(splitters) + 1
    named = chunks.mapInArrow(lean(_first_triples(shared)), _ddl(_TRIPLE)).groupBy("bucket").applyInArrow(lean_table(lambda t: _named(t, False)), _ddl(_NAMED))
    state = Stored(chunks.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(lean_pair(_updated(False)), _ddl(_NAMED)), "names")
    covered = 3
    while covered < length:
        joined = chunks.join(state.df.drop("at"), "chunk")
        named = joined.mapInArrow(lean(_next_triples(covered, ranges)), _ddl(_TRIPLE)).groupBy("bucket").applyInArrow(lean_table(lambda t: _named(t, True)), _ddl(_NAMED))
        after = Stored(state.df.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(lean_pair(_updated(True)), _ddl(_NAMED)), "names")
        state.drop()
        state, covered = after, covered * 3
    suffixes = chunks.join(state.df.drop("at"), "chunk").mapInArrow(lean(_suffixes(shared, length, m)), _ddl(_SUFFIX))
    kind = "bucket int, doc binary, pos binary, later binary"
    hits = suffixes.groupBy("bucket").applyInArrow(lean_table(_adjacent(ranges, m)), kind)
    hits = hits.union(copies.mapInArrow(lean(_copies(length, m)), kind))
    result = Stored(hits.groupBy("bucket").applyInArrow(lean_table(intervals(length)), RESULT), "intervals")
    regions.drop(), state.drop()
    return result.df


def _cut(at: int, spans_at: int, size_at: int | None, width: int):
    """mapInArrow function: the texts without their spans of tokens; rows that nothing is left of go."""

    def run(batches):
        for b in batches:
            text = pc.fill_null(b.column(at).cast(pa.string()), "")
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            lists = b.column(spans_at).to_pylist()
            for s in slices(text, RAW):
                for i in range(len(s.first) - 1):
                    spans = lists[s.rows.start + i]
                    if not spans:
                        continue
                    raw = s.buf[s.bounds[i] : s.bounds[i + 1]].tobytes()
                    starts = s.starts[s.first[i] : s.first[i + 1]] - s.bounds[i]
                    parts, last = [], 0
                    for x in sorted(spans, key=lambda x: x["start_token"]):
                        a = int(starts[x["start_token"]])
                        parts.append(raw[last : max(a, last)])
                        last = max(last, int(starts[x["end_token"]]) if x["end_token"] < len(starts) else len(raw))
                    left = b"".join([*parts, raw[last:]]).decode().rstrip() if last == len(raw) else b"".join([*parts, raw[last:]]).decode()
                    texts[s.rows.start + i] = left
                    keep[s.rows.start + i] = bool(left.strip())
            columns = [b.column(k) for k in range(width)]
            columns[at] = pa.array(texts, pa.string())
            if size_at is not None:
                columns[size_at] = pc.utf8_length(columns[at]).cast(b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:width]).filter(pa.array(keep))

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the later occurrences of repeats; documents that nothing is left of go, all others stay.

    ``n_chars``, where there is one, is counted anew. Rows of one doc_id lose the same tokens' places, as they count as one document.
    """
    later = repeats(docs, length).where("role = 'later'")
    spans = later.groupBy("doc_id").agg(F.collect_list(F.struct("start_token", "end_token")).alias("__spans")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans["__id"]), "left").select(*[docs[c] for c in docs.columns], spans["__spans"])
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None
    return joined.mapInArrow(lean(_cut(at, len(docs.columns), size_at, len(docs.columns))), docs.schema)
