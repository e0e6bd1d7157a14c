"""Arrow-buffer text kernels shared by the corpus operators.

Tokens are found and hashed on the UTF-8 bytes of a whole Arrow batch with numpy, so no Python string is made
for a token.  Two alphabets exist: ``RAW`` (a token is a run without ASCII white space) and ``WORD`` (a run of
ASCII letters, digits and non-ASCII bytes, lower-cased).  NULL texts are read as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WBASE = 0xD1342543DE82EF95
_WBASE_INV = pow(_WBASE, -1, 1 << 64)

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        step = np.full(size, base, dtype=U64)
        step[0] = 1
        have = _tables[base] = np.cumprod(step, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit; works on a copy."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
RAW = np.ones(256, dtype=bool)
RAW[[9, 10, 11, 12, 13, 32]] = False
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


class Slice:
    """Some consecutive rows' tokens: ``first[i]:first[i+1]`` are row i's, with byte spans and 64-bit hashes."""

    __slots__ = ("rows", "buf", "starts", "ends", "first", "hashes", "bounds")

    def __init__(self, rows: slice, buf, starts, ends, first, hashes, bounds):
        self.rows, self.buf, self.starts, self.ends = rows, buf, starts, ends
        self.first, self.hashes, self.bounds = first, hashes, bounds

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string or binary column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if bufs[1] is not None and bufs[1].size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


PIECE = 8 << 20


def _in_pieces(buf: np.ndarray, base: int, n: int, table: np.ndarray, rows: slice) -> Slice:
    """One row's tokens, found in pieces of about ``PIECE`` bytes that end where no token does go on."""
    starts, ends, hashes, at = [], [], [], 0
    while at < n:
        stop = min(at + PIECE, n)
        while stop < n and table[buf[base + stop]]:
            off = np.flatnonzero(~table[buf[base + stop : base + min(stop + PIECE, n)]])
            stop = stop + int(off[0]) if len(off) else min(stop + PIECE, n)
        s = tokenise(buf, np.array([base + at, base + stop]), table, rows, whole=True)
        starts.append(s.starts + at), ends.append(s.ends + at), hashes.append(s.hashes)
        at = stop
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return Slice(rows, buf[base : base + n], starts, ends, np.array([0, len(starts)]), hashes, np.array([0, n]))


def tokenise(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, rows: slice, whole: bool = False) -> Slice:
    base, n = int(offs[0]), int(offs[-1] - offs[0])
    if n > PIECE and len(offs) == 2 and not whole:
        return _in_pieces(buf, base, n, table, rows)
    b, rel = buf[base : base + n], offs - base
    if n == 0:
        z = np.zeros(0, np.int64)
        return Slice(rows, b, z, z, np.zeros(len(offs), np.int64), np.zeros(0, U64), rel)
    tok = table[b]
    edge = tok.copy()
    edge[1:] &= ~tok[:-1]
    inner = rel[1:-1]
    inner = inner[inner < n]
    edge[inner] = tok[inner]
    starts = np.flatnonzero(edge)
    edge = tok.copy()
    edge[:-1] &= ~tok[1:]
    last = inner[inner > 0] - 1
    edge[last] = tok[last]
    ends = np.flatnonzero(edge) + 1
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[b] * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASE_INV, n)[starts]
    h = mix(h + (ends - starts).astype(U64) * U64(0xE7037ED1A0B428DB))
    return Slice(rows, b, starts, ends, np.searchsorted(starts, rel), h, rel)


def slices(column, table: np.ndarray = RAW, lower: bool = False, target: int = 1 << 20) -> Iterator[Slice]:
    """The rows in runs of about ``target`` bytes (one row at least)."""
    if len(column) == 0:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if lower and not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    buf, offs = buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + target, side="right")) - 1
        to = min(n, max(to, at + 1))
        if lower:
            yield tokenise(*buffers(pc.utf8_lower(column.slice(at, to - at))), table, slice(at, to))
        else:
            yield tokenise(buf, offs[at : to + 1], table, slice(at, to))
        at = to


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``size`` tokens; the caller drops those that cross rows."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.empty(len(tokens) + 1, U64)
    total[0] = 0
    np.cumsum(tokens * powers(_WBASE, len(tokens)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_WBASE_INV, n))


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat token index of every window that stays in its row, and its row."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    skip = first[:-1] - (np.cumsum(count) - count)
    return np.arange(len(row)) + skip[row], row


def ids_of(column) -> np.ndarray:
    """The id column as int64; NULL becomes the least int64 (see ``ids_back``)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


NULL_ID = -(1 << 63)


def ids_back(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def shingle_hashes(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` tokens; a row of fewer tokens has its whole text as one. Rows ascend."""
    at, row = window_starts(s.first, size)
    h = window_hashes(s.hashes, size)[at] if len(at) else np.zeros(0, U64)
    count = s.counts()
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        total = np.zeros(len(s.hashes) + 1, U64)
        np.cumsum(s.hashes * powers(_WBASE, len(s.hashes)), out=total[1:])
        a, z = s.first[short], s.first[short + 1]
        more = mix((total[z] - total[a]) * powers(_WBASE_INV, len(s.hashes))[a] + count[short].astype(U64))
        h, row = np.concatenate([h, more]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
