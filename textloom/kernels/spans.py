"""Byte-span primitives: splitting, merging short spans, packing, and token counters.

All offsets are UTF-8 byte offsets into ``bytes``; a delimiter is whole code points, so no span breaks one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np

PREV, NEXT, NONE = "prev", "next", "none"
Span = tuple[int, int]
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_blank(data: bytes) -> bool:
    """Nothing but Unicode white space."""
    return not data or (data[0] in b"\t\n\x0b\x0c\r \xc2\xe1\xe2\xe3" and not data.decode("utf-8", "replace").strip(WHITE))


def include_mode(value: str, exact: bool = False) -> str:
    mode = value if exact else str(value).lower()
    if mode not in (PREV, NEXT, NONE):
        raise ValueError(f"include_delim must be 'prev', 'next' or 'none', not {value!r}")
    return mode


@lru_cache(maxsize=256)
def alternation(delimiters: tuple[bytes, ...]) -> re.Pattern[bytes] | None:
    """Leftmost-first search for any of the delimiters; empty ones are never found."""
    known = [d for d in delimiters if d]
    if not known:
        return None
    if all(len(d) == 1 for d in known):
        return re.compile(b"[" + b"".join(re.escape(d) for d in known) + b"]")
    return re.compile(b"|".join(re.escape(d) for d in known))


def encode_all(delimiters: Iterable[str | bytes]) -> tuple[bytes, ...]:
    return tuple(d.encode() if isinstance(d, str) else bytes(d) for d in delimiters)


def split(data: bytes, delimiters: Sequence[bytes], include: str = PREV, least: int = 0) -> list[Span]:
    """Spans between delimiters, the delimiter kept with the one before, with the next one, or dropped; short spans merge."""
    if not data:
        return []
    pattern = alternation(tuple(delimiters))
    if pattern is None:
        return [(0, len(data))]
    at, spans = 0, []
    for m in pattern.finditer(data):
        cut = m.end() if include == PREV else m.start()
        if cut > at:
            spans.append((at, cut))
        at = m.start() if include == NEXT else m.end()
    if at < len(data):
        spans.append((at, len(data)))
    return merge_short(spans, least) if least else spans


def merge_short(spans: list[Span], least: int) -> list[Span]:
    """Join neighbours while the joined span so far, or the new one, has fewer than ``least`` bytes."""
    out: list[Span] = []
    for s, e in spans:
        if out and (out[-1][1] - out[-1][0] < least or e - s < least):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def lines(data: bytes) -> list[Span]:
    """Lines with their newlines."""
    ends = list(accumulate(map(len, data.splitlines(keepends=True)))) if b"\r" not in data and b"\x0b" not in data and b"\x0c" not in data else []
    if not ends:
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+\Z", data)]
    return list(zip([0, *ends], ends))


def pack(counts: Sequence[int], size: int) -> list[int]:
    """Exclusive ends of greedy groups whose counts add up to ``size`` at most; an item that is larger stands alone."""
    total = [0, *accumulate(counts)]
    ends, at = [], 0
    while at < len(counts):
        at = max(at + 1, bisect_right(total, total[at] + size) - 1)
        ends.append(at)
    return ends


def merge_splits(splits: Sequence[str], counts: Sequence[int], size: int) -> tuple[list[str], list[int]]:
    """Texts joined by groups, and the groups' counts; unchanged where every count is above ``size``."""
    if not splits or not counts:
        return [], []
    if len(splits) != len(counts):
        raise ValueError("splits and token_counts must have the same length")
    if all(c > size for c in counts):
        return list(splits), list(counts)
    ends = pack(counts, size)
    edges = list(zip([0, *ends], ends))
    return ["".join(splits[a:z]) for a, z in edges], [sum(counts[a:z]) for a, z in edges]


class Counter:
    """Counts tokens of a span, and lists their spans. ``meter(data)`` prepares a document for many counts."""

    rows = False

    def count(self, data: bytes) -> int:
        return self.meter(data)(0, len(data))

    def meter(self, data: bytes) -> Callable[[int, int], int]:
        raise NotImplementedError

    def spans(self, data: bytes) -> list[Span]:
        raise NotImplementedError


def _points(data: bytes) -> np.ndarray:
    """Byte offsets of the code points, and the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


class CharCounter(Counter):
    def meter(self, data):
        if data.isascii():
            return lambda s, e: e - s
        raw = np.frombuffer(data, np.uint8)
        total = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return lambda s, e: int(total[e] - total[s])

    def spans(self, data):
        at = _points(data).tolist()
        return list(zip(at[:-1], at[1:]))


class ByteCounter(CharCounter):
    def meter(self, data):
        return lambda s, e: e - s


class PatternCounter(Counter):
    """Tokens are the matches of a pattern."""

    def __init__(self, pattern: bytes):
        self.pattern = pattern

    def meter(self, data):
        find = re.compile(self.pattern).findall
        return lambda s, e: len(find(data[s:e]))

    def spans(self, data):
        return [m.span() for m in re.finditer(self.pattern, data)]


class RowCounter(Counter):
    rows = True

    def meter(self, data):
        return lambda s, e: data.count(b"\n", s, e) + 1 if e > s else 0

    def spans(self, data):
        return lines(data)


class TokenizerCounter(Counter):
    """A tokenizer file: its tokens, with offsets widened to a partition of the text."""

    def __init__(self, path: str):
        self.path = path
        self._loaded = None

    def __getstate__(self):
        return {"path": self.path, "_loaded": None}

    @property
    def tokenizer(self):
        if self._loaded is None:
            try:
                from tokenizers import Tokenizer
            except ImportError as error:
                raise ImportError("counting by a tokenizer file needs the tokenizers package") from error
            try:
                self._loaded = Tokenizer.from_file(self.path)
            except Exception as error:
                raise ValueError(f"{self.path} is no tokenizer file: {error}") from error
        return self._loaded

    def meter(self, data):
        def count(s, e):
            if e <= s:
                return 0
            try:
                return len(self.tokenizer.encode(data[s:e].decode()).ids)
            except UnicodeDecodeError:
                return 1

        return count

    def spans(self, data):
        if not data:
            return []
        text = data.decode()
        points = _points(data).tolist()
        starts = [points[min(a, len(points) - 1)] for a, z in self.tokenizer.encode(text).offsets if z > a]
        edges = sorted({0, *starts[1:], len(data)}) if starts else [0, len(data)]
        return list(zip(edges[:-1], edges[1:]))


_NAMED = {"character": CharCounter, "char": CharCounter, "byte": ByteCounter, "row": RowCounter, "word": lambda: PatternCounter(rb"[^ ]+ *| +")}


def counter(name: str | Counter) -> Counter:
    """By name (any case), or by the path of a tokenizer file."""
    if isinstance(name, Counter):
        return name
    made = _NAMED.get(str(name).lower())
    if made is not None:
        return made()
    if str(name).endswith(".json") or Path(str(name)).exists():
        found = TokenizerCounter(str(name))
        _ = found.tokenizer
        return found
    raise ValueError(f"unknown tokenizer {name!r}: character, word, byte, row, or the path of a tokenizer file")
