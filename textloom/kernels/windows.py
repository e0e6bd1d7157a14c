"""Size-bounded byte chunks that end at delimiters or patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from .spans import Span, alternation

DEFAULT_TARGET_SIZE = 4096
DEFAULT_DELIMITERS = b"\n.?"


@dataclass(frozen=True)
class ByteOptions:
    """``pattern`` rules out ``delimiters``; ``patterns`` joins them, and then ``pattern`` is not read."""

    size: int = DEFAULT_TARGET_SIZE
    delimiters: bytes = DEFAULT_DELIMITERS
    pattern: bytes | None = None
    patterns: tuple[str, ...] = field(default=())
    prefix: bool = False
    consecutive: bool = False
    forward_fallback: bool = False

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("size must be 1 or more")


def _opens_run(data: bytes, at: int, width: int) -> bool:
    return at < width or data[at - width : at] != data[at : at + width]


class _Finder:
    """Searches for one kind of boundary: a class of single bytes, one pattern, or several patterns."""

    def __init__(self, needles: tuple[bytes, ...], runs: bool, many: bool = False):
        self.needles, self.runs, self.many = needles, runs, many
        self.search = alternation(needles)
        self.width = 1 if not needles else len(needles[0])

    def last(self, data: bytes, start: int, end: int) -> tuple[int, int] | None:
        """The rightmost (place, width) in the window after its first byte."""
        if self.search is None:
            return None
        if self.many and len(self.needles) > 3:  # non-overlapping matches from the left
            found = None
            for m in self.search.finditer(data, start, end):
                found = m
            return (found.start(), len(found.group())) if found and found.start() > start else None
        while end > start:
            best, width = -1, 0
            for n in self.needles:
                at = data.rfind(n, start, end)
                if at > best:
                    best, width = at, len(n)
            if best < 0:
                return None
            if not self.runs or _opens_run(data, best, width):
                return (best, width) if best > start else None
            end = best
        return None

    def first(self, data: bytes, start: int, end: int) -> tuple[int, int] | None:
        """The leftmost one from the window's end on; a run that starts the window is passed over."""
        if self.search is None:
            return None
        at = end
        if self.runs:
            width = self.width
            head = data[start : start + width]
            if head in self.needles:
                skip = start
                while data[skip : skip + width] == head:
                    skip += width
                at = max(at, skip)
        while True:
            if self.many and len(self.needles) <= 3:
                hits = [(p, i) for i, n in enumerate(self.needles) if (p := data.find(n, at)) >= 0]
                if not hits:
                    return None
                place, i = min(hits)
                return place, len(self.needles[i])
            m = self.search.search(data, at)
            if m is None:
                return None
            if not self.runs or _opens_run(data, m.start(), len(m.group())):
                return m.start(), len(m.group())
            at = m.start() + 1


def byte_chunks(data: bytes, options: ByteOptions) -> list[Span]:
    """Spans that cover ``data``; one that no delimiter ends is cut hard, unless a later delimiter may end it."""
    o = options
    single = tuple(bytes([b]) for b in dict.fromkeys(o.delimiters))
    if o.patterns:
        finders = [_Finder(single, o.consecutive), _Finder(tuple(p.encode() for p in o.patterns if p), False, many=True)]
    elif o.pattern is not None:
        finders = [_Finder((o.pattern,) if o.pattern else (), o.consecutive)]
    else:
        finders = [_Finder(single, o.consecutive)]
    searchable = [f for f in finders if f.search is not None]
    out, at, n = [], 0, len(data)
    while n - at > o.size:
        end = at + o.size
        hits = [h for f in searchable if (h := f.last(data, at, end))]
        if hits:
            place, width = max(hits, key=lambda h: h[0])
        elif o.forward_fallback and searchable:
            later = [h for f in searchable if (h := f.first(data, at, end))]
            place, width = min(later, key=lambda h: h[0]) if later else (n, 0)
        else:
            place, width = end, 0
        cut = place if o.prefix or place == n else place + width
        out.append((at, cut))
        at = cut
    if at < n:
        out.append((at, n))
    return out


