"""Markdown to structural segments, segments to groups, groups to chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

from . import chunkers as K
from .spans import counter

_EDGE = r"\x20{0,3}"
_CELL = r"\s*:?-+:?\s*"
HEADING = re.compile(_EDGE + r"(\#{1,6})(?:\s+(.*?))?\s*\Z")
FENCE = re.compile(_EDGE + r"(```+|~~~+)\s*(\S*)")
RULE = re.compile(_EDGE + r"([-*_])\1\1+\s*\Z")
DASHES = re.compile(_EDGE + rf"\|?{_CELL}(?:\|{_CELL})*\|?\s*\Z")
ITEM = re.compile(_EDGE + r"(?:[-*+]|\d{1,9}[.)])\s+")
WHOLE = ("table", "code")


@dataclass(frozen=True)
class Segment:
    """A structural span: offsets in code points and bytes, the titles it stands under, a fence's language."""

    kind: str
    char_start: int  # code points
    char_end: int
    byte_start: int  # the same place in UTF-8
    byte_end: int
    heading_path: tuple[str, ...] = ()
    lang: str | None = None

    def text(self, markdown: str) -> str:
        return markdown[self.char_start : self.char_end]

    @property
    def is_empty(self) -> bool:
        return self.char_end <= self.char_start


def _blank(row: str) -> bool:
    return not row or row.isspace()


class _Reader:
    """Finds where the block that starts at a line ends."""

    def __init__(self, rows: list[str]):
        self.rows, self.n = rows, len(rows)

    def until(self, at: int, stop) -> int:
        while at < self.n and not stop(self.rows[at]):
            at += 1
        return at

    def fence(self, at: int, mark: str) -> int:
        def closes(row: str) -> bool:
            m = FENCE.match(row)
            return bool(m) and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2]

        return min(self.n, self.until(at + 1, closes) + 1)

    def list(self, at: int) -> int:
        """Blank lines belong to a list if an item or an indented line follows them."""
        end = at = at + 1
        while True:
            at = self.until(end, lambda row: not _blank(row))
            if at >= self.n or not (ITEM.match(self.rows[at]) or self.rows[at][0] in " \t"):
                return end
            end = at + 1

    def paragraph(self, at: int) -> int:
        return self.until(at + 1, lambda row: _blank(row) or HEADING.match(row) or FENCE.match(row) or ITEM.match(row) or row.lstrip().startswith(">"))


def segment_markdown(md: str) -> list[Segment]:
    """Segments in order; what lies between them is blank."""
    rows = md.splitlines(keepends=True)
    chars = [0, *accumulate(map(len, rows))]
    octets = chars if md.isascii() else [0, *accumulate(len(r.encode()) for r in rows)]
    read, out, path, at = _Reader(rows), [], [], 0
    while (at := read.until(at, lambda row: not _blank(row))) < read.n:
        row, lang = rows[at], None
        if m := FENCE.match(row):
            kind, end, lang = "code", read.fence(at, m[1]), m[2] or None
        elif m := HEADING.match(row):
            kind, end = "heading", at + 1
            path = [*path[: len(m[1]) - 1], (m[2] or "").rstrip("#").strip()]
        elif RULE.match(row):
            kind, end = "rule", at + 1
        elif row.lstrip().startswith("|") and at + 1 < read.n and DASHES.match(rows[at + 1]):
            kind, end = "table", read.until(at + 2, lambda r: not r.lstrip().startswith("|"))
        elif row.lstrip().startswith(">"):
            kind, end = "quote", read.until(at, _blank)
        elif ITEM.match(row):
            kind, end = "list", read.list(at)
        else:
            kind, end = "prose", read.paragraph(at)
        cut = len(rows[end - 1]) - len(rows[end - 1].rstrip("\r\n"))
        out.append(Segment(kind, chars[at], chars[end] - cut, octets[at], octets[end] - cut, tuple(path), lang))
        at = end
    return out


def descends_into(above, below) -> bool:
    """Whether one heading path is the other or a part of it."""
    return all(a == b for a, b in zip(above, below)) and len(above) <= len(below)


def merge_small_segments(segments: list[Segment], least: int, respect_headings: bool = True) -> list[list[Segment]]:
    """Short segments take the next ones in until they reach ``least`` code points; tables and code stay alone."""
    groups, growing = [], False
    for s in segments:
        if growing and s.kind not in WHOLE and (not respect_headings or descends_into(groups[-1][-1].heading_path, s.heading_path)):
            groups[-1].append(s)
        else:
            groups.append([s])
            growing = s.kind not in WHOLE
        growing = growing and s.char_end - groups[-1][0].char_start < least
    return groups


def group_span(group: list[Segment]) -> Segment:
    """The one segment that covers a group."""
    a, z = group[0], group[-1]
    kinds = {s.kind for s in group} - {"heading", "rule"}
    (kind,) = (a.kind,) if len(group) == 1 else kinds if len(kinds) == 1 else ("prose",)
    return Segment(kind, a.char_start, z.char_end, a.byte_start, z.byte_end, z.heading_path, a.lang)


_UNSET = object()


def _kernel(options):
    """(bytes) -> [(start, end, tokens, text bytes)] for the options of a chunker."""
    if callable(options):
        return options
    made = counter(options.tokenizer)
    if isinstance(options, K.TableOptions):
        return lambda data: K.table_chunks(data, options, made)
    function = {K.RecursiveOptions: K.recursive_chunks, K.SentenceOptions: K.sentence_chunks, K.TokenOptions: K.token_chunks, K.CodeOptions: K.code_chunks}[type(options)]
    return lambda data: [(s, e, n, data[s:e]) for s, e, n in function(data, options, made)]


class DocumentOptions:
    """Chunkers by kind of segment, as options or as functions of bytes; None sends tables or code to ``chunker``."""

    def __init__(self, chunker=None, min_chunk_size: int = 256, respect_headings: bool = True, table_chunker=_UNSET, merge_small_segments: bool = True, code_chunker=_UNSET):
        if min_chunk_size < 0:
            raise ValueError("min_chunk_size must not be negative")
        self.chunker = chunker or K.RecursiveOptions()
        self.table = K.TableOptions() if table_chunker is _UNSET else table_chunker
        self.code = K.CodeOptions() if code_chunker is _UNSET else code_chunker
        self.respect_headings, self.merge, self.least = respect_headings, merge_small_segments, min_chunk_size


def document_chunks(markdown: str, o: DocumentOptions) -> tuple[list[tuple], list[str]]:
    """[(text, md_start, md_end, kind, heading_path, lang, token_count, is_exact)], warnings."""
    prose = _kernel(o.chunker)
    special = {"table": _kernel(o.table) if o.table is not None else prose, "code": _kernel(o.code) if o.code is not None else prose}
    found = segment_markdown(markdown)
    groups = merge_small_segments(found, o.least, o.respect_headings) if o.merge and o.least else [[s] for s in found]
    raw, out, parted = markdown.encode(), [], 0
    for s in map(group_span, groups):
        data = raw[s.byte_start : s.byte_end]
        if _blank(s.text(markdown)):
            continue
        pieces = special.get(s.kind, prose)(data) or [(0, len(data), s.char_end - s.char_start, data)]
        parted += s.kind == "table" and len(pieces) > 1
        for i, (a, z, n, text) in enumerate(pieces):
            start = s.byte_start + (a if i else 0)
            end = max(s.byte_start + z, s.byte_end if i == len(pieces) - 1 else 0)
            out.append((text.decode(), start, end, s.kind, list(s.heading_path), s.lang, n, raw[start:end] == text))
    warnings = [f"{parted} table(s) were split over several chunks; the later ones repeat the header and are no slices of the Markdown"] if parted else []
    return out, warnings
