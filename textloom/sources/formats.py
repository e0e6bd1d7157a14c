"""Formats of documents: which one bytes are in, and their text as Markdown.

Markdown and text pass through; CSV, the zipped XML formats, RTF and simple PDFs are converted with the standard library.  Old
binary formats have no reader here and are reported as unsupported.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree as E

SUPPORTED = frozenset("doc docx odt pdf ppt pptx rtf epub xlsx ods odp csv".split())
PASS_THROUGH = frozenset("md markdown txt text".split())
_BY_SUFFIX = {"md": "md", "markdown": "md", "mdown": "md", "txt": "txt", "text": "txt"}
MOST_UNZIPPED = 1 << 30


class DocumentError(Exception):
    """A document that gives no text; ``part`` and ``limit`` say where and which."""

    def __init__(self, message: str, part: str | None = None, limit: str | None = None):
        super().__init__(message)
        self.part, self.limit = part, limit


class UnsupportedDocument(DocumentError):
    pass


class ScannedDocumentError(UnsupportedDocument):
    pass


class MalformedDocument(DocumentError):
    pass


class EncryptedDocument(DocumentError):
    pass


class DocumentResourceLimit(DocumentError):
    pass


def _sniffed(data: bytes) -> str | None:
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        return "ppt" if "PowerPoint Document".encode("utf-16-le") in data else "doc"
    if data.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return None
        for head, name in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
            if any(n.startswith(head) for n in names):
                return name
        if "mimetype" in names:
            kind = zipfile.ZipFile(io.BytesIO(data)).read("mimetype").decode("latin-1").strip()
            ends = {"epub+zip": "epub", "opendocument.text": "odt", "opendocument.spreadsheet": "ods", "opendocument.presentation": "odp"}
            return next((v for k, v in ends.items() if kind.endswith(k)), None)
    return None


def resolve_format(data: bytes, format: str | None = None, filename: str | None = None) -> str:
    """The given format, else a text suffix, else the content's signature, else the suffix."""
    given = None if format is None else format.lower().lstrip(".")
    if given is not None:
        name = given
        name = {"markdown": "md", "text": "txt"}.get(name, name)
        if name not in SUPPORTED | PASS_THROUGH:
            raise ValueError(f"unsupported format {format!r}; known: {', '.join(sorted(SUPPORTED | {'md', 'txt'}))}")
        return name
    suffix = posixpath.splitext(filename or "")[1].lower().lstrip(".")
    found = _BY_SUFFIX.get(suffix) or _sniffed(data) or (suffix if suffix in SUPPORTED else None)
    if found is None:
        raise UnsupportedDocument(f"neither the content nor the name {filename!r} tells the format; name it (CSV has no signature)")
    return found


def grid(rows: list[list[str]]) -> str:
    """A pipe table; the first row is the header."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    wide = max(map(len, rows))
    cell = lambda c: re.sub(r"\s*\n\s*", " ", c).replace("|", "\\|").strip()
    shown = ["| " + " | ".join(cell(c) for c in [*r, *[""] * (wide - len(r))]) + " |" for r in rows]
    return "\n".join([shown[0], "|" + " --- |" * wide, *shown[1:]]) + "\n"


def _csv(data: bytes) -> str:
    text = data.decode("utf-8-sig", "replace")
    return grid(list(csv.reader(io.StringIO(text, newline=""))))


def _name(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _get(node, key: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == key), default)


def _all_text(node) -> str:
    parts = []
    for x in node.iter():
        n = _name(x)
        if n in ("tab",):
            parts.append("\t")
        elif n in ("br", "cr", "line-break"):
            parts.append("\n")
        elif n == "s":
            parts.append(" " * int(_get(x, "c", "1") or 1))
        elif x.text:
            parts.append(x.text)
        if x is not node and x.tail and n in ("span", "a", "tab", "s", "line-break", "em", "strong", "b", "i", "code"):
            parts.append(x.tail)
    return "".join(parts)


class _Zip:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise MalformedDocument(str(error)) from error
        if sum(i.file_size for i in self.zip.infolist()) > MOST_UNZIPPED:
            raise DocumentResourceLimit("the archive unpacks to too much", limit="unzipped_bytes")
        if any(i.flag_bits & 1 for i in self.zip.infolist()):
            raise EncryptedDocument("the archive is encrypted")

    def xml(self, part: str):
        try:
            return E.fromstring(self.zip.read(part))
        except KeyError as error:
            raise MalformedDocument(f"{part} is missing", part=part) from error
        except E.ParseError as error:
            raise MalformedDocument(f"{part}: {error}", part=part) from error

    def numbered(self, pattern: str) -> list[str]:
        found = [(int(m[1]), n) for n in self.zip.namelist() if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]


def _docx(data: bytes) -> str:
    body = next((x for x in _Zip(data).xml("word/document.xml") if _name(x) == "body"), None)
    out = []
    for x in body if body is not None else ():
        if _name(x) == "tbl":
            out.append(grid([["".join(_runs(c)) for c in r if _name(c) == "tc"] for r in x if _name(r) == "tr"]))
        elif _name(x) == "p":
            text = "".join(_runs(x)).strip()
            style = next((_get(s, "val") for s in x.iter() if _name(s) == "pStyle"), "")
            m = re.match(r"(?i)heading ?(\d)", style)
            level = int(m[1]) if m else 1 if style.lower() == "title" else 0
            listed = any(_name(s) == "numPr" for s in x.iter())
            if text:
                out.append("#" * min(level, 6) + " " + text if level else "- " + text if listed else text)
    return _joined(out)


def _runs(node):
    for x in node.iter():
        n = _name(x)
        if n == "t":
            yield x.text or ""
        elif n in ("br", "cr"):
            yield "\n"
        elif n == "tab":
            yield "\t"


def _xlsx(data: bytes) -> str:
    z = _Zip(data)
    shared = ["".join(_runs(s)) for s in z.xml("xl/sharedStrings.xml") if _name(s) == "si"] if "xl/sharedStrings.xml" in z.zip.namelist() else []
    out = []
    for part in z.numbered(r"xl/worksheets/sheet(\d+)\.xml"):
        rows = []
        for r in z.xml(part).iter():
            if _name(r) != "row":
                continue
            cells: list[str] = []
            for c in r:
                letters = re.match(r"[A-Z]*", _get(c, "r"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells)) if letters else []
                v = next((x.text or "" for x in c if _name(x) == "v"), None)
                cells.append("".join(_runs(c)) if v is None else shared[int(v)] if _get(c, "t") == "s" and int(v) < len(shared) else v)
            rows.append(cells)
        out.append(grid(rows))
    return _joined(out)


def _pptx(data: bytes) -> str:
    z, out = _Zip(data), []
    for part in z.numbered(r"ppt/slides/slide(\d+)\.xml"):
        for shape in z.xml(part).iter():
            if _name(shape) == "tbl":
                out.append(grid([["".join(_runs(c)) for c in r if _name(c) == "tc"] for r in shape if _name(r) == "tr"]))
            elif _name(shape) == "sp":
                title = any(_get(p, "type") in ("title", "ctrTitle") for p in shape.iter() if _name(p) == "ph")
                for p in shape.iter():
                    text = "".join(_runs(p)).strip() if _name(p) == "p" else ""
                    if text:
                        out.append(("## " if title else "") + text)
    return _joined(out)


def _opened(data: bytes) -> str:
    out: list[str] = []

    def walk(node):
        for x in node:
            n = _name(x)
            if n == "h":
                out.append("#" * min(6, int(_get(x, "outline-level", "1") or 1)) + " " + _all_text(x).strip())
            elif n == "table":
                rows = []
                for r in x.iter():
                    if _name(r) == "table-row":
                        cells = []
                        for c in r:
                            if _name(c) in ("table-cell", "covered-table-cell"):
                                cells += [_all_text(c).strip()] * min(64, int(_get(c, "number-columns-repeated", "1") or 1))
                        while cells and not cells[-1]:
                            cells.pop()
                        rows.append(cells)
                out.append(grid(rows))
            elif n == "list-item":
                out.append("- " + _all_text(x).strip())
            elif n == "p":
                if text := _all_text(x).strip():
                    out.append(text)
            else:
                walk(x)

    walk(_Zip(data).xml("content.xml"))
    return _joined(out)


def _epub(data: bytes) -> str:
    z = _Zip(data)
    root = next((_get(x, "full-path") for x in z.xml("META-INF/container.xml").iter() if _name(x) == "rootfile"), "")
    book = z.xml(root)
    files = {_get(x, "id"): _get(x, "href") for x in book.iter() if _name(x) == "item"}
    out = []
    for ref in (x for x in book.iter() if _name(x) == "itemref"):
        part = posixpath.normpath(posixpath.join(posixpath.dirname(root), files.get(_get(ref, "idref"), "")))
        _xhtml(z.xml(part), out)
    return _joined(out)


def _xhtml(node, out: list[str]) -> None:
    for x in node:
        n = _name(x)
        if n in ("head", "script", "style"):
            continue
        if re.fullmatch(r"h[1-6]", n):
            out.append("#" * int(n[1]) + " " + " ".join("".join(x.itertext()).split()))
        elif n == "table":
            out.append(grid([[" ".join("".join(c.itertext()).split()) for c in r if _name(c) in ("td", "th")] for r in x.iter() if _name(r) == "tr"]))
        elif n == "pre":
            out.append("```\n" + "".join(x.itertext()).strip("\n") + "\n```")
        elif n == "blockquote":
            out.append("> " + " ".join("".join(x.itertext()).split()))
        elif n in ("ul", "ol"):
            marks = [f"{i}." if n == "ol" else "-" for i in range(1, len(x) + 1)]
            out.append("\n".join(f"{m} {' '.join(''.join(li.itertext()).split())}" for m, li in zip(marks, x)))
        elif n == "p":
            if text := " ".join("".join(x.itertext()).split()):
                out.append(text)
        elif n == "hr":
            out.append("---")
        else:
            _xhtml(x, out)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)
_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable"}


def _rtf(data: bytes) -> str:
    out, hide = [], [False]
    for code, uni, word, _, sign, brace, text in _RTF.findall(data.decode("latin-1")):
        if brace == "{":
            hide.append(hide[-1])
        elif brace == "}":
            if len(hide) > 1:
                hide.pop()
        elif word in _HIDDEN or sign == "*":
            hide[-1] = True
        elif not hide[-1]:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace") if code else chr(int(uni) % 65536) if uni else "\n\n" if word == "par" else "\n" if word == "line" else "\t" if word == "tab" else sign if sign and sign in "\\{}" else text)
    return _joined(re.split(r"\n\s*\n", "".join(out)))


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SIGNS = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z]+\*?|['\"\[\]]", re.S)
_UNICODE = re.compile(rb"<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>\s*)?<([0-9A-Fa-f]+)>")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def _pdf_streams(data: bytes) -> list[bytes]:
    out = []
    for raw in _STREAM.findall(data):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        out.append(raw)
    return out


def _pdf_codes(streams: list[bytes]) -> dict[str, str]:
    """Glyph codes (hexadecimal) to text, from the fonts' ToUnicode maps; fonts share one table here."""
    codes = {}
    for raw in streams:
        for mark in (b"bfchar", b"bfrange"):
            for body in re.findall(b"begin" + mark + b"(.*?)end" + mark, raw, re.S):
                for low, high, to in _UNICODE.findall(body):
                    text = bytes.fromhex(to.decode().zfill(4)).decode("utf-16-be", "replace")
                    first, last = int(low, 16), int(high or low, 16)
                    for k in range(first, min(last, first + 65_535) + 1):
                        codes[f"{k:0{len(low)}x}"] = text[:-1] + chr(ord(text[-1]) + k - first)
    return codes


def _pdf_text(sign: bytes, codes: dict[str, str]) -> str:
    if sign[:1] == b"(":
        plain = lambda m: _ESCAPED.get(m[1], m[1] if not m[1].isdigit() else bytes([int(m[1], 8) & 255]))
        return re.sub(rb"\\([nrt()\\]|[0-7]{1,3})", plain, sign[1:-1]).decode("cp1252", "replace")
    digits = re.sub(rb"\s", b"", sign[1:-1]).decode().lower()
    wide = max(map(len, codes), default=2)
    parts = [digits[k : k + wide] for k in range(0, len(digits), wide)]
    return "".join(codes.get(x) or bytes.fromhex(x.ljust(len(x) + len(x) % 2, "0")).decode("cp1252", "replace").replace("\0", "") for x in parts)


def _pdf_lines(raw: bytes, codes: dict[str, str]) -> list[tuple[float, str]]:
    """(size of the type, text) of each line of a page's content."""
    lines: list[tuple[float, str]] = []
    held: list[str] = []
    before: list[bytes] = []
    size = scale = most = 0.0

    def end():
        nonlocal most
        if "".join(held).strip():
            lines.append((round(most, 1), "".join(held).strip()))
        held.clear()
        most = 0.0

    for sign in _SIGNS.findall(raw):
        number = [float(x) for x in before if x[:1] in b"0123456789.+-"]
        if sign == b"BT":
            scale = 1.0
        elif sign == b"Tf" and number:
            size = abs(number[-1])
        elif sign == b"Tm" and len(number) >= 6:
            end()
            scale = abs(number[-3]) or 1.0
        elif sign in (b"Td", b"TD", b"T*", b"ET", b"'", b'"'):
            end()
        if sign in (b"Tj", b"TJ", b"'", b'"'):
            for x in before:
                if x[:1] in b"(<":
                    held.append(_pdf_text(x, codes))
                elif sign == b"TJ" and x[:1] == b"-" and float(x) < -200 and held:
                    held.append(" ")
            most = max(most, size * (scale or 1.0))
        if sign[:1] in b"(<[]/0123456789.+-":
            before.append(sign)
        else:
            before = []
    end()
    return lines


def _pdf(data: bytes) -> str:
    """The text in its order; lines in larger type than most of the text are headings, by size."""
    if b"/Encrypt" in data:
        raise EncryptedDocument("the PDF is encrypted")
    streams = _pdf_streams(data)
    codes = _pdf_codes(streams)
    pages = [_pdf_lines(raw, codes) for raw in streams if b"BT" in raw]
    if not any(pages):
        raise ScannedDocumentError("the PDF has no text that can be read; a scan needs character recognition first")
    letters: dict[float, int] = {}
    for size, text in (x for page in pages for x in page):
        letters[size] = letters.get(size, 0) + len(text)
    body = max(letters, key=lambda size: (letters[size], -size))
    larger = sorted((size for size in letters if body and size > 1.15 * body), reverse=True)
    out = []
    for page in pages:
        block: list[str] = []
        for size, text in page:
            if size in larger:
                out += ["\n".join(block), "#" * min(6, larger.index(size) + 1) + " " + text]
                block = []
            else:
                block.append(text)
        out.append("\n".join(block))
    return _joined(out)


def _joined(blocks: list[str]) -> str:
    return "\n\n".join(b.strip("\n") for b in blocks if b.strip()) + "\n" if any(b.strip() for b in blocks) else ""


_READERS = {"csv": _csv, "docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "odt": _opened, "ods": _opened, "odp": _opened, "epub": _epub, "rtf": _rtf, "pdf": _pdf}


def convert(data: bytes, format: str | None = None, filename: str | None = None) -> tuple[str, str]:
    """(Markdown, format)."""
    name = resolve_format(data, format, filename)
    if name in PASS_THROUGH:
        return data.decode("utf-8", "replace"), name
    if name not in _READERS:
        raise UnsupportedDocument(f"there is no reader for {name}")
    return _READERS[name](data), name
