"""Markdown segments, merging, routing, and the formats."""

import io
import random
import zipfile
import zlib

import pytest

from textloom.kernels import chunkers as K
from textloom.kernels.markdown import DocumentOptions, descends_into, document_chunks, group_span, merge_small_segments, segment_markdown
from textloom.sources import formats

AWKWARD = ["# a\r\n\r\ntext\r\n", "a\rb\r", "no newline", "form\x0cfeed\n\nnext\n", "﻿# title\n", "```\n```\n", "```py\nopen", "".join(f"{'#' * i} h{i}\n" for i in range(1, 7)), "| a |\n|---|\n", "🩺 é\n\n漢字 text\n", "> a\n> > b\nlazy\n\nafter", "# only\n", ""]


def kinds(text):
    return [s.kind for s in segment_markdown(text)]


def test_segment_kinds():
    assert kinds("```\n# x\n| a |\n> q\n```\n") == ["code"]
    assert kinds("- a\n\n- b\n\n  more\n\nend\n") == ["list", "prose"]
    assert kinds("text\n| a |\n|---|\n| 1 |\n") == ["prose"]
    assert kinds("| a |\n|---|\n| 1 |\ntext\n***\n> q\n1. x\n") == ["table", "prose", "quote"]
    assert kinds("﻿# title") == ["prose"] and kinds("---\n") == ["rule"]
    s = segment_markdown("# A #\n\n### B\n\n## C\n\n~~~~py x\n~~~\n~~~~\n")
    assert [x.heading_path for x in s] == [("A",), ("A", "B"), ("A", "C"), ("A", "C")] and s[-1].lang == "py"
    assert descends_into(("a",), ("a", "b")) and not descends_into(("a", "b"), ("a",))


def random_markdown(r):
    block = [lambda: "#" * r.randrange(1, 7) + f" h{r.randrange(9)}", lambda: "word é " * r.randrange(1, 60), lambda: "- a\n- b\n\n- c", lambda: "| x | y |\n|---|---|\n" + "| 1 | 2 |\n" * r.randrange(0, 9), lambda: "```py\nx = 1\n\n# c\n```", lambda: "> quote\nlazy", lambda: "---", lambda: "1. one\n\n   two", lambda: "🩺漢字", lambda: "   \n\t"]
    return "".join(r.choice(block)() + "\n" * r.randrange(1, 4) for _ in range(r.randrange(10)))


@pytest.mark.parametrize("options", [{}, {"min_chunk_size": 0}, {"merge_small_segments": False}, {"respect_headings": False, "min_chunk_size": 80}, {"chunker": K.RecursiveOptions(40, 4), "table_chunker": None}, {"chunker": K.SentenceOptions(50), "code_chunker": None}])
def test_random_documents_are_rebuilt(options):
    r = random.Random(20260101)
    o = DocumentOptions(**options)
    for text in AWKWARD + [random_markdown(r) for _ in range(120)]:
        raw, at = text.encode(), 0
        for body, start, end, kind, path, lang, n, exact in document_chunks(text, o)[0]:
            assert not raw[at:start].decode().strip() or kind == "table"
            assert exact == (raw[start:end] == body.encode()) and (exact or kind == "table")
            at = max(at, end)
        assert not raw[at:].decode().strip()


def test_headings_merge_downwards_only():
    text = "# Report\n\n## Methods\n\n### Prep\n\nprose here\n"
    out, warnings = document_chunks(text, DocumentOptions(min_chunk_size=500))
    assert [x[4] for x in out] == [["Report", "Methods", "Prep"]] and not warnings
    groups = merge_small_segments(segment_markdown("# a\n\nx\n\n# b\n\ny\n"), 500)
    assert [group_span(g).heading_path for g in groups] == [("a",), ("b",)]
    assert len(merge_small_segments(segment_markdown("# a\n\nx\n\n# b\n\ny\n"), 500, respect_headings=False)) == 1
    with pytest.raises(ValueError):
        DocumentOptions(min_chunk_size=-1)


def test_tables_split_with_a_warning():
    table = "| a |\n|---|\n" + "".join(f"| {i} |\n" for i in range(12))
    out, warnings = document_chunks(table, DocumentOptions())
    assert len(out) == 4 and out[0][7] and not any(x[7] for x in out[1:]) and "table" in warnings[0]
    assert all(x[0].startswith("| a |\n|---|\n") for x in out)


def zipped(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buffer.getvalue()


W = "xmlns:w='w'"
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc><w:p><w:r><w:t>1|2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = zipped({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row><row><c r='A2' t='inlineStr'><is><t>x</t></is></c></row></sheetData></worksheet>"})
ODT = zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<d xmlns:text='t' xmlns:table='b'><body><text:h text:outline-level='2'>Head</text:h><text:p>some <text:span>bold</text:span> text</text:p><table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell></table:table-row></table:table></body></d>"})
EPUB = zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": "<c><rootfile full-path='O/b.opf'/></c>", "O/b.opf": "<p><item id='i' href='x.xhtml'/><itemref idref='i'/></p>", "O/x.xhtml": "<html><body><h1>Ch</h1><p>one <b>two</b></p><ul><li>a</li><li>b</li></ul></body></html>"})
PPTX = zipped({"ppt/slides/slide1.xml": "<s xmlns:p='p' xmlns:a='a'><p:sp><p:ph type='title'/><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>point</a:t></a:r></a:p></p:sp></s>"})


@pytest.mark.parametrize(
    "data, name, want",
    [
        (DOCX, "docx", "# Title\n\nBody text\n\n| a |  |\n| --- | --- |\n| 1\\|2 |  |\n"),
        (XLSX, "xlsx", "| name |  | 7 |\n| --- | --- | --- |\n| x |  |  |\n"),
        (ODT, "odt", "## Head\n\nsome bold text\n\n| a |\n| --- |\n"),
        (EPUB, "epub", "# Ch\n\none two\n\n- a\n- b\n"),
        (PPTX, "pptx", "## Slide\n\npoint\n"),
        (b"{\\rtf1{\\fonttbl x;}Hello \\'e9\\par next}", "rtf", "Hello \xe9\n\nnext\n"),
        (b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hel\\(lo) Tj T* (World) Tj ET") + b"\nendstream", "pdf", "Hel(lo\nWorld\n"),
    ],
)
def test_formats(data, name, want):
    assert formats.resolve_format(data) == name
    assert formats.convert(data) == (want, name)


def test_format_errors():
    assert formats.convert(b"a\xff", filename="x.MD") == ("a�", "md") and formats.convert(b"x", ".Text") == ("x", "txt")
    assert formats.convert(b"name,qty\nwidget,3\n", filename="a.csv")[0] == "| name | qty |\n| --- | --- |\n| widget | 3 |\n"
    for f, error in ((lambda: formats.convert(b"x"), formats.UnsupportedDocument), (lambda: formats.convert(b"x", "nope"), ValueError), (lambda: formats.convert(b"%PDF-1.4"), formats.ScannedDocumentError), (lambda: formats.convert(b"%PDF /Encrypt"), formats.EncryptedDocument), (lambda: formats.convert(b"PK", "docx"), formats.MalformedDocument), (lambda: formats.convert(zipped({"word/x": ""})), formats.MalformedDocument), (lambda: formats.convert(b"\xd0\xcf\x11\xe0", filename="a.doc"), formats.UnsupportedDocument)):
        with pytest.raises(error):
            f()


def pdf(*streams):
    return b"%PDF-1.7\n" + b"".join(b"stream\n" + zlib.compress(x) + b"\nendstream\n" for x in streams)


def test_pdf_headings_and_codes():
    page = b"BT /F1 26 Tf 1 0 0 1 72 700 Tm (Yearly Survey) Tj ET BT /F1 16 Tf 0 -20 Td (Sites) Tj ET BT /F2 10 Tf 0 -20 Td [(We went) -300 (to two) 20 (hundred)] TJ T* (sites, by \\(slow\\) train.) Tj ET BT /F1 16 Tf 0 -9 Td (Costs) Tj ET BT /F1 5 Tf 2 0 0 2 72 10 Tm (Little.) Tj ET"
    text, _ = formats.convert(pdf(page))
    assert text == "# Yearly Survey\n\n## Sites\n\nWe went to twohundred\nsites, by (slow) train.\n\n## Costs\n\nLittle.\n"
    from textloom.kernels.markdown import segment_markdown

    assert [s.heading_path for s in segment_markdown(text) if s.kind == "prose"] == [("Yearly Survey", "Sites"), ("Yearly Survey", "Costs")]
    codes = b"1 beginbfchar <0003> <00DF> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    assert formats.convert(pdf(codes, b"BT /F1 9 Tf <0010 00110012> Tj <0003> Tj ET"))[0] == "abc\u00df\n"
    assert formats.convert(pdf(b"BT /F1 9 Tf <4869> Tj ET"))[0] == "Hi\n"
    assert formats.convert(pdf(b"BT (one) Tj ET", b"BT (two) Tj (three) ' ET"))[0] == "one\n\ntwo\nthree\n"
