"""The chunkers as functions of one text's bytes: lists of (start, end, tokens), in byte offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

from . import signals
from .spans import PREV, Counter, Span, encode_all, include_mode, is_blank, lines, pack, split

Piece = tuple[int, int, int]
SENTENCE_ENDS = (*(c + " " for c in ".!?"), "\n")


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be 1 or more")


@dataclass(frozen=True)
class TokenOptions:
    """Windows of tokens; an overlap below 1 (float) is a share of the size."""

    chunk_size: int = 2048
    chunk_overlap: int | float = 0
    tokenizer: str | Counter = "character"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size)
        if isinstance(self.chunk_overlap, float) and not 0 <= self.chunk_overlap < 1:
            raise ValueError("a fractional chunk_overlap must be in [0, 1)")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")

    @property
    def stride(self) -> int:
        o = self.chunk_overlap
        return self.chunk_size - (int(o * self.chunk_size) if isinstance(o, float) else o)


def token_chunks(data: bytes, o: TokenOptions, c: Counter) -> list[Piece]:
    if is_blank(data):
        return []
    spans, out = c.spans(data), []
    for a in range(0, len(spans), o.stride):
        z = min(a + o.chunk_size, len(spans))
        out.append((spans[a][0], spans[z - 1][1], z - a))
        if z == len(spans):
            break
    return out


@dataclass(frozen=True)
class SentenceOptions:
    chunk_size: int = 2048
    chunk_overlap: int = 0
    min_sentences_per_chunk: int = 1
    min_characters_per_sentence: int = 12
    delim: tuple[str, ...] = SENTENCE_ENDS
    include_delim: str = PREV
    tokenizer: str | Counter = "character"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size, min_sentences_per_chunk=self.min_sentences_per_chunk, min_characters_per_sentence=self.min_characters_per_sentence)
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")
        include_mode(self.include_delim)


def sentence_chunks(data: bytes, o: SentenceOptions, c: Counter) -> list[Piece]:
    if is_blank(data):
        return []
    sentences = split(data, encode_all(o.delim), include_mode(o.include_delim), o.min_characters_per_sentence)
    measure = c.meter(data)
    counts = [measure(s, e) for s, e in sentences]
    total = [0, *accumulate(counts)]
    n, at, out = len(sentences), 0, []
    while at < n:
        end = at + 1
        budget = total[at] + o.chunk_size
        while end < n and total[end + 1] <= budget:
            end += 1
        end = min(n, max(end, at + o.min_sentences_per_chunk))
        s, e = sentences[at][0], sentences[end - 1][1]
        out.append((s, e, measure(s, e)))
        following = end
        if o.chunk_overlap and end < n:
            held, back = 0, end - 1
            while back > at and held + counts[back] + 1 <= o.chunk_overlap:
                held += counts[back] + 1
                back -= 1
            following = back + 1
        at = following
    return out


@dataclass(frozen=True)
class Level:
    """One level of rules: 'delimiters', 'whitespace' or 'token'."""

    kind: str
    delimiters: tuple[str, ...] = ()
    include: str = PREV


DEFAULT_LEVELS = (
    Level("delimiters", ("\n" * 2, *("\r\n \n \r".split(" ")))),
    Level("delimiters", SENTENCE_ENDS[:3]),
    Level("delimiters", (*'{}"[]<>():;,—|~-', "...", *"`'")),
    Level("whitespace"),
    Level("token"),
)


def levels(rules) -> tuple[Level, ...]:
    """From a list of dicts {delimiters, include_delim} or {type: whitespace | token}; None is the default."""
    if rules is None:
        return DEFAULT_LEVELS
    rules = list(rules)
    if not rules:
        raise ValueError("rules must not be empty")
    out = []
    for rule in rules:
        if isinstance(rule, Level):
            out.append(rule)
            continue
        if not isinstance(rule, dict):
            raise ValueError("a rule must be a dict")
        include = include_mode(rule.get("include_delim", PREV))
        if rule.get("delimiters") is not None:
            out.append(Level("delimiters", tuple(rule["delimiters"]), include))
        elif rule.get("type") in ("whitespace", "token"):
            out.append(Level(rule["type"], (), include))
        else:
            raise ValueError(f"unknown rule {rule!r}")
    return tuple(out)


@dataclass(frozen=True)
class RecursiveOptions:
    chunk_size: int = 2048
    min_characters_per_chunk: int = 24
    rules: tuple[Level, ...] = DEFAULT_LEVELS
    tokenizer: str | Counter = "character"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size, min_characters_per_chunk=self.min_characters_per_chunk)
        object.__setattr__(self, "rules", levels(self.rules))


def recursive_chunks(data: bytes, o: RecursiveOptions, c: Counter) -> list[Piece]:
    """Work list instead of a call stack: (start, end, level), the leftmost on top."""
    measure, out = c.meter(data), []
    todo = [(0, len(data), 0)]
    while todo:
        s, e, depth = todo.pop()
        if depth < 0:
            out.append((s, e, -1 - depth))
            continue
        if s >= e:
            continue
        part = data[s:e] if (s, e) != (0, len(data)) else data
        if depth >= len(o.rules):
            out.append((s, e, measure(s, e)))
            continue
        level = o.rules[depth]
        if level.kind == "token":
            spans = c.spans(part)
            for a in range(0, len(spans), o.chunk_size):
                z = min(a + o.chunk_size, len(spans))
                x, y = s + spans[a][0], s + spans[z - 1][1]
                out.append((x, y, measure(x, y)))
            if not spans:
                out.append((s, e, measure(s, e)))
            continue
        marks = encode_all(level.delimiters) if level.kind == "delimiters" else (b" ",)
        spans = [(s + a, s + z) for a, z in split(part, marks, level.include, o.min_characters_per_chunk)]
        if not spans:
            out.append((s, e, measure(s, e)))
            continue
        counts = [measure(a, z) for a, z in spans]
        total = [0, *accumulate(counts)]
        groups, at = [], 0
        for end in pack(counts, o.chunk_size):
            tokens = total[end] - total[at]
            groups.append((spans[at][0], spans[end - 1][1], depth + 1 if tokens > o.chunk_size else -1 - tokens))
            at = end
        todo += reversed(groups)
    return out


@dataclass(frozen=True)
class TableOptions:
    """Rows to a chunk with the row counter, a token budget with any other."""

    chunk_size: int = 3
    tokenizer: str | Counter = "row"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size)


_RULE_LINE = re.compile(r"[|:\- ]*-[|:\- ]*\Z")


def _markdown_table(data: bytes):
    rows = lines(data)
    filled = [not is_blank(data[s:e]) for s, e in rows]
    if True not in filled:
        return None
    for i in range(filled.index(True), len(rows)):
        if _RULE_LINE.match(data[rows[i][0] : rows[i][1]].decode().strip()):
            body = [r for r, f in zip(rows[i + 1 :], filled[i + 1 :]) if f]
            return (data[rows[filled.index(True)][0] : rows[i][1]], b"", body) if body else None
    return None


_QUOTED = re.compile(rb"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
_MARKS = re.compile(rb"<!--(?:.*?-->|.*)|<(?:table|tr|tbody)(?=[>/\s])|</(?:table|tr|tbody)\s*>", re.I | re.S)


class _Marks:
    """Table tags of a text outside comments: (kind, start, end), where an opening tag that never closes has end -1."""

    def __init__(self, data: bytes):
        self.found: list[tuple[str, int, int]] = []
        at = 0
        while (m := _MARKS.search(data, at)) is not None:
            at = m.end()
            if m.group().startswith(b"<!--"):
                continue
            word = re.match(rb"</?([a-zA-Z]+)", m.group()).group(1).lower().decode()
            if m.group().startswith(b"</"):
                self.found.append(("/" + word, m.start(), m.end()))
                continue
            full = _QUOTED.match(data, m.end())
            at = full.end() if full else m.end()
            self.found.append((word, m.start(), full.end() if full else -1))

    def close_of_table(self, i: int) -> int | None:
        """Index after the mark that closes the table opened by mark i."""
        depth = 0
        for k in range(i, len(self.found)):
            kind, _, end = self.found[k]
            if kind == "table":
                if end < 0:
                    return None
                depth += 1
            elif kind == "/table":
                depth -= 1
                if not depth:
                    return k + 1
        return None


def _html_table(data: bytes):
    marks = _Marks(data).found
    tool = _Marks.__new__(_Marks)
    tool.found = marks
    kinds = [k for k, *_ in marks]
    if "tbody" in kinds:
        i = kinds.index("tbody")
        head = marks[i][2]
        if head < 0:
            return None
        foot, i = b"</tbody></table>" if "/tbody" in kinds else b"</table>", i + 1
    elif "tr" in kinds:
        i = kinds.index("tr")
        head, foot = marks[i][1], b"</table>"
    else:
        return None
    rows: list[Span] = []
    while i < len(marks):
        kind, start, end = marks[i]
        if kind == "/table":
            break
        if kind == "table":
            after = tool.close_of_table(i)
            if after is None:
                break
            i = after
            continue
        if kind == "tr":
            if end < 0:
                break
            if data[start:end].endswith(b"/>"):
                rows.append((start, end))
                i += 1
                continue
            k = i + 1
            while k < len(marks) and marks[k][0] != "/tr":
                if marks[k][0] == "table":
                    after = tool.close_of_table(k)
                    k = len(marks) if after is None else after
                else:
                    k += 1
            if k >= len(marks):
                break
            rows.append((start, marks[k][2]))
            i = k + 1
            continue
        i += 1
    return (data[:head], foot, rows) if rows else None


def table_chunks(data: bytes, o: TableOptions, c: Counter) -> list[tuple[int, int, int, bytes]]:
    """(start, end, tokens, text): the text repeats the header and footer, the offsets are those of the rows."""
    if is_blank(data):
        return []
    table = _html_table(data) if b"<table" in data.lower() else _markdown_table(data)
    if table is None:
        return []
    head, foot, rows = table
    if c.rows:
        if len(rows) <= o.chunk_size:
            return [(0, len(data), len(rows), data)]
        groups = [rows[a : a + o.chunk_size] for a in range(0, len(rows), o.chunk_size)]
    else:
        whole = c.count(data.decode().strip().encode())
        if whole <= o.chunk_size:
            return [(0, len(data), whole, data)]
        base, measure = c.count(head) + c.count(foot), c.meter(data)
        groups, held = [[]], base
        for s, e in rows:
            n = measure(s, e)
            if groups[-1] and held + n >= o.chunk_size:
                groups.append([])
                held = base
            groups[-1].append((s, e))
            held += n
    out = []
    for g in groups:
        text = head + b"".join(data[s:e] for s, e in g) + foot
        out.append((g[0][0], g[-1][1], len(g) if c.rows else c.count(text), text))
    return out


BRACES, INDENT, GENERIC = "braces", "indent", "generic"
_FAMILIES = {BRACES: "rust rs javascript js jsx typescript ts tsx c h cpp c++ cc hpp java go", INDENT: "python py ruby rb"}
_FAMILY = {name: family for family, names in _FAMILIES.items() for name in names.split()}


@dataclass(frozen=True)
class CodeOptions:
    chunk_size: int = 2048
    language: str = "auto"
    tokenizer: str | Counter = "character"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size)


def code_family(language: str, data: bytes) -> str:
    name = language.lower()
    if name != "auto":
        return _FAMILY.get(name, GENERIC)
    signs = 0
    for line in data.decode().split("\n"):
        signs += line.lstrip().startswith(("def ", "class ", "import ", "from "))
        signs += line.rstrip().endswith(":")
    braces = data.count(b"{")
    if braces >= 2 and braces >= signs:
        return BRACES
    return INDENT if signs else GENERIC


def code_blocks(data: bytes, family: str) -> list[Span]:
    """Blocks of whole lines: parted by blank lines, by closed braces or by lines without indent."""
    rows = lines(data)
    blank = [is_blank(data[s:e]) for s, e in rows]
    depth, at, out = 0, 0, []
    for i in range(len(rows) - 1):
        s, e = rows[i]
        if family == BRACES:
            depth += data.count(b"{", s, e) - data.count(b"}", s, e)
        if blank[i + 1]:
            continue
        if blank[i] or (family == BRACES and depth <= 0) or (family == INDENT and data[e : e + 1] not in (b" ", b"\t")):
            out.append((at, e))
            at = e
    return [*out, (at, len(data))]


def _fill(spans: list[Span], most: int) -> list[Span]:
    """Neighbours joined up to ``most`` bytes."""
    out: list[Span] = []
    for s, e in spans:
        if out and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def code_chunks(data: bytes, o: CodeOptions, c: Counter) -> list[Piece]:
    if is_blank(data):
        return []
    measure = c.meter(data)
    most = o.chunk_size * max(1, len(data) // max(1, measure(0, len(data))))
    out, held = [], []
    for s, e in code_blocks(data, code_family(o.language, data)):
        if e - s > most:
            out += _fill(held, most)
            held = []
            out += _fill([(s + a, s + z) for a, z in lines(data[s:e])], most)
        else:
            held.append((s, e))
    return [(s, e, measure(s, e)) for s, e in out + _fill(held, most)]


@dataclass(frozen=True)
class SemanticOptions:
    threshold: float = 0.8
    chunk_size: int = 2048
    similarity_window: int = 3
    min_sentences_per_chunk: int = 1
    min_characters_per_sentence: int = 24
    delim: tuple[str, ...] = SENTENCE_ENDS
    include_delim: str = PREV
    skip_window: int = 0
    filter_window: int = 5
    filter_polyorder: int = 3
    filter_tolerance: float = 0.2
    tokenizer: str | Counter = "character"

    def __post_init__(self):
        _positive(chunk_size=self.chunk_size, similarity_window=self.similarity_window, min_sentences_per_chunk=self.min_sentences_per_chunk, min_characters_per_sentence=self.min_characters_per_sentence, filter_window=self.filter_window)
        if not 0 < self.threshold < 1:
            raise ValueError("threshold must be between 0 and 1")
        if self.skip_window < 0 or self.filter_polyorder < 0 or self.filter_polyorder >= self.filter_window:
            raise ValueError("skip_window must not be negative, filter_polyorder must be below filter_window")
        if self.filter_tolerance <= 0:
            raise ValueError("filter_tolerance must be above 0")
        include_mode(self.include_delim)


def semantic_chunks(data: bytes, o: SemanticOptions, c: Counter, embed) -> list[Piece]:
    """``embed``: a list of texts to a list of vectors."""
    return semantic_batch([data], o, c, embed)[0]


def semantic_batch(texts: list[bytes], o: SemanticOptions, c: Counter, embed) -> list[list[Piece]]:
    """The chunks of each text; what all texts want embedded goes to the model in one call a step."""
    out: list[list[Piece]] = [[] for _ in texts]
    todo = [(i, semantic_steps(data, o, c), None) for i, data in enumerate(texts)]
    while todo:
        asked = []
        for i, steps, vectors in todo:
            try:
                asked.append((i, steps, steps.send(vectors)))
            except StopIteration as end:
                out[i] = end.value
        wanted = [t for _, _, some in asked for t in some]
        vectors = embed(wanted) if wanted else []
        if len(vectors) < len(wanted):
            raise ValueError("the embedder gave fewer vectors than texts")
        todo, at = [], 0
        for i, steps, some in asked:
            todo.append((i, steps, vectors[at : at + len(some)]))
            at += len(some)
    return out


def semantic_steps(data: bytes, o: SemanticOptions, c: Counter):
    """A generator of lists of texts, which is sent their vectors, and returns the chunks."""
    if is_blank(data):
        return []
    sentences = split(data, encode_all(o.delim), include_mode(o.include_delim), o.min_characters_per_sentence)
    n, w, measure = len(sentences), o.similarity_window, c.meter(data)
    total = [0, *accumulate(measure(s, e) for s, e in sentences)]
    piece = lambda a, z: (sentences[a][0], sentences[z - 1][1], total[z] - total[a])
    if n <= w:
        return [piece(0, n)] if n else []
    text = lambda a, z: data[sentences[a][0] : sentences[z - 1][1]].decode()
    vectors = yield [text(i, i + w) for i in range(n - w)] + [text(i + w, i + w + 1) for i in range(n - w)]
    curve = [signals.cosine(a, b) for a, b in zip(vectors[: n - w], vectors[n - w :])]
    cuts = [0]
    if len(curve) >= o.filter_window and o.filter_window % 2:
        places, _ = signals.filter_splits(*signals.minima(curve, o.filter_window, o.filter_polyorder, o.filter_tolerance), o.threshold, o.min_sentences_per_chunk)
        cuts += [int(p) + w for p in places if p + w < n]
    cuts = sorted(set(cuts)) + [n]
    groups = list(zip(cuts[:-1], cuts[1:]))
    if o.skip_window and len(groups) > 1:
        groups = skip_merge(groups, (yield [text(a, z) for a, z in groups]), o.skip_window, o.threshold)
    out = []
    for a, z in groups:
        at = a
        for k in range(a + 1, z):
            if total[k + 1] - total[at] > o.chunk_size:
                out.append(piece(at, k))
                at = k
        out.append(piece(at, z))
    return out


def skip_merge(groups: list[Span], vectors, skip: int, threshold: float) -> list[Span]:
    """Each group is joined to the most alike of the next ``skip`` + 1, with all between, if it is alike enough."""
    out, i, last = [], 0, len(groups) - 1
    while i <= last:
        ahead = [(signals.cosine(vectors[i], vectors[j]), -j) for j in range(i + 1, min(i + skip + 1, last) + 1)]
        best, j = max(ahead, default=(-1.0, -i))
        j = -j if best >= threshold else i
        out.append((groups[i][0], groups[j][1]))
        i = j + 1
    return out


@dataclass(frozen=True)
class LateOptions(RecursiveOptions):
    pass


def late_chunks(data: bytes, o: LateOptions, c: Counter, embed_tokens, embed) -> list[tuple[int, int, int, np.ndarray]]:
    """Recursive chunks with the mean of their tokens' vectors; a vector to a chunk where the tokens' vectors are too few."""
    if is_blank(data):
        return []
    pieces = recursive_chunks(data, o, c)
    counts = [n for *_, n in pieces]
    vectors = embed_tokens(data.decode())
    table = isinstance(vectors, np.ndarray) and vectors.ndim == 2
    vectors = vectors.astype(np.float32, copy=False) if table else [np.asarray(v, np.float32) for v in vectors]
    if len(vectors) < sum(counts):
        vectors, table = [np.asarray(embed(data[s:e].decode()), np.float32) for s, e, _ in pieces], False
        counts = [1] * len(pieces)
    extra = len(vectors) - sum(counts)
    counts[0] += extra // 2
    counts[-1] += extra - extra // 2
    edges = [0, *accumulate(counts)]
    if table and min(counts) > 0:  # one array: all sums at once
        means = np.add.reduceat(vectors, edges[:-1], axis=0) / np.array(counts, np.float32)[:, None]
        return [(s, e, n, mean) for (s, e, _), n, mean in zip(pieces, counts, means)]
    wide = max(map(len, vectors), default=0)
    out = []
    for (s, e, _), a, z in zip(pieces, edges[:-1], edges[1:]):
        mean = np.zeros(wide, np.float32)
        for v in vectors[a:z]:
            mean[: len(v)] += v
        out.append((s, e, z - a, mean / np.float32(z - a) if z > a else mean))
    return out

