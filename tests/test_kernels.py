"""Splits, byte chunks, packing, counters and chunkers on small literals, and their invariants on random texts."""


import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions.embedders import CharTokenEmbedder, HashEmbedder, TopicEmbedder, adapt, adapt_tokens
from textloom.kernels import chunkers as K
from textloom.kernels import signals
from textloom.kernels.spans import counter, is_blank, lines, merge_short, merge_splits, pack, split
from textloom.kernels.windows import DEFAULT_DELIMITERS, DEFAULT_TARGET_SIZE, ByteOptions, byte_chunks

STRESS = ["", " \n\t ", "nodelimitershere", "Hi! Ok? Yes. No; maybe: so...", "你好。世界！这是测试。", "👩‍👩‍👧‍👦 family 🩺 emoji. ", "Ünïcode mixed 漢字 and عربى text. Next!", "word " * 300, "def f():\n    return 1\n\nclass A:\n    x = {1: 2}\n"]


def parts(text, spans):
    data = text.encode()
    return [data[s:e].decode() for s, e, *_ in spans]


def cut(text, **options):
    data = text.encode()
    return [data[s:e].decode(errors="replace") for s, e in byte_chunks(data, ByteOptions(**options))]


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("Hello. World. Test.", {"size": 10, "delimiters": b"."}, ["Hello.", " World.", " Test."]),
        ("abcdefghij", {"size": 5, "delimiters": b"."}, ["abcde", "fghij"]),
        ("Hello World Test", {"size": 8, "delimiters": b" ", "prefix": True}, ["Hello", " World", " Test"]),
        ("Hello World Test", {"size": 8, "delimiters": b" "}, ["Hello ", "World ", "Test"]),
        ("Hello\n\n\nWorld", {"size": 8, "delimiters": b"\n", "prefix": True, "consecutive": True}, ["Hello", "\n\n\nWorld"]),
        ("verylongword next", {"size": 6, "delimiters": b" ", "prefix": True, "forward_fallback": True}, ["verylongword", " next"]),
        ("Hello▁World▁Test", {"size": 15, "pattern": "▁".encode()}, ["Hello▁", "World▁Test"]),
        ("Hello▁World▁Test", {"size": 15, "pattern": "▁".encode(), "prefix": True}, ["Hello", "▁World▁Test"]),
        ("verylongwordwithnodelimiters。short", {"size": 10, "delimiters": b"", "patterns": ("。",), "prefix": True, "forward_fallback": True}, ["verylongwordwithnodelimiters", "。short"]),
        ("aaa bbb", {"size": 3, "delimiters": b"", "forward_fallback": True}, ["aaa", " bb", "b"]),
        ("", {}, []),
    ],
)
def test_byte_chunks(text, options, want):
    assert cut(text, **options) == want


def test_byte_defaults_and_overlapping_patterns():
    assert (DEFAULT_TARGET_SIZE, DEFAULT_DELIMITERS) == (4096, b"\n.?")
    assert len(cut("Hello. World。Test", size=12, delimiters=b".", patterns=("。",))) == 3
    three, four = ("ab", "bc", "zz"), ("ab", "bc", "zz", "yy")
    assert cut("xxabcxxxxx", size=9, delimiters=b"", patterns=three)[0] == "xxabc"
    assert cut("xxabcxxxxx", size=9, delimiters=b"", patterns=four)[0] == "xxab"
    with pytest.raises(ValueError):
        ByteOptions(size=0)


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n", max_size=80), st.integers(1, 12), st.booleans(), st.booleans(), st.booleans(), st.sampled_from([(), (". ",), ("a.", "b ", "..", "ba")]))
def test_byte_chunks_cover(text, size, prefix, runs, forward, patterns):
    spans = byte_chunks(text.encode(), ByteOptions(size, b" .", None, patterns, prefix, runs, forward))
    assert [s for s, _ in spans] == [0, *(e for _, e in spans)][: len(spans)] and (not spans or spans[-1][1] == len(text))
    assert all(e > s for s, e in spans)
    assert forward or all(e - s <= size + (0 if prefix else 1) for s, e in spans)


def test_split_modes():
    t = "Hello. World. Test."
    assert parts(t, split(t.encode(), [b"."])) == ["Hello.", " World.", " Test."]
    assert parts(t, split(t.encode(), [b"."], "next")) == ["Hello", ". World", ". Test", "."]
    assert parts(t, split(t.encode(), [b"."], "none")) == ["Hello", " World", " Test"]
    u = "Hello. World? Test! Done"
    assert parts(u, split(u.encode(), [b". ", b"? ", b"! "])) == ["Hello. ", "World? ", "Test! ", "Done"]
    assert split(b"", [b"."]) == [] and split(b"x", []) == [(0, 1)]
    assert len(split(b"A. B. C. D. E.", [b"."], least=4)) < 5 == len(split(b"A. B. C. D. E.", [b"."]))
    assert parts("a\n\nb\nc", split(b"a\n\nb\nc", [b"\n\n", b"\n"])) == ["a\n\n", "b\n", "c"]
    assert merge_short([(0, 2), (3, 9), (9, 20)], 4) == [(0, 9), (9, 20)]
    assert parts("a\rb\nc\x0bd", lines(b"a\rb\nc\x0bd")) == ["a\rb\n", "c\x0bd"]


def test_packing():
    assert pack([1] * 7, 3) == [3, 6, 7]
    assert pack([10, 15, 20, 5, 8, 12], 30) == [2, 4, 6]
    assert pack([50, 60, 70], 30) == [1, 2, 3]
    assert merge_splits(["a", "b", "c"], [50, 60, 70], 30) == (["a", "b", "c"], [50, 60, 70])
    assert merge_splits(list("abcdefg"), [1] * 7, 3) == (["abc", "def", "g"], [3, 3, 1])
    assert merge_splits([], [], 3) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 12))
def test_packing_is_greedy(counts, size):
    ends, held = [], 0
    for i, c in enumerate(counts):
        if i and held + c > size and (ends[-1] if ends else 0) < i:
            ends.append(i)
            held = 0
        held += c
    assert pack(counts, size) == (ends + [len(counts)] if counts else [])


def test_counters():
    n = lambda name, t: counter(name).count(t.encode())
    assert (n("character", "héllo"), n("char", "你好"), n("byte", "你好")) == (5, 2, 6)
    assert (n("word", "a b c"), n("word", "a  b"), n("ROW", "a\nb\nc"), n("row", ""), n("row", "a\n")) == (3, 2, 3, 0, 2)
    assert counter("word").spans(b"  a b") == [(0, 2), (2, 4), (4, 5)]
    assert counter("byte").spans("aé".encode()) == [(0, 1), (1, 3)]
    assert counter("row").spans(b"a\nb\n") == [(0, 2), (2, 4)]
    for bad in ("nope", "missing.json"):
        with pytest.raises(ValueError):
            counter(bad)
    assert is_blank("\u2003\x85 ".encode()) and not is_blank(b"\x1c")


def test_tokenizer_file(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "hello": 1, "world": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(path := str(tmp_path / "t.json"))
    c = counter(path)
    assert c.count(b"hello world  hello") == 3
    assert c.spans("  hello é world ".encode()) == [(0, 8), (8, 11), (11, 17)]


def test_token_windows():
    run = lambda t, n=2048, o=0, k="character": parts(t, K.token_chunks(t.encode(), K.TokenOptions(n, o, k), counter(k)))
    assert run("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert run("a🩺bc🩺de", 2) == ["a🩺", "bc", "🩺d", "e"]
    assert run("abcdefgh", 4, 0.5) == ["abcd", "cdef", "efgh"]
    assert run(" \n ") == [] and run("one two three", 2, 0, "word") == ["one two ", "three"]
    for n, o in ((0, 0), (4, 4), (4, 1.0), (4, -1)):
        with pytest.raises(ValueError):
            K.TokenOptions(n, o)


def test_sentences():
    run = lambda **o: K.sentence_chunks(b"A. B. C. D. E. F. ", K.SentenceOptions(**o), counter("char"))
    assert run(chunk_size=3, min_sentences_per_chunk=2, min_characters_per_sentence=1)[0][:2] == (0, 6)
    over = run(chunk_size=9, chunk_overlap=4, min_characters_per_sentence=1)
    assert any(b[0] < a[1] for a, b in zip(over, over[1:]))
    assert run(chunk_size=1, min_characters_per_sentence=100) == [(0, 18, 18)]
    for o in ({"chunk_size": 0}, {"chunk_overlap": 3000}, {"min_sentences_per_chunk": 0}, {"min_characters_per_sentence": 0}, {"include_delim": "x"}):
        with pytest.raises(ValueError):
            K.SentenceOptions(**o)


def test_recursion():
    run = lambda t, **o: parts(t, K.recursive_chunks(t.encode(), K.RecursiveOptions(**o), counter("char")))
    bars = [{"delimiters": ["|"]}, {"type": "token"}]
    assert run("a|bb|ccc", chunk_size=3, min_characters_per_chunk=1, rules=bars) == ["a|", "bb|", "ccc"]
    assert run("abcdefgh", chunk_size=3, min_characters_per_chunk=1, rules=[{"type": "token"}]) == ["abc", "def", "gh"]
    assert run("abcdefgh", chunk_size=3, min_characters_per_chunk=1, rules=[{"delimiters": ["|"]}]) == ["abcdefgh"]
    assert run("") == [] and run(" ") == [" "]
    for bad in ([], ["x"], [{"type": "y"}], [{"delimiters": ["a"], "include_delim": "z"}]):
        with pytest.raises(ValueError):
            K.RecursiveOptions(rules=bad)


@pytest.mark.parametrize("text", STRESS)
@pytest.mark.parametrize("size", [5, 40, 2048])
def test_coverage(text, size):
    data = text.encode()
    c = counter("char")
    for spans in (K.recursive_chunks(data, K.RecursiveOptions(size, 3), c), K.code_chunks(data, K.CodeOptions(size), c), K.sentence_chunks(data, K.SentenceOptions(size, min_characters_per_sentence=2), c), K.token_chunks(data, K.TokenOptions(size), c), K.semantic_chunks(data, K.SemanticOptions(chunk_size=size, min_characters_per_sentence=2), c, HashEmbedder().embed_batch), K.late_chunks(data, K.LateOptions(size, 3), c, CharTokenEmbedder().embed_as_tokens, CharTokenEmbedder().embed)):
        assert "".join(parts(text, spans)) in (text, "" if is_blank(data) else text)
        assert all(e > s for s, e, *_ in spans)


MD = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\n"


def test_markdown_tables():
    run = lambda t, n=3, k="row": K.table_chunks(t.encode(), K.TableOptions(n, k), counter(k))
    two = run(MD, 2)
    assert len(two) == 2 and all(x[3].startswith(b"| a | b |\n|---|---|\n") for x in two) and [x[2] for x in two] == [2, 1]
    assert run(MD, 10) == [(0, len(MD), 3, MD.encode())]
    assert run("prose") == [] == run(" ") == run("| a |\n|---|\n")
    tokens = run(MD, 35, "character")
    assert len(tokens) == 3 and all(x[2] == len(x[3]) for x in tokens)


def row(i):
    return f"<tr><td>{i}</td></tr>"


@pytest.mark.parametrize(
    "html, n",
    [
        (f"<table class='x>y'><tbody data-a=\"<tr>\">{row(1)}{row(2)}</tbody></table>", 2),
        (f"<TABLE><TR><td>1</td></TR >{row(2)}</TABLE>", 2),
        (f"<table>{row(1)}<tr><td><table>{row(8)}{row(9)}</table></td></tr></table>{row(3)}", 2),
        (f"<table><!-- {row(0)} -->{row(1)}<tr/></table>", 2),
        (f"<table><track>{row(1)}<tr><td>open</table>", 1),
        ("<table><tablet></tablet></table>", 0),
    ],
)
def test_html_tables(html, n):
    got = K.table_chunks(html.encode(), K.TableOptions(1), counter("row"))
    assert len(got) == n


def test_code():
    rust = "fn a() {\n    x();\n}\n\nfn b() {\n    y();\n}\n\nfn c() {\n    z();\n}\n"
    run = lambda t, n, lang="auto": parts(t, K.code_chunks(t.encode(), K.CodeOptions(n, lang), counter("char")))
    assert run(rust, 200) == [rust] and len(run(rust, 20)) > 1 and all(p.endswith("\n") for p in run(rust, 20))
    py = "def a():\n    return 1\ndef b():\n    return 2\ndef c():\n    return 3\n"
    assert run(py, 25, "python") == ["def a():\n    return 1\n", "def b():\n    return 2\n", "def c():\n    return 3\n"]
    assert [K.code_family(x, b"") for x in ("RS", "py", "cobol")] == ["braces", "indent", "generic"]
    assert K.code_family("auto", rust.encode()) == "braces" and K.code_family("auto", py.encode()) == "indent"


CATS = "".join(f"The cat sat on cat mat number {i}. " for i in range(5)) + "".join(f"The bank has money and finance {i}. " for i in range(5))


def test_semantic_finds_the_topic_change():
    o = K.SemanticOptions(threshold=0.5, min_characters_per_sentence=1, filter_window=5, filter_tolerance=0.5, chunk_size=10_000)
    got = parts(CATS, K.semantic_chunks(CATS.encode(), o, counter("char"), TopicEmbedder(["cat", "money"]).embed_batch))
    assert len(got) == 2 and "money" not in got[0] and "cat" not in got[1]
    groups = [(0, 1), (1, 2), (2, 3)]
    vectors = TopicEmbedder(["cat", "money"]).embed_batch(["cat cat cat. ", "finance money here. ", "cat cat cat. "])
    assert K.skip_merge(groups, vectors, 1, 0.8) == [(0, 3)] and K.skip_merge(groups, vectors, 0, 0.8) == groups
    for o in ({"threshold": 0}, {"threshold": 1}, {"filter_polyorder": 5}, {"skip_window": -1}, {"similarity_window": 0}, {"filter_tolerance": 0}):
        with pytest.raises(ValueError):
            K.SemanticOptions(**o)


def test_late_pooling():
    text, c, e = "alpha beta gamma delta", counter("char"), CharTokenEmbedder()
    got = K.late_chunks(text.encode(), K.LateOptions(8, 1), c, e.embed_as_tokens, e.embed)
    v = e.embed_as_tokens(text)
    for s, z, n, mean in got:
        assert n == z - s
        np.testing.assert_allclose(mean, v[s:z].mean(axis=0), rtol=1e-5)
    one = K.late_chunks(b"One. Two. Three.", K.LateOptions(5, 1), c, lambda t: [[1.0]], e.embed)
    assert {n for _, _, n, _ in one} == {1}
    twice = K.late_chunks(text.encode(), K.LateOptions(6, 1), c, lambda t: np.repeat(e.embed_as_tokens(t), 2, axis=0), e.embed)
    assert sum(n for _, _, n, _ in twice) == 2 * len(text)


def test_signals():
    np.testing.assert_allclose(signals.savgol_weights(5, 3, 1), np.array([1, -8, 0, 8, -1]) / 12, atol=1e-12)
    np.testing.assert_allclose(signals.savgol_weights(5, 3, 2), np.array([2, -1, -2, -1, 2]) / 7, atol=1e-12)
    x = [float((i - 10) ** 2) for i in range(20)]
    at, _ = signals.minima(x, 5, 2, 0.5)
    assert 10 in at
    got = signals.cross_similarity([(1, 0, 0), (1, 0, 0), (0, 1, 0)], 3)
    assert len(got) == 2 and abs(got[0] - 0.5) < 1e-9
    at, _ = signals.filter_splits([0, 5, 8, 15, 20], [0.1, 0.3, 0.2, 0.5, 0.4], 0.5, 3)
    assert at.tolist() == [0, 5, 8]
    assert signals.cosine([], []) == 0 == signals.cosine([1], [1, 2]) == signals.cosine([0], [1])
    for bad in (lambda: signals.savgol([1], 4), lambda: signals.savgol([1], 3, 3), lambda: signals.savgol([]), lambda: signals.cross_similarity([[1]], 3), lambda: signals.cross_similarity([[1], [1]], 2)):
        with pytest.raises(ValueError):
            bad()


def test_weights_are_rounded_once():
    assert signals.savgol_weights(5, 2, 1).tolist() == [-0.2, -0.1, 0.0, 0.1, 0.2]
    assert signals.savgol_weights(5, 2, 2).tolist() == [2 / 7, -1 / 7, -2 / 7, -1 / 7, 2 / 7] and signals.savgol_weights(5, 3)[1] == 12 / 35


def test_adapters():
    assert adapt(HashEmbedder())(["a"])[0].shape == (64,)
    assert adapt(len) is len
    assert len(adapt_tokens((len, len))) == 2
    for f, bad, kind in ((adapt, None, ValueError), (adapt, 3, TypeError), (adapt_tokens, None, ValueError), (adapt_tokens, 3, TypeError)):
        with pytest.raises(kind):
            f(bad)
    assert HashEmbedder().embed("")[0] == 1


def slow_semantic(text, o, embed):
    """Semantic chunks from the definitions: polynomials fitted to each window, percentiles, then greedy packing."""
    merged = []
    for s in [x for x in re.findall(r"(?s).*?(?:\. |! |\? |\n)|.+$", text) if x]:
        if merged and (len(merged[-1].encode()) < o.min_characters_per_sentence or len(s.encode()) < o.min_characters_per_sentence):
            merged[-1] += s
        else:
            merged.append(s)
    n, w = len(merged), o.similarity_window
    if n <= w:
        return ["".join(merged)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    curve = [cos(*embed(["".join(merged[i : i + w]), merged[i + w]])) for i in range(n - w)]
    cuts = [0]
    if len(curve) >= o.filter_window:
        found, half = [], o.filter_window // 2
        for i in range(len(curve)):
            places = [abs(i + d) for d in range(-half, half + 1)]
            near = [curve[min(max(2 * len(curve) - p - 2 if p >= len(curve) else p, 0), len(curve) - 1)] for p in places]
            fit = np.polynomial.Polynomial.fit(range(-half, half + 1), near, o.filter_polyorder, domain=[-1, 1]).coef
            if abs(fit[1]) < o.filter_tolerance and 2 * fit[2] > 0:
                found.append(i)
        limit = np.percentile([curve[i] for i in found], o.threshold * 100) if found else 0
        kept = []
        for i in found:
            if curve[i] <= limit and (not kept or i - kept[-1] >= o.min_sentences_per_chunk):
                kept.append(i)
        cuts += [i + w for i in kept if i + w < n]
    groups = [merged[a:z] for a, z in zip(cuts, cuts[1:] + [n]) if a < z]
    if o.skip_window:
        v, i, joined = embed(["".join(g) for g in groups]), 0, []
        while i < len(groups):
            ahead = {j: cos(v[i], v[j]) for j in range(i + 1, min(i + o.skip_window + 1, len(groups) - 1) + 1)}
            best = max(ahead, key=lambda j: (ahead[j], -j), default=None)
            j = best if best is not None and ahead[best] >= o.threshold else i
            joined.append([s for g in groups[i : j + 1] for s in g])
            i = j + 1
        groups = joined
    out = []
    for g in groups:
        held = [g[0]]
        for s in g[1:]:
            if sum(map(len, held)) + len(s) > o.chunk_size:
                out.append("".join(held))
                held = []
            held.append(s)
        out.append("".join(held))
    return out


def test_semantic_and_sdpm_against_brute_force_and_in_batches():
    r, e, c = random.Random(7), HashEmbedder(), counter("char")
    say = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "délta", "money", "house", "tree"]) + str(r.randrange(9)) for _ in range(r.randrange(2, 9))) + r.choice([". ", "! ", "? ", "\n"])
    texts = ["".join(say() for _ in range(r.randrange(0, 60))) for _ in range(40)] + ["", " \n"]
    for o in (K.SemanticOptions(0.6, 400), K.SemanticOptions(0.9, 150, skip_window=1), K.SemanticOptions(0.3, 2000, min_sentences_per_chunk=3, skip_window=2)):
        calls = []

        def embed(some):
            calls.append(len(some))
            return e.embed_batch(some)

        got = K.semantic_batch([t.encode() for t in texts], o, c, embed)
        assert len(calls) == (2 if o.skip_window else 1)
        for t, pieces in zip(texts, got):
            assert pieces == K.semantic_chunks(t.encode(), o, c, e.embed_batch)
            assert parts(t, pieces) == (slow_semantic(t, o, e.embed_batch) if t.strip() else [])
    with pytest.raises(ValueError):
        K.semantic_batch([t.encode() for t in texts], o, c, lambda some: e.embed_batch(some)[:-1])
