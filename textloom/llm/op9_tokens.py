"""Token counts by linear longest match: a vocabulary trie with failure links that know how many tokens they pop.

A word is a run without ASCII white space, preceded by one space, and is cut greedily into the longest pieces of the
vocabulary.  Each trie node that the next byte cannot leave has a failure link to the node for the text that
remains once the longest pieces are taken, with the number of pieces taken; so each byte is read once and no piece is built.
A word that the vocabulary cannot cut counts as one unknown token.  Counts of distinct words are remembered by hash,
within a bound that only saves time.

Defined cases: NULL and blank texts have 0 words and 0 tokens; a row gives a row, so repeated rows repeat; an empty
table gives none; a NULL doc_id stays NULL; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import lean
from .text import RAW, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 1 << 19
RESULT = "doc_id long, n_words long, n_tokens long"


class Automaton:
    """Greedy longest match over pieces that may start a word, and pieces that may continue one."""

    def __init__(self, starting: list[bytes], continuing: list[bytes]):
        self.step: dict[int, int] = {}
        fail, pops, final = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                v = root
                for c in piece:
                    key = v << 8 | c
                    v = self.step.get(key, -1)
                    if v < 0:
                        v = self.step[key] = len(fail)
                        fail.append(-1), pops.append(0), final.append(False)
                if piece:
                    final[v] = True
        below: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.step.items():
            below.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in below.get(u, ()):
                if final[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << 8 | c) not in self.step:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = self.step[z << 8 | c], n
                queue.append(v)
        self.fail, self.pops = fail, pops

    def count(self, word: bytes) -> int:
        step, fail, pops = self.step.get, self.fail, self.pops
        v = n = 0
        for c in word:
            w = step(v << 8 | c, -1)
            while w < 0:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 1
                w = step(v << 8 | c, -1)
            v = w
        while v != 1:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return 1
        return n


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Starting pieces (with their space) and continuing ones, of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model.get("added_tokens", []) if x.get("special")}
    letters = _byte_alphabet()
    every = [bytes(letters[c] for c in word) for word in model["model"]["vocab"] if word not in special]
    return [x for x in every if x[:1] == b" "], [x for x in every if b" " not in x]


_built: dict[str, tuple[Automaton, dict[int, int]]] = {}


def _counts(shared, name: str):
    def run(batches):
        held = _built.get(name)
        if held is None:
            _built.clear()
            held = _built[name] = (Automaton(*shared.value), {})
        automaton, known = held
        for b in batches:
            for s in slices(b.column(1), RAW):
                rows = len(s.first) - 1
                words, at, where = np.unique(s.hashes, return_index=True, return_inverse=True)
                got = np.empty(len(words), np.int64)
                raw, starts, ends = s.buf.tobytes(), s.starts[at].tolist(), s.ends[at].tolist()
                for i, word in enumerate(words.tolist()):
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = automaton.count(b" " + raw[starts[i] : ends[i]])
                    got[i] = n
                total = np.concatenate([[0], np.cumsum(got[where])]) if len(words) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.rows.start, rows), pa.array(s.counts(), pa.int64()), pa.array(total[s.first[1:]] - total[s.first[:-1]], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens. The vocabulary, of a fixed size, is broadcast; no shuffle."""
    both = pieces(vocabulary)
    name = hashlib.md5(repr(both).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(both)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_counts(shared, name)), RESULT)
