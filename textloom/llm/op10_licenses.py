"""License scans by patience alignment against notice templates.

A notice is looked for in stretches of ``SPREAD`` times the template's words, so that as many words again and more may stand between
its own (line numbers, comment marks); words farther apart than that are no notice by definition.  A document that lacks too
many of a template's words to reach the coverage can't match and is passed over, as is any stretch that holds too few of them; both bounds are exact.  In the
stretches left, words that are unique to both text and template are anchors, the longest increasing subsequence of
them is kept, and the gaps between are aligned in the same way; equal words next to an anchor or an edge extend it.
Coverage is the share of the template's words that are aligned.

Defined cases: NULL and empty texts match nothing; a row gives its matches, so repeated rows repeat; an empty table
gives no rows; a NULL doc_id stays NULL; several copies of a notice give a row each; of templates that match the same words the
one with the most aligned words is named, then the best covered, then the first by name; further columns are ignored; a very long text is
read in pieces of 8 MB, in memory by its number of tokens.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op2_toxicity import Lookup
from .packed import lean
from .text import WORD, slices

COVERAGE, SPREAD = 0.8, 3.0
RESULT = "doc_id long, license string, coverage double, n_aligned long, start_token long, end_token long"
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        back.append(heads[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v), heads.append(i)
        else:
            tails[k], heads[k] = v, i
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two word lists, by anchors on words unique to both; the gaps are worked off a list, not a call stack."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        seen_a: dict = {}
        seen_b: dict = {}
        for k in range(i, ie):
            seen_a[a[k]] = -1 if a[k] in seen_a else k
        for k in range(j, je):
            seen_b[b[k]] = -1 if b[k] in seen_b else k
        both = [(k, seen_b[w]) for w, k in seen_a.items() if k >= 0 and seen_b.get(w, -1) >= 0]
        both.sort()
        last_i, last_j = i, j
        chosen = [both[k] for k in increasing([y for _, y in both])]
        for x, y in chosen:
            out.append((x, y))
            todo.append((last_i, x, last_j, y))
            last_i, last_j = x + 1, y + 1
        if chosen:
            todo.append((last_i, ie, last_j, je))
    return sorted(out)


def copies(template: list[int], words: list[int], hit: np.ndarray, least: float, spread: float = SPREAD) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, aligned words) of a template's copies: ``least`` words aligned in a stretch of ``spread`` times the template.

    In a range of the tokens, starts are tried from the left until one aligns; of the starts within that copy the one with the
    most aligned words, then the shortest, counts, and what lies before and after its aligned words are ranges of their own.
    """
    n, kinds = len(template), set(template)
    wide, spare = int(spread * n) + 1, n - len(kinds)
    total = np.concatenate([[0], np.cumsum(hit)])
    places = np.flatnonzero(hit)
    found = []
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        start = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)]  # a copy starts at an aligned word
        start = start[total[np.minimum(start + wide, hi)] - total[start] >= least]
        best, first, end = None, hi, hi
        for a in start.tolist():
            if a >= end:
                break
            near = words[a : min(a + wide, hi)]
            if len(kinds.intersection(near)) + spare < least:
                continue
            got = patience(template, near)
            if len(got) < least:
                continue
            x, y = a + got[0][1], a + got[-1][1] + 1
            first, end = min(first, a), min(end, y)
            if best is None or (-len(got), y - x) < best[:2]:
                best = (-len(got), y - x, x, y)
        if best:
            _, _, x, y = best
            found.append((x, y, -best[0]))
            todo += [(max(lo, min(first, x - wide)), x), (y, hi)]  # stretches from further left end before x and didn't align
    return sorted(found)


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        words = [next(slices(pa.array([texts[k]]), WORD, lower=True)).hashes for k in self.names]
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.terms, w) for w in words]
        self.has = np.zeros((len(self.terms), len(words)))
        for k, w in enumerate(self.words):
            np.add.at(self.has[:, k], w, 1)
        self.size = np.array([len(w) for w in self.words])


def _scanned(shared, coverage: float, spread: float):
    def run(batches):
        t = shared.value
        look = Lookup(t.terms)
        for b in batches:
            for s in slices(b.column(1), WORD, lower=True):
                rows = len(s.first) - 1
                term = look(s.hashes)
                at = np.flatnonzero(term >= 0)
                pair = np.unique(s.row_of()[at] * max(1, len(t.terms)) + term[at])
                row, present = np.divmod(pair, max(1, len(t.terms)))
                reach = np.zeros((rows, len(t.names)))
                edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
                if len(edge):
                    reach[row[edge]] = np.add.reduceat(t.has[present], edge, axis=0)
                found: dict[int, list] = {}
                for i, k in zip(*np.nonzero(reach >= coverage * t.size - 1e-9)):
                    words = term[s.first[i] : s.first[i + 1]]
                    n = int(t.size[k])
                    hit = t.has[:, k][np.maximum(words, 0)].astype(bool) & (words >= 0)
                    for a, z, aligned in copies(t.words[k].tolist(), words.tolist(), hit, coverage * n - 1e-9, spread):
                        found.setdefault(int(i), []).append((-aligned, -round(aligned / n, 6), t.names[k], aligned, a, z))
                out = []
                for i, matches in found.items():
                    taken: list[tuple[int, int]] = []
                    for m in sorted(matches):
                        if all(m[5] <= a or m[4] >= z for a, z in taken):
                            taken.append((m[4], m[5]))
                            out.append((s.rows.start + i, m[2], -m[1], m[3], m[4], m[5]))
                if out:
                    c = list(zip(*out))
                    columns = [b.column(0).take(pa.array(c[0])), pa.array(c[1], pa.string()), pa.array(c[2], pa.float64())]
                    columns += [pa.array(x, pa.int64()) for x in c[3:]]
                    names = ["doc_id", "license", "coverage", "n_aligned", "start_token", "end_token"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice found: doc_id, license, coverage, n_aligned, start_token, end_token. No shuffle."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be above 0 and at most 1")
    if spread < 1:
        raise ValueError("spread must be 1 or more")
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_scanned(shared, coverage, spread)), RESULT)
