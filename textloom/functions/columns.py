"""Column expressions that Catalyst runs in the JVM: counters, splits, packing, vectors and keyword counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_characters(text: str | Column) -> Column:
    return F.char_length(_column(text)).cast("long")


def count_bytes(text: str | Column) -> Column:
    return F.octet_length(_column(text)).cast("long")


def count_words(text: str | Column) -> Column:
    """A run without spaces and the spaces after it; leading spaces are one."""
    return F.regexp_count(_column(text), F.lit("[^ ]+ *| +")).cast("long")


def count_rows(text: str | Column) -> Column:
    c = _column(text)
    return F.when(c == "", F.lit(0)).otherwise(F.regexp_count(c, F.lit("\n")) + 1).cast("long")


COUNTERS = {"character": count_characters, "char": count_characters, "byte": count_bytes, "word": count_words, "row": count_rows}


def java_quote(text: str) -> str:
    return "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in text)


def segments(text: str | Column, delimiters: tuple[str, ...], include: str = "prev") -> Column:
    """The array of segments between delimiters. ``next`` and ``none`` take single characters; ``prev`` any patterns, leftmost, then first listed."""
    c, single = _column(text), all(len(d) == 1 for d in delimiters)
    if not delimiters:
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    if include == "prev" and not single:
        return F.regexp_extract_all(c, F.lit("(?s)(.*?(?:" + "|".join(map(java_quote, delimiters)) + ")|.+$)"), F.lit(1))
    if not single or include not in ("prev", "next", "none"):
        raise ValueError("the native split takes patterns with 'prev' only; split_text takes all")
    d = "".join(map(java_quote, delimiters))
    if include == "prev":
        return F.regexp_extract_all(c, F.lit(f"(?s)([^{d}]*[{d}]|[^{d}]+$)"), F.lit(1))
    if include == "next":
        return F.regexp_extract_all(c, F.lit(f"(?s)([{d}][^{d}]*|^[^{d}]+)"), F.lit(1))
    return F.filter(F.split(c, f"[{d}]"), lambda x: x != "")


def merge_indices(counts: str | Column, size: int) -> Column:
    """Exclusive ends of greedy groups; the fold carries numbers only."""
    c = _column(counts)
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, n: Column) -> Column:
        full = (state["held"] + n > size) & (state["at"] > 0)
        cut = full & (F.coalesce(F.try_element_at(state["ends"], F.lit(-1)), F.lit(0)) < state["at"])
        return F.struct(F.when(cut, n.cast("long")).otherwise(state["held"] + n).alias("held"), (state["at"] + 1).alias("at"), F.when(cut, F.concat(state["ends"], F.array(state["at"]))).otherwise(state["ends"]).alias("ends"))

    done = lambda s: F.when(s["at"] > 0, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"])
    return F.aggregate(c, start, step, done)


def merge_splits(splits: str | Column, counts: str | Column, size: int) -> Column:
    """array<struct<merged, token_count>>: groups that fit ``size``; unchanged where every count is above it."""
    s, c = _column(splits), _column(counts)
    none = F.array().cast("array<struct<a:int,z:int,n:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("first"), F.lit(0).alias("at"), none.alias("groups"))

    def group(state: Column) -> Column:
        return F.struct(state["first"].alias("a"), state["at"].alias("z"), state["held"].alias("n"))

    def step(state: Column, n: Column) -> Column:
        cut = (state["held"] + n > size) & (state["at"] > state["first"])
        return F.struct(
            F.when(cut, n.cast("long")).otherwise(state["held"] + n).alias("held"),
            F.when(cut, state["at"]).otherwise(state["first"]).alias("first"),
            (state["at"] + 1).alias("at"),
            F.when(cut, F.concat(state["groups"], F.array(group(state)))).otherwise(state["groups"]).alias("groups"),
        )

    folded = F.aggregate(c, start, step, lambda x: F.concat(x["groups"], F.array(group(x))))
    single = F.transform(c, lambda n, i: F.struct(i.alias("a"), (i + 1).alias("z"), n.cast("long").alias("n")))
    groups = F.when(F.forall(c, lambda x: x > size), single).otherwise(folded)
    empty = F.array().cast("array<struct<merged:string,token_count:bigint>>")

    def joined(g: Column) -> Column:
        return F.struct(F.array_join(F.slice(s, g["a"] + 1, g["z"] - g["a"]), "").alias("merged"), g["n"].alias("token_count"))

    return F.when((F.size(s) == 0) | (F.size(c) == 0), empty).otherwise(F.transform(groups, joined))


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for unequal lengths and zero vectors. Summed in double precision; ``kernels.signals.cosine`` keeps to single."""
    x, y = _column(a), _column(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot(x, y) / norm).otherwise(F.lit(0.0))


def keyword_vector(text: str | Column, keywords: list[str]) -> Column:
    """Non-overlapping occurrences of each keyword, any case, and a constant 0.05."""
    low = F.lower(_column(text))
    counts = [((F.char_length(low) - F.char_length(F.replace(low, F.lit(k.lower())))) / len(k)).cast("double") for k in keywords]
    return F.array(*counts, F.lit(0.05))
