"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's quota is its share of ``total`` by weight (largest remainder).  With the default weights the total is by default
the least that draws every document, so scarce sources repeat and none loses a document; with given weights it is
the largest that needs no document twice.  Each source's documents are put in an order by a seeded hash and cut into blocks; a quota is a number of
whole blocks and one partial block.  The shards are halved again and again: at each node the
left half takes its number of blocks by a multivariate hypergeometric draw over the sources' blocks in the node, so each leaf
has exact block counts, and together they use up the quotas.  A shard's blocks of a source are a run of the source's order,
disjoint from all others; the shard is then shuffled locally.  The tree needs only the sources' counts.

A document's shard follows from where its hash lies between those of the documents at its source's shard ends.  Counts by (source, hash
range), added up, tell in which range each end lies; only those ranges are ranked.  So texts are moved once, to their shard, and a
hot source is nowhere in one task.  Positions in a shard are ranks in hash ranges of the shard, after counts of those.

Where ``total`` asks for more than a source has, its order is gone through again (``epoch`` counts the passes).  A folded result has
one row a document with the places of all its draws: these are ranked without texts and meet the texts in one exchange by document.

Defined cases: a NULL source is a source of its own, 'NULL' in ``weights`` by key None; sources without a weight have
weight 0; repeated rows count each; an empty table, or none of the weighted sources, gives no rows; NULL texts and ids are kept like any
other; ties in the hash go by doc_id (NULL as -2**63), then by the row's hash without map and variant columns, and rows that are equal but for
those take one place together, so a shard's end never parts them; columns named like the result's are replaced; texts of any length are only moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .packed import Stored

SHARDS, BLOCK, SEED, POWER, BROADCAST_SOURCES = 16, 64, 17, 0.7, 4096
PLACE = ["epoch", "shard", "position"]


def quotas(counts: dict, weights: dict, total: int | None = None) -> dict:
    """Documents to draw from each source: exact shares of the total by largest remainder (ties: the source's name)."""
    live = {s: float(weights.get(s, 0)) for s in counts if counts[s] and weights.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(live.values())
    if total is None:
        total = int(min(counts[s] * whole / w for s, w in live.items()) + 1e-9)
    exact = {s: total * w / whole for s, w in live.items()}
    got = {s: int(x + 1e-9) for s, x in exact.items()}
    for s in sorted(live, key=lambda s: (got[s] - exact[s], str(s)))[: total - sum(got.values())]:
        got[s] += 1
    return got


def covering(counts: dict, weights: dict) -> int:
    """The least total, rounded down, at which every document of the weighted sources is drawn."""
    live = {s: float(weights[s]) for s in counts if counts[s] and weights.get(s, 0) > 0}
    whole = sum(live.values())
    return int(max((counts[s] * whole / w for s, w in live.items()), default=0) * (1 + 1e-12))


def split_tree(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards x sources) numbers of blocks: rows' sums differ by one at most, columns' sums are ``blocks``."""
    out = np.zeros((shards, len(blocks)), np.int64)
    rng = np.random.default_rng(seed)
    size = np.full(shards, int(blocks.sum()) // shards, np.int64)
    size[: int(blocks.sum()) % shards] += 1
    todo = [(0, shards, np.asarray(blocks, np.int64))]
    while todo:
        a, z, have = todo.pop()
        if z - a == 1:
            out[a] = have
            continue
        m = (a + z) // 2
        left = rng.multivariate_hypergeometric(have, int(size[a:m].sum()), method="marginals") if have.sum() else have
        todo += [(m, z, have - left), (a, m, left)]
    return out


def tempered(counts: dict, power: float = POWER) -> dict:
    """Weights that damp large sources: count ** power."""
    return {s: float(n) ** power for s, n in counts.items() if n}


def _reached(end, epoch, h, key, row):
    """Whether a document is at or beyond an end (epoch, whole, h, key, row) in an epoch; the row's hash is only made at a tie."""
    beyond = end["whole"] | (h > end["h"]) | ((h == end["h"]) & ((key > end["key"]) | ((key == end["key"]) & (row >= end["row"]))))
    return (epoch > end["epoch"]) | ((epoch == end["epoch"]) & beyond)


def mix(docs: DataFrame, weights: dict | None = None, total: int | None = None, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED, power: float = POWER, columns: list[str] | None = None, fold: bool = False) -> DataFrame:
    """The drawn rows with epoch, shard and position (from 0 in each shard); ``columns`` are kept, all by default.

    With ``fold`` a document's draws are one row: its first draw's epoch, shard and position, and those of the others in the array
    ``repeats``; ``unfold`` makes the rows of the draws again.

    ``weights`` by source; tempered counts by default, and then every document is drawn unless a ``total`` is given. Counts are of all documents. The driver holds (sources x shards) numbers.
    """
    if shards < 1 or block < 1 or (total is not None and total < 0):
        raise ValueError("shards and block must be positive, total not negative")
    spark = docs.sparkSession
    keep = [c for c in (columns or docs.columns) if c not in ("shard", "position", "epoch", *(["repeats"] if fold else []))]
    ordered = docs.select(*{*keep, "doc_id", "source"})
    hashed = sorted(c for c, kind in ordered.dtypes if "map<" not in kind and kind not in ("variant", "void"))
    row = F.xxhash64(*[F.col(c) for c in hashed])
    least = F.lit(-(1 << 63))
    names = {
        "h": F.xxhash64("doc_id", F.lit(seed)).bitwiseXOR(least),  # unsigned order, as the ranges'
        "key": F.coalesce(F.col("doc_id").cast("long"), least),
        "range": F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 56).cast("int"),
        "src": F.col("source").cast("string"),
    }
    names = {f"__{k}": v for k, v in names.items()}
    ordered = ordered.select("*", *[v.alias(k) for k, v in names.items()])
    spread = Stored(ordered.groupBy("__src", "__range").agg(F.count("*").alias("n")), "spread")
    counts = {r[0]: r.n for r in spread.df.groupBy("__src").agg(F.sum("n").alias("n")).collect()}
    if weights is None and total is None:
        target = tempered(counts, power)
        quota = {s: max(n, counts[s]) for s, n in quotas(counts, target, covering(counts, target)).items()}  # rounding takes none
    else:
        quota = quotas(counts, tempered(counts, power) if weights is None else weights, total)
    sources = sorted(quota, key=lambda s: (s is not None, s))
    tree = split_tree(-(-np.array([quota[s] for s in sources], np.int64) // block), shards, seed)
    cuts = [np.append(np.minimum(np.cumsum(tree[:, i]) * block, quota[s]), quota[s]).tolist() for i, s in enumerate(sources)]  # shard j has places cuts[j-1] <= place < cuts[j]

    # The documents at the ends: which hash range each is in, and its place there.
    ends = spark.createDataFrame([(s, m) for s, at in zip(sources, cuts) for m in sorted({x % counts[s] for x in at} - {0})], "s string, m long")
    up = W.partitionBy("__src").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = spread.df.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    found = ends.join(ranges, F.col("s").eqNullSafe(F.col("__src")) & (F.col("before") <= F.col("m")) & (F.col("m") < F.col("before") + F.col("n")))
    places = found.select("s", "m", F.col("__range").alias("r"), (F.col("m") - F.col("before") + 1).alias("place"))
    few = len(sources) <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda t: t
    inside = ordered.join(small(places.select("s", "r").distinct()), F.col("__src").eqNullSafe(F.col("s")) & (F.col("__range") == F.col("r")))
    ranked = inside.select("s", "r", "__h", "__key", row.alias("__row")).withColumn("place", F.row_number().over(W.partitionBy("s", "r").orderBy("__h", "__key", "__row")))
    at = ranked.alias("a").join(small(places).alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.place") == F.col("b.place")))
    keys = {(r.s, r.m): (r.h, r.key, r.row) for r in at.select("a.s", "b.m", F.col("__h").alias("h"), F.col("__key").alias("key"), F.col("__row").alias("row")).collect()}
    spread.drop()

    plan = []
    for s, places_of in zip(sources, cuts):
        have = counts[s]
        marks = [(x // have, x % have == 0, *keys.get((s, x % have), (0, 0, 0))) for x in places_of]
        plan.append((s, marks[-1], marks[:-1]))
    mark = "struct<epoch:int, whole:boolean, h:long, key:long, row:long>"
    plans = small(spark.createDataFrame(plan, f"__s string, __last {mark}, __ends array<{mark}>"))
    drawn = ordered.join(plans, F.col("__src").eqNullSafe(F.col("__s"))).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__last.epoch"))))
    here = (F.col("__epoch"), F.col("__h"), F.col("__key"), row)
    drawn = drawn.where(~_reached(F.col("__last"), *here))
    drawn = drawn.withColumn("__shard", F.size(F.filter("__ends", lambda e: _reached(e, *here))).cast("int"))
    local = F.xxhash64("doc_id", "__epoch", F.lit(seed + 1))
    drawn = drawn.withColumns({"__l": local.bitwiseXOR(least), "__lr": F.shiftrightunsigned(local, 56).cast("int")})
    have = {(r[0], r[1]): r.n for r in drawn.groupBy("__shard", "__lr").agg(F.count("*").alias("n")).collect()}  # shards x 256 numbers
    first, start = [], 0
    for i, (shard, r) in enumerate(sorted(have)):
        start = start if first and first[-1][0] == shard else 0
        first.append((shard, r, start))
        start += have[shard, r]
    starts = spark.createDataFrame(first, "__s2 int, __r2 int, __first long")
    starts = F.broadcast(starts) if len(first) <= 256 * BROADCAST_SOURCES else starts
    within = W.partitionBy("__shard", "__lr").orderBy("__l", "__key", "__epoch", "__row")
    doc = F.struct(*keep).alias("__doc")
    packed = drawn.select("__h" if fold else doc, "__shard", "__lr", "__l", "__key", "__epoch", row.alias("__row"))
    out = packed.withColumn("__n", F.row_number().over(within) - 1).join(starts, (F.col("__shard") == F.col("__s2")) & (F.col("__lr") == F.col("__r2")))
    place = [F.col("__epoch").cast("int").alias("epoch"), F.col("__shard").alias("shard"), (F.col("__first") + F.col("__n")).cast("long").alias("position")]
    fields = [F.col("__doc").getField(c).alias(c) for c in keep]
    if not fold:
        return out.select(*fields, *place)
    # Equal rows are drawn together, so in each epoch the n-th of them takes the n-th of their places.
    same = ["__h", "__key", "__row"]
    texts = ordered.select("__h", "__key", row.alias("__row"), doc)
    both = texts.unionByName(out.select(*same, F.struct(*place).alias("__draw")), allowMissingColumns=True).repartition(*same)
    both = both.withColumn("__copy", F.row_number().over(W.partitionBy(*same, "__draw.epoch").orderBy("__draw.shard", "__draw.position")))
    met = both.groupBy(*same, "__copy").agg(F.first("__doc", ignorenulls=True).alias("__doc"), F.sort_array(F.collect_list("__draw")).alias("__draws")).where(F.size("__draws") > 0)
    first = F.col("__draws")[0]
    return met.select(*fields, *[first[c].alias(c) for c in PLACE], F.slice("__draws", 2, F.size("__draws")).alias("repeats"))


def unfold(mixed: DataFrame) -> DataFrame:
    """A row a draw from the rows of documents that ``mix`` gives with ``fold``: the rows that it gives without."""
    kept = [c for c in mixed.columns if c not in (*PLACE, "repeats")]
    draws = F.concat(F.array(F.struct(*PLACE)), "repeats")
    return mixed.select(*[F.col(f"`{c}`") for c in kept], F.explode(draws).alias("__draw")).select(*[F.col(f"`{c}`") for c in kept], *[F.col("__draw")[c].alias(c) for c in PLACE])
