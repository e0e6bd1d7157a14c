"""Signal and similarity operators over series: rows (series..., pos, value).

Native windows partition by the series keys; a series is a window partition, so its rows sort in the JVM and spill if they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import cosine, dot
from ..kernels.signals import savgol_weights


def _around(df: DataFrame, half: int, value: str, keys: list[str], order: str) -> DataFrame:
    """With ``__near``, the 4 half + 1 values around a row, and the row's place (``__i``) and number of rows (``__n``) in its series."""
    w = W.partitionBy(*keys).orderBy(order)
    near = [(F.lag(value, -k) if k < 0 else F.lead(value, k)).over(w) if k else F.col(value) for k in range(-2 * half, 2 * half + 1)]
    return df.select("*", F.array(*near).alias("__near"), (F.row_number().over(w) - 1).alias("__i"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__n"))


def _convolved(weights) -> Column:
    """Weights over neighbours, mirrored at the ends and then clamped, of ``_around``'s columns.

    Rows away from the ends take their neighbours as they are; a mirrored place is within 2 half of its row.
    """
    half = len(weights) // 2
    i, n, near = F.col("__i"), F.col("__n"), F.col("__near")
    inner: Column = F.lit(0.0)
    edge: Column = F.lit(0.0)
    for j, weight in zip(range(-half, half + 1), weights):
        place = F.when(i + j < 0, -(i + j)).otherwise(i + j)
        place = F.when(place >= n, 2 * n - place - 2).otherwise(place)
        place = F.least(F.greatest(place, F.lit(0)), n - 1)
        inner = inner + near[j + 2 * half] * float(weight)
        edge = edge + near[(place - i + 2 * half).cast("int")] * float(weight)
    return F.when((i >= half) & (i < n - half), inner).otherwise(edge)


def savgol_filter(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("series",), order: str = "pos", window: int = 5, poly: int = 3, deriv: int = 0, output: str = "filtered") -> DataFrame:
    """A Savitzky-Golay filter, or its derivative, in a window over each series."""
    weights = savgol_weights(window, poly, deriv)
    return _around(df, window // 2, value, list(keys), order).withColumn(output, _convolved(weights)).drop("__near", "__i", "__n")


def local_minima(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("series",), order: str = "pos", window: int = 11, poly: int = 2, tolerance: float = 0.2) -> DataFrame:
    """Rows where the smoothed slope is nearly 0 and the curvature positive; ``idx`` is the place in the series."""
    d1, d2 = (_convolved(savgol_weights(window, poly, d)) for d in (1, 2))
    near = _around(df, window // 2, value, list(keys), order).withColumns({"idx": F.col("__i").cast("long"), "__d1": d1, "__d2": d2})
    return near.where((F.abs("__d1") < tolerance) & (F.col("__d2") > 0)).drop("__d1", "__d2", "__near", "__i", "__n")


def filter_split_indices(df: DataFrame, value: str = "value", index: str = "idx", keys: tuple[str, ...] = ("series",), threshold: float = 0.5, min_distance: int = 2) -> DataFrame:
    """Candidates not above the series' percentile, thinned from the left to ``min_distance``."""
    limit = F.percentile(value, F.lit(threshold)).over(W.partitionBy(*keys))
    kept = df.withColumn("__limit", limit).where(F.col(value) <= F.col("__limit")).drop("__limit")
    if min_distance <= 1:
        return kept
    ordered = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("__all"))
    none = F.array().cast(ordered.schema["__all"].dataType)
    far = F.aggregate("__all", none, lambda got, x: F.when((F.size(got) == 0) | (x["i"] - F.try_element_at(got, F.lit(-1))["i"] >= min_distance), F.concat(got, F.array(x))).otherwise(got))
    return ordered.select(*keys, F.explode(far).alias("__x")).select(*keys, F.col("__x.i").alias(index), F.col("__x.v").alias(value))


def cross_similarity(df: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ("series",), order: str = "pos", window: int = 3, output: str = "similarity") -> DataFrame:
    """Cosines of neighbours, averaged over a window of pairs; a row for each pair, at its first vector."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and 3 or more")
    half, w = window // 2, W.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("__next", F.lead(vector).over(w)).where("__next is not null")
    some = (dot(vector, vector) > 0) & (dot("__next", "__next") > 0)
    pairs = pairs.withColumn("__c", F.when(some, cosine(vector, "__next")))
    return pairs.withColumn(output, F.coalesce(F.avg("__c").over(w.rowsBetween(-half, half)), F.lit(0.0))).drop("__next", "__c")


def mean_vectors(df: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """The mean vector of each series, by partial sums for each dimension, so that a large series is never in one place."""
    parts = df.select(*keys, F.posexplode(vector).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__all"))
    return rows.select(*keys, F.transform("__all", lambda x: x["__m"]).alias(vector))


def merge_groups(df: DataFrame, size: int, split: str = "split", tokens: str = "tokens", keys: tuple[str, ...] = ("series",), order: str = "pos") -> DataFrame:
    """Each series' splits, greedily joined to groups of ``size`` tokens: keys, group, merged, token_count."""
    from ..functions.columns import merge_splits

    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n"), F.col(split).alias("s")))).alias("__all"))
    merged = merge_splits(F.transform("__all", lambda x: x["s"]), F.transform("__all", lambda x: x["n"]), size)
    made = rows.select(*keys, F.posexplode_outer(merged).alias("group", "__m")).where("group is not null")
    return made.select(*keys, F.col("group").cast("long").alias("group"), "__m.merged", "__m.token_count")
