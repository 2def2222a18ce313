"""Exact interpolated quantiles without a buffer of a group's values.

Values fall into ranges, cut at an approximate sketch of all values, so that a range holds about a RANGES-th of the rows
whatever the groups are. Counts by group and range tell which ranges hold the wanted ranks; only the rows of those ranges are
looked at again, their equal values counted, and the ranks picked by running counts within a range. However large a group is,
no task has more than a range of it, and the result doesn't depend on where the sketch has cut.

Tables of at most MOST rows are left to Spark's own percentile, whose buffer is then as small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, MOST = 1024, 500_000


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts (ascending) lie below the value; NaN lies above all, null below."""
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts, float)

    @F.pandas_udf("int")
    def below(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(float)))

    return F.when(value.isNull(), 0).otherwise(below(value.cast("double")))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with b's columns, keys null-safe; b is broadcast if it is proven small."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    other = b.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    other = F.broadcast(other) if b.limit(100_001).count() <= 100_000 else other
    return a.join(other, same, how).drop(*[f"_j_{k}" for k in keys])


def _select(own: DataFrame, shares: list[float], ahead: tuple[str, int] | None) -> DataFrame:
    """own: _g (the group), _v, and with ahead its column. A row a group: _g (, ahead's column) and _q."""
    at, n = ahead or (None, 0)
    keys = ["_g", *([at] if at else [])]
    cuts = own.agg(F.percentile_approx("_v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10 * RANGES))).first()[0] or []
    own = own.withColumn("_r", range_of(F.col("_v"), sorted({c for c in cuts if not math.isnan(c)})))
    later = lambda df: df.withColumn(at, F.explode(F.sequence(F.col(at) + 1, F.col(at) + n))) if at else df
    counts = later(own.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    if at:
        counts = counts.groupBy(*keys, "_r").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*keys)  # at most RANGES rows a group
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(w)})
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil if up else F.floor)((F.col("_all") - 1) * F.lit(float(q))).cast("long").alias("rank")) for k, q in enumerate(shares) for up in (0, 1)])
    wanted = counts.withColumn("_want", F.filter(ranks, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_n")))).filter(F.size("_want") > 0)
    wanted = wanted.persist(StorageLevel.DISK_ONLY)  # a few ranges a group, read three times; the rows are counted once
    flat = wanted.filter(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys, "_all", F.col("_lo").alias("_v"), F.inline("_want"))
    mixed = wanted.filter(~F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys, "_r", "_before", "_all", "_want")
    if at:  # the groups whose rows those are: up to n before
        source = mixed.withColumn("_own", F.explode(F.sequence(F.col(at) - n, F.col(at) - 1))).withColumnRenamed(at, "_to")
        rows = _joined(own.withColumnRenamed(at, "_own"), source, ["_g", "_own", "_r"]).drop("_own").withColumnRenamed("_to", at)
    else:
        rows = _joined(own, mixed, [*keys, "_r"])
    equal = rows.groupBy(*keys, "_r", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"), F.first("_want").alias("_want"))
    first = F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = equal.withColumn("_first", first).select(*keys, "_all", "_v", F.inline(F.filter("_want", lambda x: (x["rank"] >= F.col("_first")) & (x["rank"] < F.col("_first") + F.col("_n")))))
    found = flat.unionByName(hit).groupBy(*keys).agg(F.first("_all").alias("_all"), *[F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("_v"))).alias(f"_{side}{k}") for k in range(len(shares)) for side, up in (("l", 0), ("u", 1))])

    def between(k: int, q: float) -> Column:
        at_rank, low, high = (F.col("_all") - 1) * F.lit(float(q)), F.col(f"_l{k}"), F.col(f"_u{k}")
        return F.when(low.eqNullSafe(high), low).otherwise((F.ceil(at_rank) - at_rank) * low + (at_rank - F.floor(at_rank)) * high)

    return found.select(*keys, F.array(*[between(k, q) for k, q in enumerate(shares)]).alias("_q"))


def quantiles(df: DataFrame, values: list[str], shares: list[float], by: list[str] | None = None, ahead: tuple[str, int] | None = None, most: int | None = None) -> DataFrame:
    """by, and for each value an array of its interpolated quantiles over the group's rows, nulls left out (null if none is left).

    ahead: a column of whole numbers and n: groups are then by that column too, and each row belongs to the n groups that follow its own.
    """
    by, most = by or [], MOST if most is None else most
    at = [ahead[0]] if ahead else []
    if df.limit(most + 1).count() <= most:
        own = df.select(*by, *at, *values)
        if ahead:
            own = own.withColumn(at[0], F.explode(F.sequence(F.col(at[0]) + 1, F.col(at[0]) + ahead[1])))
        return own.groupBy(*by, *at).agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in values])
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(values)]))
    own = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("one")).alias("_by"), *at, each).filter("_v is not null")
    found = _select(own.select(F.struct("_by", "_c").alias("_g"), *at, "_v"), shares, ahead)
    wide = found.groupBy(F.col("_g._by").alias("_by"), *at).agg(*[F.max(F.when(F.col("_g._c") == i, F.col("_q"))).alias(c) for i, c in enumerate(values)])
    wide = wide.select(*[F.col(f"_by.k{i}").alias(c) for i, c in enumerate(by)], *at, *values).persist(StorageLevel.DISK_ONLY)  # a row a group
    # Groups without any value keep their row.
    groups = df.select(*by, *at)
    groups = (groups.withColumn(at[0], F.explode(F.sequence(F.col(at[0]) + 1, F.col(at[0]) + ahead[1]))) if ahead else groups).distinct()
    if not by and not at:
        return wide if not wide.isEmpty() else df.agg(*[F.max(F.when(F.lit(False), F.array(F.col(c).cast("double")))).alias(c) for c in values])
    return _joined(groups, wide, [*by, *at], "left")
