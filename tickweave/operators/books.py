"""Position limits and combined books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import micros
from tickweave.operators.asof import add_aligned

ORDER = ["TransTime", "ChannelSeq"]


def running_positions(signals: DataFrame, keys=("Date", "QuoteCode"), order=ORDER, price="BidPrice1") -> DataFrame:
    """accLots and Position over all signals of the entity and session, in time order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return signals.withColumns({"accLots": F.count(F.lit(1)).over(w), "Position": F.sum(F.col(price) / 10).over(w)})


def cap_after(signals: DataFrame, limit: float | Column = 200.0, rules: Column | None = None, **kw) -> DataFrame:
    """Signals within the limits; those that later rules drop have used their quota."""
    own = running_positions(signals, **kw).filter(F.col("Position") < limit)
    return own if rules is None else own.filter(rules)


def cap_first_always(signals: DataFrame, limit: float | Column = 200.0, **kw) -> DataFrame:
    """Drops rows beyond the limit, but never an entity's first of the session."""
    return running_positions(signals, **kw).filter((F.col("accLots") <= 1) | (F.col("Position") <= limit))


def cap_session(signals: DataFrame, limit: float, date="Date", order=ORDER, price="BidPrice1", bucket_us: int = 300_000_000) -> DataFrame:
    """Rows within a running total for the whole session, in the order of time. Totals run within stretches of time, and over the sums of the stretches before."""
    own = signals.withColumn("_b", F.floor(micros(order[0]) / bucket_us))
    sums = own.groupBy(date, "_b").agg(F.sum(F.col(price) / 10).alias("_s"))
    before = sums.select(date, "_b", F.coalesce(F.sum("_s").over(Window.partitionBy(date).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    w = Window.partitionBy(date, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(before, [date, "_b"]).withColumn("BookPosition", F.col("_before") + F.sum(F.col(price) / 10).over(w))
    return out.filter(F.round("BookPosition", 6) <= limit).select(*signals.columns, "BookPosition")


def tiered_limit(deep: Column, high: float = 200.0, low: float = 100.0) -> Column:
    return F.when(deep, high).otherwise(low)


def combine_books(a: DataFrame, b: DataFrame, date="Date", value="pnl") -> tuple[DataFrame, DataFrame]:
    """Daily sum of two books over all their dates, and their correlation over common dates."""
    both = a.select(date, F.col(value).alias("a")).join(b.select(date, F.col(value).alias("b")), date)
    return add_aligned(a, b, date, value), both.agg(F.corr("a", "b").alias("corr"), F.count(F.lit(1)).alias("days"))
