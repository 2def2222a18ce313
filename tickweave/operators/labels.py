"""Labels: raw short and long moves, hedged and netted residuals, conditional baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import is_finite, tick_size
from tickweave.operators.asof import lookup


def raw_short(df: DataFrame, stop: float = 1.08, ticks: int = 2, out="raw_bp") -> DataFrame:
    """Basis points of selling at the bid and buying at the close, or at the stop plus ticks if it was passed."""
    line = F.col("RefPrice") * stop
    leave = F.when(F.col("FutureHigh") > line, line + ticks * tick_size(line)).otherwise(F.col("Close"))
    return df.withColumn(out, F.try_divide(F.col("BidPrice1") - leave, F.col("BidPrice1")) * 10_000)


def raw_long(df: DataFrame, stop: float = 1.09, out="raw_bp") -> DataFrame:
    line = F.col("RefPrice") * stop
    leave = F.when(F.col("FutureHigh") > line, line).otherwise(F.col("Close"))
    return df.withColumn(out, F.try_divide(leave - F.col("AskPrice1"), F.col("AskPrice1")) * 10_000)


def lower_stop(df: DataFrame, stop: float = 0.91, ticks: int = 1, out="raw_bp") -> DataFrame:
    line = F.col("RefPrice") * stop
    leave = F.when(F.col("FutureLow") < line, line + ticks * tick_size(line)).otherwise(F.col("Close"))
    return df.withColumn(out, F.try_divide(F.col("BidPrice1") - leave, F.col("BidPrice1")) * 10_000)


def hedged(df: DataFrame, raw="raw_bp", beta="beta", market="txf_to_1330_bp", vol="event_vol", short: bool = True) -> DataFrame:
    """hedge_bp, idio_bp, vol_bp, z and hedge_z."""
    sign = 1 if short else -1
    out = df.withColumns({"hedge_bp": F.col(beta) * F.col(market), "vol_bp": F.col(vol) * 10_000})
    out = out.withColumn("idio_bp", F.col(raw) + sign * F.col("hedge_bp"))
    return out.withColumns({"z": F.try_divide(F.col("idio_bp"), F.col("vol_bp")), "hedge_z": F.try_divide(F.col("hedge_bp"), F.col("vol_bp"))})


def net(df: DataFrame, label: str, date="Date", entity="QuoteCode", penalty: tuple[str, float] | None = None) -> DataFrame:
    """label less the mean of its (date, entity), and less the mean of its date; penalty: a flag column and its cost.

    A session's mean is aggregated and joined back (one row a session is broadcast), since a window would send the session
    through one task.
    """
    value = F.col(label) - (F.when(F.col(penalty[0]), penalty[1]).otherwise(0.0) if penalty else 0.0)
    means = F.broadcast(df.groupBy(F.col(date).alias("_d")).agg(F.avg(value).alias("_m")))
    own = df.withColumn(f"{label}_net", value - F.avg(value).over(Window.partitionBy(date, entity))).join(means, F.col(date).eqNullSafe(F.col("_d")), "left")
    return own.withColumn(f"{label}_netM", value - F.col("_m")).select(*[c for c in df.columns if c not in (f"{label}_net", f"{label}_netM")], f"{label}_net", f"{label}_netM")


def conditional_baseline(df: DataFrame, z="z", date="Date", cell="cell", sessions: int = 20, strength: float = 2000.0) -> DataFrame:
    """f per (date, cell): the prior sessions' mean of z in the cell, shrunk to their pooled mean. Missing cells count
    as empty; dates with fewer prior sessions get null."""
    daily = df.filter(is_finite(F.col(z))).groupBy(date, cell).agg(F.sum(z).alias("s"), F.count(F.lit(1)).alias("n"))
    dates, cells = df.select(date).distinct(), df.select(cell).distinct().filter(F.col(cell).isNotNull())
    # Every session gets every cell: the cells are a fixed set of bins, exploded from one array.
    listed = F.array_sort(F.array_agg(cell))
    grid = dates.withColumn("_one", F.lit(1)).join(cells.agg(listed.alias("cells")).withColumn("_one", F.lit(1)), "_one").select(date, F.explode("cells").alias(cell))
    full = grid.join(daily, [date, cell], "left").fillna(0, ["s", "n"])
    w = Window.partitionBy(cell).orderBy(date).rowsBetween(-sessions, -1)
    full = full.withColumns({"S": F.sum("s").over(w), "N": F.sum("n").over(w), "k": F.count(F.lit(1)).over(w)})
    pooled = Window.partitionBy(date)
    g = F.try_divide(F.sum("S").over(pooled), F.sum("N").over(pooled))
    full = full.withColumn("_g", g)
    return full.select(date, cell, F.when(F.col("k") == sessions, (F.col("S") + F.col("_g") * strength) / (F.col("N") + strength)).alias("f"))


def residual_ex(df: DataFrame, baseline: DataFrame, z="z", date="Date", cell="cell") -> DataFrame:
    """z less its cell's baseline f (conditional_baseline); null where there is none yet."""
    return lookup(df, baseline.select(date, cell, "f"), [date, cell]).withColumn("residual_ex", F.col(z) - F.col("f"))


def edge(df: DataFrame, fee: float = 19.3, hedge_cost: float = 0.0, idio="idio_bp") -> DataFrame:
    return df.withColumn("edge_bp", F.col(idio) - fee - hedge_cost)


def is_alpha(df: DataFrame, fee: float = 19.3, hedge_cost: float = 0.0, idio="idio_bp", date="Date", least_t: float = 2.0) -> DataFrame:
    """Mean hedged edge after costs, t of its daily means, and whether it is alpha: positive with a t that is high enough."""
    daily = edge(df, fee, hedge_cost, idio).groupBy(date).agg(F.avg("edge_bp").alias("d"))
    out = daily.agg(F.count("d").alias("days"), F.avg("d").alias("mean_edge"), (F.try_divide(F.avg("d"), F.stddev_samp("d")) * F.sqrt(F.count("d").cast("double"))).alias("t"))
    return out.withColumn("alpha", F.coalesce((F.col("mean_edge") > 0) & (F.col("t") >= least_t), F.lit(False)))


def to_bp(df: DataFrame, score: str, vol="vol_bp") -> DataFrame:
    return df.withColumn(f"{score}_bp", F.col(score) * F.col(vol))
