"""Market beta, residual volatility and the volatility clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import DAY_SECONDS, clock, micros_of_day, vol_time_scale
from tickweave.operators.quantiles import quantiles
from tickweave.operators.ticks import session_index


def daily_factor_return(quotes: DataFrame, date="Date", time="TransTime", mid="mid", start="09:00", end="13:30") -> DataFrame:
    own = quotes.filter((micros_of_day(time) >= clock(start)) & (micros_of_day(time) <= clock(end)))
    return own.groupBy(date).agg((F.try_divide(F.max_by(mid, time), F.min_by(mid, time)) - 1).alias("factor"))


def entity_daily_return(days: DataFrame, open_="open_price", close="close_price", high="high_price", low="low_price") -> DataFrame:
    """Open to close; entity-days locked at one price go, where highs and lows are known."""
    own = days.filter(F.col(high) != F.col(low)) if {high, low} <= set(days.columns) else days
    return own.withColumn("ret", F.try_divide(F.col(close), F.col(open_)) - 1)


def rolling_beta(returns: DataFrame, lookback: int = 60, min_obs: int = 20, prior: float = 20.0, date="Date", entity="QuoteCode", y="ret", x="factor") -> DataFrame:
    """beta (slope with intercept, shrunk to 1, between -0.5 and 2; 1 under min_obs) and residual_vol over the last
    lookback sessions through each date."""
    own = returns.join(session_index(returns, date), date)
    w = Window.partitionBy(entity).orderBy("session").rangeBetween(1 - lookback, 0)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w)
    both = lambda c: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c))
    own = own.withColumns({"n_obs": n, "_vx": F.var_samp(both(x)).over(w), "_vy": F.var_samp(both(y)).over(w), "_c": F.covar_samp(both(x), both(y)).over(w)})
    slope = F.try_divide(F.col("_c"), F.col("_vx"))
    shrunk = 1 + (slope - 1) * F.col("n_obs") / (F.col("n_obs") + prior)
    known = (F.col("n_obs") >= min_obs) & slope.isNotNull()
    own = own.withColumn("beta", F.when(known, F.least(F.greatest(shrunk, F.lit(-0.5)), F.lit(2.0))).otherwise(1.0))
    spread = F.col("_vy") - 2 * F.col("beta") * F.col("_c") + F.col("beta") * F.col("beta") * F.col("_vx")
    return own.withColumn("residual_vol", F.when(F.col("n_obs") >= min_obs, F.sqrt(F.greatest(spread, F.lit(0.0))))).drop("_vx", "_vy", "_c", "session")


def event_residual_vol(df: DataFrame, vol: str = "txf_residual_vol_0900_1330_60d", time="TransTime", end="13:30") -> DataFrame:
    """RemainSeconds_1330 within the day, and the part of the day's volatility that is left."""
    left = F.least(F.greatest((F.lit(clock(end)) - micros_of_day(time)) / 1e6, F.lit(0.0)), F.lit(float(DAY_SECONDS)))
    base = F.col(vol) if vol in df.columns else F.lit(None).cast("double")
    return df.withColumn("RemainSeconds_1330", left).withColumn("event_vol", base * vol_time_scale(F.col("RemainSeconds_1330") / DAY_SECONDS))


def vol_curve(moves: DataFrame, date="Date", slot="slot", value="to_close", by: list[str] | None = None) -> DataFrame:
    """Typical size of the move to the close by slot, cross-sectional medians taken out, as a share of the first slot's."""
    by = by or []
    mid = quantiles(moves, [value], [0.5], [*by, date, slot]).select(*by, date, slot, F.col(value)[0].alias("_m"))
    off = moves.join(mid, [*by, date, slot]).select(*by, slot, F.abs(F.col(value) - F.col("_m")).alias("size"))
    size = quantiles(off, ["size"], [0.5], [*by, slot]).withColumn("size", F.col("size")[0])
    first = F.first("size").over(Window.partitionBy(*by).orderBy(slot))
    return size.withColumn("share", F.try_divide(F.col("size"), first))


def curve_rmse(curve: DataFrame, expected: Column, by: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(by or [])).agg(F.sqrt(F.avg(F.pow(F.col("share") - expected, 2))).alias("rmse"))


def validate_source(returns: DataFrame, by="source", y="market", x="factor") -> DataFrame:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return returns.filter(ok).groupBy(by).agg(F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("beta"), F.count(F.lit(1)).alias("n"))


def quote_age(events: DataFrame, age="quote_age_us", by: str | None = None) -> DataFrame:
    by = [by] if by else []
    share = events.groupBy(*by).agg(F.avg(F.col(age).isNotNull().cast("double")).alias("resolved"))
    found = quantiles(events, [age], [0.5, 0.95], by).select(*by, F.col(age)[0].alias("p50"), F.col(age)[1].alias("p95"))
    return share.join(found, by) if by else share.crossJoin(found)  # one row each
