"""The event table as one plan: event keys, their ticks and features, side data, futures and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators import asof, beta, filters, ticks

UNIKEY = ["Date", "QuoteCode", "ChannelSeq"]


def event_keys(features: DataFrame, keys=filters.KEYS, order="ChannelSeq") -> DataFrame:
    """Keys of the candidate events among ticks with features."""
    return ticks.differences(features, keys, order).filter(ticks.candidate_event()).select(*UNIKEY)


def at_keys(df: DataFrame, keys: DataFrame, on=UNIKEY) -> DataFrame:
    """Rows of a source that are events."""
    return df.join(keys.select(*on), on, "left_semi")


def with_features(data: DataFrame, features: DataFrame, on=UNIKEY) -> DataFrame:
    """Ticks with their features of equal key; names that both have stay those of the ticks."""
    return data.join(features.drop(*[c for c in features.columns if c in data.columns and c not in on]), on, "left")


def with_premarket(events: DataFrame, pre: DataFrame, on=("Date", "QuoteCode"), how="left") -> DataFrame:
    """Events with the entity's figures of before the session: ClosePrice is its PreviousClosePrice, clashing names get _pm."""
    if "ClosePrice" in pre.columns:
        pre = pre.drop("ClosePrice") if "PreviousClosePrice" in pre.columns else pre.withColumnRenamed("ClosePrice", "PreviousClosePrice")
    return asof.join_prefixed(events, pre, list(on), how=how)


def with_bars(events: DataFrame, bars: DataFrame, on=("Date", "QuoteCode"), time="TransTime", slot="TimeSlot") -> DataFrame:
    """Events with the ranks and counts of the last bar strictly before them."""
    found = [c for c in bars.columns if c.endswith(("Rank", "Count")) or c == "AmountRank_canDayTrade"]
    right = bars.select(*on, F.col(slot).alias(time), F.col(slot).alias("_bar"), *found)
    return asof.asof_backward(events, right, list(on), time, ["_bar", *found]).withColumnRenamed("_bar", slot)


def market_by_name(market: DataFrame, pre: DataFrame, date="Date") -> DataFrame:
    """A market table joined to pre-market figures whose key has another name; both keys as strings."""
    right = pre.withColumn("QuoteCode", F.col("QuoteCode").cast("string"))
    left = market.withColumn("QuoteCode", F.col("quote_code").cast("string")).drop("quote_code")
    return asof.join_prefixed(left, right, [date, "QuoteCode"], how="inner")


def event_table(data: DataFrame, features: DataFrame, pre: DataFrame, bars: DataFrame, quotes: DataFrame, time="TransTime", tolerance_us: int = 10_000_000, at: str = "13:30") -> DataFrame:
    """All of it: index of candidate events, both sources reduced to them, side data before the event, the futures' move
    from the event to the close, what is left of the day's volatility, and only entities that may be traded next day."""
    keys = event_keys(features)
    own = with_features(at_keys(data, keys), at_keys(features, keys))
    own = with_bars(with_premarket(own, pre), bars, time=time)
    own = asof.future_return(own, quotes, time=time, tolerance_us=tolerance_us, at=at)
    return filters.eligible_next_day(beta.event_residual_vol(own, time=time))
