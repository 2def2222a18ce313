"""Selections, gates and universes over tick frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import clock, is_finite, micros_of_day

KEYS = ["Date", "QuoteCode"]
#: Names of columns that hold what only later ticks know: closes, futures, returns to the close, labels.
FUTURE_NAMES = re.compile(r"(?i)^(close|future.*|nextday.*|.*_to_1330_.*|.*_closebp.*|.*(raw|hedge|idio|edge)_?bp|.*_netm?|(hedge_)?z|label.*)$")


def by_entity(keys=KEYS, order="ChannelSeq"):
    return Window.partitionBy(*keys).orderBy(order)


def normalize_ticks(ticks: DataFrame, keys=KEYS, reference: DataFrame | None = None) -> DataFrame:
    """Trial matches lose their lots (FillLots_origin keeps them); marketOpen once a tick is no trial match.
    reference: one row per keys with RefPrice and OTC, attached to the ticks."""
    if reference is not None:
        ticks = ticks.drop("RefPrice", "OTC").join(reference.select(*keys, "RefPrice", "OTC"), keys, "left")
    running = by_entity(keys).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumns({
        "FillLots_origin": F.col("FillLots"),
        "FillLots": F.when(F.col("TrialMatch") != 0, F.lit(0)).otherwise(F.col("FillLots")),
        "marketOpen": F.max((F.col("TrialMatch") == 0).cast("int")).over(running) == 1,
    })


def ordered_ticks(ticks: DataFrame, keys=KEYS, order="ChannelSeq", time="TransTime") -> DataFrame:
    """ticks with reject: null, "repeat" (a key seen before) or "backward" (time before an earlier sequence's)."""
    first = F.row_number().over(Window.partitionBy(*keys, order).orderBy(time))
    high = F.max(time).over(Window.partitionBy(*keys).orderBy(order, time).rowsBetween(Window.unboundedPreceding, -1))
    marked = ticks.withColumn("_n", first)
    return marked.withColumn("reject", F.when(F.col("_n") > 1, "repeat").when(F.col(time) < high, "backward")).drop("_n")


def valid_book() -> Column:
    bid, ask = F.col("BidPrice1"), F.col("AskPrice1")
    return (bid > 0) & (ask > 0) & (ask >= bid) & (F.col("BidLots1") >= 0) & (F.col("AskLots1") >= 0)


def time_window(start: str, end: str, time="TransTime") -> Column:
    """Strictly between two times of day."""
    return (micros_of_day(time) > clock(start)) & (micros_of_day(time) < clock(end))


def rank_either(k: int, prior="day_amount_rank", intraday="AmountRank_canDayTrade") -> Column:
    return F.coalesce(F.col(prior) <= k, F.lit(False)) | F.coalesce(F.col(intraday) <= k, F.lit(False))


def price_band(low: float, high: float, name="ToRef") -> Column:
    return (F.col(name) > low) & (F.col(name) < high)


def abs_bound(name: str, most: float) -> Column:
    return F.abs(F.col(name)) < most


def eligible_next_day(df: DataFrame, name="nextday_allow_day_trade_mark", mark="X") -> DataFrame:
    """Rows so marked, by the column or its _pm twin; all rows where neither exists."""
    found = next((c for c in (name, f"{name}_pm") if c in df.columns), None)
    return df.filter(F.col(found) == mark) if found else df


def static_trade_filter(k: int = 100) -> Column:
    return (F.col("OTC") | (F.col("MD_L1Rate_30") > 0.25)) & (F.col("SpreadPairElapsed") > 0.1) & (F.col("ToRef") > 0) & rank_either(k)


def gate(df: DataFrame, clauses: dict[str, Column]) -> DataFrame:
    """A flag per clause (null counts as not passed) and passGate for all of them."""
    flags = {f"gate_{k}": F.coalesce(v, F.lit(False)) for k, v in clauses.items()}
    out = df.withColumns(flags)
    passed = F.lit(True)
    for k in flags:
        passed = passed & F.col(k)
    return out.withColumn("passGate", passed)


def entry_gate(features: list[str], start: str = "09:00:30", end: str = "12:00", k: int = 100, most: float = 1.05, elapsed: float = 0.1, rate: float = 0.25) -> dict[str, Column]:
    """The clauses that a tick must pass before it is scored, in order; all bounds are strict. Live exposure is no column, so not among them."""
    bid, ref = F.col("BidPrice1"), F.col("RefPrice")
    valid = F.lit(True)
    for c in features:
        valid = valid & is_finite(F.col(c).cast("double"))
    return {
        "universe": F.col("eligible"), "no_trial": F.col("TrialMatch") == 0, "time": time_window(start, end), "top": rank_either(k), "event": F.col("candidateEvent"),
        "price": (bid > ref) & (bid < ref * most), "pair_age": F.col("SpreadPairElapsed") > elapsed, "filled": F.col("OTC") | (F.col("MD_L1Rate_30") > rate), "features": valid, "not_stopped": ~F.col("stoppedOutToday"),
    }


def adjusted(df: DataFrame, edge="midEdge_300sBP", otc="OTC", lots="investment_netLots", least: float = 1000.0) -> DataFrame:
    """The edge with its sign turned, OTC as a number, and isInvestBuy: large net buying of an OTC entity."""
    return df.withColumns({edge: -F.col(edge), "isInvestBuy": (F.coalesce(F.col(lots) > least, F.lit(False)) & F.col(otc).cast("boolean")).cast("int"), otc: F.col(otc).cast("int")})


def eligible_universe(pre: DataFrame, targets: DataFrame, today: DataFrame, suspended: DataFrame, key="QuoteCode") -> DataFrame:
    """(pre or target) entities that are eligible today, without the suspended; nothing without today's list."""
    wanted = pre.select(key).union(targets.select(key)).distinct()
    return wanted.join(today.select(key), key, "left_semi").join(suspended.select(key), key, "left_anti")


def suspended_rows(spread="hft_strick_makerSpreadBP", close="PreviousClosePrice") -> Column:
    return F.coalesce(F.col(spread) < -70, F.lit(False)) | F.coalesce(F.col(close) > 1000, F.lit(False))


def whitelist(columns: list[str], wanted: list[str]) -> list[str]:
    """wanted columns that exist; ValueError if the name of one says that it knows the future (FUTURE_NAMES; scores of models, *_pred, don't)."""
    if leaks := sorted(c for c in wanted if FUTURE_NAMES.match(c) and not c.endswith("pred")):
        raise ValueError(f"columns that know the future: {leaks}")
    return [c for c in wanted if c in columns]


def round_features(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def period(ranges: dict[str, tuple[str, str]], date="Date") -> Column:
    """Name of the first range (both ends in) that holds the session."""
    out = F.lit(None).cast("string")
    for name, (start, end) in reversed(ranges.items()):
        out = F.when(F.col(date).between(start, end), name).otherwise(out)
    return out
