"""Tick-level features as window expressions: one partitioning (session, entity), ordered by sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import clock, micros, micros_of_day, ratio, signed_log, tick_size
from tickweave.operators.filters import KEYS, by_entity

UPTO = (Window.unboundedPreceding, 0)


def price_path(t: DataFrame, keys=KEYS, order="ChannelSeq", lookahead: bool = False) -> DataFrame:
    """Open (causal; lookahead: over the whole day), RecentFillPrice, RecordLow, RecordHigh."""
    w = by_entity(keys, order).rowsBetween(*UPTO)
    valid = (F.col("TrialMatch") == 0) & (F.col("FillPrice") != 0)
    price = F.when(valid, F.col("FillPrice"))
    span = by_entity(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if lookahead else w
    return t.withColumns({
        "Open": F.first(price, ignorenulls=True).over(span),
        "RecentFillPrice": F.coalesce(F.last(F.when(F.col("FillPrice") > 0, F.col("FillPrice")), ignorenulls=True).over(w), F.col("RefPrice")),
        "RecordLow": F.min(price).over(w),
        "RecordHigh": F.max(price).over(w),
    })


def path_ratios(t: DataFrame) -> DataFrame:
    """ToLow, ToHigh, Low_High (0.5 without a range), ToRef and ToOpen by the bid."""
    low, high, bid = F.col("RecordLow"), F.col("RecordHigh"), F.col("BidPrice1")
    return t.withColumns({
        "ToLow": ratio(bid - low, low), "ToHigh": ratio(bid - high, high), "Low_High": ratio(bid - low, high - low, 0.5),
        "ToRef": F.round(ratio(bid - F.col("RefPrice"), F.col("RefPrice")), 6), "ToOpen": F.round(ratio(bid - F.col("Open"), F.col("Open")), 6),
    })


def depth_ratios(t: DataFrame) -> DataFrame:
    """B1_A1B1 (0.5 without depth), B1_B12, A1_A12, B45_AB45."""
    b, a = (lambda k: F.col(f"BidLots{k}")), (lambda k: F.col(f"AskLots{k}"))
    return t.withColumns({
        "B1_A1B1": ratio(b(1), a(1) + b(1), 0.5), "B1_B12": ratio(b(1), b(1) + b(2)), "A1_A12": ratio(a(1), a(1) + a(2)),
        "B45_AB45": ratio(b(4) + b(5), b(4) + b(5) + a(4) + a(5)),
    })


def lots_at_record(t: DataFrame, keys=KEYS, order="ChannelSeq") -> DataFrame:
    """Signed volume since the current record low (high) was set, that tick included."""
    signed = F.col("FillLots") * F.col("InOut")
    at = lambda c: Window.partitionBy(*keys, c).orderBy(order).rowsBetween(*UPTO)
    return t.withColumns({"FillLots_atLow": F.sum(signed).over(at("RecordLow")), "FillLots_atHigh": F.sum(signed).over(at("RecordHigh"))})


def differences(t: DataFrame, keys=KEYS, order="ChannelSeq") -> DataFrame:
    w = by_entity(keys, order)
    spread = F.col("AskPrice1") - F.col("BidPrice1")
    return t.withColumn("Spread", spread).withColumns({"BidPreMove": F.col("BidPrice1") - F.lag("BidPrice1").over(w), "SpreadMove": F.col("Spread") - F.lag("Spread").over(w)})


def spread_pairs(t: DataFrame, keys=KEYS, order="ChannelSeq", widen: float = 0.01, time="TransTime") -> DataFrame:
    """The pair (bid, ask) latched when the spread widens: SpreadPairBid/Ask, Elapsed (s), ID (by first appearance),
    Seq (times entered), TotalCount (changes), CountAtSameCount, NarrowOrderTime and NarrowSide."""
    w = by_entity(keys, order)
    run = w.rowsBetween(*UPTO)
    t = t.withColumns({"_up": F.col("Spread") - F.lag("Spread").over(w), "_trial": F.lag("TrialMatch").over(w)})
    latch = F.when((F.col("_up") > widen) & (F.coalesce("_trial", F.lit(0)) == 0), F.struct(F.col("BidPrice1").alias("bid"), F.col("AskPrice1").alias("ask"), F.col(time).alias("t")))
    t = t.withColumn("_pair", F.last(latch, ignorenulls=True).over(run))
    key = F.struct("_pair.ask", "_pair.bid")
    t = t.withColumn("_key", F.when(F.col("_pair").isNotNull(), key))
    t = t.withColumn("_first", F.when(F.col("_key").isNotNull(), F.min(F.when(F.col("_key").isNotNull(), F.col(order))).over(Window.partitionBy(*keys, "_key"))))
    change = F.col("_key").isNotNull() & ~F.col("_key").eqNullSafe(F.lag("_key").over(w))
    t = t.withColumn("_change", change.cast("int"))
    t = t.withColumns({
        "SpreadPairBid": F.col("_pair.bid"), "SpreadPairAsk": F.col("_pair.ask"),
        "SpreadPairElapsed": (micros(time) - micros("_pair.t")) / 1e6,
        "SpreadPairID": F.when(F.col("_key").isNull(), 0).otherwise(F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("_first").asc_nulls_last()))),
        "SpreadPairTotalCount": F.sum("_change").over(run),
        "SpreadPairSeq": F.when(F.col("_key").isNull(), 0).otherwise(F.sum("_change").over(Window.partitionBy(*keys, "_key").orderBy(order).rowsBetween(*UPTO))),
    })
    segment = Window.partitionBy(*keys, "SpreadPairTotalCount").orderBy(order).rowsBetween(*UPTO)
    narrow = (F.col("_key").isNotNull()) & (F.col("_up") < -widen)
    ask_down, bid_up = F.col("AskPrice1") < F.lag("AskPrice1").over(w), F.col("BidPrice1") > F.lag("BidPrice1").over(w)
    side = F.when(ask_down & bid_up, 0).when(ask_down, -1).when(bid_up, 1).otherwise(0)
    t = t.withColumns({"_side": side, "_narrow": narrow})
    first = F.first(F.when(F.col("_narrow"), F.struct(F.col("SpreadPairElapsed").alias("e"), F.col("_side").alias("s"))), ignorenulls=True).over(segment)
    t = t.withColumns({"SpreadCountAtSameCount": F.sum(F.when(F.col("_up") > 0, 1).otherwise(0)).over(segment), "_n": first})
    return t.withColumns({"SpreadNarrowOrderTime": F.col("_n.e"), "SpreadNarrowSide": F.col("_n.s")}).drop("_up", "_trial", "_pair", "_key", "_first", "_change", "_side", "_narrow", "_n")


def candidate_event() -> Column:
    return (F.abs("SpreadMove") > 0.001) & (F.abs("BidPreMove") > 0.001) & (F.col("FillLots_atLow") < 0)


def recent_ticks(t: DataFrame, n: int = 30, keys=KEYS, order="ChannelSeq", time="TransTime") -> DataFrame:
    """Seconds over the last n ticks (log of one more), and the share of them with a fill."""
    w = by_entity(keys, order)
    since = F.coalesce(F.lag(time, n - 1).over(w), F.first(time).over(w.rowsBetween(*UPTO)))
    return t.withColumns({f"MD_ElaspeTime_{n}": (micros(time) - micros(since)) / 1e6, f"MD_L1Rate_{n}": F.avg((F.col("FillLots") > 0).cast("double")).over(w.rowsBetween(1 - n, 0))}).withColumn(f"MD_ElaspeTime_{n}_re", F.log1p(f"MD_ElaspeTime_{n}"))


def running_amount(t: DataFrame, keys=KEYS, order="ChannelSeq") -> DataFrame:
    return t.withColumn("Amount", F.sum(F.when(F.col("TrialMatch") == 0, F.col("FillPrice") * F.col("FillLots")).otherwise(0)).over(by_entity(keys, order).rowsBetween(*UPTO)))


def tick_bars(t: DataFrame, minutes: int = 5, start: str = "09:00", end: str = "13:20", keys=KEYS, order="ChannelSeq", time="TransTime", amount="Amount") -> DataFrame:
    """At every slot of the session from start to end, for each entity, the last running amount at or before it
    (TimeSlot is the slot's time). An entity has no row before its first tick; ticks after the last slot don't count."""
    width, first = minutes * 60_000_000, clock(start)
    last = (clock(end) - first) // width
    k = F.greatest(F.ceil((micros_of_day(time) - first) / width), F.lit(0)).cast("long")
    own = t.withColumns({"_slot": k, "_day": F.date_trunc("day", F.col(time))}).filter(F.col("_slot") <= last)
    seen = own.groupBy(*keys, "_slot").agg(F.max_by(amount, F.struct(time, order)).alias(amount), F.max("_day").alias("_day"))
    # A value holds from its slot to the one before the entity's next: no grid is joined.
    upto = F.coalesce(F.lead("_slot").over(Window.partitionBy(*keys).orderBy("_slot")) - 1, F.lit(last).cast("long"))
    held = seen.withColumn("_upto", upto).withColumn("_slot", F.explode(F.sequence("_slot", "_upto")))
    slot = F.timestamp_micros(micros("_day") + first + F.col("_slot") * width).cast("timestamp_ntz")
    return held.select(*keys, slot.alias("TimeSlot"), amount)


def amount_rank(bars: DataFrame, eligible: str | None = None, by=("Date", "TimeSlot"), amount="Amount", name="QuoteCode", out="AmountRank_canDayTrade") -> DataFrame:
    """Ordinal descending rank among eligible rows, null for the others."""
    ok = F.col(eligible) if eligible else F.lit(True)
    rank = F.row_number().over(Window.partitionBy(*by, ok).orderBy(F.desc(amount), name))
    return bars.withColumn(out, F.when(ok, rank))


def day_amount_rank(t: DataFrame, keys=KEYS, amount: Column | None = None) -> DataFrame:
    """Full-day turnover per entity and its descending rank, ties at the least."""
    total = amount if amount is not None else F.sum(F.col("FillPrice") * F.col("FillLots"))
    return t.groupBy(*keys).agg(total.alias("amount")).withColumn("day_amount_rank", F.rank().over(Window.partitionBy(keys[0]).orderBy(F.desc("amount"))))


def session_index(df: DataFrame, date="Date") -> DataFrame:
    """The sessions of a frame, numbered from 0 (one row a session)."""
    return df.select(date).distinct().withColumn("session", F.row_number().over(Window.orderBy(date)) - 1)


def rekey_to_next_session(stats: DataFrame, calendar: DataFrame, date="Date") -> DataFrame:
    """Statistics of a session under the date of the next; those of the last session go."""
    after = calendar.select(date).distinct().withColumn("_next", F.lead(date).over(Window.orderBy(date)))
    return stats.join(after, date).filter("_next is not null").withColumn(date, F.col("_next")).drop("_next")


def depth_means(t: DataFrame, keys=KEYS) -> DataFrame:
    return t.filter("marketOpen").groupBy(*keys).agg(F.avg("BidLots1").alias("avg_bidLots1"), F.avg("AskLots1").alias("avg_askLots1"))


def maker_spread(t: DataFrame, narrow: Column, keys=KEYS, buy: Column | None = None) -> DataFrame:
    """Spread of mean buy and sell prices on narrow quotes, in bp; the side with fewer fills is padded by Close."""
    buy = F.col("InOut") > 0 if buy is None else buy
    part = lambda ok, x: F.sum(F.when(narrow & ok, x))
    own = t.groupBy(*keys).agg(part(buy, F.col("FillPrice")).alias("sb"), part(buy, F.lit(1)).alias("nb"), part(~buy, F.col("FillPrice")).alias("ss"), part(~buy, F.lit(1)).alias("ns"), F.max("Close").alias("Close"))
    own = own.fillna(0, ["sb", "nb", "ss", "ns"]).withColumn("n", F.greatest("nb", "ns"))
    mean = lambda s, n: F.try_divide(F.col(s) + (F.col("n") - F.col(n)) * F.col("Close"), F.col("n"))
    return own.select(*keys, (F.try_divide(mean("ss", "ns") - mean("sb", "nb"), F.col("Close")) * 10_000).alias("hft_strick_makerSpreadBP"))


def future_prices(t: DataFrame, keys=KEYS, order="ChannelSeq", include_current: bool = True) -> DataFrame:
    """Close, FutureHigh, FutureLow over prices above 0: labels only."""
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = by_entity(keys, order).rowsBetween(0 if include_current else 1, Window.unboundedFollowing)
    price = F.when(F.col("FillPrice") > 0, F.col("FillPrice"))
    return t.withColumns({"Close": F.last(price, ignorenulls=True).over(whole), "FutureHigh": F.max(price).over(ahead), "FutureLow": F.min(price).over(ahead)})


def onset_events(t: DataFrame, value="FillLots_atLow", keys=KEYS, order="ChannelSeq") -> DataFrame:
    """Changes of a value and its onsets below zero and beyond -2, -8 and 8."""
    before = F.lag(value).over(by_entity(keys, order))
    v = F.col(value)
    chg = before.isNull() | (v != before)
    nonneg = F.coalesce(before >= 0, F.lit(True))
    return t.withColumn("_b", before).withColumns({
        "chg": chg, "prev_nonneg": nonneg, "FL_neg_chg": chg & (v < 0), "FL_neg2": chg & (v <= -2), "FL_neg8": chg & (v <= -8),
        "FL_onset": (v < 0) & nonneg, "FL_pos_chg": chg & (v > 0), "FL_pos8": chg & (v >= 8)}).drop("_b")


def deep(value="FillLots_atLow", bid="avg_bidLots1", ask="avg_askLots1", least: float = -2.0) -> Column:
    return F.coalesce(ratio(F.col(value), F.col(bid) + F.col(ask)) < least, F.lit(False))


def overshoot_tags(t: DataFrame, source="src", cooled="cooled") -> DataFrame:
    """A flag per group of events: baseline rows, and overshoot events of any direction, of buys and of sells, and those of either side that have cooled down."""
    os, buy, sell = F.col(source) == "os", F.col("InOut") == 1, F.col("InOut") == -1
    tags = {"baseline": F.col(source) == "bl", "OS_any": os, "OS_buy": os & buy, "OS_sell": os & sell, "OS_buy_cd60": os & buy & F.col(cooled), "OS_sell_cd60": os & sell & F.col(cooled)}
    return t.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tags.items()})


def relative_features(t: DataFrame) -> DataFrame:
    """Sizes relative to the entity's usual ones: B1/B2/A1/A2_Last by the mean depth, Total_Last by the day before's lots,
    TickBP (a tick in basis points of the bid), MD_ElaspeTime_30_re; and the depth shares B1_B12, A1_A12, B45_AB45."""
    last = lambda c, by: ratio(F.col(c), F.col(by))
    return depth_ratios(t).withColumns({
        **{f"{s}{k}_Last": last(f"{side}Lots{k}", f"avg_{side.lower()}Lots1") for s, side in (("B", "Bid"), ("A", "Ask")) for k in (1, 2)},
        "Total_Last": last("TotalFillLots", "last_fillLots"), "TickBP": ratio(tick_size(F.col("BidPrice1")), F.col("BidPrice1")) * 10_000,
        "MD_ElaspeTime_30_re": signed_log(F.col("MD_ElaspeTime_30")),
    })


def cool_down(t: DataFrame, seconds: int = 60, keys=KEYS, time="TransTime", order="ChannelSeq") -> DataFrame:
    """cooled: more than so many whole seconds since the entity's event before (its first counts)."""
    gap = F.floor(micros(time) / 1_000_000) - F.floor(micros(F.lag(time).over(by_entity(keys, order))) / 1_000_000)
    return t.withColumn("cooled", F.coalesce(gap > seconds, F.lit(True)))


def stop_hits(t: DataFrame, factor: float = 1.08, keys=KEYS, order="ChannelSeq") -> DataFrame:
    """hit: fill beyond RefPrice * factor; stoppedOutToday: at or after the first hit."""
    hit = (F.col("TrialMatch") == 0) & (F.col("FillPrice") > F.col("RefPrice") * factor)
    return t.withColumn("hit", hit).withColumn("stoppedOutToday", F.max(F.col("hit").cast("int")).over(by_entity(keys, order).rowsBetween(*UPTO)) == 1)


def market_state(opens: DataFrame, limit: float = 0.0025, date="Date", digits: int | None = None) -> DataFrame:
    """topOpen, the mean opening return (of so many digits, if given), and state: abnormal below the limit, undecided without entities."""
    move = F.try_divide(F.col("Open") - F.col("RefPrice"), F.col("RefPrice"))
    mean = F.avg(move) if digits is None else F.round(F.avg(move), digits)
    return opens.groupBy(date).agg(mean.alias("topOpen")).withColumn("state", F.when(F.col("topOpen").isNull(), "undecided").when(F.col("topOpen") < limit, "abnormal").otherwise("normal"))


def market_opens(t: DataFrame, prior: DataFrame, k: int = 100, keys=("Date", "QuoteCode"), order="ChannelSeq") -> DataFrame:
    """One open an entity and session, its first valid fill, of those ranked up to k the session before and eligible in this one.

    prior: keys, day_amount_rank (of the session before, under this session's date) and eligible; an entity without a row there has no part.
    """
    valid = (F.col("TrialMatch") == 0) & (F.col("FillPrice") > 0)
    opens = t.filter(valid).groupBy(*keys).agg(F.min_by("FillPrice", order).alias("Open"), F.min_by("RefPrice", order).alias("RefPrice"))
    return opens.join(prior.filter((F.col("day_amount_rank") <= k) & F.col("eligible")).select(*keys).distinct(), list(keys))


def benchmark_days(market: DataFrame, benchmark: str, k: int = 100, date="Date", entity="QuoteCode", rank="day_amount_rank") -> DataFrame:
    """Per session the benchmark entity's opening move and return, and over entities ranked better than k the mean
    opening move, its mean sign and the mean return (all against opening_ref_price)."""
    ref = F.col("opening_ref_price")
    own = market.withColumns({"_o": F.try_divide(F.col("open_price") - ref, ref), "_r": F.try_divide(F.col("close_price") - ref, ref)})
    bench, top = F.col(entity) == benchmark, F.col(rank) < k
    return own.groupBy(date).agg(F.max(F.when(bench, F.col("_o"))).alias("benchOpen"), F.max(F.when(bench, F.col("_r"))).alias("benchReturn"), F.avg(F.when(top, F.col("_o"))).alias("topOpen"), F.avg(F.when(top, F.signum("_o"))).alias("topDrop"), F.avg(F.when(top, F.col("_r"))).alias("topReturn"))


def market_state_lagged(daily: DataFrame, low: float = 0.002, floor: float = -0.035, days: int = 10, date="Date") -> DataFrame:
    """abnormal: topOpen under low, or its least over the days before under floor."""
    before = F.min("topOpen").over(Window.orderBy(date).rowsBetween(-days, -1))
    return daily.withColumn("abnormal", (F.col("topOpen") < low) | F.coalesce(before < floor, F.lit(False)))
