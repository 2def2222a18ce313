"""Queries of the tick, filter, join and streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.functions import columns as C
from tickweave.operators import asof, events, filters, ticks
from tickweave.plans.base import T_SQL, USER, X_SQL, depth_frame, query, rounded, scratch, tick_frame
from tickweave.streaming import live

VALID = """CASE WHEN "TrialMatch" = 0 AND "FillPrice" <> 0 THEN "FillPrice" END"""
RUN = """(PARTITION BY "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
PATH_SQL = f"""{T_SQL}, path AS (SELECT *, first_value({VALID} IGNORE NULLS) OVER w AS "Open", coalesce(last_value(CASE WHEN "FillPrice" > 0 THEN "FillPrice" END IGNORE NULLS) OVER w, "RefPrice") AS recent,
 min({VALID}) OVER w AS low, max({VALID}) OVER w AS high FROM t WINDOW w AS {RUN})"""


@query(f"""WITH {PATH_SQL} SELECT "ChannelSeq", round("Open", 6) AS "Open", round(recent, 6) AS recent, round(("BidPrice1" - low) / nullif(low, 0), 6) AS to_low, round(("BidPrice1" - high) / nullif(high, 0), 6) AS to_high,
 round(CASE WHEN high - low = 0 THEN 0.5 ELSE ("BidPrice1" - low) / (high - low) END, 6) AS low_high, round(("BidPrice1" - "RefPrice") / "RefPrice", 6) AS to_ref, round(("BidPrice1" - "Open") / nullif("Open", 0), 6) AS to_open FROM path""")
def d_path_ratios(spark, sf_dir):
    own = ticks.path_ratios(ticks.price_path(tick_frame(spark, sf_dir), USER))
    own = own.select("ChannelSeq", "Open", F.col("RecentFillPrice").alias("recent"), F.col("ToLow").alias("to_low"), F.col("ToHigh").alias("to_high"), F.col("Low_High").alias("low_high"), F.col("ToRef").alias("to_ref"), F.col("ToOpen").alias("to_open"))
    return rounded(own, 6, "Open", "recent", "to_low", "to_high", "low_high", "to_ref", "to_open")


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", round(first_value({VALID} IGNORE NULLS) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS "Open" FROM t""")
def d_open_of_the_day(spark, sf_dir):
    return rounded(ticks.price_path(tick_frame(spark, sf_dir), lookahead=True).select("ChannelSeq", "Open"), 6, "Open")


@query(f"""WITH {X_SQL} SELECT "ChannelSeq", round(CASE WHEN "AskLots1" + "BidLots1" = 0 THEN 0.5 ELSE "BidLots1" * 1.0 / ("AskLots1" + "BidLots1") END, 6) AS b1, round("BidLots1" * 1.0 / nullif("BidLots1" + "BidLots2", 0), 6) AS b12,
 round("AskLots1" * 1.0 / nullif("AskLots1" + "AskLots2", 0), 6) AS a12, round(("BidLots4" + "BidLots5") * 1.0 / nullif("BidLots4" + "BidLots5" + "AskLots4" + "AskLots5", 0), 6) AS b45,
 CAST((48300000000 - epoch_us("TransTime") % 86400000000) // 1000000 - CASE WHEN (48300000000 - epoch_us("TransTime") % 86400000000) < 0 AND (48300000000 - epoch_us("TransTime") % 86400000000) % 1000000 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS remain FROM x""")
def d_depth_ratios(spark, sf_dir):
    own = ticks.depth_ratios(depth_frame(spark, sf_dir)).withColumn("remain", C.remain_seconds("TransTime"))
    own = own.select("ChannelSeq", F.col("B1_A1B1").alias("b1"), F.col("B1_B12").alias("b12"), F.col("A1_A12").alias("a12"), F.col("B45_AB45").alias("b45"), "remain")
    return rounded(own, 6, "b1", "b12", "a12", "b45")


@query(f"""WITH {PATH_SQL} SELECT "ChannelSeq", CAST(sum("FillLots" * "InOut") OVER (PARTITION BY "QuoteCode", low ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_low,
 CAST(sum("FillLots" * "InOut") OVER (PARTITION BY "QuoteCode", high ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_high FROM path""")
def d_lots_at_records(spark, sf_dir):
    own = ticks.lots_at_record(ticks.price_path(tick_frame(spark, sf_dir), USER), USER)
    return own.select("ChannelSeq", F.col("FillLots_atLow").alias("at_low"), F.col("FillLots_atHigh").alias("at_high"))


PAIR_SQL = f"""{T_SQL}, s0 AS (SELECT *, "AskPrice1" - "BidPrice1" AS sp FROM t),
 s1 AS (SELECT *, sp - lag(sp) OVER w AS up, coalesce(lag("TrialMatch") OVER w, 0) AS was_trial, lag("AskPrice1") OVER w AS ask0, lag("BidPrice1") OVER w AS bid0 FROM s0 WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")),
 s2 AS (SELECT *, up > 0.01 AND was_trial = 0 AS latch FROM s1),
 s3 AS (SELECT *, last_value(CASE WHEN latch THEN "BidPrice1" END IGNORE NULLS) OVER w AS pb, last_value(CASE WHEN latch THEN "AskPrice1" END IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN latch THEN "TransTime" END IGNORE NULLS) OVER w AS pt FROM s2 WINDOW w AS {RUN}),
 s4 AS (SELECT *, (epoch_us("TransTime") - epoch_us(pt)) / 1000000.0 AS elapsed, CASE WHEN pb IS NOT NULL AND (lag(pb) OVER w IS NULL OR lag(pb) OVER w <> pb OR lag(pa) OVER w <> pa) THEN 1 ELSE 0 END AS chg,
  CASE WHEN pb IS NOT NULL THEN min("ChannelSeq") OVER (PARTITION BY "QuoteCode", pb, pa) END AS first_seq FROM s3 WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")),
 s5 AS (SELECT *, sum(chg) OVER w AS total, CASE WHEN pb IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY "QuoteCode" ORDER BY first_seq NULLS LAST) END AS pair_id, CASE WHEN pb IS NULL THEN 0 ELSE sum(chg) OVER (PARTITION BY "QuoteCode", pb, pa ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS pair_seq FROM s4 WINDOW w AS {RUN}),
 s6 AS (SELECT *, CASE WHEN pb IS NOT NULL AND up < -0.01 THEN CASE WHEN "AskPrice1" < ask0 AND "BidPrice1" > bid0 THEN 0 WHEN "AskPrice1" < ask0 THEN -1 WHEN "BidPrice1" > bid0 THEN 1 ELSE 0 END END AS side FROM s5)"""


@query(f"""WITH {PAIR_SQL} SELECT "ChannelSeq", round(pb, 4) AS pair_bid, round(pa, 4) AS pair_ask, CAST(round(elapsed * 1000000) AS BIGINT) AS elapsed, CAST(pair_id AS BIGINT) AS pair_id, CAST(pair_seq AS BIGINT) AS pair_seq, CAST(total AS BIGINT) AS total,
 CAST(sum(CASE WHEN up > 0 THEN 1 ELSE 0 END) OVER g AS BIGINT) AS widened, CAST(round(1000000 * first_value(CASE WHEN side IS NOT NULL THEN elapsed END IGNORE NULLS) OVER g) AS BIGINT) AS narrow_time, CAST(first_value(side IGNORE NULLS) OVER g AS INTEGER) AS narrow_side
 FROM s6 WINDOW g AS (PARTITION BY "QuoteCode", total ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def d_spread_pairs(spark, sf_dir):
    own = ticks.spread_pairs(ticks.differences(tick_frame(spark, sf_dir), USER), USER)
    own = own.select("ChannelSeq", F.col("SpreadPairBid").alias("pair_bid"), F.col("SpreadPairAsk").alias("pair_ask"), F.col("SpreadPairElapsed").alias("elapsed"), F.col("SpreadPairID").cast("long").alias("pair_id"), F.col("SpreadPairSeq").cast("long").alias("pair_seq"),
                     F.col("SpreadPairTotalCount").cast("long").alias("total"), F.col("SpreadCountAtSameCount").cast("long").alias("widened"), F.col("SpreadNarrowOrderTime").alias("narrow_time"), F.col("SpreadNarrowSide").alias("narrow_side"))
    us = {c: F.round(F.col(c) * 1_000_000).cast("long") for c in ("elapsed", "narrow_time")}
    return rounded(own, 4, "pair_bid", "pair_ask").withColumns(us)


AMOUNT_SQL = f"""{T_SQL}, am AS (SELECT *, sum(CASE WHEN "TrialMatch" = 0 THEN "FillPrice" * "FillLots" ELSE 0 END) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "Amount" FROM t)"""
BARS_SQL = f"""{AMOUNT_SQL}, grid AS (SELECT e.*, CAST(strptime(e."Date", '%Y%m%d') AS TIMESTAMP) + INTERVAL 9 HOUR + g.i * INTERVAL 5 MINUTE AS "TimeSlot" FROM (SELECT DISTINCT "Date", "QuoteCode" FROM t) e CROSS JOIN (SELECT unnest(range(0, 53)) AS i) g),
 bars AS (SELECT grid.*, round(am."Amount", 4) AS amount FROM grid JOIN am ON am."Date" = grid."Date" AND am."QuoteCode" = grid."QuoteCode" AND am."TransTime" <= grid."TimeSlot" QUALIFY row_number() OVER (PARTITION BY grid."Date", grid."QuoteCode", "TimeSlot" ORDER BY am."TransTime" DESC, am."ChannelSeq" DESC) = 1)"""


def _bars(spark, sf_dir):
    own = ticks.tick_bars(ticks.running_amount(tick_frame(spark, sf_dir)))
    return own.withColumn("Amount", F.round("Amount", 4))


@query(f"""WITH {AMOUNT_SQL} SELECT "ChannelSeq", round("Amount", 4) AS amount FROM am""")
def d_running_amount(spark, sf_dir):
    return ticks.running_amount(tick_frame(spark, sf_dir)).select("ChannelSeq", F.round("Amount", 4).alias("amount"))


@query(f"""WITH {BARS_SQL} SELECT * FROM bars""")
def d_tick_bars(spark, sf_dir):
    return _bars(spark, sf_dir).withColumnRenamed("Amount", "amount")


@query(f"""WITH {BARS_SQL} SELECT "Date", "QuoteCode", "TimeSlot", CASE WHEN "QuoteCode" % 3 <> 0 THEN CAST(row_number() OVER (PARTITION BY "Date", "TimeSlot", "QuoteCode" % 3 <> 0 ORDER BY amount DESC, "QuoteCode") AS INTEGER) END AS rank FROM bars""")
def d_amount_rank(spark, sf_dir):
    own = ticks.amount_rank(_bars(spark, sf_dir).withColumn("ok", F.col("QuoteCode") % 3 != 0), "ok")
    return own.select("Date", "QuoteCode", "TimeSlot", F.col("AmountRank_canDayTrade").alias("rank"))


@query(f"""WITH {X_SQL}, o AS (SELECT *, max(CASE WHEN "TrialMatch" = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM x)
 SELECT "Date", "QuoteCode", round(avg("BidLots1"), 6) AS bid, round(avg("AskLots1"), 6) AS ask FROM o WHERE open = 1 GROUP BY 1, 2""")
def d_depth_means(spark, sf_dir):
    own = ticks.depth_means(filters.normalize_ticks(depth_frame(spark, sf_dir)))
    return own.select("Date", "QuoteCode", F.round("avg_bidLots1", 6).alias("bid"), F.round("avg_askLots1", 6).alias("ask"))


@query(f"""WITH {T_SQL}, c AS (SELECT *, last_value(CASE WHEN "FillPrice" > 0 THEN "FillPrice" END IGNORE NULLS) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS "Close" FROM t),
 g AS (SELECT "Date", "QuoteCode", max("Close") AS c, coalesce(sum("FillPrice") FILTER (WHERE "AskPrice1" - "BidPrice1" < 0.05 AND "InOut" > 0), 0) AS sb, count(*) FILTER (WHERE "AskPrice1" - "BidPrice1" < 0.05 AND "InOut" > 0) AS nb, coalesce(sum("FillPrice") FILTER (WHERE "AskPrice1" - "BidPrice1" < 0.05 AND "InOut" <= 0), 0) AS ss, count(*) FILTER (WHERE "AskPrice1" - "BidPrice1" < 0.05 AND "InOut" <= 0) AS ns FROM c GROUP BY 1, 2)
 SELECT "Date", "QuoteCode", round(((ss + (greatest(nb, ns) - ns) * c) / nullif(greatest(nb, ns), 0) - (sb + (greatest(nb, ns) - nb) * c) / nullif(greatest(nb, ns), 0)) / c * 10000, 4) AS spread FROM g""")
def d_maker_spread(spark, sf_dir):
    own = ticks.maker_spread(ticks.future_prices(tick_frame(spark, sf_dir)), F.col("AskPrice1") - F.col("BidPrice1") < 0.05)
    return own.select("Date", "QuoteCode", F.round("hft_strick_makerSpreadBP", 4).alias("spread"))


FUTURE_SQL = """last_value(CASE WHEN "FillPrice" > 0 THEN "FillPrice" END IGNORE NULLS) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS "Close",
 max(CASE WHEN "FillPrice" > 0 THEN "FillPrice" END) OVER f AS "FutureHigh", min(CASE WHEN "FillPrice" > 0 THEN "FillPrice" END) OVER f AS "FutureLow" FROM t WINDOW f AS (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", {FUTURE_SQL}""")
def d_future_prices(spark, sf_dir):
    return ticks.future_prices(tick_frame(spark, sf_dir)).select("ChannelSeq", "Close", "FutureHigh", "FutureLow")


@query(f"""WITH {T_SQL}, v AS (SELECT *, "FillLots" * "InOut" AS v, lag("FillLots" * "InOut") OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq") AS b FROM t), f AS (SELECT *, b IS NULL OR v <> b AS chg, coalesce(b >= 0, true) AS nonneg FROM v)
 SELECT "ChannelSeq", chg, nonneg AS prev_nonneg, chg AND v < 0 AS "FL_neg_chg", chg AND v <= -2 AS "FL_neg2", chg AND v <= -8 AS "FL_neg8", v < 0 AND nonneg AS "FL_onset", chg AND v > 0 AS "FL_pos_chg", chg AND v >= 8 AS "FL_pos8" FROM f""")
def d_onset_flags(spark, sf_dir):
    own = ticks.onset_events(tick_frame(spark, sf_dir).withColumn("v", F.col("FillLots") * F.col("InOut")), "v", USER)
    return own.select("ChannelSeq", "chg", "prev_nonneg", "FL_neg_chg", "FL_neg2", "FL_neg8", "FL_onset", "FL_pos_chg", "FL_pos8")


@query(f"""WITH {X_SQL}, c AS (SELECT *, coalesce(epoch_us("TransTime") // 1000000 - epoch_us(lag("TransTime") OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")) // 1000000 > 3600, true) AS cooled, CASE event_type WHEN 'click' THEN 'bl' ELSE 'os' END AS src FROM x)
 SELECT "ChannelSeq", coalesce("FillLots" * "InOut" * 1.0 / nullif("BidLots1" + "AskLots1", 0) < -2, false) AS deep, src = 'bl' AS baseline, src = 'os' AS "OS_any", src = 'os' AND "InOut" = 1 AS "OS_buy", src = 'os' AND "InOut" = -1 AS "OS_sell",
 src = 'os' AND "InOut" = 1 AND cooled AS "OS_buy_cd60", src = 'os' AND "InOut" = -1 AND cooled AS "OS_sell_cd60" FROM c""")
def d_overshoot_tags(spark, sf_dir):
    own = ticks.cool_down(depth_frame(spark, sf_dir), 3600, USER).withColumns({"src": F.when(F.col("event_type") == "click", "bl").otherwise("os"), "v": F.col("FillLots") * F.col("InOut")})
    own = ticks.overshoot_tags(own.withColumn("deep", ticks.deep("v", "BidLots1", "AskLots1")))
    return own.select("ChannelSeq", "deep", "baseline", "OS_any", "OS_buy", "OS_sell", "OS_buy_cd60", "OS_sell_cd60")


@query(f"""WITH {X_SQL}, m AS (SELECT *, avg("BidLots1") OVER w AS mb, avg("AskLots1") OVER w AS ma, lag("FillLots") OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq") AS last FROM x WINDOW w AS (PARTITION BY "QuoteCode"))
 SELECT "ChannelSeq", round("BidLots1" / nullif(mb, 0), 6) AS "B1_Last", round("BidLots2" / nullif(mb, 0), 6) AS "B2_Last", round("AskLots1" / nullif(ma, 0), 6) AS "A1_Last", round("AskLots2" / nullif(ma, 0), 6) AS "A2_Last", round("FillLots" * 1.0 / nullif(last, 0), 6) AS "Total_Last",
 round((CASE WHEN "BidPrice1" < 10 THEN 0.01 WHEN "BidPrice1" < 50 THEN 0.05 WHEN "BidPrice1" < 100 THEN 0.1 WHEN "BidPrice1" < 500 THEN 0.5 WHEN "BidPrice1" < 1000 THEN 1.0 ELSE 5.0 END) / nullif("BidPrice1", 0) * 10000, 4) AS "TickBP", round(ln(1 + abs("FillPrice")), 6) AS log_elapsed FROM m""")
def d_relative_features(spark, sf_dir):
    by = Window.partitionBy("QuoteCode")
    order = by.orderBy("ChannelSeq")
    own = depth_frame(spark, sf_dir).withColumns({"avg_bidLots1": F.avg("BidLots1").over(by), "avg_askLots1": F.avg("AskLots1").over(by), "TotalFillLots": F.col("FillLots"), "last_fillLots": F.lag("FillLots").over(order), "MD_ElaspeTime_30": F.col("FillPrice")})
    own = ticks.relative_features(own).select("ChannelSeq", "B1_Last", "B2_Last", "A1_Last", "A2_Last", "Total_Last", F.round("TickBP", 4).alias("TickBP"), F.col("MD_ElaspeTime_30_re").alias("log_elapsed"))
    return rounded(own, 6, "B1_Last", "B2_Last", "A1_Last", "A2_Last", "Total_Last", "log_elapsed")


@query("""WITH m AS (SELECT strftime(l_shipdate, '%Y%m') AS "Date", l_suppkey AS k, avg(l_extendedprice) AS ref, min(l_extendedprice) + 20000 AS o, max(l_extendedprice) - 20000 AS c, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, (o - ref) / ref AS mo, (c - ref) / ref AS mr, rank() OVER (PARTITION BY "Date" ORDER BY q DESC) AS rk FROM m),
 d AS (SELECT "Date", max(CASE WHEN k = 7 THEN mo END) AS bo, max(CASE WHEN k = 7 THEN mr END) AS br, avg(CASE WHEN rk < 5 THEN mo END) AS topo, avg(CASE WHEN rk < 5 THEN sign(mo) END) AS topd, avg(CASE WHEN rk < 5 THEN mr END) AS topr FROM r GROUP BY 1)
 SELECT "Date", round(bo, 6) AS bench_open, round(br, 6) AS bench_return, round(topo, 6) AS top_open, round(topd, 6) AS top_drop, round(topr, 6) AS top_return,
 (topo < 0.002) OR coalesce(min(topo) OVER (ORDER BY "Date" ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) < -0.035, false) AS abnormal FROM d""")
def d_benchmark_days(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("Date"), F.col("l_suppkey").alias("QuoteCode"))
    own = li.agg(F.avg("l_extendedprice").alias("opening_ref_price"), (F.min("l_extendedprice") + 20000).alias("open_price"), (F.max("l_extendedprice") - 20000).alias("close_price"), F.sum("l_quantity").alias("q"))
    own = own.join(ticks.day_amount_rank(own, amount=F.sum("q")).drop("amount"), ["Date", "QuoteCode"])
    own = ticks.market_state_lagged(ticks.benchmark_days(own, 7, 5))
    own = own.select("Date", F.col("benchOpen").alias("bench_open"), F.col("benchReturn").alias("bench_return"), F.col("topOpen").alias("top_open"), F.col("topDrop").alias("top_drop"), F.col("topReturn").alias("top_return"), "abnormal")
    return rounded(own, 6, "bench_open", "bench_return", "top_open", "top_drop", "top_return")


# ---- filters


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", "FillLots" AS origin, CASE WHEN "TrialMatch" <> 0 THEN 0 ELSE "FillLots" END AS lots, round(10 + "QuoteCode" % 5, 2) AS ref, "QuoteCode" % 2 = 0 AS otc,
 max(CASE WHEN "TrialMatch" = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS open FROM t""")
def b_normalize_ticks(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    reference = t.select("Date", "QuoteCode").distinct().withColumns({"RefPrice": F.round(10.0 + F.col("QuoteCode") % 5, 2), "OTC": F.col("QuoteCode") % 2 == 0})
    own = filters.normalize_ticks(t, reference=reference)
    return own.select("ChannelSeq", F.col("FillLots_origin").alias("origin"), F.col("FillLots").alias("lots"), F.col("RefPrice").cast("double").alias("ref"), F.col("OTC").alias("otc"), F.col("marketOpen").alias("open"))


@query(f"""WITH {T_SQL}, u AS (SELECT "Date", "QuoteCode", "ChannelSeq", "TransTime" FROM t UNION ALL SELECT "Date", "QuoteCode", "ChannelSeq", "TransTime" + INTERVAL 1 SECOND FROM t WHERE "ChannelSeq" % 10 = 0 UNION ALL SELECT "Date", "QuoteCode", "ChannelSeq" + 1000000000000, "TransTime" - INTERVAL 1 SECOND FROM t WHERE "ChannelSeq" % 7 = 0),
 m AS (SELECT *, row_number() OVER (PARTITION BY "QuoteCode", "ChannelSeq" ORDER BY "TransTime") AS n, max("TransTime") OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq", "TransTime" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM u)
 SELECT "QuoteCode", "ChannelSeq", "TransTime", CASE WHEN n > 1 THEN 'repeat' WHEN "TransTime" < high THEN 'backward' END AS reject FROM m""")
def b_ordered_ticks(spark, sf_dir):
    t = tick_frame(spark, sf_dir).select("Date", "QuoteCode", "ChannelSeq", "TransTime")
    late = t.filter("ChannelSeq % 10 = 0").withColumn("TransTime", F.expr("TransTime + interval 1 second"))
    back = t.filter("ChannelSeq % 7 = 0").withColumns({"ChannelSeq": F.col("ChannelSeq") + 1_000_000_000_000, "TransTime": F.expr("TransTime - interval 1 second")})
    return filters.ordered_ticks(t.unionByName(late).unionByName(back), USER).select("QuoteCode", "ChannelSeq", "TransTime", "reject")


@query(f"""WITH {X_SQL} SELECT "ChannelSeq" FROM x WHERE "BidPrice1" > 0 AND "AskPrice1" - 0.03 > 0 AND "AskPrice1" - 0.03 >= "BidPrice1" AND "BidLots1" - 1 >= 0 AND "AskLots1" >= 0""")
def b_valid_book(spark, sf_dir):
    own = depth_frame(spark, sf_dir).withColumns({"AskPrice1": F.col("AskPrice1") - 0.03, "BidLots1": F.col("BidLots1") - 1})
    return own.filter(filters.valid_book()).select("ChannelSeq")


def _ranked(spark, sf_dir):
    return depth_frame(spark, sf_dir).withColumns({
        "day_amount_rank": F.col("FillLots"), "AmountRank_canDayTrade": F.when(F.col("InOut") != 0, F.col("BidLots1")), "ToRef": F.col("FillPrice") / 100 - 0.1, "off": F.col("FillPrice") - 20, "MD_L1Rate_30": F.col("FillPrice") / 100,
        "SpreadPairElapsed": F.col("AskLots1") / 10, "hft_strick_makerSpreadBP": F.col("FillPrice") - 75, "PreviousClosePrice": F.col("AskLots2") * 200})


RANKED_SQL = f"""{X_SQL}, y AS (SELECT *, "FillLots" AS r1, CASE WHEN "InOut" <> 0 THEN "BidLots1" END AS r2, "FillPrice" / 100 - 0.1 AS toref FROM x)"""


@query(f"""WITH {RANKED_SQL} SELECT "ChannelSeq", r1 <= 3 OR coalesce(r2 <= 3, false) AS ranked, toref > 0 AND toref < 0.3 AS band, abs("FillPrice" - 20) < 15 AS bounded,
 ("OTC" OR "FillPrice" / 100 > 0.25) AND "AskLots1" / 10.0 > 0.1 AND toref > 0 AND (r1 <= 6 OR coalesce(r2 <= 6, false)) AS static, "FillPrice" - 75 < -70 OR "AskLots2" * 200 > 1000 AS suspended FROM y""")
def b_static_filters(spark, sf_dir):
    return _ranked(spark, sf_dir).select("ChannelSeq", filters.rank_either(3).alias("ranked"), filters.price_band(0, 0.3).alias("band"), filters.abs_bound("off", 15).alias("bounded"), filters.static_trade_filter(6).alias("static"), filters.suspended_rows().alias("suspended"))


@query(f"""WITH {RANKED_SQL}, g AS (SELECT "ChannelSeq", "QuoteCode" % 4 <> 0 AS universe, "TrialMatch" = 0 AS no_trial, epoch_us("TransTime") % 86400000000 > 32430000000 AND epoch_us("TransTime") % 86400000000 < 64800000000 AS time, r1 <= 60 OR coalesce(r2 <= 60, false) AS top, "InOut" <> 0 AS event,
 "BidPrice1" > 20.0 AND "BidPrice1" < 20.0 * 1.5 AS price, "AskLots1" / 10.0 > 0.1 AS pair_age, "OTC" OR "FillPrice" / 100 > 0.25 AS filled, "BidLots1" <> 0 AS features, "FillLots" < 90 AS not_stopped FROM y)
 SELECT *, universe AND no_trial AND time AND top AND event AND price AND pair_age AND filled AND features AND not_stopped AS passed FROM g""")
def b_entry_gate(spark, sf_dir):
    own = _ranked(spark, sf_dir).withColumns({"eligible": F.col("QuoteCode") % 4 != 0, "candidateEvent": F.col("InOut") != 0, "f": F.try_divide(F.lit(1), F.col("BidLots1")), "stoppedOutToday": F.col("FillLots") >= 90})
    clauses = filters.entry_gate(["ToRef", "f"], end="18:00", k=60, most=1.5)
    own = filters.gate(own, clauses)
    return own.select("ChannelSeq", *[F.col(f"gate_{k}").alias(k) for k in clauses], F.col("passGate").alias("passed"))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'""")
def b_eligible_next_day(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("nextday_allow_day_trade_mark_pm", F.when(F.col("c_mktsegment") == "BUILDING", "X").otherwise(""))
    return filters.eligible_next_day(own).select("c_custkey", "c_acctbal")


STEP = "CASE WHEN p < 10 THEN round(p / 0.01) WHEN p < 50 THEN 1000 + round((p - 10) / 0.05) WHEN p < 100 THEN 1800 + round((p - 50) / 0.1) WHEN p < 500 THEN 2300 + round((p - 100) / 0.5) WHEN p < 1000 THEN 3100 + round((p - 500)) ELSE 3600 + round((p - 1000) / 5.0) END"


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS p, CAST(floor(l_extendedprice / l_quantity) + l_linenumber AS DOUBLE) AS q FROM lineitem),
 i AS (SELECT *, {STEP} AS i, {STEP.replace("p <", "q <").replace("(p ", "(q ").replace("round(p", "round(q")} AS j FROM b)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(j - i AS BIGINT) AS spread, round(CASE WHEN i - 1 < 1000 THEN (i - 1) * 0.01 WHEN i - 1 < 1800 THEN 10 + (i - 1001) * 0.05 WHEN i - 1 < 2300 THEN 50 + (i - 1801) * 0.1 WHEN i - 1 < 3100 THEN 100 + (i - 2301) * 0.5
 WHEN i - 1 < 3600 THEN 500 + (i - 3101) ELSE 1000 + (i - 3601) * 5 END, 2) AS below FROM i""")
def b_prev_legal_price(spark, sf_dir):
    p = F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", p.cast("double").alias("p"), (p + F.col("l_linenumber")).cast("double").alias("q"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", C.spread_ticks(F.col("q"), F.col("p")).alias("spread"), C.prev_legal_price(F.col("p")).alias("below"))


@query(f"""WITH {X_SQL} SELECT "ChannelSeq", round("FillPrice" / 7, 3) AS "ToRef", round("BidLots1" / 3.0, 3) AS "B1_Last", CASE WHEN "Date" BETWEEN '20240101' AND '20240110' THEN 'tune' WHEN "Date" BETWEEN '20240115' AND '20240131' THEN 'holdout' END AS period,
 -"FillPrice" AS "midEdge_300sBP", CAST("FillLots" > 50 AND "OTC" AS INTEGER) AS "isInvestBuy", CAST("OTC" AS INTEGER) AS "OTC" FROM x""")
def b_feature_projections(spark, sf_dir):
    own = depth_frame(spark, sf_dir).withColumns({"ToRef": F.col("FillPrice") / 7, "B1_Last": F.col("BidLots1") / 3, "midEdge_300sBP": F.col("FillPrice"), "investment_netLots": F.col("FillLots"), "FutureHigh": F.col("FillPrice")})
    names = filters.whitelist(own.columns, ["ToRef", "B1_Last", "SpreadPairElapsed"])  # the last isn't there
    own = filters.adjusted(filters.round_features(own, names, 3), least=50.0)
    return own.select("ChannelSeq", *names, filters.period({"tune": ("20240101", "20240110"), "holdout": ("20240115", "20240131")}).alias("period"), "midEdge_300sBP", "isInvestBuy", "OTC")


# ---- joins


KEYS_SQL = f"""{X_SQL}, ev AS (SELECT * FROM (SELECT *, "BidPrice1" - lag("BidPrice1") OVER w AS bm, ("AskPrice1" - "BidPrice1") - lag("AskPrice1" - "BidPrice1") OVER w AS sm, "FillLots" * "InOut" AS at_low FROM x WINDOW w AS (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq")) WHERE abs(sm) > 0.001 AND abs(bm) > 0.001 AND at_low < 0)"""


@query(f"""WITH {KEYS_SQL}, {AMOUNT_SQL[len(T_SQL) + 2:]}, {BARS_SQL[len(AMOUNT_SQL) + 2:]},
 rk AS (SELECT *, row_number() OVER (PARTITION BY "Date", "TimeSlot" ORDER BY amount DESC, "QuoteCode") AS rank FROM bars),
 j AS (SELECT ev.*, rk.rank, rk."TimeSlot" AS slot FROM ev ASOF LEFT JOIN rk ON ev."Date" = rk."Date" AND ev."QuoteCode" = rk."QuoteCode" AND ev."TransTime" > rk."TimeSlot"),
 e AS (SELECT j.*, q."FillPrice" AS mid, epoch_us(j."TransTime") - epoch_us(q."TransTime") AS age FROM j ASOF LEFT JOIN (SELECT "Date", "TransTime", arg_max("FillPrice", "ChannelSeq") AS "FillPrice" FROM t WHERE event_type = 'signup' GROUP BY 1, 2) q ON j."Date" = q."Date" AND j."TransTime" >= q."TransTime"),
 cl AS (SELECT "Date", CASE WHEN 72000000000 - max(epoch_us("TransTime") % 86400000000) <= 3600000000 THEN arg_max("FillPrice", struct_pack(t := "TransTime", s := "ChannelSeq")) END AS c FROM t WHERE event_type = 'signup' AND epoch_us("TransTime") % 86400000000 <= 72000000000 GROUP BY 1)
 SELECT e."Date", e."QuoteCode", e."ChannelSeq", e.at_low AS "FillLots_atLow", round(20.0 + e."QuoteCode" % 3, 2) AS "PreviousClosePrice", 'pm' AS event_type_pm, CAST(e.rank AS INTEGER) AS rank, e.slot AS "TimeSlot",
 round((cl.c / CASE WHEN e.age <= 3600000000 THEN nullif(e.mid, 0) END - 1) * 10000, 4) AS bp FROM e LEFT JOIN cl ON cl."Date" = e."Date" WHERE e."QuoteCode" % 3 <> 0""")
def c_event_table(spark, sf_dir):
    x = depth_frame(spark, sf_dir)
    features = x.select("Date", "QuoteCode", "ChannelSeq", "BidPrice1", "AskPrice1", (F.col("FillLots") * F.col("InOut")).alias("FillLots_atLow"))
    data = x.select("Date", "QuoteCode", "ChannelSeq", "TransTime", "BidPrice1", "FillPrice", "event_type")
    mark = F.when(F.col("QuoteCode") % 3 != 0, "X").otherwise("N")
    pre = x.select("Date", "QuoteCode").distinct().withColumns({"ClosePrice": F.round(20.0 + F.col("QuoteCode") % 3, 2), "event_type": F.lit("pm"), "nextday_allow_day_trade_mark": mark})
    bars = ticks.amount_rank(_bars(spark, sf_dir))
    quotes = x.filter("event_type = 'signup'").select("Date", "TransTime", F.col("FillPrice").alias("mid"), F.col("ChannelSeq").alias("seq"))
    keys = events.event_keys(features)
    own = events.with_features(events.at_keys(data, keys), events.at_keys(features, keys))
    own = events.with_bars(events.with_premarket(own, pre), bars)
    close = asof.asof_clock(quotes, "Date", "TransTime", "mid", "20:00", 3600, "seq")
    own = asof.asof_market(own, quotes, "Date", "TransTime", ["mid"], 3_600_000_000, bucket_us=1_200_000_000, seq="seq").join(close, "Date", "left")
    own = filters.eligible_next_day(own)
    bp = (F.try_divide(F.col("mid_close"), F.col("mid")) - 1) * 10_000
    return own.select("Date", "QuoteCode", "ChannelSeq", "FillLots_atLow", F.col("PreviousClosePrice").cast("double").alias("PreviousClosePrice"), "event_type_pm", F.col("AmountRank_canDayTrade").alias("rank"), "TimeSlot", F.round(bp, 4).alias("bp"))


@query(f"""WITH {T_SQL}, e AS (SELECT a."Date", a."ChannelSeq", b."FillPrice" AS mid, epoch_us(a."TransTime") - epoch_us(b."TransTime") AS age FROM (SELECT * FROM t WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT "Date", "TransTime", arg_max("FillPrice", "ChannelSeq") AS "FillPrice" FROM t WHERE event_type = 'view' GROUP BY 1, 2) b ON a."Date" = b."Date" AND a."TransTime" >= b."TransTime"),
 cl AS (SELECT "Date", CASE WHEN 79200000000 - max(epoch_us("TransTime") % 86400000000) <= 60000000 THEN arg_max("FillPrice", struct_pack(t := "TransTime", s := "ChannelSeq")) END AS c FROM t WHERE event_type = 'view' AND epoch_us("TransTime") % 86400000000 <= 79200000000 GROUP BY 1)
 SELECT "ChannelSeq", CASE WHEN age <= 600000000 THEN age END AS quote_age_us, round(c / CASE WHEN age <= 600000000 THEN nullif(mid, 0) END - 1, 6) AS move, CASE WHEN age <= 600000000 THEN 'view' END AS source FROM e LEFT JOIN cl USING ("Date")""")
def c_future_return(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    quotes = t.filter("event_type = 'view'").select("Date", "TransTime", F.col("FillPrice").alias("mid"), F.col("ChannelSeq").alias("seq"), F.col("event_type").alias("source"))
    own = asof.future_return(t.filter("event_type = 'purchase'").select("Date", "TransTime", "ChannelSeq"), quotes, tolerance_us=600_000_000, at="22:00", audit=["source"])
    return own.select("ChannelSeq", "quote_age_us", F.round("txf_to_1330_return", 6).alias("move"), "source")


@query("""SELECT s_suppkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3""")
def c_one_to_one(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey < 3")
    by_key = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    return asof.join_one_to_one(s.select("s_suppkey"), by_key, ["s_suppkey"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "QuoteCode", c_acctbal AS bal, total AS c_acctbal_pm FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def c_market_by_name(spark, sf_dir):
    market = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("d").alias("Date"), F.col("c_custkey").alias("quote_code"), "c_acctbal")
    pre = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("QuoteCode")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal")).withColumn("Date", F.lit("d"))
    return events.market_by_name(market, pre).select("QuoteCode", F.col("c_acctbal").alias("bal"), "c_acctbal_pm")


@query("""WITH a AS (SELECT strftime(o_orderdate, '%Y%m') AS m, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT strftime(o_orderdate, '%Y%m') AS m, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
 SELECT coalesce(a.m, b.m) AS month, a.v AS value_a, b.v AS value_b, round(coalesce(a.v, 0) - coalesce(b.v, 0), 2) AS difference FROM a FULL JOIN b ON a.m = b.m""")
def c_compare_tables(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    of = lambda status: o.filter(F.col("o_orderstatus") == status).groupBy("month").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return rounded(asof.compare_tables(of("O"), of("F"), ["month"], "value"), 2, "difference")


@query("""SELECT o_orderkey, p.mean FROM orders LEFT JOIN (SELECT o_orderpriority AS k, o_orderstatus AS s, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2 HAVING o_orderstatus <> 'P') p ON p.k = o_orderpriority AND p.s = o_orderstatus""")
def c_lookup(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    table = o.filter("o_orderstatus != 'P'").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return asof.lookup(o, table, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "mean")


# ---- streams: the files that lie there, drained, against the batch operators' SQL


def _frame(spark, sf_dir):
    return tick_frame(spark, sf_dir).withColumns({"TransTime": F.col("TransTime").cast("timestamp"), "QuoteCode": F.col("QuoteCode").cast("string")})


def _as_files(t, path: str, parts, rows: int):
    """A stream of the frames in parts, a micro-batch each, written as one file for every half million of `rows`, so that they are written and read side by side."""
    spark, files = t.sparkSession, max(1, rows // 500_000)
    for k, own in enumerate(parts, 1):  # one after the other: files are read in the order they were written
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
        for _ in range(k * files - len(spark.read.schema(t.schema).parquet(path).inputFiles())):  # a micro-batch of few rows has as many files
            t.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(path)


def _stream(spark, sf_dir, batches: int = 6):
    """The events as a stream of files: as many micro-batches, each of a stretch of time; sessions and entities span them."""
    path, t = scratch(spark, "ticks"), _frame(spark, sf_dir)
    us = F.unix_micros("TransTime")
    first, last, n = t.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    step = ((last or 0) - (first or 0)) // batches + 1
    parts = [t if first is None else t.filter(F.floor((us - first) / step) == k) for k in range(batches)]
    return _as_files(t, path, parts, n // batches)


DAY = """(PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
DAY_PATH_SQL = PATH_SQL.replace('PARTITION BY "QuoteCode"', 'PARTITION BY "Date", "QuoteCode"')
DAY_STATE_SQL = f"""{DAY_PATH_SQL}, st AS (SELECT *, sum("FillLots" * "InOut") OVER (PARTITION BY "Date", "QuoteCode", low ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_low, sum("FillLots" * "InOut") OVER (PARTITION BY "Date", "QuoteCode", high ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_high,
 "BidPrice1" - lag("BidPrice1") OVER w AS move, ("AskPrice1" - "BidPrice1") - lag("AskPrice1" - "BidPrice1") OVER w AS wider, coalesce(lag("TrialMatch") OVER w, 0) AS was_trial, (epoch_us("TransTime") - epoch_us(coalesce(lag("TransTime", 29) OVER w, first_value("TransTime") OVER w))) / 1000000.0 AS took,
 avg(CASE WHEN "FillLots" > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rate, max(CASE WHEN "TrialMatch" = 0 AND "FillPrice" > "RefPrice" * 1.08 THEN 1 ELSE 0 END) OVER {DAY} = 1 AS stopped FROM path WINDOW w AS (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq")),
 sp AS (SELECT *, last_value(CASE WHEN wider > 0.01 AND was_trial = 0 THEN "BidPrice1" END IGNORE NULLS) OVER {DAY} AS pb, last_value(CASE WHEN wider > 0.01 AND was_trial = 0 THEN "AskPrice1" END IGNORE NULLS) OVER {DAY} AS pa, (epoch_us("TransTime") - epoch_us(last_value(CASE WHEN wider > 0.01 AND was_trial = 0 THEN "TransTime" END IGNORE NULLS) OVER {DAY})) / 1000000.0 AS el FROM st)"""


@query(f"""WITH {DAY_STATE_SQL} SELECT "Date", CAST("QuoteCode" AS VARCHAR) AS "QuoteCode", "ChannelSeq", round("Open", 4) AS "Open", round(recent, 4) AS recent, round(low, 4) AS low, round(high, 4) AS high, CAST(at_low AS BIGINT) AS at_low, CAST(at_high AS BIGINT) AS at_high, round(move, 4) AS move, round(wider, 4) AS wider,
 round(pb, 4) AS pair_bid, round(pa, 4) AS pair_ask, CAST(round(el * 1000000) AS BIGINT) AS elapsed, CAST(round(took * 1000000) AS BIGINT) AS took, round(rate, 6) AS rate, coalesce(abs(wider) > 0.001 AND abs(move) > 0.001 AND at_low < 0, false) AS event, stopped FROM sp""")
def l_tick_state(spark, sf_dir):
    own = live.drain(live.tick_state(_stream(spark, sf_dir)), scratch(spark, "tick-state"), scratch(spark, "tick-state-log")).filter("reject is null")
    names = {"Open": "Open", "RecentFillPrice": "recent", "RecordLow": "low", "RecordHigh": "high", "BidPreMove": "move", "SpreadMove": "wider", "SpreadPairBid": "pair_bid", "SpreadPairAsk": "pair_ask"}
    us = {"SpreadPairElapsed": "elapsed", "MD_ElaspeTime_30": "took"}
    return own.select("Date", "QuoteCode", "ChannelSeq", *[F.round(a, 4).alias(b) for a, b in names.items()], *[F.round(F.col(a) * 1_000_000).cast("long").alias(b) for a, b in us.items()], F.round("MD_L1Rate_30", 6).alias("rate"), F.col("FillLots_atLow").cast("long").alias("at_low"), F.col("FillLots_atHigh").cast("long").alias("at_high"), F.col("candidateEvent").alias("event"), F.col("stoppedOutToday").alias("stopped"))


@query(f"""WITH {T_SQL}, r AS (SELECT "Date", 'repeat' AS reject, "ChannelSeq" AS seq, unnest(range("ChannelSeq" % 3)) FROM t UNION ALL SELECT "Date", 'backward', min("ChannelSeq") - 1, 0 FROM t GROUP BY "Date", "QuoteCode")
 SELECT "Date", reject, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM r GROUP BY 1, 2 UNION ALL SELECT "Date", 'none', count(*), CAST(sum("ChannelSeq") AS BIGINT) FROM t GROUP BY 1""")
def l_tick_rejects(spark, sf_dir):
    """Some ticks come up to three times, and in the micro-batch after its session each entity has one of an earlier sequence: they go to the side table."""
    path, sink, t = scratch(spark, "ticks"), scratch(spark, "tick-sink"), _frame(spark, sf_dir)
    twice = t.withColumn("_n", F.explode(F.sequence(F.lit(1), 1 + F.col("ChannelSeq") % 3))).drop("_n")
    last = t.groupBy("Date", "QuoteCode").agg(F.min("ChannelSeq").alias("_seq"), F.max("TransTime").alias("_time"), F.first("RefPrice").alias("RefPrice"))
    back = last.select("Date", "QuoteCode", "RefPrice", (F.col("_seq") - 1).alias("ChannelSeq"), F.col("_time").alias("TransTime"))
    days = [r[0] for r in t.select("Date").distinct().orderBy("Date").collect()]
    parts = [days[k * len(days) // 5 : (k + 1) * len(days) // 5] for k in range(5)]
    each = [twice.filter(F.col("Date").isin(now)).unionByName(back.filter(F.col("Date").isin(before)), allowMissingColumns=True) for now, before in zip([*parts, []], [[], *parts], strict=True)]
    stream = _as_files(t, path, each, 2 * t.count() // 5)
    live.drain(live.tick_state(stream, late="60 days", keep=90 * 86_400_000), sink, scratch(spark, "rejects-log"), live.tick_sink(sink))
    both = live.sunk(spark, sink, "rejects").unionByName(live.sunk(spark, sink, "ticks"))
    return both.groupBy("Date", F.coalesce("reject", F.lit("none")).alias("reject")).agg(F.count(F.lit(1)).alias("n"), F.sum("ChannelSeq").alias("total"))


@query(f"""WITH {T_SQL} SELECT "Date", count(*) AS n, CAST(sum("ChannelSeq") AS BIGINT) AS total FROM t GROUP BY 1""")
def l_dedup(spark, sf_dir):
    t = _stream(spark, sf_dir)
    own = live.drain(live.dedup(t.withColumn("_n", F.explode(F.sequence(F.lit(1), 1 + F.col("ChannelSeq") % 3))).drop("_n")), scratch(spark, "dedup"), scratch(spark, "dedup-log"))
    return own.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("ChannelSeq").alias("total"))


SLOT_SQL = f"""{T_SQL}, sl AS (SELECT "Date", "QuoteCode", time_bucket(INTERVAL 5 MINUTE, "TransTime") + INTERVAL 5 MINUTE AS slot, sum(CASE WHEN "TrialMatch" = 0 THEN "FillPrice" * "FillLots" ELSE 0 END) AS a FROM t GROUP BY 1, 2, 3),
 ends AS (SELECT DISTINCT "Date", slot FROM sl WHERE slot <= (SELECT max("TransTime") - INTERVAL 10 MINUTE FROM t)),
 day AS (SELECT e."Date", e.slot, sl."QuoteCode", round(sum(sl.a), 4) AS amount FROM ends e JOIN sl ON sl."Date" = e."Date" AND sl.slot <= e.slot GROUP BY 1, 2, 3)"""


@query(f"""WITH {SLOT_SQL} SELECT "Date", CAST("QuoteCode" AS VARCHAR) AS "QuoteCode", slot AS "TimeSlot", amount, CAST(row_number() OVER (PARTITION BY "Date", slot ORDER BY amount DESC, CAST("QuoteCode" AS VARCHAR)) AS INTEGER) AS rank FROM day""")
def l_day_ranks(spark, sf_dir):
    path = scratch(spark, "ranks")
    live.drain(live.turnover_5min(_stream(spark, sf_dir)), path, scratch(spark, "ranks-log"), live.rank_sink(path, runs=True))
    return live.sunk_ranks(spark, path).select("Date", "QuoteCode", F.col("TimeSlot").cast("timestamp_ntz").alias("TimeSlot"), F.col("Amount").alias("amount"), F.col("AmountRank_canDayTrade").alias("rank"))


@query(f"""WITH {T_SQL}, o AS (SELECT "Date", "QuoteCode", arg_min(("FillPrice" - "RefPrice") / "RefPrice", "TransTime") AS m FROM t WHERE epoch_us("TransTime") % 86400000000 >= 32400000000 AND epoch_us("TransTime") % 86400000000 < 39600000000 AND "TrialMatch" = 0 AND "FillPrice" > 0 AND "QuoteCode" % 2 = 0 GROUP BY 1, 2),
 d AS (SELECT DISTINCT "Date" FROM t WHERE epoch_us("TransTime") % 86400000000 >= 32400000000 AND epoch_us("TransTime") % 86400000000 < 39600000000), s AS (SELECT d."Date", avg(m) AS topo, count(m) AS n FROM d LEFT JOIN o ON o."Date" = d."Date" GROUP BY 1)
 SELECT "Date", round(topo, 6) AS "topOpen", n AS entities, CASE WHEN topo IS NULL THEN 'undecided' WHEN topo < 0.0025 THEN 'abnormal' ELSE 'normal' END AS state FROM s WHERE "Date" < (SELECT max("Date") FROM t)""")
def l_opening_state(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    prior = t.select("Date", F.col("QuoteCode").cast("string").alias("QuoteCode")).distinct().withColumns({"day_amount_rank": F.lit(1), "eligible": F.col("QuoteCode").cast("long") % 2 == 0})
    own = live.drain(live.opening_state(_stream(spark, sf_dir), prior, seconds=7_200), scratch(spark, "state"), scratch(spark, "state-log"))
    last = t.agg(F.max("Date")).first()[0]  # the watermark never passes the last session
    return own.filter(F.col("Date") < last).select("Date", F.round("topOpen", 6).alias("topOpen"), "entities", "state")


@query(f"""WITH {DAY_STATE_SQL} SELECT "ChannelSeq", coalesce(rate > 0.5, false) AS gate, coalesce(rate > 0.5, false) AND low * 0.5 > 6 AS enter FROM sp WHERE abs(wider) > 0.001 AND abs(move) > 0.001 AND at_low < 0 AND NOT stopped AND "QuoteCode" % 3 <> 0""")
def l_gate_score(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    ranks = t.filter("QuoteCode % 3 != 0").select("Date", F.col("QuoteCode").cast("string").alias("QuoteCode")).distinct()
    own = live.gate_score(live.tick_state(_stream(spark, sf_dir)), ranks, F.col("MD_L1Rate_30") > 0.5, F.col("RecordLow") * 0.5, 6.0)
    out = live.drain(own.select("ChannelSeq", "passGate", "enter"), scratch(spark, "gate"), scratch(spark, "gate-log"))
    return out.withColumnRenamed("passGate", "gate")
