"""Queries of the operators over the driver's tables, each with the SQL that gives the same rows (roles: see base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.functions import columns as C
from tickweave.operators import asof, beta, books, buckets, filters, labels, model, stats, ticks
from tickweave.plans.base import M_SQL, QUERIES, SQL, T_SQL, USER, months, query, scratch, tick_frame
from tickweave.sources import tables

@query(f"""WITH {T_SQL} SELECT "ChannelSeq", round(min(CASE WHEN "TrialMatch" = 0 AND "FillPrice" <> 0 THEN "FillPrice" END) OVER w, 6) AS record_low,
 round(max(CASE WHEN "TrialMatch" = 0 AND "FillPrice" <> 0 THEN "FillPrice" END) OVER w, 6) AS record_high FROM t
 WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def d_price_path(spark, sf_dir):
    own = ticks.price_path(tick_frame(spark, sf_dir), USER)
    return own.select("ChannelSeq", F.round("RecordLow", 6).alias("record_low"), F.round("RecordHigh", 6).alias("record_high"))


LOW_SQL = f"""{T_SQL}, p AS (SELECT *, min(CASE WHEN "TrialMatch" = 0 AND "FillPrice" <> 0 THEN "FillPrice" END) OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM t),
q AS (SELECT *, CAST(sum("FillLots" * "InOut") OVER (PARTITION BY "QuoteCode", low ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_low,
 "BidPrice1" - lag("BidPrice1") OVER w AS bid_move, ("AskPrice1" - "BidPrice1") - lag("AskPrice1" - "BidPrice1") OVER w AS spread_move FROM p WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq"))"""


def _candidates(spark, sf_dir):
    own = ticks.lots_at_record(ticks.price_path(tick_frame(spark, sf_dir), USER), USER)
    return ticks.differences(own, USER).filter(ticks.candidate_event())


@query(f"""WITH {LOW_SQL} SELECT "Date", "QuoteCode", "ChannelSeq", at_low FROM q WHERE abs(spread_move) > 0.001 AND abs(bid_move) > 0.001 AND at_low < 0""")
def d_candidate_events(spark, sf_dir):
    return _candidates(spark, sf_dir).select("Date", "QuoteCode", "ChannelSeq", F.col("FillLots_atLow").alias("at_low"))


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", round(avg(CASE WHEN "FillLots" > 50 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rate,
 epoch_us("TransTime") - epoch_us(coalesce(lag("TransTime", 29) OVER w, first_value("TransTime") OVER w)) AS elapsed_us FROM t WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")""")
def d_recent_ticks(spark, sf_dir):
    own = ticks.recent_ticks(tick_frame(spark, sf_dir).withColumn("FillLots", F.col("FillLots") - 50), 30, USER)
    return own.select("ChannelSeq", F.round("MD_L1Rate_30", 6).alias("rate"), F.round(F.col("MD_ElaspeTime_30") * 1e6).cast("long").alias("elapsed_us"))


@query(f"""WITH {T_SQL}, a AS (SELECT "Date", "QuoteCode", sum("FillPrice" * "FillLots") AS amount FROM t GROUP BY 1, 2)
 SELECT "Date", "QuoteCode", round(amount, 4) AS amount, rank() OVER (PARTITION BY "Date" ORDER BY round(amount, 4) DESC) AS day_rank FROM a""")
def d_day_amount_rank(spark, sf_dir):
    own = tick_frame(spark, sf_dir).groupBy("Date", "QuoteCode").agg(F.round(F.sum(F.col("FillPrice") * F.col("FillLots")), 4).alias("amount"))
    return ticks.day_amount_rank(own, amount=F.sum("amount")).withColumnRenamed("day_amount_rank", "day_rank")


@query(f"""WITH {T_SQL}, c AS (SELECT *, "BidPrice1" - lag("BidPrice1") OVER w AS d FROM t WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq"))
 SELECT "ChannelSeq", (lag("FillLots") OVER w IS NULL OR "FillLots" <> lag("FillLots") OVER w) AS chg, coalesce(CAST(epoch_us("TransTime") // 1000000 AS BIGINT) - CAST(epoch_us(lag("TransTime") OVER w) // 1000000 AS BIGINT) > 3600, true) AS cooled
 FROM c WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")""")
def d_onset_and_cool_down(spark, sf_dir):
    own = ticks.cool_down(ticks.onset_events(tick_frame(spark, sf_dir), "FillLots", USER), 3600, USER)
    return own.select("ChannelSeq", "chg", "cooled")


@query(f"""WITH {T_SQL} SELECT a."ChannelSeq", b."FillPrice" AS seen FROM (SELECT * FROM t WHERE event_type = 'click') a
 ASOF LEFT JOIN (SELECT * FROM t WHERE event_type = 'view') b ON a."QuoteCode" = b."QuoteCode" AND a."TransTime" > b."TransTime" """)
def c_asof_strict(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    right = t.filter("event_type = 'view'").select("QuoteCode", "TransTime", "ChannelSeq", F.col("FillPrice").alias("seen"))
    left = t.filter("event_type = 'click'").select("QuoteCode", "TransTime", "ChannelSeq")
    return asof.asof_backward(left, right.withColumnRenamed("ChannelSeq", "seq"), ["QuoteCode"], "TransTime", ["seen"], seq="seq").select("ChannelSeq", "seen")


@query(f"""WITH {T_SQL} SELECT a."ChannelSeq", b."FillPrice" AS seen FROM (SELECT * FROM t WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM t WHERE event_type = 'signup') b ON a."TransTime" > b."TransTime" """)
def c_asof_one_key(spark, sf_dir):
    """All events under one key: its time is cut into stretches of six hours, over which the last right row is carried."""
    t = tick_frame(spark, sf_dir).withColumn("all", F.lit(1))
    right = t.filter("event_type = 'signup'").select("all", "TransTime", F.col("ChannelSeq").alias("seq"), F.col("FillPrice").alias("seen"))
    return asof.asof_backward(t.filter("event_type = 'click'").select("all", "TransTime", "ChannelSeq"), right, ["all"], "TransTime", ["seen"], seq="seq", stretch_us=6 * 3_600_000_000).select("ChannelSeq", "seen")


@query(f"""WITH {T_SQL}, j AS (SELECT a."ChannelSeq", b."FillPrice" AS mid, epoch_us(a."TransTime") - epoch_us(b."TransTime") AS age FROM (SELECT * FROM t WHERE event_type = 'purchase') a
 ASOF LEFT JOIN (SELECT * FROM t WHERE event_type = 'signup') b ON a."Date" = b."Date" AND a."TransTime" >= b."TransTime")
 SELECT "ChannelSeq", CASE WHEN age <= 1800000000 THEN mid END AS mid, CASE WHEN age <= 1800000000 THEN age END AS age_us FROM j""")
def c_asof_market_tolerance(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    right = t.filter("event_type = 'signup'").select("Date", "TransTime", F.col("FillPrice").alias("mid"))
    left = t.filter("event_type = 'purchase'").select("Date", "TransTime", "ChannelSeq")
    return asof.asof_market(left, right, "Date", "TransTime", ["mid"], 1_800_000_000, bucket_us=600_000_000, age="age_us").select("ChannelSeq", "mid", "age_us")


@query(f"""WITH {T_SQL} SELECT "Date", CASE WHEN 48600000000 - arg_max(epoch_us("TransTime") % 86400000000, "ChannelSeq") <= 3600000000 THEN arg_max("FillPrice", "ChannelSeq") END AS mid_close
 FROM t WHERE epoch_us("TransTime") % 86400000000 <= 48600000000 GROUP BY 1""")
def c_asof_clock(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumn("mid", F.col("FillPrice"))
    return asof.asof_clock(t, "Date", "TransTime", "mid", "13:30", 3600, "ChannelSeq")


@query(f"""WITH {T_SQL}, a AS (SELECT "Date", sum("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), b AS (SELECT "Date", sum("FillPrice") AS v FROM t WHERE event_type = 'error' GROUP BY 1)
 SELECT coalesce(a."Date", b."Date") AS "Date", round(coalesce(a.v, 0) + coalesce(b.v, 0), 4) AS v FROM a FULL JOIN b ON a."Date" = b."Date" """)
def c_add_aligned(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    sums = lambda c: t.filter(c).groupBy("Date").agg(F.sum("FillPrice").alias("v"))
    return asof.add_aligned(sums("event_type = 'click'"), sums("event_type = 'error'"), "Date", "v").withColumn("v", F.round("v", 4))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p, CAST(CASE WHEN p < 10 THEN round(p / 0.01) WHEN p < 50 THEN 1000 + round((p - 10) / 0.05) WHEN p < 100 THEN 1800 + round((p - 50) / 0.1) WHEN p < 500 THEN 2300 + round((p - 100) / 0.5)
 WHEN p < 1000 THEN 3100 + round((p - 500) / 1.0) ELSE 3600 + round((p - 1000) / 5.0) END AS BIGINT) AS tick_index, CAST(CASE WHEN p < 10 THEN 0.01 WHEN p < 50 THEN 0.05 WHEN p < 100 THEN 0.1 WHEN p < 500 THEN 0.5 WHEN p < 1000 THEN 1.0 ELSE 5.0 END AS DOUBLE) AS tick_size
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / l_quantity) AS p FROM lineitem)""")
def b_tick_grid(spark, sf_dir):
    p = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p"))
    return own.select("*", C.tick_index(F.col("p")).alias("tick_index"), C.tick_size(F.col("p")).alias("tick_size"))


@query(f"""WITH {T_SQL} SELECT "Date", "QuoteCode", "ChannelSeq", ("FillPrice" > 10) AND "FillLots" > 20 AS "passGate" FROM t
 WHERE epoch_us("TransTime") % 86400000000 > 32400000000 AND epoch_us("TransTime") % 86400000000 < 45000000000""")
def b_clock_and_gate(spark, sf_dir):
    own = tick_frame(spark, sf_dir).filter(filters.time_window("09:00", "12:30"))
    return filters.gate(own, {"price": F.col("FillPrice") > 10, "lots": F.col("FillLots") > 20}).select("Date", "QuoteCode", "ChannelSeq", "passGate")


@query("""SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 100000) u
 WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def b_eligible_universe(spark, sf_dir):
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = lambda df, name: df.select(F.col(name).alias("c_custkey"))
    return filters.eligible_universe(key(c.filter("c_acctbal > 0"), "c_custkey"), key(o.filter("o_totalprice > 100000"), "o_custkey"), key(o.filter("o_orderstatus = 'O'"), "o_custkey"), key(c.filter("c_mktsegment = 'BUILDING'"), "c_custkey"), "c_custkey")


@query(f"""WITH {M_SQL}, s AS (SELECT *, dense_rank() OVER (ORDER BY "Date") AS session FROM m),
 w AS (SELECT *, count(*) OVER x AS n_obs, var_samp(factor) OVER x AS vx, covar_samp(ret, factor) OVER x AS c FROM s WINDOW x AS (PARTITION BY "QuoteCode" ORDER BY session RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
 SELECT "Date", "QuoteCode", n_obs, round(CASE WHEN n_obs >= 20 AND vx > 0 THEN least(greatest(1 + (c / vx - 1) * n_obs / (n_obs + 20), -0.5), 2.0) ELSE 1.0 END, 4) AS beta FROM w""")
def e_rolling_beta(spark, sf_dir):
    return beta.rolling_beta(months(spark, sf_dir)).select("Date", "QuoteCode", "n_obs", F.round("beta", 4).alias("beta"))


@query(f"""WITH {T_SQL}, s AS (SELECT "ChannelSeq", least(greatest((48600000000 - epoch_us("TransTime") % 86400000000) / 1000000.0, 0), 16200) AS r FROM t)
 SELECT "ChannelSeq", round(r, 2) AS remain, round(0.02 * sqrt(r / 16200) * (1.1177218 - 1.4889296 * (r / 16200) + 1.3712078 * (r / 16200) * (r / 16200)), 6) AS vol FROM s""")
def e_event_vol(spark, sf_dir):
    own = beta.event_residual_vol(tick_frame(spark, sf_dir).withColumn("v", F.lit(0.02)), "v")
    return own.select("ChannelSeq", F.round("RemainSeconds_1330", 2).alias("remain"), F.round("event_vol", 6).alias("vol"))


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", round("FillPrice" - avg("FillPrice") OVER (PARTITION BY "Date", "QuoteCode"), 6) AS net, round("FillPrice" - avg("FillPrice") OVER (PARTITION BY "Date"), 6) AS net_m FROM t""")
def f_net_labels(spark, sf_dir):
    own = labels.net(tick_frame(spark, sf_dir), "FillPrice")
    return own.select("ChannelSeq", F.round("FillPrice_net", 6).alias("net"), F.round("FillPrice_netM", 6).alias("net_m"))


@query(f"""WITH {T_SQL}, d AS (SELECT "Date", event_type AS cell, sum("FillPrice") AS s, count(*) AS n FROM t GROUP BY 1, 2),
 g AS (SELECT a."Date", b.cell, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT "Date" FROM t) a CROSS JOIN (SELECT DISTINCT event_type AS cell FROM t) b LEFT JOIN d ON d."Date" = a."Date" AND d.cell = b.cell),
 r AS (SELECT *, sum(s) OVER w AS bs, sum(n) OVER w AS bn, count(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY cell ORDER BY "Date" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 p AS (SELECT *, sum(bs) OVER (PARTITION BY "Date") / nullif(sum(bn) OVER (PARTITION BY "Date"), 0) AS pool FROM r)
 SELECT "Date", cell, round(CASE WHEN k = 5 THEN (bs + pool * 50) / (bn + 50) END, 6) AS f FROM p""")
def f_conditional_baseline(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumnsRenamed({"event_type": "cell", "FillPrice": "z"})
    return labels.conditional_baseline(t, sessions=5, strength=50.0).select("Date", "cell", F.round("f", 6).alias("f"))


@query(f"""WITH {T_SQL}, d AS (SELECT "Date", event_type AS cell, sum("FillPrice") AS s, count(*) AS n FROM t GROUP BY 1, 2),
 g AS (SELECT a."Date", b.cell, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT "Date" FROM t) a CROSS JOIN (SELECT DISTINCT event_type AS cell FROM t) b LEFT JOIN d ON d."Date" = a."Date" AND d.cell = b.cell),
 r AS (SELECT *, sum(s) OVER w AS bs, sum(n) OVER w AS bn, count(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY cell ORDER BY "Date" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 p AS (SELECT *, sum(bs) OVER (PARTITION BY "Date") / nullif(sum(bn) OVER (PARTITION BY "Date"), 0) AS pool FROM r)
, f AS (SELECT "Date", cell, CASE WHEN k = 5 THEN (bs + pool * 50) / (bn + 50) END AS f FROM p) SELECT "ChannelSeq", round("FillPrice" - f, 6) AS residual FROM t LEFT JOIN f ON f."Date" = t."Date" AND f.cell = t.event_type""")
def f_residual_ex(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumnsRenamed({"event_type": "cell", "FillPrice": "z"})
    own = labels.residual_ex(t, labels.conditional_baseline(t, sessions=5, strength=50.0))
    return own.select("ChannelSeq", F.round("residual_ex", 6).alias("residual"))


@query(f"""WITH {T_SQL}, s AS (SELECT "Date", event_type, "FillPrice", dense_rank() OVER (ORDER BY "Date") AS k FROM t),
 a AS (SELECT s.event_type, s."FillPrice", s.k + i.i AS k FROM s CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) i),
 q AS (SELECT k, event_type, quantile_cont("FillPrice", 0.5) AS q0, quantile_cont("FillPrice", 0.9) AS q1 FROM a GROUP BY 1, 2)
 SELECT c."Date", q.event_type, round(q0, 6) AS q0, round(q1, 6) AS q1 FROM q JOIN (SELECT DISTINCT "Date", k FROM s) c ON c.k = q.k""")
def h_prior_quantiles(spark, sf_dir):
    own = buckets.prior_quantiles(tick_frame(spark, sf_dir), "FillPrice", [0.5, 0.9], 3, bucket="event_type")
    return own.select("Date", "event_type", F.round("q0", 6).alias("q0"), F.round("q1", 6).alias("q1"))


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", CASE WHEN "FillPrice" > 0 AND "FillPrice" <= 10 THEN 0 WHEN "FillPrice" > 10 AND "FillPrice" <= 25 THEN 1 WHEN "FillPrice" > 25 AND "FillPrice" <= 60 THEN 2 END AS closed,
 CASE WHEN "FillPrice" <= 10 THEN 0 WHEN "FillPrice" <= 25 THEN 1 ELSE 2 END AS open FROM t""")
def h_cuts(spark, sf_dir):
    x = F.col("FillPrice")
    return tick_frame(spark, sf_dir).select("ChannelSeq", C.cut_closed_right(x, [0, 10, 25, 60]).alias("closed"), C.cut_open_ends(x, [10, 25]).alias("open"))


@query(f"""WITH {T_SQL}, s AS (SELECT "Date", "FillPrice", "FillLots", dense_rank() OVER (ORDER BY "Date") AS k FROM t), i AS (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3),
 q AS (SELECT s.k + i.i AS k, quantile_cont("FillPrice", 0.5) AS a, quantile_cont("FillPrice", 0.9) AS b FROM s CROSS JOIN i GROUP BY 1),
 h AS (SELECT 0.5 AS share, s."FillLots" AS v FROM s JOIN q ON q.k = s.k WHERE s."FillPrice" > q.a UNION ALL SELECT 0.9, s."FillLots" FROM s JOIN q ON q.k = s.k WHERE s."FillPrice" > q.b)
 SELECT CAST(share AS DOUBLE) AS share, count(*) AS trades, round(avg(v), 6) AS mean, CAST(sum(v) AS BIGINT) AS total FROM h GROUP BY 1""")
def h_threshold_sweep(spark, sf_dir):
    return buckets.threshold_sweep(tick_frame(spark, sf_dir), "FillPrice", "FillLots", [0.5, 0.9]).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {T_SQL}, w AS (SELECT *, count(*) OVER x AS acc, sum("BidPrice1" / 10) OVER x AS pos FROM t WINDOW x AS (PARTITION BY "QuoteCode" ORDER BY "TransTime", "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT "ChannelSeq", acc AS "accLots", round(pos, 4) AS pos FROM w WHERE round(pos, 6) < 60 AND "BidPrice1" <= 40""")
def i_position_caps(spark, sf_dir):
    own = books.running_positions(tick_frame(spark, sf_dir), USER)
    return own.filter((F.round("Position", 6) < 60) & (F.col("BidPrice1") <= 40)).select("ChannelSeq", "accLots", F.round("Position", 4).alias("pos"))


PNL_SQL = f"""{T_SQL}, d AS (SELECT "Date", sum(("FillLots" - 50 - 19.3) * "BidPrice1") / 10000 AS pnl, sum("BidPrice1") AS capital, count(*) AS trades FROM t GROUP BY 1),
 e AS (SELECT *, sum(pnl) OVER w AS equity FROM d WINDOW w AS (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, greatest(max(equity) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS high FROM e)"""


def _curve(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumn("bp", F.col("FillLots") - 50)
    return stats.equity(stats.daily_pnl(t, "bp", F.col("BidPrice1")))


@query(f"""WITH {PNL_SQL} SELECT "Date", trades, round(pnl, 6) AS pnl, round(equity, 6) AS equity, round(equity - high, 6) AS drawdown FROM h""")
def j_equity(spark, sf_dir):
    return _curve(spark, sf_dir).select("Date", "trades", *[F.round(c, 6).alias(c) for c in ("pnl", "equity", "drawdown")])


@query(f"""WITH {PNL_SQL} SELECT round(sum(pnl), 6) AS total, round(min(equity - high), 6) AS mdd, round(avg(pnl) / stddev_samp(pnl) * sqrt(240), 6) AS sharpe, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_days, round(avg(trades), 6) AS trades_per_day FROM h""")
def j_performance(spark, sf_dir):
    own = stats.performance(_curve(spark, sf_dir))
    return own.select(*[F.round(c, 6).alias(c) for c in ("total", "mdd", "sharpe", "win_days", "trades_per_day")])


@query(f"""WITH {T_SQL}, r AS (SELECT "Date", row_number() OVER (PARTITION BY "Date" ORDER BY "FillPrice", "ChannelSeq") AS a, row_number() OVER (PARTITION BY "Date" ORDER BY "FillLots", "ChannelSeq") AS b FROM t)
 SELECT "Date", count(*) AS n, round(corr(a, b), 6) AS ic FROM r GROUP BY 1""")
def j_session_ic(spark, sf_dir):
    return stats.session_ic(tick_frame(spark, sf_dir), [("FillPrice", "FillLots")], 2).select("Date", "n", F.round("ic", 6).alias("ic"))


@query(f"""WITH {T_SQL}, a AS (SELECT event_type, count(*) * 1.0 / (SELECT count(*) FROM t WHERE "QuoteCode" % 2 = 0) AS p FROM t WHERE "QuoteCode" % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) * 1.0 / (SELECT count(*) FROM t WHERE "QuoteCode" % 2 = 1) AS p FROM t WHERE "QuoteCode" % 2 = 1 GROUP BY 1)
 SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS tv FROM a FULL JOIN b ON a.event_type = b.event_type""")
def j_share_distance(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    return stats.share_distance(t.filter("QuoteCode % 2 = 0"), t.filter("QuoteCode % 2 = 1"), ["event_type"]).select(F.round("tv", 6).alias("tv"))


@query(f"""WITH {T_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY md5(CAST("ChannelSeq" AS VARCHAR) || '7'), "ChannelSeq") AS k FROM t) SELECT "Date", "ChannelSeq" FROM n WHERE k <= 5""")
def j_exact_sample(spark, sf_dir):
    return stats.exact_sample(tick_frame(spark, sf_dir), 5, "ChannelSeq", "7").select("Date", "ChannelSeq")


@query(f"""WITH {T_SQL} SELECT "Date", event_type AS tag, count(*) AS n, round(sum("FillPrice"), 4) AS s, round(sum("FillPrice" * "FillPrice"), 2) AS ss FROM t WHERE event_type IN ('click', 'error') GROUP BY 1, 2""")
def j_daily_sums(spark, sf_dir):
    own = stats.daily_sums(tick_frame(spark, sf_dir), {k: F.col("event_type") == k for k in ("click", "error")}, ["FillPrice"])
    return own.select("Date", "tag", "n", F.round("s_FillPrice", 4).alias("s"), F.round("ss_FillPrice", 2).alias("ss"))


@query("""WITH d AS (SELECT strftime(l_shipdate, '%Y%m') AS month, l_shipdate AS "Date", count(*) AS n, sum(l_discount) AS bp, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1, 2)
 SELECT month, CAST(sum(n) AS BIGINT) AS trades, round(sum(bp) / sum(n), 6) AS mean_bp, round(avg(e), 6) AS entities_per_day, count(*) AS days FROM d GROUP BY 1""")
def j_monthly_trades(spark, sf_dir):
    own = stats.monthly_trades(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_discount", F.date_format("l_shipdate", "yyyyMM"), "l_shipdate", "l_suppkey")
    return own.withColumns({c: F.round(c, 6) for c in ("mean_bp", "entities_per_day")})


@query("""SELECT p_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS n_share, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER (), 6) AS value_share FROM part GROUP BY 1""")
def j_value_share(spark, sf_dir):
    own = stats.value_share(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", "p_retailprice")
    return own.select("p_type", "n", F.round("n_share", 6).alias("n_share"), F.round("value_share", 6).alias("value_share"))


@query("""SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part""")
def j_average_rank(spark, sf_dir):
    return stats.average_rank(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size").select("p_partkey", "rank")


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM d)
 SELECT CAST(l.l_shipdate AS DATE) AS "Date", count(*) AS n FROM lineitem l JOIN k ON k.d = CAST(l.l_shipdate AS DATE) WHERE k.i % 5 = 0 GROUP BY 1""")
def a_every_kth_session(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("Date"))
    return tables.every_kth_session(li, 5).groupBy("Date").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(o_orderdate, '%Y%m') AS "Date", count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y%m') IN (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS d FROM orders ORDER BY d DESC LIMIT 12) GROUP BY 1""")
def a_last_sessions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("Date", F.date_format("o_orderdate", "yyyyMM"))
    return tables.last_sessions(o, 12).groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def g_rolling_ridge(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"Date": F.date_format("l_shipdate", "yyyyMM"), "y": F.col("l_extendedprice") / 1000})
    return model.rolling_ridge(li, ["l_quantity", "l_discount", "l_tax"], "y", [20, 60], [0.1, 1.0])


@query()
def g_pls_weights(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"Date": F.date_format("l_shipdate", "yyyyMM"), "y": F.col("l_extendedprice") / 1000})
    return model.pls_weights(li, ["l_quantity", "l_discount", "l_tax"], "y", 20)


@query()
def h_tree_leaves(spark, sf_dir):
    own = buckets.tree_leaves(tick_frame(spark, sf_dir), ["FillPrice", "FillLots"], "InOut", depth=2, sessions=5)
    return own.select("Date", "ChannelSeq", "leaf")


@query(f"""WITH {T_SQL}, w AS (SELECT *, sum("BidPrice1" / 10) OVER (PARTITION BY "Date" ORDER BY "TransTime", "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM t) SELECT "ChannelSeq", round(pos, 4) AS pos FROM w WHERE round(pos, 6) <= 100""")
def i_session_cap(spark, sf_dir):
    own = books.cap_session(tick_frame(spark, sf_dir), 100.0)
    return own.select("ChannelSeq", F.round("BookPosition", 4).alias("pos"))


@query(f"""WITH {T_SQL}, d AS (SELECT "Date", "QuoteCode", avg("FillPrice") AS m FROM t GROUP BY 1, 2), a AS (SELECT "Date", avg(m) AS mean FROM d GROUP BY 1)
 SELECT "Date", round(mean, 6) AS mean, round(avg(mean) OVER (ORDER BY "Date" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving FROM a""")
def j_mean_of_means(spark, sf_dir):
    own = stats.mean_of_means(tick_frame(spark, sf_dir), "FillPrice", 5)
    return own.select("Date", F.round("mean", 6).alias("mean"), F.round("moving", 6).alias("moving"))


@query("""SELECT strftime(l_shipdate, '%Y%m') AS month, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(avg(l_discount), 6) AS label_mean FROM lineitem GROUP BY 1""")
def j_level_drift(spark, sf_dir):
    own = stats.level_drift(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", "l_discount", F.date_format("l_shipdate", "yyyyMM"))
    return own.select("month", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), F.round("label_mean", 6).alias("label_mean"))


@query(f"""WITH {T_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "TransTime", "ChannelSeq") AS k FROM t) SELECT "Date", "QuoteCode", "ChannelSeq" FROM n WHERE k = 1""")
def j_first_signals(spark, sf_dir):
    return stats.first_signals(tick_frame(spark, sf_dir)).select("Date", "QuoteCode", "ChannelSeq")


@query(f"""WITH {T_SQL}, a AS (SELECT DISTINCT "Date", "QuoteCode" FROM t WHERE event_type = 'click'), b AS (SELECT DISTINCT "Date", "QuoteCode" FROM t WHERE event_type = 'view')
 SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS common FROM a JOIN b ON a."Date" = b."Date" AND a."QuoteCode" = b."QuoteCode" """)
def j_overlap(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    return stats.overlap(t.filter("event_type = 'click'"), t.filter("event_type = 'view'"), ["Date", "QuoteCode"]).select("n_a", "n_b", "common")


@query(f"""WITH {T_SQL}, e AS (SELECT "Date", count(*) AS n FROM t WHERE event_type = 'click' GROUP BY 1), p AS (SELECT "Date", count(*) AS pool FROM t GROUP BY 1), r AS (SELECT n, n * 1.0 / pool AS rate FROM e JOIN p ON e."Date" = p."Date")
 SELECT round(quantile_cont(CAST(rate AS DOUBLE), 0.5), 6) AS rate_median, round(avg(n), 6) AS per_day, round(stddev_samp(n) / avg(n), 6) AS cv FROM r""")
def j_selection_rate(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    own = stats.selection_rate(t.filter("event_type = 'click'"), t)
    return own.select(*[F.round(c, 6).alias(c) for c in ("rate_median", "per_day", "cv")])


@query(f"""WITH {T_SQL}, c AS (SELECT "Date", avg("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), e AS (SELECT "Date", avg("FillPrice") AS v FROM t WHERE event_type = 'error' GROUP BY 1), d AS (SELECT c.v - e.v AS x FROM c JOIN e ON c."Date" = e."Date")
 SELECT round(avg(x), 6) AS mean, round(avg(x) / stddev_samp(x) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_days FROM d""")
def j_delta_report(spark, sf_dir):
    sums = stats.daily_sums(tick_frame(spark, sf_dir), {k: F.col("event_type") == k for k in ("click", "error")}, ["FillPrice"])
    own = stats.delta_report(stats.daily_delta(sums, "FillPrice", "click", "error"), F.substring("Date", 1, 6))
    return own.select(F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), F.round("positive_days", 6).alias("positive_days"))


@query(f"""WITH {T_SQL}, o AS (SELECT "Date", avg(("FillPrice" - 20) / 20) AS top FROM t WHERE event_type = 'view' GROUP BY 1)
 SELECT "Date", round(top, 6) AS top, CASE WHEN top < 0.0025 THEN 'abnormal' ELSE 'normal' END AS state FROM o""")
def d_market_state(spark, sf_dir):
    opens = tick_frame(spark, sf_dir).filter("event_type = 'view'").withColumn("Open", F.col("FillPrice"))
    return ticks.market_state(opens).select("Date", F.round("topOpen", 6).alias("top"), "state")


@query(f"""WITH {T_SQL}, o AS (SELECT "Date", "QuoteCode", arg_min("FillPrice", "ChannelSeq") AS op FROM t WHERE "TrialMatch" = 0 AND "FillPrice" > 0 GROUP BY 1, 2), am AS (SELECT "Date", "QuoteCode", sum("FillPrice" * "FillLots") AS a FROM t WHERE "TrialMatch" = 0 GROUP BY 1, 2),
 rk AS (SELECT *, rank() OVER (PARTITION BY "Date" ORDER BY round(a, 4) DESC) AS r FROM am), cal AS (SELECT "Date", lead("Date") OVER (ORDER BY "Date") AS nx FROM (SELECT DISTINCT "Date" FROM t)), pr AS (SELECT nx AS "Date", "QuoteCode" FROM rk JOIN cal ON cal."Date" = rk."Date" WHERE r <= 10 AND "QuoteCode" % 3 <> 0 AND nx IS NOT NULL)
 SELECT o."Date", count(*) AS entities, round(avg((op - 20.0) / 20.0), 9) AS top, CASE WHEN round(avg((op - 20.0) / 20.0), 9) < 0.0025 THEN 'abnormal' ELSE 'normal' END AS state FROM o JOIN pr ON pr."Date" = o."Date" AND pr."QuoteCode" = o."QuoteCode" GROUP BY 1""")
def d_market_state_of_the_top(spark, sf_dir):
    """The state from one open an entity, over those of the ten greatest turnovers of the session before that may be traded. Turnovers equal to four digits share a rank."""
    t = tick_frame(spark, sf_dir)
    amounts = t.filter("TrialMatch = 0").groupBy("Date", "QuoteCode").agg(F.round(F.sum(F.col("FillPrice") * F.col("FillLots")), 4).alias("_a"))
    ranked = amounts.withColumn("day_amount_rank", F.rank().over(Window.partitionBy("Date").orderBy(F.desc("_a"))))
    prior = ticks.rekey_to_next_session(ranked, t).withColumn("eligible", F.col("QuoteCode") % 3 != 0)
    opens = ticks.market_opens(t, prior, 10)
    state = ticks.market_state(opens, digits=9).join(opens.groupBy("Date").agg(F.count(F.lit(1)).alias("entities")), "Date")
    return state.select("Date", "entities", F.col("topOpen").alias("top"), "state")



@query(f"""WITH {T_SQL}, a AS (SELECT "Date", "QuoteCode", count(*) AS n FROM t GROUP BY 1, 2), c AS (SELECT "Date", lead("Date") OVER (ORDER BY "Date") AS nxt FROM (SELECT DISTINCT "Date" FROM t) x)
 SELECT c.nxt AS "Date", a."QuoteCode", a.n FROM a JOIN c ON a."Date" = c."Date" WHERE c.nxt IS NOT NULL""")
def d_rekey_to_next_session(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    return ticks.rekey_to_next_session(t.groupBy("Date", "QuoteCode").agg(F.count(F.lit(1)).alias("n")), t)


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", max(CASE WHEN "TrialMatch" = 0 AND "FillPrice" > 20.0 * 1.08 THEN 1 ELSE 0 END) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS stopped FROM t""")
def d_stop_hits(spark, sf_dir):
    return ticks.stop_hits(tick_frame(spark, sf_dir)).select("ChannelSeq", F.col("stoppedOutToday").alias("stopped"))


@query("""SELECT n_regionkey, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def c_join_prefixed(spark, sf_dir):
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    own = asof.join_prefixed(c.withColumn("n_name", F.lit("x")), n, ["c_nationkey"], {"n_nationkey": "c_nationkey"}, how="inner")
    return own.groupBy("n_regionkey").agg(F.count("n_name_pm").alias("n"), F.sum((F.col("c_acctbal") > 0).cast("long")).alias("positive"))


@query("""SELECT bin, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM (SELECT p_retailprice, CAST((CASE WHEN p_retailprice > q[2] THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > q[3] THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > q[4] THEN 1 ELSE 0 END) AS INTEGER) AS bin
 FROM part, (SELECT quantile_cont(p_retailprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM part) e) b GROUP BY 1""")
def h_qcut(spark, sf_dir):
    own = stats.bin_means(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", 4, ["p_retailprice"])
    return own.select("bin", "n", F.round("p_retailprice", 4).alias("price"))


FLAGSHIP_SQL = f"""WITH {LOW_SQL}, c AS (SELECT * FROM q WHERE abs(spread_move) > 0.001 AND abs(bid_move) > 0.001 AND at_low < 0),
 v AS (SELECT * FROM t WHERE event_type = 'view'), j AS (SELECT c.*, v."FillPrice" AS seen FROM c ASOF LEFT JOIN v ON c."QuoteCode" = v."QuoteCode" AND c."TransTime" > v."TransTime"),
 n AS (SELECT *, "FillPrice" - avg("FillPrice") OVER (PARTITION BY "Date") AS label FROM j WHERE seen IS NOT NULL),
 s AS (SELECT *, dense_rank() OVER (ORDER BY "Date") AS k FROM n), i AS (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3),
 th AS (SELECT s.k + i.i AS k, quantile_cont(s.seen, 0.3) AS lim FROM s CROSS JOIN i GROUP BY 1),
 g AS (SELECT s.* FROM s JOIN th ON th.k = s.k WHERE s.seen > th.lim),
 caps AS (SELECT *, sum("BidPrice1" / 10) OVER (PARTITION BY "Date", "QuoteCode" ORDER BY "TransTime", "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM g),
 d AS (SELECT "Date", sum((label - 19.3) * "BidPrice1") / 10000 AS pnl, count(*) AS trades FROM caps WHERE pos < 200 GROUP BY 1),
 e AS (SELECT *, sum(pnl) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM d)
 SELECT "Date", trades, round(pnl, 6) AS pnl, round(equity - greatest(max(equity) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS drawdown FROM e"""


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Events, point-in-time side data, net label, prior-session threshold, caps, daily result."""
    views = tick_frame(spark, sf_dir).filter("event_type = 'view'").select("QuoteCode", "TransTime", F.col("ChannelSeq").alias("seq"), F.col("FillPrice").alias("seen"))
    own = asof.asof_backward(_candidates(spark, sf_dir), views, ["QuoteCode"], "TransTime", ["seen"], seq="seq").filter("seen is not null")
    # The event table is written once; means, limits and trades all read it.
    path = scratch(spark, "events")
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    limits = buckets.prior_quantiles(own, "seen", [0.3], 3)
    own = labels.net(own, "FillPrice").withColumn("label", F.col("FillPrice_netM"))
    trades = books.cap_after(buckets.with_thresholds(own, limits).filter(F.col("seen") > F.col("q0")))
    curve = stats.equity(stats.daily_pnl(trades, "label", F.col("BidPrice1")))
    return curve.select("Date", "trades", F.round("pnl", 6).alias("pnl"), F.round("drawdown", 6).alias("drawdown"))


from tickweave.plans import more_models, more_reports, more_tables, more_ticks  # noqa: E402, F401  each adds its queries
