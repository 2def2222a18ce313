"""Queries of the reports, comparisons and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import stats
from tickweave.plans.base import M_SQL, T_SQL, months, query, rounded, tick_frame

# ---- conditions


@query(f"""WITH {T_SQL} SELECT substr("Date", 1, 7) AS part, event_type AS tag, count(*) AS n, round(avg("FillPrice"), 6) AS mean, round(stddev_pop("FillPrice"), 4) AS std FROM t WHERE event_type IN ('click', 'error') GROUP BY 1, 2""")
def j_pooled(spark, sf_dir):
    sums = stats.daily_sums(tick_frame(spark, sf_dir), {k: F.col("event_type") == k for k in ("click", "error")}, ["FillPrice"])
    own = stats.pooled(sums.withColumn("part", F.substring("Date", 1, 7)), "FillPrice", ["part", "tag"])
    return rounded(rounded(own, 6, "mean"), 4, "std")


RATE_SQL = f"""{T_SQL}, e AS (SELECT "Date", count(*) AS n FROM t WHERE event_type = 'click' GROUP BY 1), p AS (SELECT "Date", count(*) AS pool FROM t GROUP BY 1), r AS (SELECT n, n * 1.0 / pool AS rate FROM e JOIN p ON e."Date" = p."Date")"""


@query(f"""WITH {RATE_SQL} SELECT round(quantile_cont(CAST(rate AS DOUBLE), 0.1), 6) AS rate_p10, round(quantile_cont(CAST(rate AS DOUBLE), 0.9), 6) AS rate_p90 FROM r""")
def j_selection_spread(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    return rounded(stats.selection_rate(t.filter("event_type = 'click'"), t).select("rate_p10", "rate_p90"), 6, "rate_p10", "rate_p90")


DELTA_SQL = f"""{T_SQL}, c AS (SELECT "Date", avg("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), e AS (SELECT "Date", avg("FillPrice") AS v FROM t WHERE event_type = 'error' GROUP BY 1), d AS (SELECT c."Date", c.v - e.v AS x FROM c JOIN e ON c."Date" = e."Date")"""


def _delta(spark, sf_dir):
    sums = stats.daily_sums(tick_frame(spark, sf_dir), {k: F.col("event_type") == k for k in ("click", "error")}, ["FillPrice"])
    return stats.daily_delta(sums, "FillPrice", "click", "error")


@query(f"""WITH {DELTA_SQL}, m AS (SELECT substr("Date", 1, 7) AS m, avg(x) AS x FROM d GROUP BY 1) SELECT CAST(count(*) FILTER (WHERE x > 0) AS BIGINT) AS positive_months, count(*) AS months FROM m""")
def j_delta_months(spark, sf_dir):
    return stats.delta_report(_delta(spark, sf_dir), F.substring("Date", 1, 7)).select("positive_months", "months")


@query(f"""WITH {DELTA_SQL}, m AS (SELECT substr("Date", 1, 7) AS m, avg(x) AS x FROM d GROUP BY 1), g AS (SELECT avg(x) AS mean, avg(x) / stddev_samp(x) * sqrt(count(*)) AS t, (SELECT count(*) FILTER (WHERE x > 0) * 1.0 / count(*) FROM m) AS share FROM d)
 SELECT false AS pass_selection, mean >= 0.08 AS pass_effect, t >= 3 AS pass_t, share >= 0.8 AS pass_months, true AS pass_hedge, true AS pass_evenness, mean * mean > 0 AS pass_regimes, false AS accepted FROM g""")
def j_acceptance(spark, sf_dir):
    own = stats.delta_report(_delta(spark, sf_dir), F.substring("Date", 1, 7)).withColumns({"rate_median": F.lit(0.2), "delta_hedge": F.lit(-2.0), "tv": F.lit(0.1), "mean_normal": F.col("mean"), "mean_abnormal": F.col("mean")})
    return stats.acceptance(own).select(*[f"pass_{k}" for k in ("selection", "effect", "t", "months", "hedge", "evenness", "regimes")], "accepted")


@query(f"""WITH {T_SQL}, a AS (SELECT * FROM t WHERE event_type IN ('click', 'view')), b AS (SELECT * FROM t WHERE event_type IN ('view', 'error')), ka AS (SELECT DISTINCT "Date", "QuoteCode" FROM a), kb AS (SELECT DISTINCT "Date", "QuoteCode" FROM b),
 o AS (SELECT (SELECT count(*) FROM ka) AS na, (SELECT count(*) FROM kb) AS nb, count(*) AS c FROM ka JOIN kb USING ("Date", "QuoteCode")), da AS (SELECT "Date", avg("FillPrice") AS v FROM a GROUP BY 1), db AS (SELECT "Date", avg("FillPrice") AS v FROM b GROUP BY 1), r AS (SELECT corr(da.v, db.v) AS r FROM da JOIN db USING ("Date")),
 ow AS (SELECT "Date", avg("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), po AS (SELECT "Date", avg("FillPrice") AS v FROM t GROUP BY 1), x AS (SELECT avg(ow.v - po.v) AS x FROM ow JOIN po USING ("Date"))
 SELECT na AS n_a, nb AS n_b, c AS common, round(c * 1.0 / na, 6) AS share_a, round(c * 1.0 / nb, 6) AS share_b, round(x, 6) AS disjoint_effect, round(r, 6) AS corr, CASE WHEN x >= 0.05 AND r < 0.7 THEN 'develop' WHEN x >= 0.05 THEN 'refine' WHEN r < 0.7 THEN 'drop' ELSE 'duplicate' END AS decision FROM o, r, x""")
def j_similarity(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    own = stats.similarity(t.filter("event_type in ('click', 'view')"), t.filter("event_type in ('view', 'error')"), t, "FillPrice")
    return rounded(own, 6, "share_a", "share_b", "disjoint_effect", "corr")


@query(f"""WITH {M_SQL}, d AS (SELECT "Date", round(avg(ret), 12) AS y, round(max(ret), 12) AS x, count(*) AS n, substr("Date", 1, 4) AS yr FROM m GROUP BY 1),
 e AS (SELECT yr, count(*) AS days, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(y, x) END AS corr, var_pop(x) AS v FROM d WHERE n > 5 GROUP BY 1)
 SELECT yr, days, CASE WHEN v > 0 THEN round(slope, 5) END AS slope, CASE WHEN v > 0 THEN round(intercept, 6) END AS intercept, round(corr, 5) AS corr, CASE WHEN v > 0 THEN round(1 - slope, 5) END AS k FROM e""")
def j_leak_regression(spark, sf_dir):
    daily = months(spark, sf_dir).groupBy("Date").agg(F.round(F.avg("ret"), 12).alias("y"), F.round(F.max("ret"), 12).alias("x"), F.count(F.lit(1)).alias("n")).withColumn("yr", F.substring("Date", 1, 4))
    own = stats.leak_regression(daily, "y", "x", "yr", least=5)
    return rounded(rounded(own, 6, "intercept"), 5, "slope", "corr", "k")


# ---- rank correlations

IC_SQL = f"""{T_SQL}, r AS (SELECT "Date", row_number() OVER (PARTITION BY "Date" ORDER BY "FillPrice", "ChannelSeq") AS a, row_number() OVER (PARTITION BY "Date" ORDER BY "FillLots", "ChannelSeq") AS b, row_number() OVER (PARTITION BY "Date" ORDER BY "InOut", "ChannelSeq") AS c FROM t),
 ic AS (SELECT "Date", 'FillPrice~FillLots' AS pair, corr(a, b) AS ic FROM r GROUP BY 1 UNION ALL SELECT "Date", 'InOut~FillLots', corr(c, b) FROM r GROUP BY 1),
 pe AS (SELECT CASE WHEN "Date" <= '20240115' THEN 'one' ELSE 'two' END AS period, pair, avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) AS ir, count(ic) AS days FROM ic GROUP BY 1, 2)"""


def _periods(spark, sf_dir):
    ic = stats.session_ic(tick_frame(spark, sf_dir), [("FillPrice", "FillLots"), ("InOut", "FillLots")], 2)
    return stats.ic_by_period(ic, F.when(F.col("Date") <= "20240115", "one").otherwise("two"))


@query(f"""WITH {IC_SQL} SELECT period, pair, round(mean_ic, 6) AS mean_ic, round(ir, 5) AS ir, days FROM pe""")
def j_ic_by_period(spark, sf_dir):
    return rounded(rounded(_periods(spark, sf_dir), 6, "mean_ic"), 5, "ir")


@query(f"""WITH {IC_SQL} SELECT a.pair, round(a.mean_ic, 6) AS a, round(b.mean_ic, 6) AS b, coalesce(sign(a.mean_ic) = sign(b.mean_ic) AND abs(b.mean_ic) >= abs(a.mean_ic) / 3, false) AS survives FROM (SELECT * FROM pe WHERE period = 'one') a LEFT JOIN (SELECT * FROM pe WHERE period = 'two') b ON a.pair = b.pair""")
def j_ic_survival(spark, sf_dir):
    return rounded(stats.survival(_periods(spark, sf_dir), "one", "two"), 6, "a", "b")


@query(f"""WITH {IC_SQL}, f AS (SELECT *, sign(mean_ic) <> sign(lag(mean_ic) OVER (PARTITION BY pair ORDER BY period)) AS flip FROM pe), g AS (SELECT pair, avg(abs(mean_ic)) AS grad, avg(mean_ic) / stddev_samp(mean_ic) AS ir, count(*) FILTER (WHERE flip) AS flips FROM f GROUP BY 1)
 SELECT pair, round(grad, 6) AS grad, round(ir, 4) AS ir, flips, CASE WHEN abs(ir) >= 1 AND flips <= 1 THEN 'alpha' WHEN grad >= 0.02 THEN 'coordinate' ELSE 'plain' END AS kind FROM g""")
def j_nominate(spark, sf_dir):
    return rounded(rounded(stats.nominate(_periods(spark, sf_dir)), 6, "grad"), 4, "ir")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM part), b AS (SELECT p_size, (p_retailprice > q[1])::INT + (p_retailprice > q[2])::INT + (p_retailprice > q[3])::INT + (p_retailprice > q[4])::INT AS bin FROM part, e), m AS (SELECT bin, avg(p_size) AS v FROM b GROUP BY 1)
 SELECT round(max(v) FILTER (WHERE bin = 4), 6) AS top, round(max(v) FILTER (WHERE bin = 0), 6) AS bottom, round(max(v) FILTER (WHERE bin = 4) - max(v) FILTER (WHERE bin = 0), 6) AS spread FROM m""")
def j_top_bottom(spark, sf_dir):
    return rounded(stats.top_bottom(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", "p_size"), 6, "top", "bottom", "spread")


# ---- results by session

CURVE_SQL = f"""{T_SQL}, d AS (SELECT "Date", sum(("FillLots" - 50 - 19.3) * "BidPrice1") / 10000 AS pnl, sum("BidPrice1") AS capital, count(*) AS trades FROM t GROUP BY 1),
 e AS (SELECT *, sum(pnl) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM d), h AS (SELECT *, equity - greatest(max(equity) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dd FROM e),
 i AS (SELECT *, sum((dd = 0)::INT) OVER (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM h), u AS (SELECT *, CAST(sum((dd < 0)::INT) OVER (PARTITION BY island ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS uw FROM i)"""


def _curve(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumn("bp", F.col("FillLots") - 50)
    return stats.equity(stats.daily_pnl(t, "bp", F.col("BidPrice1")))


@query(f"""WITH {CURVE_SQL} SELECT "Date", round(capital, 4) AS capital, round(pnl / capital * 10000, 4) AS weighted_bp, uw AS under_water FROM u""")
def j_under_water(spark, sf_dir):
    return rounded(_curve(spark, sf_dir).select("Date", "capital", "weighted_bp", "under_water"), 4, "capital", "weighted_bp")


@query(f"""WITH {CURVE_SQL} SELECT max(uw) AS longest_under_water, round(min(pnl), 6) AS worst_day, round(avg(capital), 4) AS mean_capital, round(min(dd) / avg(capital), 8) AS mdd_to_capital, round(sum(pnl) / abs(min(dd)), 6) AS return_to_mdd FROM u""")
def j_performance_ratios(spark, sf_dir):
    own = stats.performance(_curve(spark, sf_dir)).select("longest_under_water", "worst_day", "mean_capital", "mdd_to_capital", "return_to_mdd")
    return rounded(rounded(rounded(own, 6, "worst_day", "return_to_mdd"), 4, "mean_capital"), 8, "mdd_to_capital")


@query(f"""WITH {CURVE_SQL} SELECT round(sum(pnl), 6) AS total, round(min(dd), 6) AS mdd, max(uw) AS time_to_high, round(sum(pnl) / sum(capital) * 10000, 5) AS mean_bp, round(abs(min(dd)) / avg(pnl), 4) AS mdd_to_mean FROM u""")
def j_grid_report(spark, sf_dir):
    own = stats.grid_report(_curve(spark, sf_dir))
    return rounded(rounded(rounded(own, 6, "total", "mdd"), 5, "mean_bp"), 4, "mdd_to_mean")


@query(f"""WITH {CURVE_SQL} SELECT "Date", round(dd, 6) AS drawdown FROM u ORDER BY dd, "Date" LIMIT 5""")
def j_deepest_days(spark, sf_dir):
    return rounded(stats.deepest_days(_curve(spark, sf_dir)).select("Date", "drawdown"), 6, "drawdown")


MONTH_SQL = """mo AS (SELECT strftime(o_orderdate, '%Y%m') AS month, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)"""


def _monthly(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MONTH_SQL}, p AS (SELECT * FROM (VALUES ('early', '199201', '199412'), ('middle', '199406', '199612'), ('late', '199701', '199812')) x(period, lo, hi)) SELECT period, count(*) AS months, round(sum(v), 2) AS v, CAST(sum(n) AS BIGINT) AS n FROM mo JOIN p ON month BETWEEN lo AND hi GROUP BY 1""")
def j_period_sums(spark, sf_dir):
    own = stats.period_sums(_monthly(spark, sf_dir), {"early": ("199201", "199412"), "middle": ("199406", "199612"), "late": ("199701", "199812")}, ["v", "n"])
    return rounded(own, 2, "v")


@query(f"""WITH {T_SQL}, a AS (SELECT "Date", sum("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), b AS (SELECT "Date", sum("FillPrice") AS v FROM t WHERE event_type = 'view' GROUP BY 1), c AS (SELECT coalesce(a."Date", b."Date") AS d, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM a FULL JOIN b ON a."Date" = b."Date"),
 w AS (SELECT substr(d, 1, 7) AS m, sum(a - b) AS x FROM c GROUP BY 1) SELECT round(avg(a - b), 5) AS mean, round(avg(a - b) / stddev_samp(a - b) * sqrt(count(*)), 5) AS t, round(corr(a, b), 6) AS corr, (SELECT count(*) FILTER (WHERE x > 0) FROM w) AS months_won, (SELECT count(*) FROM w) AS months FROM c""")
def j_paired(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    of = lambda kind: t.filter(F.col("event_type") == kind).groupBy("Date").agg(F.sum("FillPrice").alias("pnl"))
    return rounded(rounded(stats.paired(of("click"), of("view"), F.substring("Date", 1, 7)), 5, "mean", "t"), 6, "corr")


@query(f"""WITH {T_SQL}, g AS (SELECT event_type AS bin, "Date", count(*) AS n, sum("FillPrice") AS r, sum("FillPrice" - "FillLots" / 10.0) AS i FROM t GROUP BY 1, 2)
 SELECT bin, CAST(sum(n) AS BIGINT) AS n, round(sum(r) / sum(n), 5) AS raw, round(sum(i) / sum(n), 5) AS hedged, round(avg(i / n - 19.3), 5) AS daily_edge, round(avg(i / n - 19.3) / stddev_samp(i / n - 19.3) * sqrt(count(*)), 4) AS t FROM g GROUP BY 1""")
def j_edge_by_bin(spark, sf_dir):
    own = stats.edge_by_bin(tick_frame(spark, sf_dir).withColumns({"bin": F.col("event_type"), "idio": F.col("FillPrice") - F.col("FillLots") / 10}), "bin", "FillPrice", "idio")
    return rounded(rounded(own, 5, "raw", "hedged", "daily_edge"), 4, "t")


# ---- configurations and ranks


@query("""WITH a AS (SELECT l_suppkey AS k, round(sum(l_discount), 2) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_suppkey AS k, round(sum(l_discount), 2) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), j AS (SELECT a.v AS a, b.v AS b FROM a JOIN b ON a.k = b.k),
 r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j) SELECT round(corr(ra, rb), 6) AS rank_corr, count(*) AS configs FROM r""")
def j_rank_stability(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    of = lambda k: li.filter(F.col("l_linenumber") % 2 == k).groupBy("l_suppkey").agg(F.round(F.sum("l_discount"), 2).alias("v"))
    return rounded(stats.rank_stability(of(0), of(1), "l_suppkey", "v"), 6, "rank_corr")


@query("""SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey BETWEEN 5 AND 20 ORDER BY s_acctbal DESC, s_suppkey LIMIT 12""")
def j_select_best(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return stats.select_best(own, "s_acctbal", F.col("s_nationkey").between(5, 20), 12, ["s_suppkey"]).select("s_suppkey", "s_acctbal")


@query("""SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 8) AS pct FROM part""")
def j_percent_rank(spark, sf_dir):
    return rounded(stats.average_rank(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", ["p_brand"], "pct", pct=True).select("p_partkey", "pct"), 8, "pct")


@query("""SELECT p_partkey, round((row_number() OVER (ORDER BY p_size, p_partkey) - 1) * 1.0 / count(*) OVER (), 8) AS ecdf FROM part""")
def j_ecdf(spark, sf_dir):
    return rounded(stats.ecdf(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", "p_partkey").select("p_partkey", "ecdf"), 8, "ecdf")


@query("""SELECT CAST(unnest([0.05, 0.5, 0.95]) AS DOUBLE) AS share, round(unnest(quantile_cont(o_totalprice, [0.05, 0.5, 0.95])), 4) AS mark FROM orders""")
def j_quantile_markers(spark, sf_dir):
    return rounded(stats.quantile_markers(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", [0.05, 0.5, 0.95]), 4, "mark")


DAY2_SQL = f"""{T_SQL}, y AS (SELECT "Date", avg("FillPrice") AS a, avg("FillLots" * 1.0) AS b FROM t GROUP BY 1)"""


def _daily(spark, sf_dir):
    return tick_frame(spark, sf_dir).groupBy("Date").agg(F.avg("FillPrice").alias("a"), F.avg("FillLots").alias("b"))


@query(f"""WITH {DAY2_SQL} SELECT round(corr(a, b), 6) AS corr, round(stddev_samp(a), 6) AS vol_a, round(stddev_samp(b), 6) AS vol_b, round(stddev_samp(a) * sqrt(252), 5) AS annual_vol_a, round(stddev_samp(b) * sqrt(252), 5) AS annual_vol_b FROM y""")
def j_return_stats(spark, sf_dir):
    return rounded(rounded(stats.return_stats(_daily(spark, sf_dir), "a", "b"), 6, "corr", "vol_a", "vol_b"), 5, "annual_vol_a", "annual_vol_b")


@query(f"""WITH {DAY2_SQL}, c AS (SELECT quantile_cont(a, 0.2) AS ca, quantile_cont(b, 0.2) AS cb FROM y) SELECT count(*) FILTER (WHERE a <= ca) AS n_a, count(*) FILTER (WHERE a <= ca AND b <= cb) AS common, round(count(*) FILTER (WHERE a <= ca AND b <= cb) * 1.0 / count(*) FILTER (WHERE a <= ca), 6) AS overlap FROM y, c""")
def j_worst_overlap(spark, sf_dir):
    return rounded(stats.worst_overlap(_daily(spark, sf_dir), "a", "b"), 6, "overlap")


@query(f"""WITH {DAY2_SQL} SELECT "Date", round(sum(a) OVER w, 5) AS cum_a, round(sum(b) OVER w, 5) AS cum_b, round(sum(0.6 * a + 0.4 * b) OVER w, 5) AS cum_combined FROM y WINDOW w AS (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def j_cumulative(spark, sf_dir):
    return rounded(stats.cumulative(_daily(spark, sf_dir), {"a": 0.6, "b": 0.4}), 5, "cum_a", "cum_b", "cum_combined")


@query(f"""WITH {DAY2_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY "Date") AS k FROM y) SELECT x."Date", round(count(*) FILTER (WHERE z.a <= x.a) * 1.0 / count(*), 6) AS pct, round((SELECT min(a) FROM k p WHERE p.k < x.k AND p.k >= x.k - 7), 6) AS prior_min FROM k x JOIN k z ON z.k <= x.k AND z.k > x.k - 7 GROUP BY x."Date", x.k, x.a""")
def j_rolling_rank(spark, sf_dir):
    return rounded(stats.rolling_percent_rank(_daily(spark, sf_dir), "a", 7).select("Date", "pct", "prior_min"), 6, "pct", "prior_min")


@query("""SELECT 'o_totalprice' AS name, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 3) AS p25, round(quantile_cont(o_totalprice, 0.5), 3) AS p50, round(quantile_cont(o_totalprice, 0.75), 3) AS p75, max(o_totalprice) AS greatest FROM orders""")
def j_describe(spark, sf_dir):
    return rounded(stats.describe(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_totalprice"]), 3, "mean", "std", "p25", "p50", "p75")


@query(f"""WITH {T_SQL}, b AS (SELECT event_type AS k, sum("FillPrice") AS v, count(*) AS n FROM t GROUP BY 1), a AS (SELECT event_type AS k, sum("FillPrice") AS v, count(*) AS n FROM t WHERE "FillLots" > 90 GROUP BY 1)
 SELECT b.k AS event_type, round(b.v / (SELECT sum(v) FROM b), 6) AS share_before, b.n AS n_before, round(coalesce(a.v, 0) / (SELECT sum(v) FROM a), 6) AS share_after, coalesce(a.n, 0) AS n_after FROM b LEFT JOIN a ON a.k = b.k""")
def j_composition_change(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    return rounded(stats.composition_change(t, t.filter("FillLots > 90"), "event_type", "FillPrice"), 6, "share_before", "share_after")


# ---- model logs: the mean lots of a kind of event play its coefficient in a session, selected above a line

LOG_SQL = f"""{T_SQL}, lg AS (SELECT "Date", event_type AS feature, avg("FillLots" * 1.0) - 50 AS coef, avg("FillLots" * 1.0) > 48 AS selected FROM t GROUP BY 1, 2)"""


def _log(spark, sf_dir):
    own = tick_frame(spark, sf_dir).groupBy("Date", F.col("event_type").alias("feature")).agg((F.avg("FillLots") - 50).alias("coef"))
    return own.withColumns({"selected": F.col("coef") > -2, "std_coef": F.when(F.col("coef") > -2, F.col("coef") * 2)})


@query(f"""WITH {LOG_SQL} SELECT feature, round(avg(selected::INT), 6) AS frequency, CAST(sum(selected::INT) AS BIGINT) AS times, round(sum(CASE WHEN selected THEN abs(coef * 2) ELSE 0 END) / (SELECT count(DISTINCT "Date") FROM lg), 5) AS importance,
 round(quantile_cont(coef, 0.25), 5) AS p25, round(quantile_cont(coef, 0.5), 5) AS p50, round(quantile_cont(coef, 0.75), 5) AS p75, sign(quantile_cont(coef, 0.5)) AS sign FROM lg GROUP BY 1""")
def j_feature_report(spark, sf_dir):
    log = _log(spark, sf_dir)
    own = stats.selection_frequency(log).join(stats.mean_importance(log), "feature").join(stats.coefficient_stability(log), "feature")
    return rounded(rounded(own.withColumn("sign", F.col("sign").cast("int")), 6, "frequency"), 5, "importance", "p25", "p50", "p75")


@query(f"""WITH {LOG_SQL} SELECT "Date", feature, round(abs(coef) / sum(abs(coef)) OVER (PARTITION BY "Date") * 100, 5) AS share FROM lg""")
def j_relative_importance(spark, sf_dir):
    return rounded(stats.relative_importance(_log(spark, sf_dir)).select("Date", "feature", "share"), 5, "share")


@query(f"""WITH {LOG_SQL}, d AS (SELECT "Date", sum(selected::INT) AS kept, count(*) AS n FROM lg GROUP BY 1) SELECT count(*) AS sessions, max(n) AS features, CAST(sum((kept < n)::INT) AS BIGINT) AS screened FROM d""")
def j_screening_summary(spark, sf_dir):
    return stats.screening_summary(_log(spark, sf_dir))


@query(f"""WITH {LOG_SQL}, n AS (SELECT "Date", feature, CASE WHEN selected THEN coef * 2 END AS v, row_number() OVER (PARTITION BY feature ORDER BY "Date") AS k FROM lg),
 g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS pk, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS nk, first_value(v IGNORE NULLS) OVER b AS nv FROM n
  WINDOW a AS (PARTITION BY feature ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY feature ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 x AS (SELECT *, coalesce(v, pv + (nv - pv) * (k - pk) / nullif(nk - pk, 0), pv) AS x FROM g) SELECT "Date", feature, round(avg(x) OVER (PARTITION BY feature ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS ma FROM x""")
def j_moving_average(spark, sf_dir):
    own = stats.moving_average(_log(spark, sf_dir), "std_coef", 5, ["feature"])
    return rounded(own.select("Date", "feature", F.col("std_coef_ma5").alias("ma")), 5, "ma")


@query("""PIVOT (SELECT o_orderpriority AS priority, o_orderstatus AS s, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2) ON s IN ('F', 'O', 'P') USING first(v) GROUP BY priority""")
def j_grid_pivot(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("s")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return stats.grid_pivot(own, "priority", "s", "v", ["F", "O", "P"])


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def k_set_operations(spark, sf_dir):
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    either = c.filter("c_acctbal > 5000").select("c_custkey").union(o.filter("o_totalprice > 300000").select("o_custkey")).distinct()
    return either.join(o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti")
