"""Queries of beta, volatility, labels, models, buckets and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.functions import columns as C
from tickweave.operators import beta, books, buckets, grid, labels, model
from tickweave.plans.base import M_SQL, T_SQL, USER, months, query, rounded, tick_frame

# ---- beta and volatility


@query(f"""WITH {T_SQL} SELECT "Date", round(arg_max("FillPrice", "TransTime") / arg_min("FillPrice", "TransTime") - 1, 6) AS factor FROM t WHERE epoch_us("TransTime") % 86400000000 BETWEEN 32400000000 AND 48600000000 GROUP BY 1""")
def e_daily_factor(spark, sf_dir):
    return rounded(beta.daily_factor_return(tick_frame(spark, sf_dir).withColumn("mid", F.col("FillPrice"))), 6, "factor")


DAYS_SQL = f"""{T_SQL}, days AS (SELECT "Date", "QuoteCode", arg_min("FillPrice", "ChannelSeq") AS o, arg_max("FillPrice", "ChannelSeq") AS c, max("FillPrice") AS h, min("FillPrice") AS l FROM t GROUP BY 1, 2)"""


def _days(spark, sf_dir):
    return tick_frame(spark, sf_dir).groupBy("Date", "QuoteCode").agg(F.min_by("FillPrice", "ChannelSeq").alias("open_price"), F.max_by("FillPrice", "ChannelSeq").alias("close_price"), F.max("FillPrice").alias("high_price"), F.min("FillPrice").alias("low_price"))


@query(f"""WITH {DAYS_SQL} SELECT "Date", "QuoteCode", round(c / nullif(o, 0) - 1, 6) AS ret FROM days WHERE h <> l""")
def e_entity_return(spark, sf_dir):
    return rounded(beta.entity_daily_return(_days(spark, sf_dir)).select("Date", "QuoteCode", "ret"), 6, "ret")


@query(f"""WITH {M_SQL}, s AS (SELECT *, dense_rank() OVER (ORDER BY "Date") AS session FROM m),
 w AS (SELECT *, count(*) OVER x AS n, var_samp(factor) OVER x AS vx, var_samp(ret) OVER x AS vy, covar_samp(ret, factor) OVER x AS c FROM s WINDOW x AS (PARTITION BY "QuoteCode" ORDER BY session RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, CASE WHEN n >= 20 AND vx > 0 THEN least(greatest(1 + (c / vx - 1) * n / (n + 20), -0.5), 2.0) ELSE 1.0 END AS beta FROM w)
 SELECT "Date", "QuoteCode", round(CASE WHEN n >= 20 THEN sqrt(greatest(vy - 2 * beta * c + beta * beta * vx, 0)) END, 6) AS residual_vol FROM b""")
def e_residual_vol(spark, sf_dir):
    return rounded(beta.rolling_beta(months(spark, sf_dir)).select("Date", "QuoteCode", "residual_vol"), 6, "residual_vol")


CURVE_SQL = f"""{T_SQL}, mv AS (SELECT "Date", CAST(epoch_us("TransTime") % 86400000000 // 14400000000 AS BIGINT) AS slot, "FillPrice" - 20 AS v FROM t), md AS (SELECT "Date", slot, quantile_cont(v, 0.5) AS m FROM mv GROUP BY 1, 2),
 sz AS (SELECT mv.slot, quantile_cont(abs(v - m), 0.5) AS size FROM mv JOIN md ON md."Date" = mv."Date" AND md.slot = mv.slot GROUP BY 1), cv AS (SELECT slot, size, size / first_value(size) OVER (ORDER BY slot) AS share FROM sz)"""


@query(f"""WITH {CURVE_SQL} SELECT slot, round(size, 6) AS size, round(share, 6) AS share, round((SELECT sqrt(avg(power(share - (1 - slot / 6.0), 2))) FROM cv), 6) AS rmse FROM cv""")
def e_vol_curve(spark, sf_dir):
    moves = tick_frame(spark, sf_dir).select("Date", F.floor(C.micros_of_day("TransTime") / 14_400_000_000).alias("slot"), (F.col("FillPrice") - 20).alias("to_close"))
    curve = beta.vol_curve(moves)
    rmse = beta.curve_rmse(curve, 1 - F.col("slot") / 6).withColumn("_k", F.lit(1))
    return rounded(curve.withColumn("_k", F.lit(1)).join(rmse, "_k").drop("_k"), 6, "size", "share", "rmse")


@query(f"""WITH {T_SQL} SELECT event_type AS source, round(corr("FillLots", "FillPrice"), 6) AS corr, round(regr_slope("FillPrice", "FillLots"), 6) AS beta, count(*) AS n FROM t WHERE "InOut" <> 0 OR "FillLots" > 50 GROUP BY 1""")
def e_validate_source(spark, sf_dir):
    t = tick_frame(spark, sf_dir).withColumns({"source": F.col("event_type"), "market": F.when((F.col("InOut") != 0) | (F.col("FillLots") > 50), F.col("FillPrice")), "factor": F.col("FillLots").cast("double")})
    return rounded(beta.validate_source(t), 6, "corr", "beta")


@query(f"""WITH {T_SQL}, a AS (SELECT event_type AS source, CASE WHEN "FillLots" > 30 THEN epoch_us("TransTime") - epoch_us(lag("TransTime") OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq")) END AS age FROM t)
 SELECT source, round(count(age) * 1.0 / count(*), 6) AS resolved, round(quantile_cont(CAST(age AS DOUBLE), 0.5), 2) AS p50, round(quantile_cont(CAST(age AS DOUBLE), 0.95), 2) AS p95 FROM a GROUP BY 1""")
def e_quote_age(spark, sf_dir):
    from pyspark.sql import Window

    age = C.micros("TransTime") - C.micros(F.lag("TransTime").over(Window.partitionBy("QuoteCode").orderBy("ChannelSeq")))
    own = tick_frame(spark, sf_dir).select(F.col("event_type").alias("source"), F.when(F.col("FillLots") > 30, age).alias("quote_age_us"))
    return rounded(rounded(beta.quote_age(own, by="source"), 6, "resolved"), 2, "p50", "p95")


# ---- labels

TICK = lambda p: f"CASE WHEN {p} < 10 THEN 0.01 WHEN {p} < 50 THEN 0.05 WHEN {p} < 100 THEN 0.1 WHEN {p} < 500 THEN 0.5 WHEN {p} < 1000 THEN 1.0 ELSE 5.0 END"
LABEL_SQL = f"""{T_SQL}, f AS (SELECT *, "FillPrice" AS c, max("FillPrice") OVER w AS fh, min("FillPrice") OVER w AS fl FROM t WINDOW w AS (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq" ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
 lb AS (SELECT *, ("BidPrice1" - CASE WHEN fh > 20.0 * 1.08 THEN 20.0 * 1.08 + 2 * ({TICK("20.0 * 1.08")}) ELSE c END) / nullif("BidPrice1", 0) * 10000 AS short, (CASE WHEN fh > 20.0 * 1.09 THEN 20.0 * 1.09 ELSE c END - "AskPrice1") / nullif("AskPrice1", 0) * 10000 AS long,
 ("BidPrice1" - CASE WHEN fl < 20.0 * 0.91 THEN 20.0 * 0.91 + ({TICK("20.0 * 0.91")}) ELSE c END) / nullif("BidPrice1", 0) * 10000 AS lower, "FillLots" / 50.0 AS beta, "InOut" * 10.0 AS market, 0.001 + "FillLots" / 10000.0 AS vol FROM f)"""


def _labelled(spark, sf_dir):
    from pyspark.sql import Window

    ahead = Window.partitionBy("QuoteCode").orderBy("ChannelSeq").rowsBetween(0, 5)
    own = tick_frame(spark, sf_dir).withColumns({"Close": F.col("FillPrice"), "FutureHigh": F.max("FillPrice").over(ahead), "FutureLow": F.min("FillPrice").over(ahead), "beta": F.col("FillLots") / 50, "txf_to_1330_bp": F.col("InOut") * 10.0, "event_vol": 0.001 + F.col("FillLots") / 10_000})
    return labels.lower_stop(labels.raw_long(labels.raw_short(own, out="short"), out="long"), out="lower")


@query(f"""WITH {LABEL_SQL} SELECT "ChannelSeq", round(short, 6) AS short, round(long, 6) AS long, round(lower, 6) AS lower FROM lb""")
def f_raw_labels(spark, sf_dir):
    return rounded(_labelled(spark, sf_dir).select("ChannelSeq", "short", "long", "lower"), 6, "short", "long", "lower")


@query(f"""WITH {LABEL_SQL} SELECT "ChannelSeq", round(beta * market, 6) AS hedge, round(short + beta * market, 6) AS idio, round((short + beta * market) / (vol * 10000), 6) AS z, round(beta * market / (vol * 10000), 6) AS hedge_z,
 round((short + beta * market) / (vol * 10000) * (vol * 10000), 6) AS back, round(short + beta * market - 19.3 - 2, 6) AS edge, round(long - beta * market, 6) AS long_idio FROM lb""")
def f_hedged_labels(spark, sf_dir):
    own = labels.hedged(_labelled(spark, sf_dir), "short")
    long = labels.hedged(own, "long", short=False).select("ChannelSeq", F.col("idio_bp").alias("long_idio"))
    own = labels.edge(labels.to_bp(own, "z"), hedge_cost=2.0)
    own = own.select("ChannelSeq", F.col("hedge_bp").alias("hedge"), F.col("idio_bp").alias("idio"), "z", "hedge_z", F.round("z_bp", 6).alias("back"), F.col("edge_bp").alias("edge")).join(long, "ChannelSeq")
    return rounded(own, 6, "hedge", "idio", "z", "hedge_z", "edge", "long_idio")


@query(f"""WITH {LABEL_SQL}, v AS (SELECT *, "FillPrice" - CASE WHEN "FillLots" > 80 THEN 20.0 ELSE 0.0 END AS y FROM lb) SELECT "ChannelSeq", round(y - avg(y) OVER (PARTITION BY "Date", "QuoteCode"), 6) AS net, round(y - avg(y) OVER (PARTITION BY "Date"), 6) AS net_m FROM v""")
def f_net_with_penalty(spark, sf_dir):
    own = labels.net(tick_frame(spark, sf_dir).withColumn("hit", F.col("FillLots") > 80), "FillPrice", penalty=("hit", 20.0))
    return own.select("ChannelSeq", F.round("FillPrice_net", 6).alias("net"), F.round("FillPrice_netM", 6).alias("net_m"))


@query(f"""WITH {LABEL_SQL}, d AS (SELECT "Date", avg(long - beta * market + 1000 - 19.3) AS d FROM lb GROUP BY 1) SELECT count(d) AS days, round(avg(d), 4) AS mean_edge, round(avg(d) / stddev_samp(d) * sqrt(count(d)), 4) AS t, avg(d) > 0 AND avg(d) / stddev_samp(d) * sqrt(count(d)) >= 2 AS alpha FROM d""")
def f_is_alpha(spark, sf_dir):
    own = labels.hedged(_labelled(spark, sf_dir), "long", short=False).withColumn("idio_bp", F.col("idio_bp") + 1000)
    return rounded(labels.is_alpha(own), 4, "mean_edge", "t")


# ---- models: ridge on two features in closed form

LI_SQL = """li AS (SELECT strftime(l_shipdate, '%Y%m') AS "Date", l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y, CASE WHEN CAST(strftime(l_shipdate, '%m') AS INTEGER) <= 6 THEN 1 ELSE 0 END AS ab FROM lineitem)"""


def _closed(by: str = "", where: str = "", alpha: str = "alpha", y: str = "y", n: str = "nd.n") -> str:
    """Prior sessions' sums, standardised with the population's spread, the 2 x 2 system solved by hand."""
    own = f", {by}" if by else ""
    return f"""ses AS (SELECT "Date", row_number() OVER (ORDER BY "Date") AS k FROM (SELECT DISTINCT "Date" FROM li)),
 mo AS (SELECT k{own}, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum({y}) AS sy, sum(a * a) AS saa, sum(b * b) AS sbb, sum({y} * {y}) AS syy, sum(a * b) AS sab, sum(a * {y}) AS say, sum(b * {y}) AS sby FROM li JOIN ses ON ses."Date" = li."Date" {where} GROUP BY k{own}),
 ro AS (SELECT s."Date", nd.n AS w{own}, sum(mo.n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(sy) AS sy, sum(saa) AS saa, sum(sbb) AS sbb, sum(syy) AS syy, sum(sab) AS sab, sum(say) AS say, sum(sby) AS sby FROM ses s CROSS JOIN nd JOIN mo ON mo.k < s.k AND mo.k >= s.k - nd.n GROUP BY s."Date", nd.n{own}),
 co AS (SELECT *, sa / n AS ma, sb / n AS mb, sy / n AS my, sqrt(saa / n - (sa / n) * (sa / n)) AS da, sqrt(sbb / n - (sb / n) * (sb / n)) AS db, sqrt(syy / n - (sy / n) * (sy / n)) AS dy, sab / n - sa / n * sb / n AS cab, say / n - sa / n * sy / n AS cay, sby / n - sb / n * sy / n AS cby FROM ro),
 st AS (SELECT *, n + {alpha} AS d, n * cab / (da * db) AS o, n * cay / da AS ya, n * cby / db AS yb FROM co, al),
 so AS (SELECT *, (d * ya - o * yb) / (d * d - o * o) / da AS ca, (d * yb - o * ya) / (d * d - o * o) / db AS cb FROM st)"""


RIDGE_SQL = f"""WITH {LI_SQL}, nd AS (SELECT unnest([20, 60]) AS n), al AS (SELECT unnest([0.1, 50.0]) AS alpha), {_closed()}"""


def _li(spark, sf_dir, *more):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(*more, F.date_format("l_shipdate", "yyyyMM").alias("Date"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_extendedprice") / 1000).alias("y"), (F.month("l_shipdate") <= 6).cast("int").alias("ab"))


@query(f"""{RIDGE_SQL} SELECT "Date", w AS n_training_days, CAST(alpha AS DOUBLE) AS alpha, f AS feature, round(CASE f WHEN 'a' THEN ca WHEN 'b' THEN cb ELSE my - ma * ca - mb * cb END, 5) AS coef, round(CASE f WHEN 'a' THEN ca * da WHEN 'b' THEN cb * db ELSE 0 END, 5) AS std_coef FROM so CROSS JOIN (SELECT unnest(['a', 'b', '']) AS f)""")
def g_ridge_coefficients(spark, sf_dir):
    own = model.rolling_ridge(_li(spark, sf_dir), ["a", "b"], "y", [20, 60], [0.1, 50.0])
    return rounded(own.drop("selected"), 5, "coef", "std_coef")


@query(f"""WITH {LI_SQL}, nd AS (SELECT 20 AS n), al AS (SELECT 0.1 AS alpha), {_closed("ab")} SELECT "Date", ab, f AS feature, round(CASE f WHEN 'a' THEN ca WHEN 'b' THEN cb ELSE my - ma * ca - mb * cb END, 5) AS coef FROM so CROSS JOIN (SELECT unnest(['a', 'b', '']) AS f)""")
def g_ridge_by_regime(spark, sf_dir):
    own = model.rolling_ridge(_li(spark, sf_dir), ["a", "b"], "y", [20], [0.1], regime="ab")
    return rounded(own.select("Date", "ab", "feature", "coef"), 5, "coef")


@query(f"""WITH {LI_SQL}, nd AS (SELECT 20 AS n), al AS (SELECT 0.1 AS alpha), {_closed()}, k AS (SELECT *, abs(cay) >= 0.05 * da * dy AS ka, abs(cby) >= 0.05 * db * dy AS kb FROM so)
 SELECT "Date", f AS feature, CASE f WHEN 'a' THEN ka WHEN 'b' THEN kb END AS selected, round(CASE f WHEN 'a' THEN CASE WHEN ka AND kb THEN ca WHEN ka THEN ya / d / da ELSE 0 END WHEN 'b' THEN CASE WHEN ka AND kb THEN cb WHEN kb THEN yb / d / db ELSE 0 END END, 5) AS coef FROM k CROSS JOIN (SELECT unnest(['a', 'b']) AS f)""")
def g_ridge_screened(spark, sf_dir):
    own = model.rolling_ridge(_li(spark, sf_dir), ["a", "b"], "y", [20], [0.1], screen=0.05).filter("feature != ''")
    return rounded(own.select("Date", "feature", "selected", "coef"), 5, "coef")


LIVE_SQL = f"""{LI_SQL.replace("li AS (", "li0 AS (")}, li AS (SELECT "Date", a, b, CASE WHEN "Date" < (SELECT max("Date") FROM li0) THEN y END AS y FROM li0)"""


@query(f"""WITH {LIVE_SQL}, nd AS (SELECT 20 AS n), al AS (SELECT 0.1 AS alpha), {_closed(where="WHERE y IS NOT NULL")} SELECT li."Date", count(*) AS n, round(avg(my - ma * ca - mb * cb + ca * a + cb * b), 4) AS score FROM li LEFT JOIN so ON so."Date" = li."Date" GROUP BY 1""")
def g_scores_of_live_session(spark, sf_dir):
    """The last session has no labels yet, and gets its scores from the sessions before."""
    li = _li(spark, sf_dir)
    last = li.agg(F.max("Date")).first()[0]
    li = li.withColumn("y", F.when(F.col("Date") < last, F.col("y")))
    scored = model.predict(li, model.rolling_ridge(li, ["a", "b"], "y", [20], [0.1]), ["a", "b"], "score")
    return rounded(scored.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")), 4, "score")


@query(f"""{RIDGE_SQL}, p AS (SELECT so.w, so.alpha, so."Date", y, my - ma * ca - mb * cb + ca * a + cb * b AS s FROM li JOIN so ON so."Date" = li."Date")
 SELECT w AS n_training_days, CAST(alpha AS DOUBLE) AS alpha, count(DISTINCT "Date") AS sessions, count(*) AS rows, round(corr(s, y), 6) AS corr, round(avg((s - y) * (s - y)), 3) AS mse FROM p GROUP BY 1, 2""")
def g_grid_metrics(spark, sf_dir):
    li = _li(spark, sf_dir)
    own = model.grid_metrics(li, model.rolling_ridge(li, ["a", "b"], "y", [20, 60], [0.1, 50.0]), ["a", "b"], "y")
    return rounded(rounded(own, 6, "corr"), 3, "mse")


PARAM_SQL = f"""WITH {LI_SQL.replace(" AS ab FROM", " AS ab, l_suppkey AS ent, l_orderkey AS o, l_linenumber AS ln FROM")}, nd AS (SELECT unnest([20, 60]) AS n), al AS (SELECT unnest([0.1, 50.0]) AS alpha), {_closed("ab")},
 p AS (SELECT so.w, so.alpha, li."Date", li.ab, y, a AS price, ent, li.o AS o, ln, my - ma * ca - mb * cb + ca * li.a + cb * li.b AS s FROM li JOIN so ON so."Date" = li."Date" AND so.ab = li.ab),
 e AS (SELECT w, alpha, ab, quantile_cont(s, [0.2, 0.8]) AS e FROM p GROUP BY ALL),
 bins AS (SELECT p.w, p.alpha, avg(y) FILTER (p.ab = 0 AND s > e[2]) AS top_mean, avg(y) FILTER (p.ab = 1 AND s > e[2]) - avg(y) FILTER (p.ab = 1 AND s <= e[1]) AS spread FROM p JOIN e ON e.w = p.w AND e.alpha = p.alpha AND e.ab = p.ab GROUP BY ALL),
 sig AS (SELECT *, count(*) OVER v AS n, sum(price / 10) OVER v AS pos FROM p WHERE s > CASE ab WHEN 0 THEN 38.00005 ELSE 40.00005 END AND price < 48 WINDOW v AS (PARTITION BY w, alpha, "Date", ent ORDER BY o, ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 book AS (SELECT *, sum(price / 10) OVER (PARTITION BY w, alpha, "Date" ORDER BY o, ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS book FROM sig WHERE n <= 1 OR pos <= 9.12345),
 days AS (SELECT w, alpha, "Date", count(*) AS trades, sum(price * (y - 40) / 10) AS pnl, sum(price / 10) AS cap FROM book WHERE round(book, 6) <= 250.0005 GROUP BY ALL),
 cu AS (SELECT *, sum(pnl) OVER v AS s FROM days WINDOW v AS (PARTITION BY w, alpha ORDER BY "Date")), dd AS (SELECT *, s - max(s) OVER (PARTITION BY w, alpha ORDER BY "Date") AS down FROM cu),
 isl AS (SELECT *, sum(CASE WHEN down >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w, alpha ORDER BY "Date") AS island FROM dd), sx AS (SELECT w, alpha, max(n) AS n FROM (SELECT w, alpha, island, count(*) FILTER (down < 0) AS n FROM isl GROUP BY ALL) GROUP BY ALL)
 SELECT b.w AS n_training_days, CAST(b.alpha AS DOUBLE) AS alpha, round(any_value(b.top_mean), 4) AS top_mean, round(any_value(b.spread), 4) AS spread, CAST(sum(trades) AS BIGINT) AS trades, round(sum(pnl) / 10000, 5) AS total, round(min(down) / 10000, 5) AS mdd, round(sum(pnl) / sum(cap), 4) AS mean_bp, round(abs(min(down)) / avg(pnl), 4) AS mdd_to_mean, CAST(any_value(sx.n) AS BIGINT) AS time_to_high
 FROM bins b JOIN dd ON dd.w = b.w AND dd.alpha = b.alpha JOIN sx ON sx.w = b.w AND sx.alpha = b.alpha GROUP BY 1, 2"""


@query(PARAM_SQL)
def g_param_metrics(spark, sf_dir):
    """Top bin, spread and backtest of every model of the grid; rows are scored by all models at once."""
    own = _li(spark, sf_dir, "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    models = model.rolling_ridge(own, ["a", "b"], "y", [20, 60], [0.1, 50.0], regime="ab")
    found = grid.param_metrics(own, models, ["a", "b"], "y", "ab", least=(38.00005, 40.00005), entity_limit=9.12345, session_limit=250.0005, fee=40.0, max_price=48, entity="l_suppkey", order=("l_orderkey", "l_linenumber"), price="l_quantity", stretch_us=5_000)
    return rounded(rounded(found, 4, "top_mean", "spread", "mean_bp", "mdd_to_mean"), 5, "total", "mdd")


@query(f"""WITH {LI_SQL.replace("li AS (", "li0 AS (")}, li AS (SELECT "Date", a, b, u.lb, CASE u.lb WHEN 'y' THEN y ELSE 2 * y - a END AS yy FROM li0 CROSS JOIN (SELECT unnest(['y', 'v']) AS lb) u), nd AS (SELECT 20 AS n), al AS (SELECT 0.1 AS alpha), {_closed("lb", y="yy")}
 SELECT "Date", lb AS label, f AS feature, round(CASE f WHEN 'a' THEN ca ELSE cb END, 5) AS coef FROM so CROSS JOIN (SELECT unnest(['a', 'b']) AS f)""")
def g_label_sweep(spark, sf_dir):
    own = model.label_sweep(_li(spark, sf_dir).withColumn("v", 2 * F.col("y") - F.col("a")), ["a", "b"], ["y", "v"], [20], [0.1])
    return rounded(own.filter("feature != ''").select("Date", "label", "feature", "coef"), 5, "coef")


@query(f"""WITH {LI_SQL}, nd AS (SELECT 20 AS n), al AS (SELECT 0.1 AS alpha), {_closed()}, c AS (SELECT "Date", cay / (da * dy) AS u, cby / (db * dy) AS v, cab / (da * db) AS r FROM so),
 w1 AS (SELECT *, u / sqrt(u * u + v * v) AS wa, v / sqrt(u * u + v * v) AS wb FROM c)
 SELECT "Date", f AS feature, round(CASE f WHEN 'a' THEN wa ELSE wb END, 4) AS weight FROM w1 CROSS JOIN (SELECT unnest(['a', 'b']) AS f)""")
def g_pls_first_component(spark, sf_dir):
    own = model.pls_weights(_li(spark, sf_dir), ["a", "b"], "y", 20).filter("component = 1")
    return rounded(own.select("Date", "feature", "weight"), 4, "weight")


@query(f"""WITH {T_SQL}, n AS (SELECT *, CASE WHEN "FillLots" > 30 THEN "FillPrice" END AS f FROM t), m AS (SELECT "Date", quantile_cont(f, 0.5) AS m FROM n GROUP BY 1), p AS (SELECT "Date", lag(m) OVER (ORDER BY "Date") AS p FROM m)
 SELECT "ChannelSeq", round(coalesce(f, p.p, (SELECT quantile_cont(f, 0.5) FROM n)), 6) AS f FROM n JOIN p ON p."Date" = n."Date" """)
def g_impute_prior_median(spark, sf_dir):
    own = tick_frame(spark, sf_dir).withColumn("f", F.when(F.col("FillLots") > 30, F.col("FillPrice")))
    return rounded(model.impute_prior_median(own, ["f"]).select("ChannelSeq", "f"), 6, "f")


@query(f"""WITH {T_SQL}, s AS (SELECT "ChannelSeq", "InOut", round(CASE WHEN "FillLots" <> 7 THEN 1 + 0.5 * "FillPrice" - 0.1 * "FillLots" END, 6) AS s FROM t)
 SELECT "ChannelSeq", s + 0.0 AS score, coalesce(CASE "InOut" WHEN 1 THEN s > 5 AND 2 * s > 12 WHEN -1 THEN s > 8 AND 2 * s > 14 ELSE false END, false) AS enter FROM s""")
def g_score_and_vote(spark, sf_dir):
    """Coefficients by name; "c" has none and counts 0, a null feature gives no score and no entry. Scores have six digits, so that a sum at a limit isn't over it by its last bit."""
    own = tick_frame(spark, sf_dir).withColumns({"a": F.col("FillPrice"), "b": F.when(F.col("FillLots") != 7, F.col("FillLots")), "c": F.lit(3.0)})
    score = model.linear_score(F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(-0.1)), F.lit(1.0), ["a", "b", "c"])
    state = F.when(F.col("InOut") == 1, "normal").when(F.col("InOut") == -1, "abnormal").otherwise("undecided")
    own = own.withColumn("score", F.round(score, 6) + 0.0)
    return own.select("ChannelSeq", "score", model.dual_vote(F.col("score"), 2 * F.col("score"), {"normal": (5.0, 12.0), "abnormal": (8.0, 14.0)}, state).alias("enter"))


# ---- buckets


@query(f"""WITH {T_SQL}, c AS (SELECT "ChannelSeq", CASE WHEN "FillLots" > 0 AND "FillLots" <= 30 THEN 0 WHEN "FillLots" > 30 AND "FillLots" <= 90 THEN 1 END AS tb, CASE WHEN "FillPrice" <= 10 THEN 0 WHEN "FillPrice" <= 25 THEN 1 ELSE 2 END AS pb FROM t)
 SELECT "ChannelSeq", coalesce(tb * 10 + pb, -1) AS cell FROM c""")
def h_cell_id(spark, sf_dir):
    return tick_frame(spark, sf_dir).select("ChannelSeq", C.cell_id(C.cut_closed_right(F.col("FillLots"), [0, 30, 90]), C.cut_open_ends(F.col("FillPrice"), [10, 25]), -1).alias("cell"))


PRIOR = lambda v, q, n=3: f"""(SELECT s.k + i.i AS k, quantile_cont(s.{v}, {q}) AS q FROM s CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS i) i GROUP BY 1)"""
SES_SQL = f"""{T_SQL}, s AS (SELECT *, dense_rank() OVER (ORDER BY "Date") AS k FROM t)"""


@query(f"""WITH {SES_SQL} SELECT s."ChannelSeq", coalesce(s."FillPrice" > a.q AND s."FillLots" > b.q, false) AS both, s."FillPrice" > 10 AND s."FillLots" > 40 AS fixed FROM s LEFT JOIN {PRIOR('"FillPrice"', 0.7)} a ON a.k = s.k LEFT JOIN {PRIOR('"FillLots"', 0.3)} b ON b.k = s.k""")
def h_conditions(spark, sf_dir):
    own = tick_frame(spark, sf_dir)
    for name, q, as_ in (("FillPrice", 0.7, "la"), ("FillLots", 0.3, "lb")):
        own = buckets.with_thresholds(own, buckets.prior_quantiles(tick_frame(spark, sf_dir), name, [q]).withColumnRenamed("q0", as_))
    return own.select("ChannelSeq", buckets.dual_condition("FillPrice", "la", "FillLots", "lb").alias("both"), buckets.fixed_condition({"FillPrice": 10, "FillLots": 40}).alias("fixed"))


@query(f"""WITH {SES_SQL}, w AS (SELECT *, s.k % 2 AS flag FROM s) SELECT w."ChannelSeq", coalesce(CASE flag WHEN 0 THEN w."FillPrice" > a.q AND w."FillLots" > b.q ELSE w."FillLots" > c.q AND w."FillPrice" > d.q END, false) AS enter
 FROM w LEFT JOIN {PRIOR('"FillPrice"', 0.7)} a ON a.k = w.k LEFT JOIN {PRIOR('"FillLots"', 0.3)} b ON b.k = w.k LEFT JOIN {PRIOR('"FillLots"', 0.9)} c ON c.k = w.k LEFT JOIN {PRIOR('"FillPrice"', 0.5)} d ON d.k = w.k""")
def h_regime_conditions(spark, sf_dir):
    """Normal sessions pass at .7/.3 of their two scores, flagged ones at .9/.5 of theirs."""
    t = tick_frame(spark, sf_dir)
    calendar = buckets.session_index(t).select("Date", ((F.col("session") + 1) % 2).alias("flag"))
    own = t
    for name, shares, names in (("FillPrice", [0.7, 0.5], ["la", "ld"]), ("FillLots", [0.3, 0.9], ["lb", "lc"])):
        limits = buckets.prior_quantiles(t, name, shares)
        own = buckets.with_thresholds(own, limits.withColumnsRenamed({f"q{i}": x for i, x in enumerate(names)}))
    own = own.join(F.broadcast(calendar), "Date")  # a row a session
    enter = buckets.regime_condition("flag", {0: buckets.dual_condition("FillPrice", "la", "FillLots", "lb"), 1: buckets.dual_condition("FillLots", "lc", "FillPrice", "ld")})
    return own.select("ChannelSeq", enter.alias("enter"))


@query(f"""WITH {SES_SQL} SELECT CAST(0.5 AS DOUBLE) AS share, count(*) AS trades, round(avg("FillLots"), 6) AS mean, CAST(sum("FillLots") AS BIGINT) AS total FROM s JOIN {PRIOR('"FillPrice"', 0.5)} q ON q.k = s.k WHERE s."FillPrice" > q.q AND s."FillPrice" > 19.3""")
def h_sweep_with_floor(spark, sf_dir):
    return rounded(buckets.threshold_sweep(tick_frame(spark, sf_dir), "FillPrice", "FillLots", [0.5], floor=19.3), 6, "mean")


def _limits_sql(key: str, value: str, shares: list[float]) -> str:
    """Prior sessions' quantiles by session (and key), a row a quantile."""
    return f"""(SELECT s.k + i.i AS k{key}, u.q AS share, quantile_cont(s.{value}, {shares})[u.p] AS q FROM s CROSS JOIN (SELECT unnest(range(1, 4)) AS i) i CROSS JOIN (SELECT unnest({shares}) AS q, unnest({list(range(1, len(shares) + 1))}) AS p) u GROUP BY s.k + i.i{key}, u.q, u.p)"""


def _signals_sql(shares_a: list[float], shares_b: list[float]) -> str:
    """A row for each event and combination that it is a signal of."""
    parts = []
    for name, a, b in (("plain", '"FillPrice"', '"FillLots"'), ("turned", '"FillLots"', '"FillPrice"')):
        for bucketed in (False, True):
            key = ", event_type" if bucketed else ""
            on = " AND {0}.event_type = s.event_type" if bucketed else ""
            parts.append(f"""SELECT s.*, '{name}' AS source, {str(bucketed).lower()} AS bucketed, per.period, CAST(a.share AS DOUBLE) AS q_a, CAST(b.share AS DOUBLE) AS q_b, fl.floor FROM s JOIN {_limits_sql(key, a, shares_a)} a ON a.k = s.k{on.format("a")} JOIN {_limits_sql(key, b, shares_b)} b ON b.k = s.k{on.format("b")}
 JOIN (SELECT * FROM (VALUES ('tune', '20240101', '20240115'), ('holdout', '20240116', '20240131')) v(period, lo, hi)) per ON s."Date" BETWEEN per.lo AND per.hi JOIN (SELECT unnest(['none', 'fee']) AS floor) fl ON fl.floor = 'none' OR s."FillPrice" > 19.3 WHERE s.{a} > a.q AND s.{b} > b.q""")
    return f"{SES_SQL}, sig AS (" + " UNION ALL ".join(parts) + ")"


SCORES = {"plain": ("FillPrice", "FillLots"), "turned": ("FillLots", "FillPrice")}


def _period():
    return F.when(F.col("Date") <= "20240115", "tune").otherwise("holdout")


def _floors():
    return {"none": F.lit(True), "fee": F.col("FillPrice") > 19.3}


@query(f"""WITH {_signals_sql([0.3, 0.6], [0.2, 0.5])} SELECT source, bucketed, period, q_a, q_b, floor, count(*) AS trades, CAST(round(sum("FillPrice") * 100) AS BIGINT) AS total FROM sig GROUP BY ALL""")
def h_sweep_grid(spark, sf_dir):
    """Totals in hundredths; prices have two digits, so the sum is one of whole numbers."""
    own = buckets.sweep_grid(tick_frame(spark, sf_dir), SCORES, "FillPrice", [0.3, 0.6], [0.2, 0.5], _floors(), _period(), bucket="event_type")
    return own.drop("mean").withColumn("total", F.round(F.col("total") * 100).cast("long"))


@query(f"""WITH {_signals_sql([0.2, 0.4, 0.6, 0.8], [0.2, 0.5])}, run AS (SELECT *, count(*) OVER w AS lots, sum("BidPrice1" / 10) OVER w AS pos FROM sig WINDOW w AS (PARTITION BY source, bucketed, period, q_a, q_b, floor, "QuoteCode" ORDER BY "TransTime", "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 kept AS (SELECT *, lots < 20 + "FillLots" % 9 AND pos < 33.33335 AND "BidPrice1" <= 90 AS ok FROM run),
 days AS (SELECT source, bucketed, period, q_a, q_b, floor, "Date", count(*) AS signals, count(*) FILTER (ok) AS trades, coalesce(sum("BidPrice1" * ("FillLots" - 19.3) / 1e5) FILTER (ok), 0) AS pnl, coalesce(sum("BidPrice1" / 10) FILTER (ok), 0) AS cap FROM kept GROUP BY ALL)
 SELECT source, bucketed, period, q_a, q_b, floor, CAST(sum(signals) AS BIGINT) AS signals, CAST(sum(trades) AS BIGINT) AS trades, count(*) FILTER (trades > 0) AS days, round(sum(trades) / count(*) FILTER (trades > 0), 4) AS trades_day, round(sum(pnl) / sum(cap) * 10000, 4) AS capw_bp, round(sum(pnl), 5) AS pnl, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (trades > 0), 4) AS win_day, round(avg(pnl) FILTER (trades > 0) / stddev_samp(pnl) FILTER (trades > 0) * sqrt(240), 4) AS sharpe
 FROM days GROUP BY source, bucketed, period, q_a, q_b, floor HAVING sum(signals) >= 30 AND sum(trades) > 0""")
def h_grid_evaluation(spark, sf_dir):
    """64 combinations, each with its own running lots and positions, from one shuffle of the events."""
    own = tick_frame(spark, sf_dir).withColumn("_q", F.concat_ws("|", "QuoteCode", _period()))
    found = buckets.evaluate_grid(own, SCORES, "FillLots", [0.2, 0.4, 0.6, 0.8], [0.2, 0.5], _floors(), _period(), rules=F.col("BidPrice1") <= 90, lots=20 + F.col("FillLots") % 9, limit=33.33335, least=30, bucket="event_type", keys=("_q",))
    return rounded(rounded(found, 4, "trades_day", "capw_bp", "win_day", "sharpe"), 5, "pnl")


TREE_SHARES = [i / 32 for i in range(1, 32)]


@query(f"""WITH {SES_SQL}, tg AS (SELECT DISTINCT k FROM s WHERE k > 5), pr AS (SELECT tg.k, s."FillPrice" AS a, CAST(s."FillLots" AS DOUBLE) AS b, s."InOut" AS y FROM tg JOIN s ON s.k < tg.k AND s.k >= tg.k - 5),
 q AS (SELECT k, quantile_cont(a, {TREE_SHARES}) AS qa, quantile_cont(b, {TREE_SHARES}) AS qb, count(*) AS n, sum(y) AS s FROM pr GROUP BY k),
 cut AS (SELECT k, ax, i, CASE ax WHEN 0 THEN qa[i] ELSE qb[i] END AS c, n, s FROM q CROSS JOIN (SELECT unnest([0, 1]) AS ax) CROSS JOIN (SELECT unnest(range(1, 32)) AS i)),
 g AS (SELECT cut.k, ax, i, c, n, s, count(*) FILTER (CASE ax WHEN 0 THEN a ELSE b END <= c) AS ln, coalesce(sum(y) FILTER (CASE ax WHEN 0 THEN a ELSE b END <= c), 0) AS ls FROM cut JOIN pr ON pr.k = cut.k GROUP BY ALL),
 best AS (SELECT k, arg_min(struct_pack(ax := ax, c := c), struct_pack(g := -(CAST(ls * ls AS DOUBLE) / ln + CAST((s - ls) * (s - ls) AS DOUBLE) / (n - ln)), ax := ax, i := i)) AS m FROM g WHERE ln >= greatest(20, 0.05 * n) AND n - ln >= greatest(20, 0.05 * n) GROUP BY k)
 SELECT s."ChannelSeq", CAST(CASE WHEN s.k <= 5 THEN NULL WHEN best.k IS NULL THEN 1 WHEN CASE m.ax WHEN 0 THEN "FillPrice" ELSE "FillLots" END <= m.c THEN 2 ELSE 3 END AS INT) AS leaf FROM s LEFT JOIN best ON best.k = s.k""")
def h_tree_stumps(spark, sf_dir):
    """Trees of one cut, each from the five sessions before; sessions without five get none."""
    return buckets.tree_leaves(tick_frame(spark, sf_dir), ["FillPrice", "FillLots"], "InOut", depth=1, sessions=5, least_rows=20).select("ChannelSeq", "leaf")


@query("""WITH q AS (SELECT o_orderpriority AS k, quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders GROUP BY 1)
 SELECT o_orderkey, CAST((CASE WHEN o_totalprice > e[2] THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice > e[3] THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice > e[4] THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM orders JOIN q ON q.k = o_orderpriority""")
def h_qcut_by_group(spark, sf_dir):
    return buckets.qcut(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 4, ["o_orderpriority"]).select("o_orderkey", "bin")


# ---- books

POS_SQL = f"""{T_SQL}, w AS (SELECT *, count(*) OVER x AS acc, sum("BidPrice1" / 10) OVER x AS pos FROM t WINDOW x AS (PARTITION BY "QuoteCode" ORDER BY "TransTime", "ChannelSeq" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {POS_SQL} SELECT "ChannelSeq", acc <= 1 OR pos <= 8 AS first_kept, pos < CASE WHEN "QuoteCode" % 2 = 0 THEN 40.0 ELSE 15.0 END AND "FillLots" > 20 AS tier_kept FROM w WHERE acc <= 1 OR pos <= 8 OR (pos < CASE WHEN "QuoteCode" % 2 = 0 THEN 40.0 ELSE 15.0 END AND "FillLots" > 20)""")
def i_caps(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    first = books.cap_first_always(t, 8.0, keys=USER).select("ChannelSeq", F.lit(True).alias("f"))
    tier = books.cap_after(t, books.tiered_limit(F.col("QuoteCode") % 2 == 0, 40.0, 15.0), rules=F.col("FillLots") > 20, keys=USER).select("ChannelSeq", F.lit(True).alias("t"))
    both = first.join(tier, "ChannelSeq", "full")
    return both.select("ChannelSeq", F.coalesce("f", F.lit(False)).alias("first_kept"), F.coalesce("t", F.lit(False)).alias("tier_kept"))


@query(f"""WITH {T_SQL}, a AS (SELECT "Date", sum("FillPrice") AS v FROM t WHERE event_type = 'click' GROUP BY 1), b AS (SELECT "Date", sum("FillLots" * 1.0) AS v FROM t WHERE event_type = 'view' GROUP BY 1), c AS (SELECT corr(a.v, b.v) AS corr, count(*) AS days FROM a JOIN b ON a."Date" = b."Date")
 SELECT coalesce(a."Date", b."Date") AS "Date", round(coalesce(a.v, 0) + coalesce(b.v, 0), 4) AS pnl, round(c.corr, 6) AS corr, c.days FROM a FULL JOIN b ON a."Date" = b."Date", c""")
def i_combined_books(spark, sf_dir):
    t = tick_frame(spark, sf_dir)
    of = lambda kind, v: t.filter(F.col("event_type") == kind).groupBy("Date").agg(F.sum(F.col(v).cast("double")).alias("pnl"))
    whole, alike = books.combine_books(of("click", "FillPrice"), of("view", "FillLots"))
    return rounded(whole.withColumn("_k", F.lit(1)).join(alike.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("pnl", F.round("pnl", 4)), 6, "corr")
