"""Queries of the sources and sinks: tables written, merged and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.plans.base import T_SQL, query, scratch, tick_frame
from tickweave.sources import tables


def _small(spark, sf_dir):
    return tick_frame(spark, sf_dir).select("Date", "ChannelSeq", "FillPrice")


def _mid(spark, sf_dir):
    """The session of the middle between the first and the last event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = F.timestamp_micros(F.floor((F.min(us) + F.max(us)) / 2).cast("long"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_format(middle, "yyyyMMdd")).first()[0]


MID_SQL = """mid AS (SELECT strftime(make_timestamp(CAST(floor((min(epoch_us(ts)) + max(epoch_us(ts))) / 2.0) AS BIGINT)), '%Y%m%d') AS m FROM events)"""


@query(f"""WITH {T_SQL}, {MID_SQL} SELECT "Date", count(*) AS n FROM t WHERE "Date" > (SELECT m FROM mid) GROUP BY 1""")
def a_newer_sessions(spark, sf_dir):
    t = _small(spark, sf_dir)
    return tables.newer_than(t, t.filter(F.col("Date") <= _mid(spark, sf_dir))).groupBy("Date").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T_SQL}, {MID_SQL} SELECT "Date", count(*) AS n, round(sum(CASE WHEN "Date" < (SELECT m FROM mid) THEN "FillPrice" + 1 ELSE "FillPrice" END), 4) AS total FROM t GROUP BY 1""")
def a_merge_write(spark, sf_dir):
    """Sessions up to the middle lie there with other prices: those before the last of them stay, it is refreshed, later ones are added."""
    t, mid, path = _small(spark, sf_dir), _mid(spark, sf_dir), scratch(spark, "merge")
    old = t.filter(F.col("Date") <= mid).withColumn("FillPrice", F.col("FillPrice") + 1)
    tables.append(old, path)
    done = [r[0] for r in tables.read_or_empty(spark, path, "ChannelSeq long, FillPrice double, Date string").select("Date").distinct().collect()]
    tables.merge_write(spark, t, path, done)
    own = spark.read.schema("ChannelSeq long, FillPrice double, Date string").parquet(path)
    return own.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("FillPrice"), 4).alias("total"))


@query(f"""WITH {T_SQL} SELECT "Date", count(*) AS n, CAST(NULL AS VARCHAR) AS missing FROM t WHERE "Date" IN ('20240103', '20240105') GROUP BY 1 UNION ALL SELECT '20991231', 0, 'missing'
 UNION ALL SELECT "Date", count(*), 'range' FROM t WHERE "Date" BETWEEN '20240110' AND '20240112' GROUP BY 1""")
def a_read_sessions(spark, sf_dir):
    t = _small(spark, sf_dir)
    own, missing = tables.read_sessions(t, ["20240103", "20240105", "20991231"])
    count = lambda df, text: df.groupBy("Date").agg(F.count(F.lit(1)).alias("n")).withColumn("missing", F.lit(text).cast("string"))
    found = tables.union_all([count(own, None), count(tables.session_range(t, "20240110", "20240112"), "range")])
    return found.unionByName(t.select(F.explode(F.array(*map(F.lit, missing))).alias("Date")).distinct().withColumns({"n": F.lit(0).cast("long"), "missing": F.lit("missing")}))


@query(f"""WITH {T_SQL}, s AS (SELECT *, CASE WHEN CAST("Date" AS INTEGER) % 3 = 0 THEN 'local' WHEN CAST("Date" AS INTEGER) % 3 = 1 THEN 'nas' ELSE 'sdk' END AS source FROM t)
 SELECT "Date", source, count(*) AS n, round(sum("FillPrice"), 4) AS mid FROM s GROUP BY 1, 2""")
def a_prefer_source(spark, sf_dir):
    """Every third session has all sources, the next third two of them, the rest trades only, which have no mid price."""
    t, day = _small(spark, sf_dir), F.col("Date").cast("int") % 3
    quotes = t.select("Date", "ChannelSeq", F.col("FillPrice").alias("mid"))
    trades = t.select("Date", "ChannelSeq", F.col("FillPrice").alias("last_price"))
    own = tables.prefer_source({"local": quotes.filter(day == 0), "nas": quotes.filter(day <= 1), "sdk": trades})
    return own.groupBy("Date", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mid"), 4).alias("mid"))


@query(f"""WITH {T_SQL} SELECT "ChannelSeq", CASE WHEN "Date" IN (SELECT strftime(ts, '%Y%m%d') FROM events WHERE value > 150) THEN 1 ELSE 0 END AS "isAbnormalDate" FROM t""")
def a_flag_sessions(spark, sf_dir):
    t = _small(spark, sf_dir)
    return tables.flag_sessions(t, t.filter("FillPrice > 150")).select("ChannelSeq", "isAbnormalDate")


@query("""SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(round(sum(o_totalprice) / 1000, 5) / 100, 7) AS ret FROM orders WHERE strftime(o_orderdate, '%Y%m%d') >= '19940101' GROUP BY 1""")
def a_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice") / 1000, 5).alias("ret"))
    tables.write_csv(daily, path)
    return tables.read_portfolio_csv(spark, path, pct=["ret"], start=19940101).select("date", F.col("n").cast("long").alias("n"), F.round("ret", 7).alias("ret"))


@query(f"""WITH {T_SQL}, a AS (SELECT "Date", "QuoteCode", round(avg("FillPrice"), 4) AS score FROM t GROUP BY 1, 2), {MID_SQL} SELECT "Date", "QuoteCode", CASE WHEN "Date" >= (SELECT m FROM mid) THEN -score ELSE score END AS score FROM a""")
def a_prediction_cache(spark, sf_dir):
    path, own = scratch(spark, "cache"), tick_frame(spark, sf_dir).groupBy("Date", "QuoteCode").agg(F.round(F.avg("FillPrice"), 4).alias("score"))
    tables.cache_predictions(own, ["QuoteCode"], ["score"], path)
    tables.cache_predictions(own.filter(F.col("Date") >= _mid(spark, sf_dir)).withColumn("score", -F.col("score")), ["QuoteCode"], ["score"], path)
    return spark.read.schema("QuoteCode long, score double, Date string").parquet(path)


@query(f"""WITH {T_SQL}, m AS (SELECT "Date", round(avg("FillPrice") FILTER (WHERE event_type = 'click'), 4) AS coef, round(avg("FillPrice"), 4) AS intercept FROM t GROUP BY 1)
 SELECT "Date" AS until, m.coef AS click, intercept, round(intercept * 2, 4) AS threshold, 2 AS suspended FROM m""")
def a_params_round_trip(spark, sf_dir):
    path = scratch(spark, "params")
    own = tick_frame(spark, sf_dir).groupBy("Date").agg(F.round(F.avg(F.when(F.col("event_type") == "click", F.col("FillPrice"))), 4).alias("c"), F.round(F.avg("FillPrice"), 4).alias("i"))
    block = F.struct(F.create_map(F.lit("click"), F.col("c")).alias("coefficients"), F.col("i").alias("intercept"), F.round(F.col("i") * 2, 4).alias("threshold"))
    meta = F.struct(F.col("Date").alias("trained_until"), F.lit(0.1).alias("alpha"), F.lit(1.0).alias("otc_turnover_threshold"))
    names = ("normal_model", "normal_model_M", "abnormal_model", "abnormal_model_M")
    tables.write_params(own.select(F.array(F.lit("1101"), F.lit("2330")).alias("suspended_list"), F.array(F.lit("2317")).alias("target_list"), meta.alias("metadata"), *[block.alias(n) for n in names]), path)
    found = tables.read_params(spark, path, lines=True)
    return found.select(F.col("metadata.trained_until").alias("until"), F.col("normal_model.coefficients")["click"].alias("click"), F.col("abnormal_model_M.intercept").alias("intercept"), F.col("normal_model_M.threshold").alias("threshold"), F.size("suspended_list").alias("suspended"))


@query("""SELECT o_orderkey, CAST(o_totalprice / CASE WHEN (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) > 100000 THEN 100 ELSE 1 END AS FLOAT) AS price FROM orders""")
def a_scaled_prices(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("price"))
    own = tables.downcast(tables.descale(o, ["price"], tables.price_scale(o, "price")))
    return own.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price")


@query(f"""WITH {T_SQL}, l AS (SELECT lag("FillPrice", 3) OVER (PARTITION BY "QuoteCode" ORDER BY "ChannelSeq") AS a, CASE WHEN "InOut" <> 0 THEN 1 END AS b FROM t) SELECT round(count(a) * 1.0 / count(*), 6) AS a, round(count(b) * 1.0 / count(*), 6) AS b FROM l""")
def a_coverage(spark, sf_dir):
    from pyspark.sql import Window

    own = tick_frame(spark, sf_dir).withColumns({"a": F.lag("FillPrice", 3).over(Window.partitionBy("QuoteCode").orderBy("ChannelSeq")), "b": F.when(F.col("InOut") != 0, 1)})
    return tables.coverage(own, ["a", "b"]).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""WITH {T_SQL} SELECT "Date" || '_' || "QuoteCode" || '_' || "ChannelSeq" AS unikey, "FillPrice", "FillLots" FROM t WHERE "FillLots" > 50""")
def a_export_points(spark, sf_dir):
    path, own = scratch(spark, "points"), tick_frame(spark, sf_dir).filter("FillLots > 50")
    tables.export_points(tables.project_available(own, ["Date", "QuoteCode", "ChannelSeq", "FillPrice", "missing"], ("Lots",)), ["FillPrice", "FillLots"], path, F.concat_ws("_", "Date", "QuoteCode", "ChannelSeq"))
    return spark.read.parquet(path)


@query(f"""WITH {T_SQL} SELECT "Date", count(*) AS n FROM t GROUP BY 1""")
def a_scan_sessions(spark, sf_dir):
    """Session files named by their session."""
    path = scratch(spark, "sessions")
    _small(spark, sf_dir).withColumn("session", F.col("Date")).write.partitionBy("session").parquet(path)
    found = tables.scan_sessions(spark, path)
    assert tables.require_columns(found, ["ChannelSeq"]) and not tables.require_columns(found, ["Spread"])
    return found.groupBy("Date").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T_SQL} SELECT "Date", count(*) AS n, CASE WHEN CAST("Date" AS INT) % 3 = 0 THEN 'FillLots' END AS missing, CASE WHEN CAST("Date" AS INT) % 3 <> 0 THEN CAST(sum("FillLots") AS BIGINT) END AS lots FROM t GROUP BY 1""")
def a_incomplete_sessions(spark, sf_dir):
    """Every third session was written without a needed column: it is passed over and reported, not filled with nulls."""
    path, own = scratch(spark, "sessions"), tick_frame(spark, sf_dir).select("Date", "ChannelSeq", "FillLots").withColumn("session", F.col("Date"))
    third = F.col("Date").cast("int") % 3 == 0
    own.filter(~third).write.partitionBy("session").parquet(path)
    own.filter(third).drop("FillLots").write.mode("append").partitionBy("session").parquet(path)
    whole, passed = tables.scan_complete(spark, path, ["ChannelSeq", "FillLots"])
    kept = whole.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("missing"), F.sum("FillLots").alias("lots"))
    return kept.unionByName(passed.select(F.col("session").alias("Date"), F.col("rows").alias("n"), F.array_join("missing", ",").alias("missing"), F.lit(None).cast("bigint").alias("lots")))
