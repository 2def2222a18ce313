"""What the query modules share: the registry, and the roles that the driver's tables play.

An event is a tick (user_id the entity, event_id the sequence, the day of ts the session, value the price, props.k the
lots, purchase +1 and error -1 the direction); lineitem months are sessions of suppliers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}
USER = ["QuoteCode"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tick_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    bid = F.round("value", 2)
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("Date"), F.col("user_id").alias("QuoteCode"), F.col("event_id").alias("ChannelSeq"), F.col("ts").alias("TransTime"), "event_type",
        F.col("value").alias("FillPrice"), k.alias("FillLots"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("InOut"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("TrialMatch"), bid.alias("BidPrice1"), (bid + (k % 7 + 1) * 0.01).alias("AskPrice1"), F.lit(20.0).alias("RefPrice"))


T_SQL = """t AS (SELECT strftime(ts, '%Y%m%d') AS "Date", user_id AS "QuoteCode", event_id AS "ChannelSeq", ts AS "TransTime", event_type,
 value AS "FillPrice", CAST(json_extract_string(props, '$.k') AS BIGINT) AS "FillLots",
 CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS "InOut", CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS "TrialMatch",
 round(value, 2) AS "BidPrice1", round(value, 2) + (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 + 1) * 0.01 AS "AskPrice1", 20.0 AS "RefPrice" FROM events)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-months: mean price move as return, market mean as factor."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = li.groupBy(F.date_format("l_shipdate", "yyyyMM").alias("Date"), F.col("l_suppkey").alias("QuoteCode")).agg((F.sum("l_discount") / F.count(F.lit(1)) - 0.05).alias("ret"))
    # The table of supplier-months is written once: rows, the market's means and calendars all read it.
    path = scratch(spark, "months")
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    return own.join(own.groupBy("Date").agg(F.avg("ret").alias("factor")), "Date")


M_SQL = """own AS (SELECT strftime(l_shipdate, '%Y%m') AS "Date", l_suppkey AS "QuoteCode", sum(l_discount) / count(*) - 0.05 AS ret FROM lineitem GROUP BY 1, 2),
m AS (SELECT own.*, avg(ret) OVER (PARTITION BY "Date") AS factor FROM own)"""


def depth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks with five levels of lots on both sides, and OTC for odd entities."""
    k = F.col("FillLots")
    lots = {f"BidLots{i}": (k * i) % 11 for i in range(1, 6)} | {f"AskLots{i}": (k + i) % 7 for i in range(1, 6)}
    return tick_frame(spark, sf_dir).withColumns(lots).withColumn("OTC", F.col("QuoteCode") % 2 == 1)


X_SQL = T_SQL + """, x AS (SELECT t.*, """ + ", ".join([f'("FillLots" * {i}) % 11 AS "BidLots{i}"' for i in range(1, 6)] + [f'("FillLots" + {i}) % 7 AS "AskLots{i}"' for i in range(1, 6)]) + """, "QuoteCode" % 2 = 1 AS "OTC" FROM t)"""


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir); without one in a temporary folder, where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})
