"""Exact deduplication by a stateful stream.

Arrivals (digest, stable identifier, content locator) flow through a streaming aggregation whose keyed state
is on disk (RocksDB) and never expires: per digest the best identifier so far, the locator of its text, and
the group's size. A hit is a digest met before; for hits the full texts are compared, each against the text
that the state's locator points to, so a digest's collision can't drop a row.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays (nulls
lose; equal ids go by place in the files, so exactly one row stays); an empty table gives no rows; clashing
further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.base import located, scratch, small_side, staged, text_of

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Copies of one text that a single task compares with it.
COPIES_A_TASK = 2_000
#: Micro-batches that arrivals come in where the caller doesn't say how many files make one.
BATCHES = 4


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(arrivals: DataFrame) -> DataFrame:
    """Streaming (or batch) digest -> keeper, group_size. No watermark: a key stays for good."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "at_file", "at_row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """The state after all arrivals under path. Each micro-batch writes the keys it changed; the last word on a key counts."""
    out, batches = scratch(spark, "dedup-state"), []

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(schema)
        reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
        query = (keyed_state(reader.parquet(path)).writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", scratch(spark, "dedup-stream")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "digest string, keeper struct<doc_id: bigint, at_file: string, at_row: bigint>, group_size bigint"
    if not batches:
        return spark.createDataFrame([], kind)
    found = spark.read.schema(f"{kind}, batch int").parquet(out)
    if len(set(batches)) == 1:
        return found.drop("batch")
    return found.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("x")).select("digest", "x.*")


def decide(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_a_batch: int | None = None, place: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, at_file, at_row, digest, keep_id, group_size, kept. place: the columns of located(), if docs has them."""
    spark = docs.sparkSession
    docs, *place = (docs, *place) if place else located(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col(place[0]).alias("at_file"), F.col(place[1]).alias("at_row"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    path = scratch(spark, "arrivals")
    docs.select("doc_id", "at_file", "at_row", "digest").write.parquet(path)
    arrivals = spark.read.schema("doc_id bigint, at_file string, at_row bigint, digest string").parquet(path)
    state = run_stream(spark, path, arrivals.schema, files_a_batch or max(1, -(-len(arrivals.inputFiles()) // BATCHES)))

    repeated = state.filter("group_size > 1").withColumn("n_salts", F.ceil(F.col("group_size") / COPIES_A_TASK).cast("int"))
    hits = staged(docs.join(small_side(repeated.select("digest", "keeper", "n_salts")), "digest"), "hits")
    own = (F.col("at_file") == F.col("keeper.at_file")) & (F.col("at_row") == F.col("keeper.at_row"))
    kept_text = hits.filter(own).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("at_file", "at_row"), F.col("n_salts")).cast("int"))
    differ = staged(salted.join(kept_text, ["digest", "salt"]).filter(F.col("text") != F.col("kept_text")).select("doc_id", "at_file", "at_row", "digest", "text"), "collisions")
    full = arrivals.join(state, "digest")
    mine = F.struct("doc_id", "at_file", "at_row")
    shape = ["doc_id", "at_file", "at_row", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size", mine.eqNullSafe(F.col("keeper")).alias("kept")]
    if differ.isEmpty():
        return full.select(*shape)
    # Equal digests of different texts: those rows form groups of their own, by the whole text.
    apart = differ.groupBy("digest", "text").agg(F.max(mine).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    less = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("n_apart"))
    rest = full.join(differ.select("at_file", "at_row"), ["at_file", "at_row"], "left_anti").join(less, "digest", "left")
    rest = rest.withColumn("group_size", F.col("group_size") - F.coalesce("n_apart", F.lit(0)))
    return rest.select(*shape).unionByName(differ.join(apart, ["digest", "text"]).select(*shape))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row of equal text outlives."""
    own, file, row = located(docs)
    gone = decide(own, place=(file, row)).filter(~F.col("kept")).select(F.col("at_file").alias(file), F.col("at_row").alias(row))
    return own.join(small_side(gone), [file, row], "left_anti").select(*docs.columns)
