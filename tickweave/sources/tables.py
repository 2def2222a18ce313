"""Sources, sinks and incremental maintenance of session tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators.asof import lookup
from tickweave.operators.quantiles import quantiles

PARAMS = T.StructType([
    T.StructField("suspended_list", T.ArrayType(T.StringType())), T.StructField("target_list", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.StructType([T.StructField("trained_until", T.StringType()), T.StructField("alpha", T.DoubleType()), T.StructField("otc_turnover_threshold", T.DoubleType())])),
    *[T.StructField(m, T.StructType([T.StructField("coefficients", T.MapType(T.StringType(), T.DoubleType())), T.StructField("intercept", T.DoubleType()), T.StructField("threshold", T.DoubleType())])) for m in ("normal_model", "normal_model_M", "abnormal_model", "abnormal_model_M")],
])


def scan_sessions(spark: SparkSession, path: str | list[str], date="Date") -> DataFrame:
    """Files or folders named by session (yyyymmdd first, or after "name="), merged by column name, the session from that name."""
    df = spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))
    return df.withColumn(date, F.regexp_extract(F.col("_metadata.file_path"), SESSION, 1))


SESSION = r".*[/=](\d{8})(?=[^/]*(?:/[^/]*)?$)"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, session, names (its columns) and rows of every Parquet file under path, from the files' footers; tasks read those, not the driver."""
    files = spark.read.parquet(path).inputFiles()

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for file in batch.column("file").to_pylist():
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as held:
                    meta = pq.ParquetFile(held)
                    found.append((file, meta.schema_arrow.names, meta.metadata.num_rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], ["file", "names", "rows"])

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 200)))
    found = listed.mapInArrow(run, "file string, names array<string>, rows bigint")
    return found.select("file", F.regexp_extract("file", SESSION, 1).alias("session"), "names", "rows")


def scan_complete(spark: SparkSession, path: str, need: list[str], date="Date") -> tuple[DataFrame, DataFrame]:
    """scan_sessions() without the sessions of which a file lacks a needed column, and a report of those: session, missing, files, rows.

    A merged schema would give nulls for such a column; the footers tell. Names by which a table is partitioned are in no file.
    """
    known = footers(spark, path)
    lack = known.withColumn("missing", F.array_except(F.array(*map(F.lit, need)), "names"))
    by_session = lack.groupBy("session").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"), F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.collect_list("file").alias("_files"))
    rows = by_session.collect()  # a row a session
    good = [f for r in rows if not r["missing"] for f in r["_files"]]
    report = spark.createDataFrame([(r["session"], r["missing"], r["files"], r["rows"]) for r in rows if r["missing"]], "session string, missing array<string>, files bigint, rows bigint")
    whole = scan_sessions(spark, path, date)
    if not good:
        return whole.limit(0), report
    return scan_sessions(spark, good, date), report


def require_columns(df: DataFrame, names: list[str]) -> bool:
    return set(names) <= set(df.columns)


def project_available(df: DataFrame, names: list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c in names or (suffixes and c.endswith(suffixes))])


def newer_than(source: DataFrame, existing: DataFrame, date="Date") -> DataFrame:
    """Rows of sessions after the last existing one."""
    last = existing.agg(F.max(date)).first()[0]
    return source if last is None else source.filter(F.col(date) > last)


def append(df: DataFrame, path: str, date="Date") -> None:
    df.write.mode("append").option("compression", "zstd").partitionBy(date).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of this schema where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def merge_write(spark: SparkSession, df: DataFrame, path: str, existing: list[str], force: bool = False, date="Date") -> None:
    """Writes sessions that aren't there and refreshes the last that is; force rewrites all."""
    done = sorted(existing)[:-1]
    own = df if force or not done else df.filter(~F.col(date).isin(*done))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def session_range(df: DataFrame, start: str, end: str, date="Date") -> DataFrame:
    return df.filter(F.col(date).between(start, end))


def last_sessions(df: DataFrame, n: int, date="Date") -> DataFrame:
    return df.join(F.broadcast(df.select(date).distinct().orderBy(F.desc(date)).limit(n)), date, "left_semi")


def every_kth_session(df: DataFrame, step: int, date="Date") -> DataFrame:
    days = df.select(date).distinct().withColumn("_k", F.row_number().over(Window.orderBy(date)) - 1)
    return df.join(days.filter(F.col("_k") % step == 0).select(date), date, "left_semi")


def read_sessions(df: DataFrame, wanted: list[str], date="Date") -> tuple[DataFrame, list[str]]:
    """Rows of the wanted sessions, and those of them that the table lacks."""
    own = df.filter(F.col(date).isin(*wanted)) if wanted else df
    there = {r[0] for r in own.select(date).distinct().collect()} if wanted else set()
    return own, sorted(set(wanted) - there)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prefer_source(parts: dict[str, DataFrame], date="Date", mid="mid", last="last_price") -> DataFrame:
    """One source a session, the first of parts that has it; without a mid price the last price stands in."""
    tagged = [df.withColumns({"source": F.lit(name), "_p": F.lit(i)}) for i, (name, df) in enumerate(parts.items())]
    best = union_all([t.select(date, "_p") for t in tagged]).groupBy(date).agg(F.min("_p").alias("_p"))
    own = lookup(union_all(tagged), best.withColumn("_best", F.lit(True)), [date, "_p"]).filter("_best").drop("_p", "_best")
    return own.withColumn(mid, F.coalesce(mid, last)) if last in own.columns else own


def flag_sessions(df: DataFrame, flagged: DataFrame, date="Date", out="isAbnormalDate") -> DataFrame:
    marks = flagged.select(date).distinct().withColumn("_f", F.lit(1))
    return df.join(F.broadcast(marks) if flagged.limit(100_001).count() <= 100_000 else marks, date, "left").withColumn(out, F.col("_f").isNotNull().cast("int")).drop("_f")


def read_portfolio_csv(spark: SparkSession, path: str, date="date", pct: list[str] | None = None, start: int | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", True).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    df = df.filter(F.col(date) >= start) if start else df
    return df.withColumns({date: F.to_date(F.col(date).cast("string"), "yyyyMMdd"), **{c: F.col(c) / 100 for c in pct or []}})


def read_params(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Model parameters of files of one object each; lines: of one object a line."""
    return spark.read.schema(PARAMS).option("multiLine", not lines).json(path)


def params_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[c for c in PARAMS.names if c in df.columns])).alias("value"))


def write_params(df: DataFrame, path: str) -> None:
    """Model parameters as JSON, one line a row; ValueError if a row lacks one of the model blocks, its intercept or its threshold."""
    blocks = [f.name for f in PARAMS.fields if f.name.endswith(("model", "model_M"))]
    if missing := [c for c in blocks if c not in df.columns]:
        raise ValueError(f"model blocks missing: {missing}")
    lacks = F.lit(False)
    for c in blocks:
        lacks = lacks | F.col(f"{c}.coefficients").isNull() | F.col(f"{c}.intercept").isNull() | F.col(f"{c}.threshold").isNull()
    if not df.filter(lacks).isEmpty():
        raise ValueError("a model block lacks its coefficients, intercept or threshold")
    params_json(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cache_predictions(df: DataFrame, keys: list[str], scores: list[str], path: str, date="Date") -> None:
    """Scores with their keys by session; sessions of df replace theirs, others stay."""
    df.select(*dict.fromkeys([date, *keys, *scores])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_panel(ic: DataFrame, path: str, pairs: list[str], date="Date") -> None:
    """Correlations per session as a wide CSV: a column for each pair."""
    write_csv(ic.groupBy(date).pivot("pair", pairs).agg(F.first("ic")), path)


def downcast(df: DataFrame) -> DataFrame:
    narrow = {"double": "float", "bigint": "int"}
    return df.select(*[F.col(c).cast(narrow[k]).alias(c) if k in narrow else F.col(c) for c, k in df.dtypes])


def descale(df: DataFrame, names: list[str], by: float) -> DataFrame:
    return df.withColumns({c: F.col(c) / by for c in names})


def price_scale(df: DataFrame, name: str, over: float = 100_000, factor: float = 100.0) -> float:
    """factor if the median price is that high, else 1."""
    mid = quantiles(df, [name], [0.5]).select(F.col(name)[0]).first()[0]
    return factor if mid is not None and mid > over else 1.0


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names])


def export_points(trades: DataFrame, columns: list[str], path: str, key: Column) -> None:
    trades.select(key.alias("unikey"), *columns).write.mode("overwrite").parquet(path)
