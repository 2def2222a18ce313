"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most max_rows (narrow) rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than SPACE, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def once(value: Column, then) -> Column:
    """then(value), with value evaluated once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, with underscores behind where docs has a column of that name (in any case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with each row's place as two further columns, and their names: the file and the row in it. A frame that isn't read straight from Parquet is written to the shared folder first."""
    file, row = fresh(docs, "at_file", "at_row")
    if "_metadata" not in docs.columns:
        try:
            return docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")}), file, row
        except Exception as error:  # an analysis error: this frame has no file behind each row
            if "_metadata" not in str(error):
                raise
    out = staged(docs, "located")
    hidden = out.metadataColumn("_metadata")
    return out.withColumns({file: hidden.getField("file_path"), row: hidden.getField("row_index")}), file, row
