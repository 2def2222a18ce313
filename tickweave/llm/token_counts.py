"""Token counts from an exact histogram of encoded lengths.

One pass encodes every document and counts documents by length. From the histogram, sums over suffixes (all
documents at least this long) give totals, quantiles and totals under any context limit. Suffix sums run in
two levels, within and across blocks of lengths, so no task gathers all lengths.

Defined results: a null text counts as empty and has length 0; repeated rows count each time; an empty table
gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.base import staged, text_of

#: Lengths in a block of the two-level sums.
BLOCK = 512


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """One row n_tokens for every row of docs."""

    def run(batches):
        for batch in batches:
            encode = _encoding(path, pattern).encode_ordinary
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py())) for t in batch.column("text")], pa.int64())], ["n_tokens"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """n_tokens, n_docs, and over the suffix of documents this long or longer docs_from, tokens_from; total_at_limit: all
    tokens if documents were cut at n_tokens; docs_total."""
    # Written once: blocks and rows both read it, and encoding is what costs.
    rows = staged(counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    rows = rows.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("n").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block")
    docs_from, tokens_from = F.sum("n_docs").over(within) + F.col("n_after"), F.sum("tokens").over(within) + F.col("t_after")
    return out.select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs_total", "tokens_total").withColumn(
        "total_at_limit", F.col("tokens_total") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, n_docs, n_cut (documents longer than the limit), total and truncated_total, in one aggregation."""
    each = [F.struct(F.lit(k).cast("long").alias("context_limit"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
                     F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs"))), F.lit(0)).alias("n_cut"),
                     F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"),
                     F.coalesce(F.sum(F.least("n_tokens", F.lit(k)) * F.col("n_docs")), F.lit(0)).alias("truncated_total")) for k in limits]
    return hist.agg(F.array(*each).alias("x")).select(F.inline("x"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of documents don't exceed."""
    upto = F.col("docs_total") - F.col("docs_from") + F.col("n_docs")
    each = [F.struct(F.lit(q).alias("share"), F.min(F.when(upto >= F.ceil(F.lit(q) * F.col("docs_total")), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return hist.agg(F.array(*each).alias("x")).select(F.inline("x"))
