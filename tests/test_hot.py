"""Keys that hold most rows: bounded tasks, equal results."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import asof, stats


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tolerance", [None, 40_000_000])
def test_asof_in_stretches_equals_asof(spark, strict, tolerance):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 5, 9)
    at = lambda: start + datetime.timedelta(seconds=rng.randint(0, 900))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = spark.createDataFrame([(key(), at(), i) for i in range(400)] + [("only left", at(), 999)], "k string, t timestamp, i int")
    right = spark.createDataFrame([(key(), at(), s, None if s % 9 == 0 else float(s)) for s in range(120)], "k string, t timestamp, s int, v double")
    plain = asof.asof_backward(left, right, ["k"], "t", ["v"], strict, tolerance, seq="s", age="age")
    cut = asof.asof_backward(left, right, ["k"], "t", ["v"], strict, tolerance, seq="s", age="age", stretch_us=60_000_000)
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_ordinal_ranks_of_a_session_with_all_rows(spark):
    rng = np.random.default_rng(1)
    n = 8_000
    rows = [("d1" if i % 50 else "d2", i, float(rng.integers(0, 4)) if i % 2 else float(rng.normal())) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "Date string, seq long, v double").repartition(4)
    plain = {r["seq"]: r["rank"] for r in stats.ordinal_rank(df, "v", "seq", ["Date"], "rank").collect()}
    cut = {r["seq"]: r["rank"] for r in stats.ordinal_rank(df, "v", "seq", ["Date"], "rank", most=0).collect()}
    assert plain == cut and sorted(plain[s] for d, s, _ in rows if d == "d2") == list(range(1, n // 50 + 1))


def test_no_range_of_ranks_is_large(spark):
    """A third of the rows are one value: they are split by the tie."""
    from tickweave.operators import quantiles

    df = spark.range(0, 64_000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.randn(2)).alias("v"))
    shares = F.array(*[F.lit(i / 64) for i in range(1, 64)])
    cuts = df.agg(F.percentile_approx("v", shares, F.lit(640)), F.percentile_approx(F.col("id").cast("double"), shares, F.lit(640))).first()
    own = df.withColumns({"_r": quantiles.range_of(F.col("v"), sorted(set(cuts[0]))), "_k": quantiles.range_of(F.col("id").cast("double"), sorted(set(cuts[1])))})
    assert own.groupBy("v", "_k").count().agg(F.max("count")).first()[0] <= 64_000 / 64
    assert own.filter("v != 0").groupBy("_r").count().agg(F.max("count")).first()[0] <= 1.5 * 64_000 / 64
