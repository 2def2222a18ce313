"""Quantiles by ranges against numpy, however the groups lie."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import buckets, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(2)
    n = 6000
    df = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "cold", "none", None], n), "session": rng.integers(1, 7, n), "x": rng.normal(size=n), "y": rng.integers(0, 5, n).astype(float)})
    df.loc[rng.random(n) < 0.05, "x"] = None
    df.loc[df["g"] == "none", "x"] = None
    df.loc[:3, "x"] = [math.inf, -math.inf, 1e300, -1e-300]
    df.loc[:3, "g"] = "cold"
    return df


@pytest.fixture(scope="module")
def sdf(spark, frame):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, session int, x double, y double").repartition(4)


def expected(values):
    values = np.sort(values.dropna())
    if not len(values):
        return None
    out = []
    for q in SHARES:
        at = (len(values) - 1) * q
        low, high = values[math.floor(at)], values[math.ceil(at)]
        out.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and all(x == y or x == pytest.approx(y, rel=1e-12) or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b)))


@pytest.mark.parametrize("most", [0, None])
def test_quantiles_of_groups_and_of_all(sdf, frame, most):
    found = {r["g"]: r for r in quantiles.quantiles(sdf, ["x", "y"], SHARES, ["g"], most=most).collect()}
    assert set(found) == {"hot", "cold", "none", None}
    for g, r in found.items():
        own = frame[frame["g"].isna() if g is None else frame["g"] == g]
        assert same(r["x"], expected(own["x"])) and same(r["y"], expected(own["y"]))
    whole = quantiles.quantiles(sdf, ["x", "y"], SHARES, most=most).collect()
    assert len(whole) == 1 and same(whole[0]["x"], expected(frame["x"])) and same(whole[0]["y"], expected(frame["y"]))


@pytest.mark.parametrize("most", [0, None])
def test_quantiles_of_the_sessions_before(sdf, frame, most):
    found = {(r["g"], r["session"]): r["x"] for r in quantiles.quantiles(sdf, ["x"], SHARES, ["g"], ahead=("session", 3), most=most).collect()}
    for g in ("hot", "cold", None, "none"):
        own = frame[frame["g"].isna() if g is None else frame["g"] == g]
        for session in range(2, 10):
            assert same(found[g, session], expected(own[own["session"].between(session - 3, session - 1)]["x"]))


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    for most in (0, None):
        assert quantiles.quantiles(none, ["x"], [0.5], ["g"], most=most).collect() == []
        assert [r["x"] for r in quantiles.quantiles(none, ["x"], [0.5], most=most).collect()] == [None]


def test_ranges_bound_what_a_task_sees(spark, monkeypatch):
    """All rows in one group: of the ranges that are looked at again, none has more than its share of the rows."""
    sdf = spark.range(0, 40_000, 1, 4).withColumn("x", F.hash("id") % 20_000 + F.rand(1))
    cuts = sdf.agg(F.percentile_approx("x", F.array(*[F.lit(k / 64) for k in range(1, 64)]), F.lit(10_000))).first()[0]
    sizes = [r["count"] for r in sdf.groupBy(quantiles.range_of(F.col("x"), cuts)).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 40_000 / 64
    monkeypatch.setattr(quantiles, "RANGES", 64)
    values = np.sort([r["x"] for r in sdf.select("x").collect()])
    found = quantiles.quantiles(sdf, ["x"], [0.3, 0.7], most=0).first()["x"]
    assert found == pytest.approx([np.quantile(values, 0.3), np.quantile(values, 0.7)])


def test_bins_and_thresholds_by_ranges(spark, sdf, monkeypatch):
    ways = []
    for most in (0, 500_000):
        monkeypatch.setattr(quantiles, "MOST", most)
        bins = buckets.qcut(sdf.filter("abs(x) < 10"), "x", 5, ["g"]).groupBy("g", "bin").count().collect()
        prior = buckets.prior_quantiles(sdf.filter("abs(x) < 10").withColumnRenamed("session", "Date"), "x", [0.3, 0.8], bucket="g")
        ways.append((sorted(map(tuple, bins), key=str), sorted((r["Date"], str(r["g"]), round(r["q0"], 12), round(r["q1"], 12)) for r in prior.collect())))
    assert ways[0] == ways[1] and ways[0][1]


def test_ranges_of_values_that_are_no_numbers(spark):
    from tickweave.operators.quantiles import range_of

    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    own = df.select(range_of(F.col("v"), [1.0, 2.0]).alias("r"))
    assert [r.r for r in own.collect()] == [0, 1, 2, 2, 2, 0]
    assert "lambda" not in own._jdf.queryExecution().toString()
