"""Steps whose cost grew faster than the input, on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from tickweave.operators import buckets, grid, quantiles, stats


def test_f13_few_passes_and_stretches_stay_in_tasks(spark, monkeypatch):
    """Rows go through Python six times at most, no table by stretch is collected, and a session's running total goes on over stretches whatever join Spark turns to."""
    rng = np.random.default_rng(2)
    n = 20_000
    df = pd.DataFrame({"Date": rng.choice(["d1", "d2", "d3"], n), "ab": rng.integers(0, 2, n), "x": rng.normal(size=n), "QuoteCode": rng.integers(0, 400, n), "price": rng.integers(10, 300, n) / 10, "y": rng.normal(20, 40, n), "seq": np.arange(n)})
    models = pd.DataFrame([(d, ab, w, 0.1, f, c) for d in ("d1", "d2", "d3") for ab in (0, 1) for w, k in ((20, 1.0), (60, -1.0)) for f, c in (("x", k), ("", 0.0))], columns=["Date", "ab", "n_training_days", "alpha", "feature", "coef"])
    passes, taken = [], []
    over, collect = Classic.mapInArrow, Classic.collect
    monkeypatch.setattr(Classic, "mapInArrow", lambda self, f, *a, **k: passes.append(f.__name__) or over(self, f, *a, **k))
    monkeypatch.setattr(Classic, "collect", lambda self: taken.append(collect(self)) or taken[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    try:
        found = grid.param_metrics(spark.createDataFrame(df).repartition(4), spark.createDataFrame(models), ["x"], "y", "ab", least=(0.3, 0.2), entity_limit=20.0005, session_limit=900.0005, order=("seq", "seq"), price="price", stretch_us=200)
        got = {r["n_training_days"]: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for w, k in ((20, 1.0), (60, -1.0)):
        m = df[df["x"] * k > np.where(df["ab"] == 0, 0.3, 0.2)]
        g = m.groupby(["Date", "QuoteCode"])["price"]
        m = m[~((g.cumcount() + 1 > 1) & (g.cumsum() / 10 > 20.0005))]
        m = m[(m.groupby("Date")["price"].cumsum() / 10).round(6) <= 900.0005]
        assert got[w]["trades"] == len(m) > 1_000 and got[w]["total"] == pytest.approx((m["price"] * (m["y"] - 19.3) / 10).sum() / 10_000)
    assert len(passes) <= 6 and max(map(len, taken)) < 100  # there are 100 stretches a day


def test_f17_rows_find_their_leaf_without_a_copy_or_a_join(spark):
    """A feature without a value lies under all cuts, one that is no number over all."""
    rng = np.random.default_rng(4)
    rows = [(f"d{i % 4}", i, float(rng.integers(0, 50)), float(i % 9), float(i % 9 > 4)) for i in range(2_000)]
    rows += [("d3", 2_000, 1.0, None, None), ("d3", 2_001, 1.0, float("nan"), None), (None, 2_002, 1.0, 1.0, 1.0)]
    own = buckets.tree_leaves(spark.createDataFrame(rows, "Date string, i long, a double, b double, y double"), ["a", "b"], "y", depth=1, sessions=2, least_rows=20)
    plan = own._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {r.i: r.leaf for r in own.collect()}
    assert len(got) == 2_003 - (2_002 not in got) and got[2_000] == 2 and got[2_001] == 3
    assert all(got[i] == (3 if b > 4 else 2) for day, i, _, b, _ in rows[:2_000] if day == "d3")


def test_f18_rows_are_read_few_times_for_their_ranks(spark, monkeypatch):
    """A table beyond MOST rows is read three times at most (count, bounds, sort), for one period or two, with one value on a third of the rows."""
    monkeypatch.setattr(quantiles, "MOST", 0)
    monkeypatch.setattr(stats, "ROWS_A_PART", 700, raising=False)
    rng = np.random.default_rng(5)
    n = 6_000
    df = pd.DataFrame({"Date": rng.choice(["d1", "d2", "d3", "d4"], n, p=[0.7, 0.1, 0.1, 0.1]), "ChannelSeq": rng.permutation(n), "x": np.where(np.arange(n) % 3 == 0, 0.0, rng.normal(size=n)), "y": rng.integers(0, 5, n).astype(float), "z": rng.normal(size=n)})
    df.loc[::11, "x"], df.loc[::13, "z"] = np.nan, np.inf
    df = pd.concat([df, pd.DataFrame({"Date": ["d5", "d6", "d6"], "ChannelSeq": [n, n + 1, n + 2], "x": [1.0, 1.0, 1.0], "y": [0.0, 0.0, 0.0], "z": [0.0, 0.0, np.inf]})], ignore_index=True)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    own = spark.createDataFrame(df).repartition(4)
    own = own.mapInArrow(counted, own.schema)
    ic = stats.session_ic(own, [("x", "y"), ("z", "x")], 1)
    survived = {r["pair"]: r for r in stats.survival(stats.ic_by_period(ic, F.when(F.col("Date") <= "d2", "one").otherwise("two")), "one", "two").collect()}
    assert read.value <= 3 * len(df)
    got = {(r["Date"], r["pair"]): (r["n"], r["ic"]) for r in ic.collect()}
    means = {}
    for a, b in (("x", "y"), ("z", "x")):
        for day, rows in df[np.isfinite(df[a]) & np.isfinite(df[b])].groupby("Date"):
            ra, rb = (rows.sort_values([c, "ChannelSeq"]).assign(r=np.arange(len(rows)))["r"].reindex(rows.index) for c in (a, b))
            count, found = got.pop((day, f"{a}~{b}"))
            assert count == len(rows) and (found is None if len(rows) == 1 else found == pytest.approx(np.corrcoef(ra, rb)[0, 1], abs=1e-12))
            means.setdefault((f"{a}~{b}", day <= "d2"), []).append(found)
    assert not got
    for pair in ("x~y", "z~x"):
        for name, early in (("a", True), ("b", False)):
            assert survived[pair][name] == pytest.approx(np.mean([v for v in means[pair, early] if v is not None]))
