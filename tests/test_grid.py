"""Threshold grids with position limits against pandas, one combination at a time."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import buckets, grid


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(7)
    n = 9_000
    df = pd.DataFrame({"Date": np.sort(rng.choice([f"2024010{d}" for d in range(1, 9)], n)), "QuoteCode": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcde"), n)), "a": rng.normal(size=n).round(2), "b": rng.normal(size=n).round(2), "BidPrice1": rng.integers(10, 200, n) / 10, "y": rng.normal(20, 30, n), "lots": rng.integers(5, 60, n).astype(float), "ok": rng.random(n) < 0.8, "bucket": rng.choice(["u", "v"], n)})
    df["ChannelSeq"] = np.arange(n)
    df["TransTime"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(df["ChannelSeq"] // 3, unit="s")
    df.loc[rng.random(n) < 0.02, "a"] = None
    df.loc[rng.random(n) < 0.02, "BidPrice1"] = None
    df.loc[rng.random(n) < 0.02, "y"] = None
    return df


def limits(df, col, q, bucketed):
    days, out = sorted(df["Date"].unique()), {}
    for i, d in enumerate(days):
        own = df[df["Date"].isin(days[max(0, i - 3) : i])]
        for b in df["bucket"].unique() if bucketed else [None]:
            values = (own if b is None else own[own["bucket"] == b])[col].dropna()
            if len(values):
                out[d, b] = np.quantile(values, q)
    return [out.get((d, b if bucketed else None), np.nan) for d, b in zip(df["Date"], df["bucket"])]


def test_grid_with_limits_of_its_own_for_each_combination(spark, events):
    shares_a, shares_b = [0.2, 0.6], [0.5, 0.3]
    sdf = spark.createDataFrame([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if pd.isna(x) else x for x in r) for r in events.astype(object).itertuples(index=False)], "Date string, QuoteCode string, a double, b double, BidPrice1 double, y double, lots double, ok boolean, bucket string, ChannelSeq long, TransTime timestamp").repartition(5)
    period = F.when(F.col("Date") <= "20240104", "first").when(F.col("Date") <= "20240107", "second")
    found = buckets.evaluate_grid(sdf, {"ab": ("a", "b"), "ba": ("b", "a")}, "y", shares_a, shares_b, {"none": F.lit(True), "high": F.col("y") > 10}, period, rules=F.col("ok"), lots=F.col("lots"), limit=40.0005, least=60, bucket="bucket").collect()
    got = {(r["source"], r["bucketed"], r["q_a"], r["q_b"], r["floor"], r["period"]): r for r in found}
    want = 0
    for source, (x, y) in {"ab": ("a", "b"), "ba": ("b", "a")}.items():
        for bucketed in (False, True):
            for qa in shares_a:
                for qb in shares_b:
                    for floor in ("none", "high"):
                        hit = (events[x] > limits(events, x, qa, bucketed)) & (events[y] > limits(events, y, qb, bucketed)) & events["BidPrice1"].notna()
                        hit &= (events["y"] > 10) if floor == "high" else True
                        for per, lo, hi in (("first", "20240101", "20240104"), ("second", "20240105", "20240107")):
                            m = events[hit & events["Date"].between(lo, hi)].sort_values(["Date", "QuoteCode", "TransTime", "ChannelSeq"])
                            key = (source, bucketed, qa, qb, floor, per)
                            groups = m.groupby(["Date", "QuoteCode"])["BidPrice1"]
                            kept = m[(groups.cumcount() + 1 < m["lots"]) & (groups.cumsum() / 10 < 40.0005) & m["ok"]]
                            if len(m) < 60 or not len(kept):
                                assert key not in got
                                continue
                            want += 1
                            r, pnl = got[key], (kept["BidPrice1"] * (kept["y"] - 19.3) / 1e5).fillna(0)
                            daily = pnl.groupby(kept["Date"]).sum()
                            assert (r["signals"], r["trades"], r["days"]) == (len(m), len(kept), kept["Date"].nunique())
                            assert r["pnl"] == pytest.approx(pnl.sum()) and r["capw_bp"] == pytest.approx(pnl.sum() / (kept["BidPrice1"] / 10).sum() * 1e4) and r["win_day"] == pytest.approx((daily > 0).mean())
                            if len(daily) > 1:
                                assert r["sharpe"] == pytest.approx(daily.mean() / daily.std() * math.sqrt(240))
    assert want == len(got) > 20


def test_grid_of_an_empty_table(spark, events):
    sdf = spark.createDataFrame(events.head(3)).limit(0)
    assert buckets.evaluate_grid(sdf, {"ab": ("a", "b")}, "y", [0.5], [0.5], {"none": F.lit(True)}, F.lit("p")).collect() == []


@pytest.mark.parametrize("few", [3, 10_000])
def test_edges_of_every_model_are_exact(spark, monkeypatch, few):
    """Scores of very unequal density, ties and invalid features; ranges are split again until few rows are left."""
    monkeypatch.setattr(grid, "FEW", few)
    rng = np.random.default_rng(3)
    n = 5_000
    df = pd.DataFrame({"Date": rng.choice(["d1", "d2", "d3"], n), "ab": rng.integers(0, 2, n), "x": np.exp(rng.normal(0, 6, n)), "z": rng.integers(0, 3, n).astype(float), "y": rng.normal(size=n)})
    df.loc[:50, "x"] = np.nan
    models = pd.DataFrame([(d, ab, w, al, f, float(c)) for d in ("d1", "d2") for ab in (0, 1) for w in (20, 60) for al in (0.1, 1.0) for f, c in (("x", rng.normal() * (al > 0.5)), ("z", rng.normal()), ("", rng.normal()))], columns=["Date", "ab", "n_training_days", "alpha", "feature", "coef"])
    sdf = spark.createDataFrame(df).repartition(3)
    scorer = grid.Scorer(spark.createDataFrame(models), ["x", "z"], "Date", "ab")
    own = grid._prepared(sdf, ["x", "z"], "Date", "ab").withColumn("_y", F.col("y"))
    edges = grid.exact_edges(own, scorer, 5)
    sums = grid.bin_ends(own, scorer, edges)
    assert set(edges) == set(range(8)) == set(sums)
    coef = {k: g.set_index("feature")["coef"] for k, g in models.groupby(["Date", "ab", "n_training_days", "alpha"])}
    for c, (w, al) in enumerate(scorer.combos):
        for ab in (0, 1):
            part = df[(df["ab"] == ab) & df["Date"].isin(["d1", "d2"]) & df["x"].notna()]
            s = np.array([r.x * (m := coef[r.Date, ab, w, al])["x"] + r.z * m["z"] + m[""] for r in part.itertuples()])
            want = np.quantile(s, [0, 0.2, 0.4, 0.6, 0.8, 1])
            assert edges[ab * 4 + c] == pytest.approx(want.tolist(), rel=1e-9)
            if al > 0.5:
                top, bottom = s > want[-2], s <= want[1]
                assert sums[ab * 4 + c] == pytest.approx((top.sum(), part["y"][top].sum(), bottom.sum(), part["y"][bottom].sum()))


def test_limits_of_entity_and_session_for_every_model(spark):
    rng = np.random.default_rng(8)
    n = 6_000
    df = pd.DataFrame({"Date": np.sort(rng.choice(["d1", "d2"], n)), "ab": 0, "x": rng.normal(size=n), "QuoteCode": rng.choice(["hot", "hot", "a", "b", "c"], n), "price": rng.integers(10, 300, n) / 10, "y": rng.normal(20, 40, n), "seq": np.arange(n)})
    df["ab"] = (df["Date"] == "d2").astype(int)
    models = pd.DataFrame([(d, ab, w, 0.1, f, c) for d, ab in (("d1", 0), ("d2", 1)) for w, k in ((20, 1.0), (60, -1.0), (90, 0.0)) for f, c in (("x", k), ("", 0.0))], columns=["Date", "ab", "n_training_days", "alpha", "feature", "coef"])
    found = grid.param_metrics(spark.createDataFrame(df).repartition(4), spark.createDataFrame(models), ["x"], "y", "ab", least=(0.30001, 0.2), entity_limit=300.0005, session_limit=850.0005, order=("seq", "seq"), price="price", stretch_us=700)
    got = {r["n_training_days"]: r for r in found.collect()}
    for w, k in ((20, 1.0), (60, -1.0)):
        m = df[(df["x"] * k > np.where(df["ab"] == 0, 0.30001, 0.2)) & (df["price"] < 1000)]
        g = m.groupby(["Date", "QuoteCode"])["price"]
        m = m[~((g.cumcount() + 1 > 1) & (g.cumsum() / 10 > 300.0005))]
        m = m[(m.groupby("Date")["price"].cumsum() / 10).round(6) <= 850.0005]
        daily = (m["price"] * (m["y"] - 19.3) / 10).groupby(m["Date"]).sum()
        assert got[w]["trades"] == len(m) > 100 and got[w]["total"] == pytest.approx(daily.sum() / 10_000)
        down = daily.cumsum() - daily.cumsum().cummax()
        assert got[w]["mdd"] == pytest.approx(down.min() / 10_000) and got[w]["time_to_high"] == (down < 0).sum()
    assert got[90]["trades"] is None and got[90]["top_mean"] is None


def test_a_grid_finds_the_quantiles_of_a_score_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tickweave.operators import buckets

    asked, found = [], buckets.prior_quantiles
    monkeypatch.setattr(buckets, "prior_quantiles", lambda *a, **k: asked.append(a[1]) or found(*a, **k))
    df = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("Date"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"), F.lit("k").alias("b"))
    buckets.sweep_grid(df, {"p": ("x", "y"), "t": ("y", "x")}, "x", [0.3], [0.6], {"all": F.lit(True)}, F.lit("one"), bucket="b")
    assert sorted(asked) == ["x", "x", "y", "y"]
