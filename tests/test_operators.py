"""Operators on hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickweave.functions import columns as C
from tickweave.operators import asof, beta, books, buckets, filters, labels, model, stats, ticks
from tickweave.sources import tables

DAY = dt.date(2024, 1, 5)


def at(text):
    h, m, s = (text + ":00" if text.count(":") == 1 else text).split(":")
    return dt.datetime.combine(DAY, dt.time(int(h), int(m), int(s)))


@pytest.fixture(scope="module")
def quotes(spark):
    rows = [("d", at("08:50"), 0, 20000.0), ("d", at("09:00"), 1, 20000.0), ("d", at("09:00:29"), 2, 20020.0), ("d", at("13:29:59"), 3, 20200.0), ("d", at("13:31"), 4, 22000.0)]
    return spark.createDataFrame(rows, "Date string, TransTime timestamp_ntz, seq long, mid double")


@pytest.mark.parametrize(("when", "tolerance", "age"), [("09:00:30", 10, 1_000_000), ("09:00:34", 10, 5_000_000), ("09:00:34", 2, None)])
def test_future_return(spark, quotes, when, tolerance, age):
    events = spark.createDataFrame([("d", at(when), 7)], "Date string, TransTime timestamp_ntz, id int")
    r = asof.future_return(events, quotes, tolerance_us=tolerance * 1_000_000).first()
    assert r.quote_age_us == age
    assert (r.txf_to_1330_return is None) if age is None else r.txf_to_1330_return == pytest.approx(20200 / 20020 - 1)


def test_factor_return_ends_at_the_close(quotes):
    assert beta.daily_factor_return(quotes).first().factor == pytest.approx(0.01)


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("a", at("09:05"), 1), ("b", at("09:05"), 2), ("c", at("09:00"), 3)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at("09:05"), 5.0), ("a", at("09:04:59"), 4.0), ("b", at("09:05"), 6.0)], "k string, t timestamp_ntz, v double")
    run = lambda strict: {r.id: r.v for r in asof.asof_backward(left, right, ["k"], "t", ["v"], strict).collect()}
    assert run(True) == {1: 4.0, 2: None, 3: None} and run(False) == {1: 5.0, 2: 6.0, 3: None}


def test_asof_market_agrees_without_buckets(spark):
    rows = [("d", at("09:00") + dt.timedelta(seconds=37 * i)) for i in range(60)]
    left = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "Date string, TransTime timestamp_ntz, id int")
    right = spark.createDataFrame([(d, t - dt.timedelta(seconds=i % 9), float(i)) for i, (d, t) in enumerate(rows) if i % 4 == 0], "Date string, TransTime timestamp_ntz, v double")
    small = asof.asof_market(left, right, "Date", "TransTime", ["v"], 100_000_000, bucket_us=30_000_000)
    large = asof.asof_market(left, right, "Date", "TransTime", ["v"], 100_000_000, bucket_us=10**12)
    assert sorted(small.collect(), key=lambda r: r.id) == sorted(large.collect(), key=lambda r: r.id) and small.count() == 60


def test_beta_and_residual_vol(spark):
    factors, rest = [-0.02, -0.01, 0.01, 0.02], [-0.002, 0.002, 0.002, -0.002]
    days = [(f"2024010{i + 1}", "1101", 1.5 * f + e, f) for i, (f, e) in enumerate(zip(factors, rest))]
    own = spark.createDataFrame(days, "Date string, QuoteCode string, ret double, factor double")
    r = beta.rolling_beta(own, 4, 2, 0.0).orderBy(F.desc("Date")).first()
    assert r.beta == pytest.approx(1.5) and r.residual_vol == pytest.approx(0.004 / math.sqrt(3))
    few = beta.rolling_beta(own, 4, 9, 0.0).first()
    assert few.beta == 1.0 and few.residual_vol is None


def test_locked_days_are_dropped(spark):
    own = spark.createDataFrame([("a", 10.0, 11.0, 11.0, 10.0), ("b", 10.0, 10.0, 10.0, 10.0)], "QuoteCode string, open_price double, close_price double, high_price double, low_price double")
    assert [r.QuoteCode for r in beta.entity_daily_return(own).collect()] == ["a"]
    assert beta.entity_daily_return(own.drop("high_price")).count() == 2


def test_volatility_clock(spark):
    want = {"09:15": 0.908, "10:00": 0.696, "11:00": 0.532, "11:30": 0.485, "12:00": 0.447, "12:30": 0.403, "13:00": 0.323, "13:30": 0.0, "09:00": 1.0, "08:30": 1.0, "14:00": 0.0}
    own = spark.createDataFrame([(k, at(k), 1.0) for k in want], "k string, TransTime timestamp_ntz, v double")
    got = {r.k: (r.event_vol, r.RemainSeconds_1330) for r in beta.event_residual_vol(own, "v").collect()}
    assert all(got[k][0] == pytest.approx(v, abs=6e-4) for k, v in want.items()) and got["10:00"][1] == 12_600
    assert beta.event_residual_vol(own.drop("v"), "v").filter("event_vol is not null").count() == 0
    # Minute by minute through the session: it only falls, and lies under the square root of time until the last twenty minutes.
    left = spark.range(271).select((1 - F.col("id") / 270).alias("x"))
    minutes = left.select("x", C.vol_time_scale(F.col("x")).alias("v")).orderBy("x").collect()
    assert all(a.v < b.v for a, b in zip(minutes, minutes[1:]))
    assert all((r.v < math.sqrt(r.x)) == (r.x > 23 / 270) for r in minutes if 0 < r.x < 1)


def test_tick_grid_is_invertible(spark):
    prices = [0.01, 9.99, 10.0, 10.05, 49.95, 50.0, 99.9, 100.0, 499.5, 500.0, 999.0, 1000.0, 1005.0]
    own = spark.createDataFrame([(p,) for p in prices], "p double").select("p", C.price_of_index(C.tick_index(F.col("p"))).alias("back"), C.prev_legal_price(F.col("p")).alias("prev"))
    rows = {r.p: r for r in own.collect()}
    assert all(r.back == p for p, r in rows.items())
    assert rows[10.0].prev == 9.99 and rows[50.0].prev == 49.95 and rows[100.0].prev == 99.9 and rows[1000.0].prev == 999.0
    spread = spark.range(1).select(C.spread_ticks(F.lit(10.05), F.lit(9.99)), C.spread_ticks(F.lit(0.0), F.lit(5.0)), C.spread_ticks(F.lit(5.0), F.lit(5.02))).first()
    assert tuple(spread) == (2, 0, -2)


TICK = "Date string, QuoteCode string, ChannelSeq long, TransTime timestamp_ntz, TrialMatch int, FillPrice double, FillLots double, InOut int, BidPrice1 double, AskPrice1 double, RefPrice double"


@pytest.fixture(scope="module")
def tape(spark):
    t0 = at("09:00")
    rows = [("d", "A", i, t0 + dt.timedelta(seconds=i), int(i < 2), p, 1.0 if p else 0.0, io, b, a, 100.0) for i, (p, io, b, a) in enumerate(
        [(99.0, 1, 99.0, 99.5), (98.0, 1, 99.0, 99.5), (100.0, 1, 99.5, 100.0), (0.0, 0, 99.0, 100.0), (99.0, -1, 98.5, 99.0), (99.0, -1, 98.0, 99.5), (98.5, -1, 98.0, 99.0), (110.0, 1, 98.0, 99.0)])]
    return spark.createDataFrame(rows, TICK)


def test_price_path_and_lots_at_low(tape):
    own = ticks.lots_at_record(ticks.price_path(tape))
    got = {r.ChannelSeq: r for r in own.collect()}
    assert got[1].Open is None and got[2].Open == 100.0 and got[3].RecentFillPrice == 100.0 and got[0].RecordLow is None
    assert [got[i].RecordLow for i in (2, 3, 4, 5, 6, 7)] == [100.0, 100.0, 99.0, 99.0, 98.5, 98.5]
    assert [got[i].FillLots_atLow for i in (4, 5, 6, 7)] == [-1.0, -2.0, -1.0, 0.0]
    ahead = {r.ChannelSeq: r.Open for r in ticks.price_path(tape, lookahead=True).collect()}
    assert set(ahead.values()) == {100.0}


def test_spread_pairs(tape):
    own = {r.ChannelSeq: r for r in ticks.spread_pairs(ticks.differences(tape)).collect()}
    assert own[2].SpreadPairElapsed is None and own[2].SpreadPairID == 0
    assert (own[3].SpreadPairID, own[3].SpreadPairTotalCount, own[3].SpreadPairElapsed) == (1, 1, 0.0)
    assert own[4].SpreadPairElapsed == 1.0 and own[4].SpreadNarrowSide == -1
    assert (own[5].SpreadPairID, own[5].SpreadPairTotalCount, own[5].SpreadPairBid) == (2, 2, 98.0) and own[5].SpreadNarrowSide is None


def test_normalise_order_stop_and_gate(tape, spark):
    assert [r.marketOpen for r in filters.normalize_ticks(tape).orderBy("ChannelSeq").collect()][:3] == [False, False, True]
    twice = tape.unionByName(tape.filter("ChannelSeq = 3"))
    assert filters.ordered_ticks(twice).filter("reject = 'repeat'").count() == 1
    assert [r.ChannelSeq for r in ticks.stop_hits(tape).filter("stoppedOutToday").collect()] == [7]
    gate = filters.gate(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), {"x": F.col("a") > 1, "y": F.col("b") > 1})
    assert [r.passGate for r in gate.orderBy("a").collect()] == [False, True]
    with pytest.raises(ValueError, match="future"):
        filters.whitelist(["a"], ["a", "txf_to_1330_return"])


def test_causality(tape):
    """Features up to a tick don't change when later ticks go."""
    features = lambda t: ticks.recent_ticks(ticks.lots_at_record(ticks.price_path(t)), 3)
    whole, cut = features(tape).filter("ChannelSeq < 5"), features(tape.filter("ChannelSeq < 5"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_labels(spark):
    own = spark.createDataFrame([("d", "A", 100.0, 100.0, 101.0, 109.0, 90.0, 99.0), ("d", "A", 100.0, 100.0, 101.0, 107.0, 95.0, 99.0)], "Date string, QuoteCode string, RefPrice double, BidPrice1 double, AskPrice1 double, FutureHigh double, FutureLow double, Close double")
    short = [r.raw_bp for r in labels.raw_short(own).orderBy("FutureHigh").collect()]
    assert short[0] == pytest.approx(100.0) and short[1] == pytest.approx((100 - 109) / 100 * 1e4)
    net = labels.net(labels.raw_short(own), "raw_bp").agg(F.sum("raw_bp_net")).first()[0]
    assert abs(net) < 1e-9


def test_cuts_and_qcut(spark):
    own = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    closed = [r[0] for r in own.orderBy("x").select(C.cut_closed_right(F.col("x"), [0, 5, 10])).collect()]
    assert closed == [None] + [0] * 5 + [1] * 5
    assert [r.bin for r in buckets.qcut(own, "x", 2).orderBy("x").collect()] == [0] * 6 + [1] * 5
    same = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "x double")
    assert {r.bin for r in buckets.qcut(same, "x", 4).collect()} <= {0, 1}


def test_prior_quantiles_skip_the_first_session(spark):
    own = spark.createDataFrame([(f"d{d}", float(v)) for d in range(4) for v in range(d + 1)], "Date string, x double")
    got = {r.Date: r.q0 for r in buckets.prior_quantiles(own, "x", [0.5], 2).collect()}
    assert "d0" not in got and got["d1"] == 0.0 and got["d2"] == 0.0 and got["d3"] == pytest.approx(1.0)


def test_caps(spark):
    rows = [("d", "A", at("09:00") + dt.timedelta(seconds=i), i, 500.0) for i in range(6)]
    own = spark.createDataFrame(rows, "Date string, QuoteCode string, TransTime timestamp_ntz, ChannelSeq long, BidPrice1 double")
    assert books.cap_after(own, 200.0).count() == 3 and books.cap_after(own, 200.0, F.col("ChannelSeq") > 1).count() == 1
    assert books.cap_first_always(own, 10.0).count() == 1 and books.cap_session(own, 200.0).count() == 4


def test_equity(spark):
    own = spark.createDataFrame([(f"d{i}", float(v), 10.0, 1) for i, v in enumerate([1, -2, -1, 4, -1])], "Date string, pnl double, capital double, trades int")
    got = stats.equity(own).orderBy("Date").collect()
    assert [r.drawdown for r in got] == [0, -2, -3, 0, -1] and [r.under_water for r in got] == [0, 1, 2, 0, 1]
    assert stats.performance(stats.equity(own)).first().mdd == -3


def test_rolling_ridge_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 0.1 * rng.normal(size=60) + 3
    rows = [(f"d{i // 10}", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    own = spark.createDataFrame(rows, "Date string, a double, b double, y double")
    got = {r.feature: r.coef for r in model.rolling_ridge(own, ["a", "b"], "y", [3], [0.5]).filter("Date = 'd4'").collect()}
    xs, ys = x[10:40], y[10:40]
    z, mean, sd = (xs - xs.mean(0)) / xs.std(0), xs.mean(0), xs.std(0)
    want = np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ (ys - ys.mean())) / sd
    assert [got["a"], got["b"]] == pytest.approx(list(want)) and got[""] == pytest.approx(ys.mean() - mean @ want)
    scored = model.predict(own, model.rolling_ridge(own, ["a", "b"], "y", [3], [0.5]), ["a", "b"], "pred")
    assert scored.filter("Date = 'd0' and pred is not null").count() == 0 and scored.filter("Date = 'd5' and pred is null").count() == 0


def test_scores_and_votes(spark):
    own = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double").withColumn("m", F.create_map(F.lit("a"), F.lit(2.0)))
    assert [r[0] for r in own.select(model.linear_score(F.col("m"), F.lit(1.0), ["a", "b"])).collect()] == [3.0, None]
    vote = model.dual_vote(F.lit(5.0), F.lit(5.0), {"normal": (1, 2), "abnormal": (9, 9)}, F.col("s"))
    assert [r[0] for r in spark.createDataFrame([("normal",), ("abnormal",), ("undecided",)], "s string").select(vote).collect()] == [True, False, False]


def test_sources(spark, tmp_path):
    own = spark.createDataFrame([("20240101", 1), ("20240102", 2), ("20240103", 3)], "Date string, v int")
    assert tables.newer_than(own, own.filter("v < 3")).count() == 1 and tables.newer_than(own, own.limit(0)).count() == 3
    path = str(tmp_path / "t")
    tables.merge_write(spark, own, path, [])
    tables.merge_write(spark, own.withColumn("v", F.col("v") * 10), path, ["20240101", "20240102"])
    assert {r.v for r in spark.read.parquet(path).collect()} == {1, 20, 30}
    assert tables.last_sessions(own, 2).count() == 2 and tables.every_kth_session(own, 2).count() == 2
    best = tables.prefer_source({"l1": own.filter("v = 1").withColumn("mid", F.lit(1.0)), "sdk": own.withColumn("last_price", F.lit(2.0))})
    assert {(r.Date, r.source, r.mid) for r in best.collect()} == {("20240101", "l1", 1.0), ("20240102", "sdk", 2.0), ("20240103", "sdk", 2.0)}
    with pytest.raises(ValueError, match="repeats"):
        asof.join_one_to_one(own, own.unionByName(own), ["Date"])


def test_stream_state_equals_batch(spark, tape, tmp_path):
    from tickweave.streaming import live

    path = str(tmp_path / "ticks")
    own = tape.withColumn("TransTime", F.col("TransTime").cast("timestamp"))
    own.coalesce(1).write.parquet(path)
    stream = live.tick_state(live.dedup(spark.readStream.schema(own.schema).parquet(path)), late=None)
    out = live.drain(stream, str(tmp_path / "out"), str(tmp_path / "log")).filter("reject is null")
    got = {r.ChannelSeq: (r.RecordLow, r.FillLots_atLow) for r in out.collect()}
    want = {r.ChannelSeq: (r.RecordLow, r.FillLots_atLow) for r in ticks.lots_at_record(ticks.price_path(tape)).collect()}
    assert got == want
