"""Exact cases of the operators that look back, carry on or run as streams."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import buckets, events, filters, model, stats, ticks
from tickweave.sources import tables
from tickweave.streaming import live

DAY = datetime.datetime(2024, 1, 5)
at = lambda h, m, s=0, us=0: DAY.replace(hour=h, minute=m, second=s, microsecond=us)


def test_tick_bars_carry_amounts_forward(spark):
    t = spark.createDataFrame([("d", "A", 1, at(9, 1), 10.0), ("d", "A", 2, at(9, 22), 20.0), ("d", "B", 1, at(9, 6), 15.0), ("d", "C", 1, at(13, 21), 9.0)], "Date string, QuoteCode string, ChannelSeq long, TransTime timestamp_ntz, Amount double")
    bars = ticks.amount_rank(ticks.tick_bars(t))
    got = {(r.QuoteCode, r.TimeSlot.strftime("%H:%M")): (r.Amount, r.AmountRank_canDayTrade) for r in bars.collect()}
    assert ("A", "09:00") not in got and got["A", "09:05"] == (10.0, 1) and ("B", "09:05") not in got
    assert got["A", "09:10"] == (10.0, 2) and got["B", "09:10"] == (15.0, 1) and got["A", "09:25"] == (20.0, 1) and got["A", "13:20"] == (20.0, 1)
    assert not any(k[0] == "C" for k in got) and len(got) == 52 + 51


def test_a_live_session_gets_models_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{d}", float(x), float(2 * x + 1) if d < 5 else None) for d in range(6) for x in rng.random(20)]
    df = spark.createDataFrame(rows, "Date string, x double, y double")
    models = model.rolling_ridge(df, ["x"], "y", [3], [1e-9])
    assert {r.Date for r in models.select("Date").distinct().collect()} == {"d1", "d2", "d3", "d4", "d5"}
    live_rows = model.predict(df, models, ["x"], "s").filter("Date = 'd5'").collect()
    assert len(live_rows) == 20 and all(r.s == pytest.approx(2 * r.x + 1, abs=1e-5) for r in live_rows)


def brute_tree(prior: pd.DataFrame, x, y, depth, least, bins, shares):
    """Leaf of (a, b) by the same rules, rows instead of cells."""
    edges = [np.quantile(prior[c], shares) for c in x]
    place = lambda df: [np.array([(e < v).sum() for v in df[c]]) for c, e in zip(x, edges, strict=True)]
    a, b = place(prior)
    v = prior[y].to_numpy()

    def grow(box, level, leaf, out):
        (a0, a1), (b0, b1) = box
        best = None
        for axis, (lo, hi) in enumerate(box if level < depth else ()):
            for cut in range(lo + 1, hi):
                parts = [((a0, cut), (b0, b1)), ((cut, a1), (b0, b1))] if axis == 0 else [((a0, a1), (b0, cut)), ((a0, a1), (cut, b1))]
                own = [v[(a >= p[0][0]) & (a < p[0][1]) & (b >= p[1][0]) & (b < p[1][1])] for p in parts]
                if min(map(len, own)) >= least:
                    gain = sum(o.sum() ** 2 / len(o) for o in own)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, parts
        if best is None:
            out.append((box, leaf))
        else:
            grow(best[1][0], level + 1, 2 * leaf, out)
            grow(best[1][1], level + 1, 2 * leaf + 1, out)
        return out

    leaves = grow(((0, bins), (0, bins)), 0, 1, [])

    def of(df):
        ja, jb = place(df)
        return [next(leaf for ((a0, a1), (b0, b1)), leaf in leaves if a0 <= i < a1 and b0 <= j < b1) for i, j in zip(ja, jb, strict=True)]

    return of


def test_tree_leaves_know_prior_sessions_only(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"Date": np.repeat([f"d{i}" for i in range(4)], 60), "i": range(240), "a": rng.normal(size=240), "b": rng.integers(0, 5, 240).astype(float)})
    pdf["y"] = (pdf.a > 0.3) * 2.0 + (pdf.b > 2) + rng.normal(size=240) / 10
    kw = {"depth": 2, "sessions": 2, "bins": 8, "least_rows": 10}
    leaves = lambda n: {r.i: r.leaf for r in buckets.tree_leaves(spark.createDataFrame(pdf[pdf.Date <= f"d{n}"]), ["a", "b"], "y", **kw).collect()}
    whole, early = leaves(3), leaves(2)
    assert all(whole[i] == leaf for i, leaf in early.items()), "later sessions change nothing"
    assert all(whole[i] is None for i in range(120)), "two sessions before or none"
    shares = [i / 8 for i in range(1, 8)]
    for d in (2, 3):
        prior = pdf[(pdf.Date < f"d{d}") & (pdf.Date >= f"d{d - 2}")]
        own = pdf[pdf.Date == f"d{d}"]
        assert [whole[i] for i in own.i] == brute_tree(prior, ["a", "b"], "y", 2, max(10, 0.05 * len(prior)), 8, shares)(own)
    few = buckets.tree_leaves(spark.createDataFrame(pdf), ["a", "b"], "y", depth=2, sessions=2, bins=8)
    assert few.filter("leaf > 1").isEmpty(), "no leaf of under 200 rows"


def tick_rows(n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for q in ("A", "B"):
        for i in range(n):
            bid = round(20 + rng.normal(), 1)
            lots = None if rng.random() < 0.1 else float(rng.integers(0, 5))
            rows.append(("20240105", q, i, at(9, i // 60, i % 60, int(rng.integers(0, 10**6))), None if rng.random() < 0.1 else round(20 + rng.normal(), 1), lots, int(rng.integers(-1, 2)), int(i < 3 or rng.random() < 0.05), bid, round(bid + int(rng.integers(1, 4)) * 0.1, 1), 20.0))
    return rows


TICK = "Date string, QuoteCode string, ChannelSeq long, TransTime timestamp, FillPrice double, FillLots double, InOut int, TrialMatch int, BidPrice1 double, AskPrice1 double, RefPrice double"


def batches_of(spark, tmp_path, parts, schema=TICK):
    """A stream of one micro-batch for each list of rows."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            os.makedirs(tmp_path / "in", exist_ok=True)
            os.rename(f, tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_tick_state_of_many_batches_equals_the_batch_operators(spark, tmp_path):
    rows = tick_rows()
    t = spark.createDataFrame(rows, TICK).withColumn("us", F.unix_micros("TransTime"))
    own = ticks.recent_ticks(ticks.spread_pairs(ticks.differences(ticks.lots_at_record(ticks.price_path(t)))), 30)
    own = ticks.stop_hits(own.withColumn("candidateEvent", F.coalesce(ticks.candidate_event(), F.lit(False))))
    names = ["Open", "RecentFillPrice", "RecordLow", "RecordHigh", "FillLots_atLow", "FillLots_atHigh", "BidPreMove", "SpreadMove", "SpreadPairBid", "SpreadPairAsk", "SpreadPairElapsed", "MD_ElaspeTime_30", "MD_L1Rate_30", "candidateEvent", "stoppedOutToday"]
    want = {(r.QuoteCode, r.ChannelSeq): r for r in own.collect()}
    parts = [[r for r in rows if a <= r[2] < b] for a, b in ((0, 17), (17, 18), (18, 60), (60, 90))]
    late = [parts[0][1], (*parts[0][2][:2], 95, parts[0][2][3], *parts[0][2][4:])]  # a sequence that has come, and a new one of a time gone by
    stream = live.tick_state(batches_of(spark, tmp_path, [*parts, late]), late="1 day")
    got = live.drain(stream, str(tmp_path / "out"), str(tmp_path / "log")).collect()
    assert sorted(r.reject for r in got if r.reject) == ["backward", "backward"]
    fine = [r for r in got if r.reject is None]
    assert len(fine) == len(rows)
    for r in fine:
        for c in names:
            a, b = r[c], want[r.QuoteCode, r.ChannelSeq][c]
            if c.startswith("FillLots"):
                a, b = a or 0.0, b or 0.0  # without any lots yet: none
            if c == "stoppedOutToday":
                b = bool(b)
            assert a == (b if a is None or b is None or isinstance(b, bool) else pytest.approx(b, abs=1e-9)), (c, r.QuoteCode, r.ChannelSeq, a, b)


@pytest.mark.parametrize("seed", [1, 2])
def test_tick_state_of_entities_that_pause(spark, tmp_path, seed):
    """Random splits of random ticks: entities stay away for several batches, the first among them, and sessions end in between."""
    rng = random.Random(seed)
    rows = []
    for day in ("20240105", "20240106"):
        shift = datetime.timedelta(days=int(day[-1]) - 5)
        for i in range(70):
            if rng.random() < 0.9:
                q, price = rng.choice("AAABCD"), rng.randint(90, 110) / 10
                rows.append((day, q, i, at(9, 0, 0) + shift + datetime.timedelta(seconds=20 * i), price, float(rng.randint(0, 4)), rng.choice([-1, 0, 1]), int(rng.random() < 0.2), price - 0.05 * rng.randint(0, 3), price + 0.05, 10.0))
    t = spark.createDataFrame(rows, TICK).withColumn("us", F.unix_micros("TransTime"))
    own = ticks.recent_ticks(ticks.spread_pairs(ticks.differences(ticks.lots_at_record(ticks.price_path(t)))), 30)
    own = ticks.stop_hits(own.withColumn("candidateEvent", F.coalesce(ticks.candidate_event(), F.lit(False))))
    names = ["Open", "RecentFillPrice", "RecordLow", "RecordHigh", "BidPreMove", "SpreadMove", "SpreadPairBid", "SpreadPairAsk", "SpreadPairElapsed", "MD_ElaspeTime_30", "MD_L1Rate_30", "candidateEvent", "stoppedOutToday"]
    want = {(r.Date, r.QuoteCode, r.ChannelSeq): [r[c] for c in names] for r in own.collect()}
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 6)), len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    parts[1] = [r for r in parts[1] if r[1] != "A"] or parts[1][:1]  # the state of the first batch has no tick in the second
    kept = {(r[0], r[1], r[2]) for p in parts for r in p}
    sink = str(tmp_path / "sink")
    live.drain(live.tick_state(batches_of(spark, tmp_path, parts)), sink, str(tmp_path / "log"), live.tick_sink(sink))
    assert live.sunk(spark, sink, "rejects").count() == 0
    got = {(r.Date, r.QuoteCode, r.ChannelSeq): [r[c] for c in names] for r in live.sunk(spark, sink, "ticks").collect()}
    assert set(got) == kept
    whole = set(want) == kept
    for k, values in got.items():
        if whole or k[1] != "A":
            for c, a, b in zip(names, values, want[k]):
                b = bool(b) if c == "stoppedOutToday" else b
                assert a == (b if a is None or b is None or isinstance(b, bool) else pytest.approx(b, abs=1e-9)), (c, k, a, b)


def test_tick_state_is_kept_while_an_entity_pauses(spark, tmp_path):
    row = lambda q, i, minute, price: ("20240105", q, i, at(9, minute), price, 1.0, 1, 0, price - 0.1, price, 10.0)
    parts = [[row("A", 1, 0, 5.0), row("B", 1, 0, 7.0)], [row("B", 2, 1, 7.5)], [row("B", 3, 2, 7.0)], [row("A", 2, 3, 9.0), row("B", 4, 3, 8.0)]]
    found = {(r.QuoteCode, r.ChannelSeq): r for r in live.drain(live.tick_state(batches_of(spark, tmp_path, parts)), str(tmp_path / "out"), str(tmp_path / "log")).collect()}
    assert (found["A", 2].Open, found["A", 2].RecordLow, found["A", 2].BidPreMove) == (5.0, 5.0, pytest.approx(4.0))
    assert len(found) == 6


def test_null_lots_leave_the_running_volume_alone():
    row = lambda i, lots: ("A", i, pd.Timestamp(at(9, 0, i)), 10.0, lots, -1, 0, 9.9, 10.0, 10.0, i * 10**6)
    t = pd.DataFrame([row(0, 5.0), row(1, None), row(2, 5.0), row(3, 5.0)], columns=["QuoteCode", "ChannelSeq", "TransTime", "FillPrice", "FillLots", "InOut", "TrialMatch", "BidPrice1", "AskPrice1", "RefPrice", "us"])
    out, state = live.advance(t, None)
    assert out.FillLots_atLow.tolist() == [-5, -5, -10, -15] and state["lots_low"] == -15
    trial = t.assign(TrialMatch=1)
    assert live.advance(trial, None)[0].RecordLow.isna().all() and not live.advance(trial.assign(FillPrice=20.0), None)[0].stoppedOutToday.any()


def test_ranks_of_the_day_to_date_over_batches(spark, tmp_path):
    row = lambda q, i, when, amount, trial=0: ("20240105", q, i, when, amount, 1.0, 1, trial, 1.0, 1.1, 1.0)
    parts = [[row("A", 1, at(9, 1), 100.0), row("B", 1, at(9, 2), 60.0), row("B", 2, at(9, 3), 500.0, 1)], [row("B", 3, at(9, 8), 70.0)], [row("A", 2, at(9, 31), 1.0)], [row("A", 3, at(11, 0), 1.0)]]
    path = str(tmp_path / "ranks")
    live.drain(live.turnover_5min(batches_of(spark, tmp_path, parts)), path, str(tmp_path / "log"), live.rank_sink(path))
    got = {(r.QuoteCode, r.TimeSlot.strftime("%H:%M")): (r.Amount, r.AmountRank_canDayTrade) for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert got == {("A", "09:05"): (100.0, 1), ("B", "09:05"): (60.0, 2), ("A", "09:10"): (100.0, 2), ("B", "09:10"): (130.0, 1), ("A", "09:35"): (101.0, 2), ("B", "09:35"): (130.0, 1)}


def test_ranks_read_what_was_carried_over_and_no_more(spark, tmp_path):
    """Every batch brings a slot of each entity; ranks equal those of all slots, a new writer (a restart) goes on, and a batch's plan reads its own slots and one carry."""
    rng = random.Random(9)
    slots = [(q, k, rng.randint(1, 50)) for k in range(8) for q in "ABCD" if rng.random() < 0.8]
    path, frames = str(tmp_path / "sink"), []
    kind = "Date string, QuoteCode string, slot struct<start: timestamp, end: timestamp>, Amount double"
    write = live.rank_sink(path)
    for k in range(8):
        rows = [("20240105", q, (at(9, 5 * s), at(9, 5 * s + 5)), float(a)) for q, s, a in slots if s == k]
        if k == 5:
            write = live.rank_sink(path)
        write(spark.createDataFrame(rows, kind), k)
        if k == 6:
            write(spark.createDataFrame(rows, kind), k)
        frames.append(len(list((tmp_path / "sink" / "carry" / f"batch={k}").rglob("*.parquet"))))
    want = {}
    for k in range(8):
        day = {}
        for q, s, a in slots:
            if s <= k:
                day[q] = day.get(q, 0) + a
        if any(s == k for _, s, _ in slots):
            for rank, q in enumerate(sorted(day, key=lambda q: (-day[q], q)), 1):
                want[q, k] = (day[q], rank)
    got = {(r["QuoteCode"], r["TimeSlot"].minute // 5 - 1 + 12 * (r["TimeSlot"].hour - 9)): (r["Amount"], r["AmountRank_canDayTrade"]) for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert got == want and max(frames) <= 4


def test_opening_state_weighs_entities_alike(spark, tmp_path):
    row = lambda day, q, i, when, price, trial=0: (day, q, i, when, price, 1.0, 1, trial, 1.0, 1.1, 100.0)
    next_day = lambda d, *a: at(*a) + datetime.timedelta(days=d)
    rows = [row("d1", "A", 1, at(9, 0, 1), 99.0, 1), row("d1", "A", 2, at(9, 0, 2), 102.0), row("d1", "A", 3, at(9, 0, 3), 90.0), row("d1", "A", 4, at(9, 0, 4), 90.0), row("d1", "B", 1, at(9, 0, 5), 100.0), row("d1", "C", 1, at(9, 0, 5), 50.0), row("d1", "B", 2, at(9, 0, 20), 10.0),
            row("d2", "C", 1, next_day(1, 9, 0, 1), 100.0), row("d3", "A", 1, next_day(5, 9, 0, 1), 100.0)]
    prior = spark.createDataFrame([(d, q, 1 if q != "C" else 200, True) for d in ("d1", "d2", "d3") for q in "ABC"], "Date string, QuoteCode string, day_amount_rank int, eligible boolean")
    got = {r.Date: (r.topOpen, r.entities, r.state) for r in live.drain(live.opening_state(batches_of(spark, tmp_path, [rows]), prior), str(tmp_path / "out"), str(tmp_path / "log")).collect()}
    assert got["d1"] == (pytest.approx(0.01), 2, "normal") and got["d2"] == (None, 0, "undecided")


def test_qcut_keeps_rows_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), ("a", None)], "g string, v double")
    assert sorted(((r.g or "", r.v or 0), r.bin) for r in buckets.qcut(df, "v", 2, ["g"]).collect()) == [(("", 1.0), 0), (("", 2.0), 1), (("a", 0), None), (("a", 1.0), 0)]


def test_whitelist_turns_away_names_of_the_future():
    for name in ("Close", "FutureHigh", "txf_to_1330_bp", "residual_TakerSell_CloseBP", "x_net", "x_netM", "z", "idio_bp"):
        with pytest.raises(ValueError):
            filters.whitelist([name], [name])
    assert filters.whitelist(["ToRef", "PreviousClosePrice", "x_net_pred"], ["ToRef", "PreviousClosePrice", "x_net_pred", "gone"]) == ["ToRef", "PreviousClosePrice", "x_net_pred"]


def test_ecdf_and_ranks_with_one_hot_value(spark):
    values = [5.0] * 300 + [float(x) for x in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    s = pd.Series(values, dtype=float)
    got = stats.average_rank(df, "v").toPandas().set_index("k")["rank"].sort_index()
    assert np.allclose(got.dropna(), s.rank().dropna()) and got.isna().sum() == 1
    e = stats.ecdf(df, "v", "k").toPandas().sort_values(["v", "k"])
    assert np.allclose(e.ecdf, np.arange(500) / 500)


def test_parameters_without_a_block_are_refused(spark, tmp_path):
    one = spark.range(1).select(F.struct(F.create_map(F.lit("a"), F.lit(1.0)).alias("coefficients"), F.lit(1.0).alias("intercept"), F.lit(None).cast("double").alias("threshold")).alias("normal_model"))
    with pytest.raises(ValueError):
        tables.write_params(one, str(tmp_path / "p"))
    for name in ("normal_model_M", "abnormal_model", "abnormal_model_M"):
        one = one.withColumn(name, F.col("normal_model"))
    with pytest.raises(ValueError):
        tables.write_params(one, str(tmp_path / "p"))


def test_session_files_by_name(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "s").mkdir()
    for name in ("20240105_tick", "20240108_tick"):
        (tmp_path / "s" / f"{name}.parquet").write_bytes(next((tmp_path / "x").glob("*.parquet")).read_bytes())
    assert {r.Date: r["count"] for r in tables.scan_sessions(spark, str(tmp_path / "s")).groupBy("Date").count().collect()} == {"20240105": 3, "20240108": 3}


def test_event_table_is_one_plan(spark):
    tick = "Date string, QuoteCode string, ChannelSeq long, TransTime timestamp_ntz, BidPrice1 double, AskPrice1 double"
    data = spark.createDataFrame([("d", "A", i, at(9, 1, i), 10.0 + i % 2, 10.1 + i % 2 + (i % 3) / 10) for i in range(6)], tick)
    features = data.drop("TransTime").withColumn("FillLots_atLow", F.lit(-1.0))
    pre = spark.createDataFrame([("d", "A", 9.5, "X")], "Date string, QuoteCode string, ClosePrice double, nextday_allow_day_trade_mark string")
    bars = spark.createDataFrame([("d", "A", at(9, 1, 2), 1), ("d", "A", at(9, 1, 3), 2)], "Date string, QuoteCode string, TimeSlot timestamp_ntz, AmountRank_canDayTrade int")
    quotes = spark.createDataFrame([("d", at(9, 1, 0), 100.0, 1), ("d", at(13, 29, 30), 101.0, 2)], "Date string, TransTime timestamp_ntz, mid double, seq long")
    out = events.event_table(data, features, pre, bars, quotes).orderBy("ChannelSeq").collect()
    moved = [i for i in range(1, 6) if abs(i % 3 - (i - 1) % 3) > 0]
    assert [r.ChannelSeq for r in out] == moved and all(r.PreviousClosePrice == 9.5 and r.FillLots_atLow == -1 for r in out)
    assert [r.AmountRank_canDayTrade for r in out] == [None if i <= 2 else 1 if i == 3 else 2 for i in moved]
    assert all(r.txf_to_1330_bp == pytest.approx(100.0) and r.quote_age_us == r.ChannelSeq * 10**6 for r in out)
