"""Rows that only larger tables have, and results much larger than the rows they come from."""

import datetime
import random

import pytest

from tests.test_findings_r03 import START, agrees, events_of, rows_of
from tickweave.streaming import live


def test_f1_a_score_of_no_price_decides_nothing(spark, tmp_path):
    """The candidate of sequence 2 has passed the gate before any valid price: its score isn't known, so neither is whether it enters."""
    path = events_of(spark, tmp_path, [(1, 0, 4, "signup", 9, 3), (2, 60, 4, "error", 0, 5), (3, 70, 4, "error", 14, 9), (4, 80, 4, "error", 8, 10)])
    agrees(spark, "l_gate_score", path)
    assert {s: (r.gate, r.enter) for s, r in rows_of(spark, "l_gate_score", path).items()} == {2: (True, None), 3: (True, True), 4: (True, False)}


def shuffled(spark, run):
    """What run() gives, and how many records its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, quantiles, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    found = run()
    return found, sum(n for stage, n in stages().items() if stage > before)


def slot(k):
    return START + datetime.timedelta(minutes=5 * k)


def ranked(slots, ends, no=()):
    """The rows of day_ranks over (entity, slot, amount): turnover to date, none last, equal ones by name."""
    found = {}
    for e in ends:
        day = {}
        for q, k, amount in slots:
            if k <= e:
                day[q] = round(day.get(q) or 0.0, 9) + amount if amount is not None else day.get(q)
        order = sorted((q for q in day if q not in no), key=lambda q: (day[q] is None, -round(day[q] or 0.0, 4), q))
        found |= {(q, slot(e)): (None if day[q] is None else round(day[q], 4), None if q in no else order.index(q) + 1) for q in day}
    return found


def got(df):
    found = df.collect()
    rows = {(r.QuoteCode, r.TimeSlot): (r.Amount, r.AmountRank_canDayTrade) for r in found}
    assert len(rows) == len(found)
    return rows


KIND = "Date string, QuoteCode string, TimeSlot timestamp, Amount double"


@pytest.mark.parametrize("most", [1 << 24, 150])
def test_f2_trades_are_shuffled_and_not_ranks(spark, monkeypatch, most):
    """Three of 303 entities go on trading, all have a rank at every slot: 36,360 ranks of 660 rows; with few ranks a task the slots are cut."""
    monkeypatch.setattr(live, "RANKS_A_TASK", 303 * 12 if most == 150 else most, raising=False)
    slots = [(f"q{i}", 0, float(i % 40)) for i in range(300)] + [(f"r{i}", k, 0.1 * (i + 1)) for i in range(3) for k in range(120)]
    df = spark.createDataFrame([("d", q, slot(k), a) for q, k, a in slots], KIND)
    rows, records = shuffled(spark, lambda: got(live.day_ranks(df, df.select("Date", "TimeSlot").distinct())))
    assert rows == ranked(slots, range(120)) and len(rows) == 36_360
    assert records < 12_000


def test_f2_stretches_hold_ties_nulls_and_the_ineligible(spark, monkeypatch, tmp_path):
    """Blocks of a few slots, over batches, in both forms of the sink."""
    monkeypatch.setattr(live, "RANKS_A_TASK", 40, raising=False)
    rng = random.Random(4)
    slots = [(q, k, rng.choice([None, 0.0, 0.1, 0.2, 0.3])) for k in range(30) for q in ("a", "b", "ä", "Z", "10", "9", "", "c", "d") if rng.random() < 0.3]
    no = ("b", "9")
    may = spark.createDataFrame([("d", q) for q in {q for q, _, _ in slots} - set(no)], "Date string, QuoteCode string")
    ends = sorted({k for _, k, _ in slots})
    want = ranked(slots, ends, no)
    df = spark.createDataFrame([("d", q, slot(k), a) for q, k, a in slots], KIND)
    assert got(live.day_ranks(df, df.select("Date", "TimeSlot").distinct(), may)) == want
    assert got(live.day_ranks(df, spark.createDataFrame([("d", slot(k)) for k in (3, 4, 17)], "Date string, TimeSlot timestamp"), may)) == ranked(slots, (3, 4, 17), no)
    writers = live.rank_sink(f"{tmp_path}/flat", may), live.rank_sink(f"{tmp_path}/short", may, runs=True)
    for n, (a, b) in enumerate(((0, 11), (11, 12), (12, 30))):
        batch = spark.createDataFrame([("d", q, (slot(k - 1), slot(k)), v) for q, k, v in slots if a <= k < b], "Date string, QuoteCode string, slot struct<start: timestamp, end: timestamp>, Amount double")
        for write in writers:
            write(batch, n)
    assert got(spark.read.parquet(f"{tmp_path}/flat/ranks")) == got(live.sunk_ranks(spark, f"{tmp_path}/short")) == want
