"""Rows that only larger tables have: zero prices, equal times and amounts, sums at a limit."""

import datetime

import pytest

from tests.compare import connect, difference
from tickweave.plans.queries import QUERIES, SQL

START = datetime.datetime(2024, 1, 3, 9)


def events_of(spark, path, rows):
    """A table of events: id, seconds after nine, user, kind, value, lots."""
    own = [(i, START + datetime.timedelta(seconds=s), u, kind, float(v), '{"k": %d}' % k) for i, s, u, kind, v, k in rows]
    spark.createDataFrame(own, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def agrees(spark, name, path):
    assert difference(QUERIES[name](spark, path), connect(path), SQL[name]) is None


def rows_of(spark, name, path):
    """The rows of a query by sequence."""
    return {r["ChannelSeq"]: r for r in QUERIES[name](spark, path).collect()}


def test_f10_a_year_of_one_greatest_return(spark, tmp_path):
    """Every month's greatest return is 0.05, from sums of other lengths, so nothing is regressed on it in 2024."""
    rows = [(s, 0.1 if s == m % 7 else 0.01 * (s + m % 3), datetime.datetime(y, m, 1 + i)) for y in (2023, 2024) for m in range(1, 13) for s in range(7) for i in range(1 + (m if s == m % 7 else 0))]
    rows = [(s, d - (0.001 * x.month if x.year == 2023 and d == 0.1 else 0.0), x) for s, d, x in rows]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    agrees(spark, "j_leak_regression", str(tmp_path))
    found = {r.yr: r for r in QUERIES["j_leak_regression"](spark, str(tmp_path)).collect()}
    assert found["2023"].slope is not None
    assert (found["2024"].days, found["2024"].slope, found["2024"].intercept, found["2024"].corr, found["2024"].k) == (12, None, None, None, None)


def test_f4_a_repeat_does_not_make_its_first_backward(spark):
    from tickweave.operators import filters

    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [("q", 1, at(0))] + [x for i in range(2, 60) for x in (("q", i, at(10 * i + 1)), ("q", i, at(10 * i)))]
    own = filters.ordered_ticks(spark.createDataFrame(rows, "QuoteCode string, ChannelSeq long, TransTime timestamp").coalesce(1), ["QuoteCode"])
    found = sorted((r.ChannelSeq, r.TransTime, r.reject) for r in own.collect())
    assert found[0][2] is None and [x[2] for x in found[1:]] == [None, "repeat"] * 58


def test_f4_sequences_beyond_a_million(spark, tmp_path):
    path = events_of(spark, tmp_path, [(i, i % 1_000_000 * 10 + i // 1_000_000, 1, "view", 5, 3) for i in (7, 14, 1_000_007, 1_000_014, 1_000_020)])
    agrees(spark, "b_ordered_ticks", path)
    got = [r.reject for r in QUERIES["b_ordered_ticks"](spark, path).collect()]
    assert len(got) == 9 and got.count("repeat") == 1


def test_f5_quotes_of_nothing_and_of_one_time(spark, tmp_path):
    """A quote of 0 gives no return; of two at one time the later sequence counts; the close is the last by time."""
    hours = 11 * 3600  # the close is at 20:00
    rows = [(1, 0, 4, "view", 9, 3), (2, 60, 9, "signup", 0, 1), (3, 70, 4, "error", 7, 9), (4, 75, 9, "signup", 5, 1), (5, 75, 9, "signup", 4, 1), (6, 80, 4, "error", 9, 4), (8, hours - 10, 9, "signup", 8, 1), (7, hours - 5, 9, "signup", 6, 1)]
    path = events_of(spark, tmp_path, rows)
    agrees(spark, "c_event_table", path)
    assert {s: r.bp for s, r in rows_of(spark, "c_event_table", path).items()} == {3: None, 6: 5000.0}


def test_f6_quotes_of_nothing_and_of_one_time(spark, tmp_path):
    """The close is at 22:00, the last by time."""
    hours = 13 * 3600
    rows = [(1, 10, 9, "view", 0, 1), (2, 20, 4, "purchase", 9, 3), (3, 30, 9, "view", 5, 1), (4, 30, 9, "view", 4, 1), (5, 40, 4, "purchase", 9, 2), (8, hours - 10, 9, "view", 8, 1), (7, hours - 5, 9, "view", 6, 1)]
    path = events_of(spark, tmp_path, rows)
    agrees(spark, "c_future_return", path)
    assert {s: r.move for s, r in rows_of(spark, "c_future_return", path).items()} == {2: None, 5: 0.5}


def test_f7_a_price_of_nothing_is_no_low(spark, tmp_path):
    path = events_of(spark, tmp_path, [(1, 0, 4, "view", 9, 3), (2, 1, 4, "view", 0, 3), (3, 2, 4, "view", 5, 3), (4, 3, 4, "view", 0, 3)])
    agrees(spark, "d_future_prices", path)
    assert [r.FutureLow for _, r in sorted(rows_of(spark, "d_future_prices", path).items())] == [5.0, 5.0, 5.0, None]


def test_f8_an_open_of_nothing_gives_no_return(spark, tmp_path):
    path = events_of(spark, tmp_path, [(1, 0, 4, "view", 0, 3), (2, 1, 4, "view", 5, 3), (3, 0, 6, "view", 4, 3), (4, 1, 6, "view", 5, 3)])
    agrees(spark, "e_entity_return", path)
    assert {r.QuoteCode: r.ret for r in QUERIES["e_entity_return"](spark, path).collect()} == {4: None, 6: 0.25}


def test_f9_scores_at_a_limit(spark, tmp_path):
    """Scores of exactly 6 (bought) and 8 (sold) are not over these limits, whatever the lots are."""
    rows = [(2 * k + i, k, 4, kind, (limit - 1 + k / 10) * 2, k) for k in range(100) for i, (kind, limit) in enumerate((("purchase", 6), ("error", 8)))]
    path = events_of(spark, tmp_path, rows)
    agrees(spark, "g_score_and_vote", path)
    got = rows_of(spark, "g_score_and_vote", path).values()
    assert not any(r.enter for r in got) and {r.score for r in got} == {6.0, 8.0, None}


def test_f11_equal_turnovers_rank_by_name(spark, tmp_path):
    """Both have traded for 0.3 and 0.6, in different orders of their parts."""
    rows = [(1, 0, 1, "view", 0.1, 1), (2, 301, 1, "view", 0.2, 1), (3, 601, 1, "view", 0.3, 1), (4, 0, 0, "view", 0.3, 1), (5, 301, 0, "view", 0.3, 1), (6, 4000, 1, "view", 1, 1), (7, 90_000, 1, "view", 1, 1)]
    path = events_of(spark, tmp_path, rows)
    agrees(spark, "l_day_ranks", path)
    late = [(r.QuoteCode, r.amount, r["rank"]) for r in QUERIES["l_day_ranks"](spark, path).collect() if r.TimeSlot == START + datetime.timedelta(minutes=15)]
    assert sorted(late) == [("0", 0.6, 1), ("1", 0.6, 2)]


def test_f12_equal_turnovers_share_a_rank(spark, tmp_path):
    """Eleven entities have traded for 0.6, in different orders of its parts: all share the first rank, and seven of them, whose opens differ, may be traded."""
    orders = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.2, 0.3, 0.1), (0.6,)]
    day = 86_400
    rows = [(100 * u + i, 10 * i, u, "view", v, 1) for u in range(11) for i, v in enumerate(orders[u % 4])] + [(5_000 + u, day, u, "view", 20.01 + u / 100, 1) for u in range(11)]
    path = events_of(spark, tmp_path, rows)
    agrees(spark, "d_market_state_of_the_top", path)
    found = QUERIES["d_market_state_of_the_top"](spark, path).collect()
    assert [(r.entities, r.state) for r in found] == [(7, "normal")] and found[0].top == pytest.approx(0.003142857, abs=1e-9)
