"""Column expressions: prices, clocks, buckets, safe arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price below which a tick size holds, and the tick size; above the last, 5.
TICK_BANDS = [(10.0, 0.01), (50.0, 0.05), (100.0, 0.1), (500.0, 0.5), (1000.0, 1.0)]
LAST_TICK = 5.0
#: Coefficients of the volatility clock.
CLOCK = (1.1177218, -1.4889296, 1.3712078)
DAY_SECONDS = 16_200


def tick_size(price: Column) -> Column:
    return reduce(lambda out, band: F.when(price < band[0], band[1]).otherwise(out), reversed(TICK_BANDS), F.lit(LAST_TICK))


def tick_index(price: Column) -> Column:
    """Number of legal ticks from 0 to price, across bands; 0 for a price of 0."""
    out, floor, ticks = None, 0.0, 0
    steps = []
    for top, step in TICK_BANDS:
        steps.append((top, floor, step, ticks))
        ticks += round((top - floor) / step)
        floor = top
    out = F.lit(ticks) + F.round((price - floor) / LAST_TICK)
    for top, low, step, before in reversed(steps):
        out = F.when(price < top, F.lit(before) + F.round((price - low) / step)).otherwise(out)
    return out.cast("long")


def price_of_index(index: Column) -> Column:
    """The legal price at a tick index."""
    floor, ticks, steps = 0.0, 0, []
    for top, step in TICK_BANDS:
        n = round((top - floor) / step)
        steps.append((ticks + n, floor, step, ticks))
        floor, ticks = top, ticks + n
    out = F.lit(floor) + (index - ticks) * LAST_TICK
    for upto, low, step, before in reversed(steps):
        out = F.when(index < upto, F.lit(low) + (index - before) * step).otherwise(out)
    return F.round(out, 2)


def spread_ticks(ask: Column, bid: Column) -> Column:
    """Legal ticks between bid and ask; 0 if either is 0, negative if crossed."""
    return F.when((ask == 0) | (bid == 0), F.lit(0).cast("long")).otherwise(tick_index(ask) - tick_index(bid))


def prev_legal_price(price: Column) -> Column:
    return price_of_index(tick_index(price) - 1)


def vol_time_scale(x: Column) -> Column:
    """Share of a day's volatility that is left when share x of the day is."""
    a, b, c = CLOCK
    return F.sqrt(x) * (a + b * x + c * x * x)


def micros(t: str | Column) -> Column:
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def micros_of_day(t: str | Column) -> Column:
    return micros(t) % 86_400_000_000


def clock(text: str) -> int:
    """Microseconds of the day of "HH:MM[:SS]"."""
    h, m, *s = map(int, text.split(":"))
    return (h * 3600 + m * 60 + (s[0] if s else 0)) * 1_000_000


def remain_seconds(t: str | Column, until: str = "13:25") -> Column:
    """Whole seconds from t to a time of day."""
    return F.floor((F.lit(clock(until)) - micros_of_day(t)) / 1_000_000).cast("long")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b; otherwise (null by default) where b is 0."""
    out = F.try_divide(a, b)
    return out if otherwise is None else F.when(b == 0, F.lit(otherwise)).otherwise(out)


def signed_log(x: Column) -> Column:
    return F.log1p(F.abs(x))


def cut_closed_right(x: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Bin k for edges[k] < x <= edges[k + 1]; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        low = x >= edges[k] if include_lowest and k == 0 else x > edges[k]
        out = F.when(low & (x <= edges[k + 1]), k).otherwise(out)
    return out


def cut_open_ends(x: Column, breaks: list[float]) -> Column:
    """Right-closed bins with open outer ones; null only for null."""
    out = F.lit(len(breaks))
    for k in range(len(breaks) - 1, -1, -1):
        out = F.when(x <= breaks[k], k).otherwise(out)
    return F.when(x.isNotNull(), out)


def cell_id(time_bin: Column, price_bin: Column, missing: int | None = None) -> Column:
    out = time_bin * 10 + price_bin
    return out if missing is None else F.coalesce(out, F.lit(missing))
