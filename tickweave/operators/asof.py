"""Point-in-time joins, composed of one union and one window: one shuffle by the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import clock, micros, micros_of_day


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], time: str, values: list[str], strict: bool = True, tolerance_us: int | None = None, seq: str | None = None, age: str | None = None, stretch_us: int | None = None) -> DataFrame:
    """left with the values of the last right row before (strict) or not after its time, within tolerance.

    At equal times right rows sort after left ones if strict, before them if not. Ties among right rows go by
    seq. All left rows stay; their values are null where nothing qualifies.

    stretch_us: for keys that may hold very many rows. A key's time is then cut into stretches of that length, a task each; what a stretch
    leaves behind (one row) is carried over the stretches after it.
    """
    side = 1 if strict else -1
    tie = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    none = F.lit(None)
    packed = F.struct(F.col(time).alias("_at"), *values)
    both = left.select(*on, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct("*").alias("_row"), none.cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_hit")).unionByName(
        right.select(*on, F.col(time).alias("_t"), F.lit(side).alias("_side"), tie.alias("_tie"), packed.alias("_hit")), allowMissingColumns=True)
    cut = [] if stretch_us is None else ["_stretch"]
    both = both if stretch_us is None else both.withColumn("_stretch", F.floor(micros("_t") / stretch_us))
    w = Window.partitionBy(*on, *cut).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).filter("_side = 0")
    if cut:
        # Every stretch that has left rows gets what the one before it with right rows has left; a row a key and stretch.
        names = [*on, *cut]
        stretches = both.groupBy(*names).agg(F.max_by("_hit", F.when(F.col("_side") != 0, F.struct("_t", "_tie"))).alias("_last"))
        earlier = Window.partitionBy(*on).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = stretches.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null")
        same = F.lit(True)
        for i, c in enumerate(names):
            same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
        out = out.join(carried, same, "left").withColumn("_hit", F.coalesce("_hit", "_carried"))
    gap = micros("_t") - micros("_hit._at")
    ok = F.lit(True) if tolerance_us is None else gap <= tolerance_us
    found = [F.when(ok, F.col(f"_hit.{v}")).alias(v) for v in values]
    return out.select("_row.*", *found, *([F.when(ok, gap).alias(age)] if age else []))


def asof_market(left: DataFrame, right: DataFrame, date: str, time: str, values: list[str], tolerance_us: int, bucket_us: int = 60_000_000, age: str = "quote_age_us", seq: str | None = None) -> DataFrame:
    """As-of join without an entity key, at or before, within tolerance; sessions are split into buckets of
    time so that one session isn't one task. Right rows are copied to the buckets that their tolerance reaches. Of those at one time the last by seq counts.
    """
    reach = -(-tolerance_us // bucket_us)
    bucket = lambda df: df.withColumn("_b", F.floor(micros(time) / bucket_us))
    spread = bucket(right.select(date, time, *values, *([seq] if seq and seq not in values else []))).withColumn("_b", F.explode(F.sequence(F.col("_b"), F.col("_b") + reach)))
    return asof_backward(bucket(left), spread, [date, "_b"], time, values, strict=False, tolerance_us=tolerance_us, seq=seq, age=age).drop("_b")


def asof_clock(quotes: DataFrame, date: str, time: str, value: str, at: str = "13:30", max_age_s: int = 60, seq: str = "seq") -> DataFrame:
    """Per session the last value at or before a time of day, null if older than max_age_s."""
    early = quotes.filter(micros_of_day(time) <= clock(at))
    last = early.groupBy(date).agg(F.max_by(F.struct(F.col(time).alias("t"), F.col(value).alias("v")), F.struct(time, seq)).alias("x"))
    return last.select(date, F.when(F.lit(clock(at)) - micros_of_day("x.t") <= max_age_s * 1_000_000, F.col("x.v")).alias(f"{value}_close"))


def future_return(events: DataFrame, quotes: DataFrame, date="Date", time="TransTime", mid="mid", tolerance_us: int = 10_000_000, at="13:30", seq="seq", audit: list[str] | None = None) -> DataFrame:
    """Return from the quote at an event to the session's close quote, and in basis points. audit: further columns of the entry quote (contract, source) that come along."""
    entry = asof_market(events, quotes, date, time, [mid, *(audit or [])], tolerance_us, seq=seq)
    close = asof_clock(quotes, date, time, mid, at, seq=seq)
    out = entry.join(close, date, "left")
    move = F.try_divide(F.col(f"{mid}_close"), F.col(mid)) - 1
    return out.withColumns({"txf_to_1330_return": move, "txf_to_1330_bp": move * 10_000})


def join_prefixed(left: DataFrame, right: DataFrame, on: list[str], renames: dict[str, str] | None = None, suffix="_pm", how="left") -> DataFrame:
    """Join in which clashing names of the right side get a suffix."""
    for a, b in (renames or {}).items():
        right = right.withColumnRenamed(a, b)
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, how)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how="left") -> DataFrame:
    """Left join that raises if either side repeats a key."""
    for name, df in (("left", left), ("right", right)):
        if not repeated_keys(df, on).isEmpty():
            raise ValueError(f"the {name} side repeats keys {on}")
    return left.join(right, on, how)


def add_aligned(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Sum of two series over the union of their dates, missing as 0."""
    both = a.select(on, F.col(value).alias("_a")).join(b.select(on, F.col(value).alias("_b")), on, "full")
    return both.select(on, (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias(value))


def compare_tables(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    both = a.select(*on, F.col(value).alias(f"{value}_a")).join(b.select(*on, F.col(value).alias(f"{value}_b")), on, "full")
    return both.withColumn("difference", F.coalesce(f"{value}_a", F.lit(0.0)) - F.coalesce(f"{value}_b", F.lit(0.0)))


def lookup(df: DataFrame, small: DataFrame, on: list[str], max_rows: int = 100_000) -> DataFrame:
    """Left join to a table of thresholds or baselines, broadcast if it is proven small."""
    return df.join(F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small, on, "left")
