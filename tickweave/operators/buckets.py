"""Buckets, prior-session quantiles and threshold sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.arrays import codes, group_starts, running
from tickweave.operators.quantiles import quantiles
from tickweave.operators.ticks import session_index


def qcut(df: DataFrame, value: str, k: int, by: list[str] | None = None, out: str = "bin") -> DataFrame:
    """Equal-frequency bins by interpolated quantile edges, equal edges merged, the lowest edge in; null for null values. All rows stay."""
    by = by or []
    edges = quantiles(df, [value], [i / k for i in range(k + 1)], by).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.array_distinct(value).alias("_edges"))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        joined = df.join(F.broadcast(edges) if edges.limit(100_001).count() <= 100_000 else edges, same, "left").drop(*[f"_by_{c}" for c in by])
    else:  # one row
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("_edges")


def prior_quantiles(df: DataFrame, value: str, shares: list[float], n: int = 3, date="Date", bucket: str | None = None, valid_only: bool = False) -> DataFrame:
    """Per session (and bucket) the interpolated quantiles q0, q1, ... of value over the n sessions before it.

    valid_only: sessions without any value don't count as sessions.
    """
    calendar = session_index(df.filter(F.col(value).isNotNull()) if valid_only else df, date)
    own = df.filter(F.col(value).isNotNull()).select(date, value, *([bucket] if bucket else [])).join(calendar, date).drop(date)
    found = quantiles(own, [value], shares, [bucket] if bucket else [], ahead=("session", n)).withColumnRenamed(value, "_q")
    return found.join(calendar, "session").select(date, *([bucket] if bucket else []), *[F.col("_q")[i].alias(f"q{i}") for i in range(len(shares))])


def with_thresholds(df: DataFrame, thresholds: DataFrame, date="Date", bucket: str | None = None) -> DataFrame:
    return df.join(thresholds, [date, *([bucket] if bucket else [])], "left")


def dual_condition(score_a: str, limit_a: str, score_b: str, limit_b: str) -> Column:
    """Both scores over their limits; a missing score or limit is no."""
    return F.coalesce((F.col(score_a) > F.col(limit_a)) & (F.col(score_b) > F.col(limit_b)), F.lit(False))


def regime_condition(regime: str, conditions: dict[int, Column]) -> Column:
    """The condition of a row's own regime; no in any other."""
    out = F.lit(False)
    for name, condition in conditions.items():
        out = F.when(F.col(regime) == name, condition).otherwise(out)
    return F.coalesce(out, F.lit(False))


def fixed_condition(limits: dict[str, float]) -> Column:
    out = F.lit(True)
    for name, least in limits.items():
        out = out & F.coalesce(F.col(name) > least, F.lit(False))
    return out


def _passed(score: str, limits: str) -> Column:
    """How many of the ascending limits (an array column) the score exceeds. Limits ascend with their quantiles, so it exceeds those of the lower ones."""
    return F.coalesce(F.size(F.filter(limits, lambda x: F.col(score) > x)), F.lit(0))


def threshold_sweep(df: DataFrame, score: str, outcome: str, shares: list[float], n: int = 3, date="Date", bucket: str | None = None, floor: float | None = None) -> DataFrame:
    """Per quantile: trades, mean and sum of outcome over rows whose score is above the prior sessions' quantile.

    A row counts once, with the highest limit that it exceeds; the small table of those counts gives the sums of each quantile.
    """
    shares = sorted(shares)
    limits = prior_quantiles(df, score, shares, n, date, bucket)
    limits = limits.select(date, *([bucket] if bucket else []), F.array(*[f"q{i}" for i in range(len(shares))]).alias("_limits"))
    own = with_thresholds(df, limits, date, bucket)
    own = own if floor is None else own.filter(F.col(score) > floor)
    level = own.select(_passed(score, "_limits").alias("_level"), F.col(outcome).alias("_y")).filter("_level > 0")
    sums = level.groupBy("_level").agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("known"), F.sum("_y").alias("s"))
    each = sums.select("*", F.explode(F.slice(F.array(*map(F.lit, shares)), F.lit(1), F.col("_level"))).alias("share"))
    return each.groupBy("share").agg(F.sum("n").alias("trades"), F.try_divide(F.sum("s"), F.sum("known")).alias("mean"), F.sum("s").alias("total"))


def _levels(df: DataFrame, sources: dict[str, tuple[str, str]], shares: dict[str, list[float]], n: int, date: str, bucket: str | None) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """df with, for each source and (not) bucketed, how many limits of either side a row exceeds (columns _a0, _b0, _a1, ...), and what those are of."""
    out, kinds = df, [(name, bucketed) for name in sources for bucketed in ([False, True] if bucket else [False])]
    wanted: dict[tuple, list[float]] = {}  # a score's shares of all sides and sources: its quantiles are found once
    for name, bucketed in kinds:
        for side, score in zip("ab", sources[name], strict=True):
            wanted[score, bucketed] = sorted({*wanted.get((score, bucketed), []), *shares[side]})
    found = {(score, bucketed): prior_quantiles(df, score, own, n, date, bucket if bucketed else None) for (score, bucketed), own in wanted.items()}
    tables: dict[bool, DataFrame] = {}
    for (score, bucketed), own in wanted.items():
        key = [date, *([bucket] if bucketed else [])]
        sides = [(k, side) for k, (name, b) in enumerate(kinds) if b == bucketed for side, c in zip("ab", sources[name], strict=True) if c == score]
        limits = found[score, bucketed].select(*key, *[F.array(*[f"q{own.index(q)}" for q in shares[side]]).alias(f"_l{side}{k}") for k, side in sides])
        tables[bucketed] = limits if bucketed not in tables else tables[bucketed].join(limits, key, "full")
    for bucketed, found in tables.items():  # a row a session (and bucket)
        key = [date, *([bucket] if bucketed else [])]
        out = out.join(F.broadcast(found) if found.limit(100_001).count() <= 100_000 else found, key, "left")
    names = {f"_{side}{k}": _passed(sources[name][i], f"_l{side}{k}") for k, (name, _) in enumerate(kinds) for i, side in enumerate("ab")}
    return out.withColumns(names).drop(*[f"_l{side}{k}" for k in range(len(kinds)) for side in "ab"]), kinds


def sweep_grid(df: DataFrame, sources: dict[str, tuple[str, str]], outcome: str, shares_a: list[float], shares_b: list[float], floors: dict[str, Column], period: Column, n: int = 3, date="Date", bucket: str | None = None) -> DataFrame:
    """Every combination of source (name: two scores), bucketed or not, two quantiles and floor, per period: trades, mean and
    sum of outcome over rows whose scores are both above their prior sessions' quantiles.

    A row counts once a source, in the cell of the highest limits that it exceeds; combinations are sums over that small table.
    """
    shares = {"a": sorted(shares_a), "b": sorted(shares_b)}
    own, kinds = _levels(df, sources, shares, n, date, bucket)
    own = own.withColumn("period", period).filter("period is not null")
    passed = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in floors.items()]))
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_a{k}").alias("a"), F.col(f"_b{k}").alias("b")) for k in range(len(kinds))]), lambda x: (x["a"] > 0) & (x["b"] > 0))
    cells = own.select("period", F.col(outcome).alias("_y"), passed.alias("_f"), F.explode(each).alias("x"))
    cells = cells.groupBy("period", "_f", "x").agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("known"), F.sum("_y").alias("s"))
    upto = lambda side: F.slice(F.array(*map(F.lit, shares[side])), F.lit(1), F.col(f"x.{side}"))
    whole = cells.select("period", "n", "known", "s", F.col("x.k").alias("k"), upto("a").alias("qa"), upto("b").alias("qb"), F.explode("_f").alias("floor"))
    whole = whole.withColumn("q_a", F.explode("qa")).withColumn("q_b", F.explode("qb"))
    sums = whole.groupBy("period", "k", "q_a", "q_b", "floor").agg(F.sum("n").alias("trades"), F.try_divide(F.sum("s"), F.sum("known")).alias("mean"), F.sum("s").alias("total"))
    named = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k"))
    return sums.select(named([x[0] for x in kinds]).alias("source"), named([x[1] for x in kinds]).alias("bucketed"), "period", "q_a", "q_b", "floor", "trades", "mean", "total")


def evaluate_grid(df: DataFrame, sources: dict[str, tuple[str, str]], outcome: str, shares_a: list[float], shares_b: list[float], floors: dict[str, Column], period: Column, rules: Column | None = None, lots: Column | None = None,
                  limit: float = 200.0, fee: float = 19.3, least: int = 300, n: int = 3, date="Date", bucket: str | None = None, keys=("Date", "QuoteCode"), order=("TransTime", "ChannelSeq"), price="BidPrice1", year: int = 240) -> DataFrame:
    """The combinations of sweep_grid, each traded under position limits of its own: source, bucketed, q_a, q_b, floor, period, signals, trades, days, trades_day, capw_bp, pnl, win_day, sharpe.

    A combination's signals of an entity and session count up lots and position in the order of time; a signal is traded if the
    lots up to it are under `lots` (a column, if given), the position under `limit` and it meets `rules`; dropped ones have used their
    quota. Combinations with fewer than `least` signals in a period are left out there. A null outcome earns nothing.

    Events are dealt once, by `keys`, and sorted; a task then keeps the running lots and positions of all combinations as
    arrays and each row's combinations as a mask, so no row is copied for a combination.
    """
    shares = {"a": sorted(shares_a), "b": sorted(shares_b)}
    own, kinds = _levels(df, sources, shares, n, date, bucket)
    names = list(floors)
    combos = [(k, i, j, f) for k in range(len(kinds)) for i in range(len(shares["a"])) for j in range(len(shares["b"])) for f in range(len(names))]
    yes = lambda c: F.coalesce(c, F.lit(False))
    levels = [f"_{side}{k}" for k in range(len(kinds)) for side in "ab"]
    some = F.lit(False)
    for k in range(len(kinds)):
        some = some | ((F.col(f"_a{k}") > 0) & (F.col(f"_b{k}") > 0))
    earned = F.coalesce(F.col(price) * (F.col(outcome) - fee) / 1e5, F.lit(0.0))
    keyed = [F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(keys)]
    own = own.withColumn("_period", period).filter(F.col("_period").isNotNull() & some & F.col(price).isNotNull())
    own = own.select(*keyed, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(date).cast("string").alias("_date"), "_period", (F.col(price) / 10).alias("_size"), earned.cast("double").alias("_earned"), yes(F.lit(True) if rules is None else rules).alias("_ok"),
                     F.coalesce((F.lit(float("inf")) if lots is None else lots).cast("double"), F.lit(0.0)).alias("_lots"), F.array(*[yes(v) for v in floors.values()]).alias("_floors"), F.array(*levels).alias("_levels"))
    keyed = [f"_k{i}" for i in range(len(keys))]
    own = own.repartition(*keyed).sortWithinPartitions(*keyed, *[f"_o{i}" for i in range(len(order))])

    def run(batches):
        kind, at_a, at_b, at_f = np.array(combos).T
        c, width = len(combos), 2 * len(kinds)
        before, count, held, sums = None, np.zeros(c), np.zeros(c), {}
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                m = batch.num_rows
                key = list(zip(*(batch.column(k).to_pylist() for k in keyed), strict=True))
                start = group_starts(key, before)
                before = key[-1]
                level = batch.column("_levels").flatten().to_numpy().reshape(m, width)
                floor = batch.column("_floors").flatten().to_numpy(zero_copy_only=False).reshape(m, len(names))
                mask = (level[:, 2 * kind] > at_a) & (level[:, 2 * kind + 1] > at_b) & floor[:, at_f]
                size, gain = batch.column("_size").to_numpy(), batch.column("_earned").to_numpy()
                both = running(mask.astype(float), start, count), running(mask * size[:, None], start, held)
                count, held = both[0][-1], both[1][-1]
                ok = mask & (both[0] < batch.column("_lots").to_numpy()[:, None]) & (both[1] < limit) & batch.column("_ok").to_numpy(zero_copy_only=False)[:, None]
                days = list(zip(batch.column("_date").to_pylist(), batch.column("_period").to_pylist(), strict=True))
                where = {d: i for i, d in enumerate(dict.fromkeys(days))}
                place = np.array([where[d] for d in days])
                for d, i in where.items():
                    mine = place == i
                    got = ok[mine]
                    now = np.stack([mask[mine].sum(0), got.sum(0), gain[mine] @ got, size[mine] @ got])
                    sums[d] = sums[d] + now if d in sums else now
        for (day, per), x in sums.items():
            some = np.flatnonzero(x[0])
            yield pa.RecordBatch.from_arrays([pa.array([day] * len(some), pa.string()), pa.array([per] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(x[0][some].astype(np.int64)), pa.array(x[1][some].astype(np.int64)), pa.array(x[2][some]), pa.array(x[3][some])], ["day", "period", "combo", "signals", "trades", "pnl", "cap"])

    days = own.mapInArrow(run, "day string, period string, combo int, signals bigint, trades bigint, pnl double, cap double").groupBy("period", "combo", "day").agg(*[F.sum(x).alias(x) for x in ("signals", "trades", "pnl", "cap")])
    traded = lambda x: F.when(F.col("trades") > 0, x)
    found = days.groupBy("period", "combo").agg(F.sum("signals").alias("signals"), F.sum("trades").alias("trades"), F.count(traded(F.lit(1))).alias("days"), F.sum("pnl").alias("pnl"), F.sum("cap").alias("_cap"), F.avg(traded((F.col("pnl") > 0).cast("double"))).alias("win_day"),
                                                 F.avg(traded(F.col("pnl"))).alias("_m"), F.stddev_samp(traded(F.col("pnl"))).alias("_s"))
    found = found.filter((F.col("signals") >= least) & (F.col("days") > 0))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("combo"))
    return found.select(pick([kinds[k][0] for k, *_ in combos]).alias("source"), pick([kinds[k][1] for k, *_ in combos]).alias("bucketed"), pick([shares["a"][i] for _, i, _, _ in combos]).alias("q_a"), pick([shares["b"][j] for _, _, j, _ in combos]).alias("q_b"), pick([names[f] for *_, f in combos]).alias("floor"),
                        "period", "signals", "trades", "days", (F.col("trades") / F.col("days")).alias("trades_day"), F.try_divide("pnl", "_cap").alias("_r"), "pnl", "win_day", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(year)))).alias("sharpe")).withColumn("capw_bp", F.col("_r") * 1e4).drop("_r")


def tree_leaves(df: DataFrame, x: list[str], y: str, depth: int = 3, sessions: int = 20, min_leaf: float = 0.05, least_rows: int = 200, bins: int = 32, date="Date") -> DataFrame:
    """Leaf id of each row in a regression tree on two features, fitted per session on the sessions before it, and on nothing else.

    Cuts are tried at the quantiles (bins of them) of each feature over the same prior sessions; the tree is exact on
    the grid of sums between them, which is all that a task receives: at most bins x bins cells a session. A leaf has
    at least max(least_rows, min_leaf of the rows). Rows of a session with fewer than `sessions` before it get null.

    Edges and trees are as large as the calendar, not as the data, and are sent to every task: a batch of rows adds to the sums of the
    sessions that follow without a copy of the rows for each, and a row finds its leaf without a join.
    """
    shares = [i / bins for i in range(1, bins)]
    own = df.select(date, *x, y).persist(StorageLevel.DISK_ONLY)  # read by all passes that come before the leaves
    calendar = session_index(own, date)
    edges = calendar
    for side, c in zip("ab", x, strict=True):
        found = prior_quantiles(own, c, shares, sessions, date).select(date, F.array(*[F.col(f"q{i}").cast("double") for i in range(len(shares))]).alias(f"_e{side}"))
        edges = edges.join(found, date)
    edges = edges.select("session", "_ea", "_eb").collect()  # some 500 bytes a session
    known = lambda found: np.array([e for e in found if e is not None], float)
    edges = {r["session"]: (known(r["_ea"]), known(r["_eb"])) for r in edges if r["session"] >= sessions}
    spark, number = df.sparkSession, {r["d"]: r["session"] for r in calendar.select(F.col(date).cast("string").alias("d"), "session").collect() if r["d"] is not None}
    sent = spark.sparkContext.broadcast((number, edges))

    def cell(session: int, found: dict, a: np.ndarray, b: np.ndarray, none: np.ndarray, none_b: np.ndarray) -> np.ndarray:
        """Place in the grid: edges under a value, none under null."""
        ea, eb = found[session]
        return np.where(none, 0, np.searchsorted(ea, a)) * bins + np.where(none_b, 0, np.searchsorted(eb, b))

    def summed(batches):
        number, edges = sent.value
        found: dict = {}

        def told():
            for session, (s, n) in found.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), session, np.int32)), pa.array((some // bins).astype(np.int32)), pa.array((some % bins).astype(np.int32)), pa.array(s[some]), pa.array(n[some].astype(np.int64))], ["session", "_a", "_b", "s", "n"])

        for batch in batches:
            names, place = codes(batch.column("d"))
            a, b, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "y"))
            none, none_b = (batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for i, day in enumerate(names):
                mine = np.flatnonzero(place == i)
                for session in range(number[day] + 1, number[day] + sessions + 1):
                    if session in edges:
                        at = cell(session, edges, a[mine], b[mine], none[mine], none_b[mine])
                        s, n = found.setdefault(session, (np.zeros(bins * bins), np.zeros(bins * bins)))
                        s += np.bincount(at, weights=y[mine], minlength=bins * bins)
                        n += np.bincount(at, minlength=bins * bins)
            if len(found) > 1_000:
                yield from told()
                found.clear()
        yield from told()

    rows = own.filter(F.col(date).isNotNull() & F.col(y).isNotNull()).select(F.col(date).cast("string").alias("d"), *[F.col(c).cast("double").alias(name) for c, name in zip((*x, y), "aby", strict=True)])
    ahead = rows.mapInArrow(summed, "session int, _a int, _b int, s double, n bigint").groupBy("session", "_a", "_b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros((bins, bins)), np.zeros((bins, bins))
        s[group["_a"], group["_b"]], n[group["_a"], group["_b"]] = group["s"], group["n"]
        least, leaves = max(float(least_rows), min_leaf * n.sum()), np.zeros((bins, bins), np.int32)

        def grow(box, level, leaf):
            (a0, a1), (b0, b1) = box
            best = None
            for axis, (lo, hi) in enumerate(box if level < depth else ()):
                for cut in range(lo + 1, hi):
                    parts = [((a0, cut), (b0, b1)), ((cut, a1), (b0, b1))] if axis == 0 else [((a0, a1), (b0, cut)), ((a0, a1), (cut, b1))]
                    ns = [n[p[0][0] : p[0][1], p[1][0] : p[1][1]].sum() for p in parts]
                    if min(ns) >= least:
                        gain = sum(s[p[0][0] : p[0][1], p[1][0] : p[1][1]].sum() ** 2 / m for p, m in zip(parts, ns, strict=True))
                        if best is None or gain > best[0] + 1e-12:
                            best = gain, parts
            if best is None:
                leaves[a0:a1, b0:b1] = leaf
            else:
                grow(best[1][0], level + 1, 2 * leaf)
                grow(best[1][1], level + 1, 2 * leaf + 1)

        grow(((0, bins), (0, bins)), 0, 1)
        return pd.DataFrame({"session": [group["session"].iloc[0]], "leaves": [leaves.ravel()]})

    trees = {r["session"]: np.array(r["leaves"], np.int32) for r in ahead.groupBy("session").applyInPandas(fit, "session int, leaves array<int>").collect()}  # bins x bins numbers a session
    own.unpersist()
    grown = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("int")
    def leaf(day: pd.Series, a: pd.Series, b: pd.Series, none: pd.Series, none_b: pd.Series) -> pd.Series:
        number, edges = sent.value
        out = pd.array(np.zeros(len(day), np.int32), dtype="Int32")
        out[:] = pd.NA
        place, names = pd.factorize(day)
        a, b, none, none_b = a.to_numpy(float), b.to_numpy(float), none.to_numpy(bool), none_b.to_numpy(bool)
        for i, d in enumerate(names):
            if (tree := grown.value.get(number[d])) is not None:
                mine = np.flatnonzero(place == i)
                out[mine] = tree[cell(number[d], edges, a[mine], b[mine], none[mine], none_b[mine])]
        return pd.Series(out)

    known_day = df.filter(F.col(date).isNotNull())
    return known_day.withColumn("leaf", leaf(F.col(date).cast("string"), *[F.col(c).cast("double") for c in x], *[F.col(c).isNull() for c in x]))
