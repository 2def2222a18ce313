"""Metrics of a grid of rolling models, without a copy of the rows for each model.

A row's scores by all models of its session are one product in an Arrow batch; the matrices are as large as the calendar times
the grid, not as the data, and are sent to every task. Passes over the rows then return sums, counts or narrow rows:

* bins of equal frequency: the ranks of the edges are found by counting scores in ranges between bounds that follow from the features',
  and again within the ranges that hold them, until a range has a small share of the rows, whose values are counted one by one; the
  edges are exact, and a last pass sums outcomes over them;
* the backtest: rows that are a signal to some model go through one shuffle by entity and session for the running lots and positions of
  all models; the survivors (a bit for each model) are kept on disk, and those of the stretches of time in which a session's running
  total can still be within its limit go on to one shuffle by session and stretch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.arrays import codes, running, sorted_starts
from tickweave.functions.columns import is_finite

#: Ranges that a pass counts scores in (at least, at most, of all series), rows (at least a share) of a range that are few, and passes after which a range holds one value.
BINS, MOST_BINS, ALL_BINS, FEW, FEW_SHARE, DEPTH = 4096, 65_536, 1 << 18, 10_000, 2_000, 6
ROWS, WORD = 4096, 62


class Scorer:
    """Scores of rows by every model of the grid: columns of a matrix for each (session, regime)."""

    def __init__(self, models: DataFrame, features: list[str], date: str, regime: str):
        self.features, self.matrices = features, {}
        rows = models.select(F.col(date).cast("string"), F.col(regime).cast("int"), "n_training_days", "alpha", "feature", "coef").collect()  # calendar x grid x features
        self.combos = sorted({(r[2], r[3]) for r in rows})
        place, at = {c: i for i, c in enumerate(self.combos)}, {f: i for i, f in enumerate([*features, ""])}
        for day, reg, days, alpha, feature, coef in rows:
            m = self.matrices.setdefault((day, reg), np.full((len(features) + 1, len(self.combos)), np.nan))
            m[at[feature], place[days, alpha]] = coef

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """rows x models; nan without a model or with an invalid feature."""
        n = batch.num_rows
        x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(self.features) + 1)
        x = np.where(np.isfinite(x).all(1)[:, None], x, np.nan)
        names, day = codes(batch.column("_date"))
        kinds, reg = np.unique(batch.column("_regime").to_numpy(zero_copy_only=False), return_inverse=True)
        none = np.full((len(self.features) + 1, len(self.combos)), np.nan)
        own = np.stack([self.matrices.get((d, int(k)), none) for d in names for k in kinds])
        place = day * len(kinds) + reg
        # Feature by feature, so that a row has the same score in every pass, whatever batch it is in.
        out = x[:, :1] * own[place, 0]
        for i in range(1, x.shape[1]):
            out += x[:, i : i + 1] * own[place, i]
        return out

    def bounds(self, own: DataFrame) -> dict[int, tuple[float, float]]:
        """Of each series with scores a value at or under its least and one at or over its greatest, from the ranges of the features by session and regime."""
        m, k, most = len(self.combos), len(self.features) + 1, np.finfo(float).max / 4
        valid = is_finite(F.col("_x")[0])
        for i in range(1, k):
            valid = valid & is_finite(F.col("_x")[i])
        found: dict = {}
        for r in own.filter(valid).groupBy("_date", "_regime").agg(*[f(F.col("_x")[i]) for f in (F.min, F.max) for i in range(k)]).collect():  # the calendar
            if (c := self.matrices.get((r[0], r[1]))) is None:
                continue
            low, high = (np.array(r[2 + j * k : 2 + (j + 1) * k], float)[:, None] * c for j in (0, 1))
            with np.errstate(over="ignore", invalid="ignore"):
                # Rounding keeps the order, so sums in the scores' own order bound them.
                ends = [np.add.accumulate(f(low, high), 0)[-1] for f in (np.minimum, np.maximum)]
            for j in np.flatnonzero(~np.isnan(c).any(0)):
                before = found.get(r[1] * m + int(j), (np.inf, -np.inf))
                found[r[1] * m + int(j)] = min(before[0], max(-most, float(ends[0][j]))), max(before[1], min(most, float(ends[1][j])))
        return found


def _parts(batches):
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            yield whole.slice(first, ROWS)


def _prepared(df: DataFrame, features: list[str], date: str, regime: str) -> DataFrame:
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features], F.lit(1.0))
    return df.withColumns({"_x": x, "_date": F.col(date).cast("string"), "_regime": F.col(regime).cast("int")})


def _series(scores: np.ndarray, regimes: np.ndarray, n_models: int):
    """(number of the series, its finite scores, their rows) for each model and regime."""
    for reg in np.unique(regimes):
        mine = np.flatnonzero(regimes == reg)
        for c in range(n_models):
            ok = mine[np.isfinite(scores[mine, c])]
            if len(ok):
                yield int(reg) * n_models + c, scores[ok, c], ok


def _range(values: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    if high <= low:
        return np.zeros(len(values), np.int64)
    return np.clip((values - low) * (bins / (high - low)), 0, bins - 1).astype(np.int64)


def _inside(values: np.ndarray, path: tuple) -> np.ndarray:
    """Of the values, those that fall in the named range at every level. path: (low, high, ranges, range) for each."""
    for low, high, bins, b in path:
        values = values[_range(values, low, high, bins) == b]
    return values


def exact_edges(own: DataFrame, scorer: Scorer, k: int) -> dict[int, list[float]]:
    """Edges (k + 1, interpolated) of equal-frequency bins of each series' scores."""
    box, m = own.sparkSession.sparkContext.broadcast(scorer), len(scorer.combos)
    own = own.select("_x", "_date", "_regime")

    # Open ranges of a series: path so far, next low and high, rows before, rows in it, ranks wanted in it; the first pass tells the rows.
    open_ = {(s, ()): (low, high, 0, None, []) for s, (low, high) in scorer.bounds(own).items()}
    size: dict = {}
    few: dict = {}
    for _ in range(DEPTH):
        for key in [x for x, r in open_.items() if r[3] is not None and r[3] <= max(FEW, size[x[0]] // FEW_SHARE)]:
            few[key] = open_.pop(key)
        if not open_:
            break
        bins = max(BINS, min(MOST_BINS, ALL_BINS // len(open_)))
        names = list(open_)
        todo = own.sparkSession.sparkContext.broadcast([(s, path, *open_[s, path][:2]) for s, path in names])

        def counted(batches, todo=todo, bins=bins):
            sums = np.zeros((len(todo.value), bins), np.int64)
            for batch in _parts(batches):
                values = {s: v for s, v, _ in _series(box.value(batch), batch.column("_regime").to_numpy(zero_copy_only=False), m)}
                for i, (s, path, low, high) in enumerate(todo.value):
                    if s in values:
                        np.add.at(sums[i], _range(_inside(values[s], path), low, high, bins), 1)
            i, b = np.nonzero(sums)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[i, b])], ["i", "b", "n"])

        hist = np.zeros((len(names), bins), np.int64)
        told = own.mapInArrow(counted, "i int, b int, n bigint").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()  # ranges of series
        hist[told["i"].to_numpy(), told["b"].to_numpy()] = told["n"].to_numpy()
        after = {}
        for i, (s, path) in enumerate(names):
            low, high, before, n, ranks = open_[s, path]
            if n is None:
                size[s] = n = int(hist[i].sum())
                ranks = sorted({f((n - 1) * j / k) for j in range(k + 1) for f in (math.floor, math.ceil)}) if n else []
            upto = before + np.cumsum(hist[i])
            for rank in ranks:
                b = int(np.searchsorted(upto, rank, "right"))
                width = (high - low) / bins
                new = (s, (*path, (low, high, bins, b)))
                after.setdefault(new, (low + b * width, low + (b + 1) * width, int(upto[b] - hist[i, b]), int(hist[i, b]), []))[4].append(rank)
        open_ = after
    few |= open_  # after DEPTH passes a range holds next to one value
    names = list(few)
    last = own.sparkSession.sparkContext.broadcast(names)

    def listed(batches):
        found: dict = {}
        for batch in _parts(batches):
            values = {s: v for s, v, _ in _series(box.value(batch), batch.column("_regime").to_numpy(zero_copy_only=False), m)}
            for i, (s, path) in enumerate(last.value):
                if s in values:
                    for v, n in zip(*np.unique(_inside(values[s], path), return_counts=True), strict=True):
                        found[i, float(v)] = found.get((i, float(v)), 0) + int(n)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.float64()), pa.array(list(found.values()), pa.int64())], ["i", "v", "n"])

    values = own.mapInArrow(listed, "i int, v double, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    ranks = [(i, rank - few[name][2]) for i, name in enumerate(names) for rank in few[name][4]]
    picks = own.sparkSession.createDataFrame(ranks or [(-1, 0)], "i int, rank bigint")
    hit = values.join(F.broadcast(picks), "i").filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    at = {(names[r["i"]][0], r["rank"] + few[names[r["i"]]][2]): r["v"] for r in hit.select("i", "rank", "v").collect()}
    size = {s: n for s, n in size.items() if n}
    out = {s: [math.nan] * (k + 1) for s in size}
    for s, n in size.items():
        for i in range(k + 1):
            x = (n - 1) * i / k
            low, high = at[s, math.floor(x)], at[s, math.ceil(x)]
            out[s][i] = low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return out


def bin_ends(own: DataFrame, scorer: Scorer, edges: dict[int, list[float]]) -> dict[int, tuple]:
    """Of each series: outcomes summed and counted over its top bin and its bottom bin; equal edges are one, and a single bin is no bin."""
    box, m = own.sparkSession.sparkContext.broadcast(scorer), len(scorer.combos)
    ends = {s: (d[-2], d[1]) for s, e in edges.items() if len(d := sorted(set(e))) > 1}

    def run(batches):
        found = {}
        for batch in _parts(batches):
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for s, v, rows in _series(box.value(batch), batch.column("_regime").to_numpy(zero_copy_only=False), m):
                if s in ends:
                    known = np.isfinite(y[rows])
                    top, bottom = (v > ends[s][0]) & known, (v <= ends[s][1]) & known
                    found[s] = found.get(s, 0) + np.array([top.sum(), y[rows][top].sum(), bottom.sum(), y[rows][bottom].sum()])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([float(x[i]) for x in found.values()]) for i in range(4))], ["s", "tn", "ts", "bn", "bs"])

    rows = own.select("_x", "_date", "_regime", "_y").mapInArrow(run, "s int, tn double, ts double, bn double, bs double").groupBy("s").agg(*[F.sum(c) for c in ("tn", "ts", "bn", "bs")]).collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def _words(mask: np.ndarray) -> pa.Array:
    """Of each row its bits in whole numbers of WORD bits."""
    words = [mask[:, i : i + WORD] @ (1 << np.arange(len(mask[0, i : i + WORD]), dtype=np.int64)) for i in range(0, mask.shape[1], WORD)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(mask) + 1, dtype=np.int32) * len(words)), pa.array(np.stack(words, 1).ravel()))


def _masks(batch: pa.RecordBatch, m: int) -> np.ndarray:
    words, c = batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), np.arange(m)
    return (words[:, c // WORD] >> (c % WORD)) & 1 == 1


def traded_days(own: DataFrame, scorer: Scorer, least: dict[int, float], entity_limit: float, session_limit: float, stretch_us: int = 300_000_000) -> DataFrame:
    """combo, day, trades, pnl, capital: signals (a score over the regime's least) within the limits of entity and session, the first of an entity always within its own."""
    spark, m = own.sparkSession, len(scorer.combos)
    box = spark.sparkContext.broadcast(scorer)
    floor = np.array([least.get(0, np.inf), least.get(1, np.inf)])

    def signals(batches):
        for batch in _parts(batches):
            with np.errstate(invalid="ignore"):
                mask = box.value(batch) > floor[batch.column("_regime").to_numpy(zero_copy_only=False).astype(int)][:, None]
            some = np.flatnonzero(mask.any(1))
            if len(some):
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_date", "_entity", "_o0", "_o1", "_size", "_earned")), _words(mask[some])], ["day", "entity", "o0", "o1", "size", "earned", "bits"])

    def by_entity(batches):
        before, lots, held = None, np.zeros(m), np.zeros(m)
        for batch in _parts(batches):
            start, before = sorted_starts(batch, ["day", "entity"], before)
            mask = _masks(batch, m)
            n = running(mask.astype(float), start, lots)
            size = running(mask * batch.column("size").to_numpy()[:, None], start, held)
            lots, held = n[-1], size[-1]
            kept = mask & ((n <= 1) | (size <= entity_limit))
            some = np.flatnonzero(kept.any(1))
            if len(some):
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("day", "o0", "o1", "size", "earned")), _words(kept[some])], ["day", "o0", "o1", "size", "earned", "bits"])

    kinds = dict(own.dtypes)
    order = f"o0 bigint, o1 {kinds['_o1']}, size double, earned double, bits array<bigint>"
    found = own.select("_x", "_date", "_regime", "_entity", "_o0", "_o1", "_size", "_earned").mapInArrow(signals, f"day string, entity {kinds['_entity']}, {order}")
    dealt = found.repartition("day", "entity").sortWithinPartitions("day", "entity", "o0", "o1")
    kept = dealt.mapInArrow(by_entity, f"day string, {order}").withColumn("b", F.floor(F.col("o0") / stretch_us)).persist(StorageLevel.DISK_ONLY)
    has = lambda c: F.col("bits")[c // WORD].bitwiseAND(F.lit(1 << c % WORD)) != 0
    sums = kept.groupBy("day", "b").agg(F.array(*[F.sum(F.when(has(c), F.col("size")).otherwise(0.0)) for c in range(m)]).alias("x"), F.sum(F.least("size", F.lit(0.0))).alias("down"))
    w = Window.partitionBy("day").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # the stretches of a day
    before = sums.select("day", "b", "down", F.array(*[F.coalesce(F.sum(F.col("x")[c]).over(w), F.lit(0.0)) for c in range(m)]).alias("before"))
    # A stretch can't hold a row within the limit if its sum before, less all that its rows may take back, is over it.
    live = before.filter(F.exists("before", lambda x: x + F.col("down") <= session_limit + 1e-5)).drop("down")

    def by_session(batches):
        last, held, found = None, np.zeros(m), {}
        for batch in _parts(batches):
            start, last = sorted_starts(batch, ["day", "b"], last)
            mask, size = _masks(batch, m), batch.column("size").to_numpy()
            own_sum = running(mask * size[:, None], start, held)
            held = own_sum[-1]
            offset = batch.column("before").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m)
            ok = mask & (np.round(own_sum + offset, 6) <= session_limit)
            earned = batch.column("earned").to_numpy()
            names, place = codes(batch.column("day"))
            for i, day in enumerate(names):
                mine = place == i
                found[day] = found.get(day, 0) + np.stack([ok[mine].sum(0), earned[mine] @ ok[mine], size[mine] @ ok[mine]])
        for day, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array([day] * m), pa.array(x[0].astype(np.int64)), pa.array(x[1]), pa.array(x[2])], ["combo", "day", "trades", "pnl", "capital"])

    # Dealt by another expression than the join's keys: Spark would drop a deal that the join's own shuffle makes needless, and then that shuffle for a broadcast.
    ordered = kept.join(live, ["day", "b"]).repartition(F.concat_ws(" ", "day", "b")).sortWithinPartitions("day", "b", "o0", "o1").select("day", "b", "size", "earned", "bits", "before")
    names = "combo int, day string, trades bigint, pnl double, capital double"
    daily = ordered.mapInArrow(by_session, names).groupBy("combo", "day").agg(*[F.sum(c).alias(c) for c in ("trades", "pnl", "capital")]).filter("trades > 0")
    rows = daily.collect()  # calendar x grid
    kept.unpersist()
    return spark.createDataFrame(rows, names)


def param_metrics(df: DataFrame, models: DataFrame, features: list[str], outcome: str, regime: str, least: tuple[float, float] = (40.0, 40.0), bins: int = 5, entity_limit: float = 200.0, session_limit: float = 40_000.0,
                  fee: float = 19.3, max_price: float = 1000.0, date="Date", entity="QuoteCode", order=("TransTime", "ChannelSeq"), price="BidPrice1", stretch_us: int = 300_000_000) -> DataFrame:
    """Per (n_training_days, alpha) of models (rolling_ridge by regime 0 and 1): top_mean, the mean outcome of the top bin of scores in regime 0;
    spread, top less bottom bin in regime 1; and of the backtest total, mdd, time_to_high (longest stretch of sessions under the
    high so far), mean_bp of capital and mdd_to_mean. least: scores over which a row of regime 0 and 1 is a signal. A row without a
    model or with an invalid feature has no score; one without an outcome earns nothing."""
    spark, scorer = df.sparkSession, Scorer(models, features, date, regime)
    m = len(scorer.combos)
    own = _prepared(df.filter(F.col(regime).isin(0, 1)), features, date, regime).withColumn("_y", F.coalesce(F.col(outcome).cast("double"), F.lit(float("nan"))))
    ends = bin_ends(own, scorer, exact_edges(own, scorer, bins))
    over = lambda n, s: s / n if n else None
    rows = []
    for c, (days, alpha) in enumerate(scorer.combos):
        a, b = ends.get(c), ends.get(m + c)
        spread = None if b is None or not b[0] or not b[2] else b[1] / b[0] - b[3] / b[2]
        rows.append((c, days, alpha, None if a is None else over(a[0], a[1]), spread))
    out = spark.createDataFrame(rows, "combo int, n_training_days int, alpha double, top_mean double, spread double")
    at = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0]).cast("long")
    earned = F.coalesce(F.col(price) * (F.col(outcome) - fee) / 10, F.lit(0.0)).cast("double")
    signals = own.filter(F.col(price) < max_price).withColumns({"_entity": F.col(entity), "_o0": at, "_o1": F.col(order[1]), "_size": (F.col(price) / 10).cast("double"), "_earned": earned})
    daily = traded_days(signals, scorer, dict(enumerate(least)), entity_limit, session_limit, stretch_us)
    w = Window.partitionBy("combo").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_down", F.col("_sum") - F.max("_sum").over(w))
    curve = curve.withColumn("_island", F.sum((F.col("_down") >= 0).cast("int")).over(w))
    stretch = curve.groupBy("combo", "_island").agg(F.sum((F.col("_down") < 0).cast("long")).alias("n")).groupBy("combo").agg(F.max("n").alias("time_to_high"))
    told = curve.groupBy("combo").agg(F.sum("trades").alias("trades"), (F.sum("pnl") / 10_000).alias("total"), (F.min("_down") / 10_000).alias("mdd"), (F.try_divide(F.sum("pnl"), F.sum("capital") * 10_000) * 10_000).alias("mean_bp"), F.try_divide(F.abs(F.min("_down")), F.avg("pnl")).alias("mdd_to_mean"))
    return out.join(told.join(stretch, "combo"), "combo", "left").drop("combo")
