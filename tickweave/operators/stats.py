"""Condition reports, rank correlations, decompositions, equity curves and comparisons."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import is_finite
from tickweave.operators import quantiles as quantile_module
from tickweave.operators.buckets import qcut
from tickweave.operators.quantiles import quantiles

FEE = 19.3
YEAR = 240


def daily_sums(df: DataFrame, tags: dict[str, Column], values: list[str], date="Date") -> DataFrame:
    """Per session and tag: n, and sum and sum of squares of each value over the tag's rows."""
    each = F.explode(F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in tags.items()]), lambda t: t.isNotNull()))
    own = df.select(date, each.alias("tag"), *values)
    return own.groupBy(date, "tag").agg(F.count(F.lit(1)).alias("n"), *[a for c in values for a in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}"))])


def pooled(sums: DataFrame, value: str, by: list[str]) -> DataFrame:
    mean = F.sum(f"s_{value}") / F.sum("n")
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(f"ss_{value}") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std"))


def exact_sample(df: DataFrame, n: int, key: str, seed: str = "0", date="Date") -> DataFrame:
    """n rows of each session, by a hash of key and seed."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(date).orderBy(order, key))).filter(F.col("_n") <= n).drop("_n")


def selection_rate(events: DataFrame, pool: DataFrame, date="Date") -> DataFrame:
    """Median, p10 and p90 of the daily share of the pool; events per day and their variation."""
    counts = lambda df, name: df.groupBy(date).agg(F.count(F.lit(1)).alias(name))
    both = counts(events, "n").join(counts(pool, "pool"), date).withColumn("rate", F.col("n") / F.col("pool"))
    q = F.percentile("rate", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return both.agg(q.alias("q"), F.avg("n").alias("per_day"), F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv")).select(
        F.col("q")[1].alias("rate_median"), F.col("q")[0].alias("rate_p10"), F.col("q")[2].alias("rate_p90"), "per_day", "cv")


def daily_delta(sums: DataFrame, value: str, tag: str, base: str, date="Date") -> DataFrame:
    """Per session the difference of mean value between two tags."""
    mean = lambda t, name: sums.filter(F.col("tag") == t).select(date, (F.col(f"s_{value}") / F.col("n")).alias(name))
    return mean(tag, "a").join(mean(base, "b"), date).select(date, (F.col("a") - F.col("b")).alias("delta"))


def delta_report(delta: DataFrame, month: Column) -> DataFrame:
    """t of the daily difference, share of positive days, positive months."""
    months = delta.groupBy(month.alias("m")).agg(F.avg("delta").alias("d"))
    days = delta.agg(F.avg("delta").alias("mean"), (F.try_divide(F.avg("delta"), F.stddev_samp("delta")) * F.sqrt(F.count("delta").cast("double"))).alias("t"), F.avg((F.col("delta") > 0).cast("double")).alias("positive_days"))
    counted = months.agg(F.sum((F.col("d") > 0).cast("long")).alias("positive_months"), F.count(F.lit(1)).alias("months"))
    return days.withColumn("_k", F.lit(1)).join(counted.withColumn("_k", F.lit(1)), "_k").drop("_k")


def share_distance(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Total-variation distance between the bucket shares of two frames."""
    def shares(df, name):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")

    both = shares(a, "pa").join(shares(b, "pb"), by, "full").fillna(0.0, ["pa", "pb"])
    return both.agg((F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2).alias("tv"))


def verdict(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    out = metrics.withColumns({f"pass_{k}": F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    whole = F.lit(True)
    for k in rules:
        whole = whole & F.col(f"pass_{k}")
    return out.withColumn("accepted", whole)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of each condition's entity-days that the other holds too."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    both = ka.withColumn("a", F.lit(1)).join(kb.withColumn("b", F.lit(1)), keys, "full")
    common = F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0))
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), common.alias("common")).withColumns({"share_a": F.try_divide("common", "n_a"), "share_b": F.try_divide("common", "n_b")})


def leak_regression(daily: DataFrame, y: str, x: str, by: str, n: str = "n", least: int = 500) -> DataFrame:
    """Slope, intercept, correlation and 1 - slope of y on x over the days with more than `least` rows; null where x is the same on all."""
    own = daily.filter((F.col(n) > least) & F.col(x).isNotNull() & F.col(y).isNotNull())
    return own.groupBy(by).agg(F.count(F.lit(1)).alias("days"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x)).alias("corr")).withColumn("k", 1 - F.col("slope"))


#: Rows of a part that one task sorts.
ROWS_A_PART = 500_000


def _in_order(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n rows of df sorted over all parts: _p, the part's number, and _i, the place in it from 0."""
    at = df.repartitionByRange(n // ROWS_A_PART + 1, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return at.withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def _parts(placed: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """By group and part: what is to be added to _i for a rank from 1 (_add), the group's rows there (_n), and the sums."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"), *sums).withColumn("_add", before - F.col("_first") + 1).drop("_first")


def _ranked(df: DataFrame, value: str, tie: str, by: list[str], out: str, n: int) -> tuple[DataFrame, DataFrame]:
    """df with its ranks, and the sorted rows on disk that it reads."""
    placed = _in_order(df, [*by, value, tie], n).persist(StorageLevel.DISK_ONLY)  # places are given once; the parts' bounds are sketched anew each time
    found = quantile_module._joined(placed, _parts(placed, by).drop("_n"), [*by, "_p"])
    return found.withColumn(out, (F.col("_i") + F.col("_add")).cast("int")).select(*df.columns, out), placed


def ordinal_rank(df: DataFrame, value: str, tie: str, by: list[str], out: str, most: int | None = None) -> DataFrame:
    """Ranks from 1 within by, in the order of a number and of a number that breaks ties.

    Rows are sorted over all groups, in parts of about ROWS_A_PART rows however they are spread over groups and values; a place in
    a part is offset by the group's rows in the parts before. The sorted rows stay on disk until the session ends. Tables of at
    most `most` rows are numbered by one window.
    """
    most = quantile_module.MOST if most is None else most
    n = df.count()
    if n <= most:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)))
    return _ranked(df, value, tie, by, out, n)[0]


def session_ic(df: DataFrame, pairs: list[tuple[str, str]], least: int = 200, date="Date", tie: str = "ChannelSeq", most: int | None = None) -> DataFrame:
    """Spearman correlation (ordinal ranks) per session and pair; null under `least` complete rows.

    Tables of more than `most` rows are sorted twice: by a for its ranks, then by b, whose ranks are places in parts and the parts'
    offsets, so that sums by part are enough. The result, a row a session and pair, is then computed at once and kept on disk.
    """
    most = quantile_module.MOST if most is None else most
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for i, (a, b) in enumerate(pairs)]))
    own = df.select(date, F.col(tie).alias("_tie"), each.alias("p")).select(date, "_tie", "p.*").filter(is_finite(F.col("a")) & is_finite(F.col("b")))
    by, n = [date, "pair"], own.count()
    if n <= most:
        window = lambda v: F.row_number().over(Window.partitionBy(*by).orderBy(v, "_tie")).cast("double")
        found = own.withColumn("ra", window("a")).withColumn("rb", window("b")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("ic"))
    else:
        ranked, placed = _ranked(own, "a", "_tie", by, "ra", n)
        ra = F.col("ra").cast("double")
        parts = _parts(_in_order(ranked.select(*by, "_tie", "b", "ra"), [*by, "b", "_tie"], n), by, F.sum(ra).alias("_s"), F.sum(ra * F.col("_i")).alias("_si"))
        sums = parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_si") + F.col("_add") * F.col("_s")).alias("_sum"))
        rows = F.col("n").cast("double")  # ranks are 1 to n: their mean is (n + 1) / 2, their variance (n * n - 1) / 12
        found = sums.select(*by, "n", F.try_divide(F.col("_sum") / rows - (rows + 1) * (rows + 1) / 4, (rows * rows - 1) / 12).alias("ic")).persist(StorageLevel.DISK_ONLY)
        found.count()
        placed.unpersist()
    names = F.array(*[F.lit(f"{a}~{b}") for a, b in pairs])
    return found.select(date, F.get(names, F.col("pair")).alias("pair"), "n", F.when(F.col("n") >= least, F.col("ic")).alias("ic"))


def ic_by_period(ic: DataFrame, period: Column) -> DataFrame:
    return ic.groupBy(period.alias("period"), "pair").agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.count("ic").alias("days"))


def survival(periods: DataFrame, first: str, second: str, k: int = 10) -> DataFrame:
    """Of the k pairs strongest in the first period, those of the same sign and a third the size in the second."""
    a = periods.filter(F.col("period") == first).select("pair", F.col("mean_ic").alias("a")).orderBy(F.desc(F.abs("a")), "pair").limit(k)
    both = a.join(periods.filter(F.col("period") == second).select("pair", F.col("mean_ic").alias("b")), "pair", "left")
    return both.withColumn("survives", F.coalesce((F.signum("a") == F.signum("b")) & (F.abs("b") >= F.abs("a") / 3), F.lit(False)))


def nominate(monthly: DataFrame, feature="pair", value="mean_ic", coordinate: float = 0.02, alpha_ir: float = 1.0) -> DataFrame:
    """grad (mean monthly size), IR and sign flips of each feature; coordinate, alpha or plain."""
    w = Window.partitionBy(feature).orderBy("period")
    own = monthly.withColumn("_flip", (F.signum(value) != F.signum(F.lag(value).over(w))).cast("long"))
    out = own.groupBy(feature).agg(F.avg(F.abs(value)).alias("grad"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("ir"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("flips"))
    return out.withColumn("kind", F.when((F.abs("ir") >= alpha_ir) & (F.col("flips") <= 1), "alpha").when(F.col("grad") >= coordinate, "coordinate").otherwise("plain"))


def bin_means(df: DataFrame, score: str, k: int, values: list[str]) -> DataFrame:
    return qcut(df, score, k).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in values])


def top_bottom(df: DataFrame, score: str, value: str, k: int = 5) -> DataFrame:
    m = bin_means(df, score, k, [value]).filter("bin is not null")
    return m.agg(F.max_by(value, "bin").alias("top"), F.min_by(value, "bin").alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def daily_pnl(trades: DataFrame, bp: str, capital: Column, fee: float = FEE, date="Date") -> DataFrame:
    """pnl (after the fee), capital, trades and capital-weighted basis points per session."""
    own = trades.withColumn("_cap", capital)
    return own.groupBy(date).agg((F.sum((F.col(bp) - fee) * F.col("_cap")) / 10_000).alias("pnl"), F.sum("_cap").alias("capital"), F.count(F.lit(1)).alias("trades")).withColumn("weighted_bp", F.try_divide(F.col("pnl"), F.col("capital")) * 10_000)


def equity(daily: DataFrame, date="Date", value="pnl") -> DataFrame:
    """Cumulative value, high-water mark (from 0), drawdown and the run of sessions under water. Sessions are few."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    own = daily.withColumn("equity", F.sum(value).over(w))
    own = own.withColumn("high", F.greatest(F.max("equity").over(w), F.lit(0.0))).withColumn("drawdown", F.col("equity") - F.col("high"))
    own = own.withColumn("_island", F.sum((F.col("drawdown") == 0).cast("int")).over(w))
    run = F.sum((F.col("drawdown") < 0).cast("long")).over(Window.partitionBy("_island").orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("under_water", run).drop("_island")


def performance(curve: DataFrame, value="pnl") -> DataFrame:
    """total, mdd, longest under water, Sharpe, share of winning days, trades a day, worst day, mean capital, ratios."""
    out = curve.agg(F.sum(value).alias("total"), F.min("drawdown").alias("mdd"), F.max("under_water").alias("longest_under_water"), (F.try_divide(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"), F.avg((F.col(value) > 0).cast("double")).alias("win_days"), F.avg("trades").alias("trades_per_day"), F.min(value).alias("worst_day"), F.avg("capital").alias("mean_capital"))
    return out.withColumns({"mdd_to_capital": F.try_divide("mdd", "mean_capital"), "return_to_mdd": F.try_divide(F.col("total"), F.abs("mdd"))})


def paired(a: DataFrame, b: DataFrame, month: Column, date="Date", value="pnl") -> DataFrame:
    """Mean daily difference with t and correlation, and months won."""
    both = a.select(date, F.col(value).alias("a")).join(b.select(date, F.col(value).alias("b")), date, "full").fillna(0.0, ["a", "b"]).withColumn("d", F.col("a") - F.col("b"))
    days = both.agg(F.avg("d").alias("mean"), (F.try_divide(F.avg("d"), F.stddev_samp("d")) * F.sqrt(F.count("d").cast("double"))).alias("t"), F.corr("a", "b").alias("corr"))
    won = both.groupBy(month.alias("m")).agg(F.sum("d").alias("d")).agg(F.sum((F.col("d") > 0).cast("long")).alias("months_won"), F.count(F.lit(1)).alias("months"))
    return days.withColumn("_k", F.lit(1)).join(won.withColumn("_k", F.lit(1)), "_k").drop("_k")


def monthly_trades(trades: DataFrame, bp: str, month: Column, date="Date", entity="QuoteCode") -> DataFrame:
    daily = trades.groupBy(month.alias("month"), date).agg(F.count(F.lit(1)).alias("n"), F.sum(bp).alias("bp"), F.countDistinct(entity).alias("entities"))
    return daily.groupBy("month").agg(F.sum("n").alias("trades"), (F.sum("bp") / F.sum("n")).alias("mean_bp"), F.avg("entities").alias("entities_per_day"), F.count(F.lit(1)).alias("days"))


def value_share(df: DataFrame, by: str, value: str) -> DataFrame:
    whole = Window.partitionBy()
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value")).withColumns({"n_share": F.try_divide(F.col("n"), F.sum("n").over(whole)), "value_share": F.try_divide(F.col("value"), F.sum("value").over(whole))})


def range_bucket(df: DataFrame, value: str, n: int = 64) -> Column:
    """Number of the range of about equal size that a row's value falls in, of at most n; equal values share one."""
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(1_000))).first()[0] or []
    return sum((F.coalesce(F.col(value) > e, F.lit(False)).cast("int") for e in sorted(set(edges))), F.lit(0))


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank", pct: bool = False) -> DataFrame:
    """Ranks from 1, ties at their mean, null for null; pct divides by the number of values.

    Values are counted first; prefix sums over the distinct ones run in ranges, so no task sees all rows or values.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", range_bucket(df, value))
    ranges = counts.groupBy(*by, "_r").agg(F.sum("_n").alias("_m"))
    before = ranges.select(*by, "_r", F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*by)).alias("_all"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.join(before, [*by, "_r"]).withColumn("_rank", F.col("_before") + upto + (F.col("_n") + 1) / 2)
    rank = F.col("_rank") / F.col("_all") if pct else F.col("_rank")
    return df.join(ranked.select(*by, value, rank.alias(out)), [*by, value], "left").select(*df.columns, out)


def rank_stability(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Spearman correlation (mean ranks) of a metric between two samples of configurations."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return average_rank(average_rank(both, "a", out="ra"), "b", out="rb").agg(F.corr("ra", "rb").alias("rank_corr"), F.count(F.lit(1)).alias("configs"))


def select_best(df: DataFrame, metric: str, keep: Column, k: int = 1, ties: list[str] | None = None) -> DataFrame:
    """The k rows of greatest metric among those to keep, equal ones in the order of ties."""
    return df.filter(keep).orderBy(F.desc(metric), *(ties or [])).limit(k)


def ecdf(df: DataFrame, value: str, key: str) -> DataFrame:
    """Share of rows before each one in the order of value and key. Ranges of values, and of keys within a value, are numbered one by one and offset by those before."""
    own = df.filter(F.col(value).isNotNull())
    own = own.withColumns({"_r": range_bucket(own, value), "_k": range_bucket(own, key)})
    groups = own.groupBy("_r", value, "_k").agg(F.count(F.lit(1)).alias("_n"))
    ranges = groups.groupBy("_r").agg(F.sum("_n").alias("_m"))
    before = ranges.select("_r", F.coalesce(F.sum("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy(value, "_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = groups.join(F.broadcast(before), "_r").select(F.col(value).alias("_v"), F.col("_k").alias("_g"), (F.col("_b") + upto).alias("_first"), "_all")
    at = F.row_number().over(Window.partitionBy(value, "_k").orderBy(key)) - 1
    numbered = own.withColumn("_i", at)
    return numbered.join(offset, (F.col(value) == F.col("_v")) & (F.col("_k") == F.col("_g"))).withColumn("ecdf", (F.col("_first") + F.col("_i")) / F.col("_all")).select(*df.columns, "ecdf")


def quantile_markers(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """share, mark: interpolated quantiles of a value."""
    return quantiles(df, [value], shares).select(F.inline(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col(value).alias("mark"))))


def period_sums(monthly: DataFrame, periods: dict[str, tuple[str, str]], values: list[str], month="month") -> DataFrame:
    """Sums of a monthly table's values over named ranges of months, both ends in; a month may be in several."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(month).between(a, b), F.lit(k)) for k, (a, b) in periods.items()])))
    return monthly.select(each.alias("period"), *values).groupBy("period").agg(F.count(F.lit(1)).alias("months"), *[F.sum(c).alias(c) for c in values])


def edge_by_bin(df: DataFrame, by: str, raw: str, idio: str, date="Date", fee: float = FEE) -> DataFrame:
    """Per bin: rows, mean raw and hedged basis points, and mean and t of the daily mean hedged edge after the fee."""
    daily = df.groupBy(by, date).agg(F.count(F.lit(1)).alias("n"), F.sum(raw).alias("r"), F.sum(idio).alias("i"))
    edge = F.col("i") / F.col("n") - fee
    return daily.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("r") / F.sum("n")).alias("raw"), (F.sum("i") / F.sum("n")).alias("hedged"), F.avg(edge).alias("daily_edge"), (F.try_divide(F.avg(edge), F.stddev_samp(edge)) * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("t"))


def deepest_days(curve: DataFrame, k: int = 5, date="Date") -> DataFrame:
    """The k sessions of deepest drawdown, equal ones by date."""
    return curve.orderBy("drawdown", date).limit(k)


def screening_summary(log: DataFrame, feature="feature", selected="selected", date="Date") -> DataFrame:
    """sessions, features, and in how many sessions some feature was left out."""
    days = log.filter(F.col(feature) != "").groupBy(date).agg(F.sum(F.col(selected).cast("long")).alias("kept"), F.count(F.lit(1)).alias("all"))
    return days.agg(F.count(F.lit(1)).alias("sessions"), F.max("all").alias("features"), F.sum((F.col("kept") < F.col("all")).cast("long")).alias("screened"))


def acceptance(metrics: DataFrame) -> DataFrame:
    """verdict by the pass lines of a condition: selection rate 0.5 to 2 %, effect 0.08 or more, daily t 3 or more, 80 % of
    months positive, hedge effect under 5 bp, distance at most 0.2, and the same sign in both regimes."""
    share = F.try_divide(F.col("positive_months"), F.col("months"))
    return verdict(metrics, {
        "selection": F.col("rate_median").between(0.005, 0.02), "effect": F.col("mean") >= 0.08, "t": F.col("t") >= 3, "months": share >= 0.8,
        "hedge": F.abs("delta_hedge") < 5, "evenness": F.col("tv") <= 0.2, "regimes": F.col("mean_normal") * F.col("mean_abnormal") > 0,
    })


def similarity(a: DataFrame, b: DataFrame, pool: DataFrame, z: str, keys=("Date", "QuoteCode"), unikey=("Date", "QuoteCode", "ChannelSeq"), least: float = 0.05, alike: float = 0.7, date="Date") -> DataFrame:
    """New condition a against reference b: overlap of entity-days both ways, effect of a's events that aren't b's over the pool,
    correlation of the two daily means, and what to do: develop, refine, drop or duplicate."""
    mean = lambda df, name: df.groupBy(date).agg(F.avg(z).alias(name))
    daily = mean(a, "a").join(mean(b, "b"), date).agg(F.corr("a", "b").alias("corr"))
    own = mean(a.join(b.select(*unikey), list(unikey), "left_anti"), "own").join(mean(pool, "pool"), date).agg(F.avg(F.col("own") - F.col("pool")).alias("disjoint_effect"))
    out = overlap(a, b, list(keys))
    for part in (own, daily):  # single rows
        out = out.withColumn("_k", F.lit(1)).join(part.withColumn("_k", F.lit(1)), "_k").drop("_k")
    cuts, near = F.coalesce(F.col("disjoint_effect") >= least, F.lit(False)), F.coalesce(F.col("corr") >= alike, F.lit(False))
    return out.withColumn("decision", F.when(cuts & ~near, "develop").when(cuts, "refine").when(~near, "drop").otherwise("duplicate"))


def grid_report(curve: DataFrame, value="pnl") -> DataFrame:
    """total, mdd, sessions to a new high (longest stretch under water), basis points of capital, and drawdown to mean result."""
    out = curve.agg(F.sum(value).alias("total"), F.min("drawdown").alias("mdd"), F.max("under_water").alias("time_to_high"), (F.try_divide(F.sum(value), F.sum("capital")) * 10_000).alias("mean_bp"), F.avg(value).alias("_m"))
    return out.withColumn("mdd_to_mean", F.try_divide(F.abs("mdd"), F.col("_m"))).drop("_m")


def describe(df: DataFrame, values: list[str]) -> DataFrame:
    """Per value: count, mean, standard deviation, least, quartiles and greatest."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest")) for c in values]
    middle = quantiles(df, values, [0.25, 0.5, 0.75]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("_q")) for c in values])))
    own = df.agg(F.array(*parts).alias("x")).select(F.inline("x")).join(F.broadcast(middle), "name")  # a row a value
    return own.select("name", "n", "mean", "std", "least", *[F.col("_q")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "greatest")


def composition_change(before: DataFrame, after: DataFrame, by: str, value: str) -> DataFrame:
    """Value shares per bin before and after position limits."""
    parts = [value_share(df, by, value).select(by, F.col("value_share").alias(f"share_{k}"), F.col("n").alias(f"n_{k}")) for k, df in (("before", before), ("after", after))]
    return parts[0].join(parts[1], by, "full").fillna(0)


def return_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    out = df.agg(F.corr(a, b).alias("corr"), F.stddev_samp(a).alias("vol_a"), F.stddev_samp(b).alias("vol_b"))
    return out.withColumns({f"annual_{c}": F.col(c) * F.sqrt(F.lit(252.0)) for c in ("vol_a", "vol_b")})


def worst_overlap(df: DataFrame, a: str, b: str, share: float = 0.2) -> DataFrame:
    """Share of a's worst sessions that are among b's."""
    cuts = quantiles(df, [a, b], [share]).select(F.col(a)[0].alias("ca"), F.col(b)[0].alias("cb"), F.lit(1).alias("_k"))
    both = df.withColumn("_k", F.lit(1)).join(cuts, "_k")
    low = lambda c, cut: F.col(c) <= F.col(cut)
    return both.agg(F.sum(low(a, "ca").cast("long")).alias("n_a"), F.sum((low(a, "ca") & low(b, "cb")).cast("long")).alias("common")).withColumn("overlap", F.try_divide("common", "n_a"))


def cumulative(df: DataFrame, values: dict[str, float], date="Date") -> DataFrame:
    """Running sums of the values and of their weighted combination."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    whole = sum((F.col(c) * k for c, k in values.items()), F.lit(0.0))
    return df.select(date, *[F.sum(c).over(w).alias(f"cum_{c}") for c in values], F.sum(whole).over(w).alias("cum_combined"))


def rolling_percent_rank(df: DataFrame, value: str, n: int = 100, date="Date") -> DataFrame:
    """Share of the last n values that the current one is not below, and the least of those before it."""
    w = Window.orderBy(date).rowsBetween(1 - n, 0)
    own = df.withColumn("_w", F.collect_list(value).over(w))
    out = own.withColumn("pct", F.size(F.filter("_w", lambda x: x <= F.col(value))) / F.size("_w")).drop("_w")
    return out.withColumn("prior_min", F.min(value).over(Window.orderBy(date).rowsBetween(-n, -1)))


def mean_of_means(df: DataFrame, value: str, n: int = 30, date="Date", entity="QuoteCode") -> DataFrame:
    daily = df.groupBy(date, entity).agg(F.avg(value).alias("m")).groupBy(date).agg(F.avg("m").alias("mean"))
    return daily.withColumn("moving", F.avg("mean").over(Window.orderBy(date).rowsBetween(1 - n, 0)))


def level_drift(df: DataFrame, score: str, label: str, month: Column) -> DataFrame:
    own = df.select(month.alias("month"), score, F.col(label).alias("_label"))
    q = quantiles(own, [score], [0.5, 0.9], ["month"]).select("month", F.col(score)[0].alias("p50"), F.col(score)[1].alias("p90"))
    return q.join(own.groupBy("month").agg(F.avg("_label").alias("label_mean")), "month")


def first_signals(df: DataFrame, keys=("Date", "QuoteCode"), order=("TransTime", "ChannelSeq")) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def grid_pivot(df: DataFrame, rows: str, columns: str, value: str, levels: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, levels).agg(F.first(value))


def selection_frequency(log: DataFrame, feature="feature", selected="selected") -> DataFrame:
    return log.groupBy(feature).agg(F.avg(F.col(selected).cast("double")).alias("frequency"), F.sum(F.col(selected).cast("long")).alias("times"))


def mean_importance(log: DataFrame, feature="feature", coef="std_coef", date="Date") -> DataFrame:
    """Mean size of standardised coefficients over all sessions, unselected as 0."""
    days = log.select(date).distinct().count()
    return log.groupBy(feature).agg((F.sum(F.abs(F.coalesce(coef, F.lit(0.0)))) / F.lit(float(max(days, 1)))).alias("importance"))


def coefficient_stability(log: DataFrame, feature="feature", coef="coef") -> DataFrame:
    q = F.percentile(coef, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return log.groupBy(feature).agg(q.alias("q")).select(feature, F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), F.signum(F.col("q")[1]).alias("sign"))


def relative_importance(log: DataFrame, feature="feature", coef="coef", date="Date") -> DataFrame:
    return log.withColumn("share", F.try_divide(F.abs(coef), F.sum(F.abs(coef)).over(Window.partitionBy(date))) * 100)


def moving_average(df: DataFrame, value: str, n: int, by: list[str], date="Date") -> DataFrame:
    """Moving average after linear interpolation of gaps."""
    w = Window.partitionBy(*by).orderBy(date)
    at = F.row_number().over(w)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("k"), F.col(value).alias("v")))
    own = df.withColumn("_at", at)
    own = own.withColumns({"_p": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col("_at") - F.col("_p.k"), F.col("_n.k") - F.col("_p.k"))
    own = own.withColumn("_x", F.coalesce(F.col(value), line, F.col("_p.v")))
    return own.withColumn(f"{value}_ma{n}", F.avg("_x").over(w.rowsBetween(1 - n, 0))).drop("_at", "_p", "_n", "_x")
