"""Rolling linear models from per-session moments.

A session is reduced to counts, sums and cross products in one aggregation; windows over sessions add them up;
a task then solves a system of features by features. Grids of penalties and window lengths reuse the moments.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.columns import is_finite
from tickweave.operators.quantiles import quantiles
from tickweave.operators.ticks import session_index


def impute_prior_median(df: DataFrame, features: list[str], date="Date") -> DataFrame:
    """Nulls become the session before's median, else the median over all."""
    medians = quantiles(df, features, [0.5], [date]).select(date, *[F.col(c)[0].alias(f"_m_{c}") for c in features])
    w = Window.orderBy(date)
    prior = medians.select(date, *[F.lag(f"_m_{c}").over(w).alias(f"_p_{c}") for c in features])
    whole = quantiles(df, features, [0.5]).select(*[F.col(c)[0].alias(f"_g_{c}") for c in features]).first()
    out = df.join(prior, date, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_p_{c}"), F.lit(whole[f"_g_{c}"])) for c in features}).drop(*[f"_p_{c}" for c in features])


def moments(df: DataFrame, features: list[str], label: str, date="Date", regime: str | None = None) -> DataFrame:
    """Per session (and regime): n and the upper triangle of products of (1, features, label), label finite."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    own = df.filter(is_finite(F.col(label).cast("double")))
    for c in features:
        own = own.filter(is_finite(F.col(c).cast("double")))
    cells = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return own.groupBy(date, *([regime] if regime else [])).agg(F.array(*cells).alias("cells"))


def _rolled(m: DataFrame, calendar: DataFrame, windows: list[int], width: int, date: str, regime: str | None) -> DataFrame:
    """Moments (width cells) of the n sessions before each session of the calendar, for each n. A session without
    labels has no moments, but counts as a session and gets those of the sessions before it."""
    own = m.join(calendar, date).withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(max(windows))))).withColumn("session", F.col("session") + F.col("_back"))
    within = lambda n, i: F.sum(F.when(F.col("_back") <= n, F.col("cells")[i]))
    sums = own.groupBy("session", *([regime] if regime else [])).agg(*[F.array(*[within(n, i) for i in range(width)]).alias(f"_w{n}") for n in windows])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n_training_days"), F.col(f"_w{n}").alias("cells")) for n in windows]))
    return sums.join(calendar, "session").select(date, *([regime] if regime else []), each.alias("x")).select(date, *([regime] if regime else []), "x.*").filter(F.col("cells")[0].isNotNull())


def rolling_ridge(df: DataFrame, features: list[str], label: str, windows: list[int], alphas: list[float], date="Date", regime: str | None = None, screen: float = 0.0) -> DataFrame:
    """Long table of models: date, (regime), n_training_days, alpha, feature, coef, std_coef, selected; the
    intercept is feature "". Features are standardised by the window's moments, the intercept is free; those
    whose correlation with the label is under `screen` are left out (selected false, coef 0)."""
    k = len(features) + 2
    rolled = _rolled(moments(df, features, label, date, regime), session_index(df, date), windows, k * (k + 1) // 2, date, regime)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = r["cells"]
                a = a + np.triu(a, 1).T
                n = a[0, 0]
                mean = a[0, 1:] / n
                cov = a[1:, 1:] / n - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 0, None))
                ok = (sd[:-1] > 1e-12) & (np.abs(cov[:-1, -1]) >= screen * sd[:-1] * sd[-1])
                for alpha in alphas:
                    beta = np.zeros(k - 2)
                    if ok.any():
                        z = cov[:-1, :-1][np.ix_(ok, ok)] / np.outer(sd[:-1][ok], sd[:-1][ok])
                        beta[ok] = np.linalg.solve(z * n + alpha * np.eye(ok.sum()), n * cov[:-1, -1][ok] / sd[:-1][ok]) / sd[:-1][ok]
                    key = {c: r[c] for c in (date, *([regime] if regime else []), "n_training_days")} | {"alpha": alpha}
                    rows += [key | {"feature": f, "coef": float(b), "std_coef": float(b * s), "selected": bool(o)} for f, b, s, o in zip(features, beta, sd, ok, strict=False)]
                    rows.append(key | {"feature": "", "coef": float(mean[-1] - mean[:-1] @ beta), "std_coef": 0.0, "selected": True})
            yield pd.DataFrame(rows, columns=names)

    kinds = dict(rolled.dtypes)
    keys = [date, *([regime] if regime else []), "n_training_days"]
    names = [*keys, "alpha", "feature", "coef", "std_coef", "selected"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "alpha double, feature string, coef double, std_coef double, selected boolean"])
    return rolled.mapInPandas(solve, schema)


def coefficient_maps(models: DataFrame, keys: list[str]) -> DataFrame:
    """One row a model: coefficients (map) and intercept."""
    entries = F.collect_list(F.when(F.col("feature") != "", F.struct("feature", "coef")))
    return models.groupBy(*keys).agg(F.map_from_entries(entries).alias("coefficients"), F.max(F.when(F.col("feature") == "", F.col("coef"))).alias("intercept"))


def linear_score(coefficients: Column, intercept: Column, features: list[str]) -> Column:
    """intercept + sum of coef * feature by name; a feature without coefficient counts 0, an invalid one gives null."""
    total, valid = intercept, F.lit(True)
    for c in features:
        x = F.col(c).cast("double")
        total = total + F.coalesce(F.try_element_at(coefficients, F.lit(c)), F.lit(0.0)) * x
        valid = valid & is_finite(x)
    return F.when(valid, total)


def predict(df: DataFrame, models: DataFrame, features: list[str], out: str, date="Date", regime: str | None = None) -> DataFrame:
    """df with its session's model's score. models: of one window and alpha."""
    keys = [date, *([regime] if regime else [])]
    maps = coefficient_maps(models, keys)
    return df.join(maps, keys, "left").withColumn(out, linear_score(F.col("coefficients"), F.col("intercept"), features)).drop("coefficients", "intercept")


def dual_vote(score_a: Column, score_m: Column, limits: dict[str, tuple[float, float]], state: Column) -> Column:
    """Both scores over the limits of the market's state; no in any other state."""
    out = F.lit(False)
    for name, (a, m) in limits.items():
        out = F.when(state == name, (score_a > a) & (score_m > m)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def pls_weights(df: DataFrame, features: list[str], label: str, sessions: int, components: int = 2, date="Date") -> DataFrame:
    """Weights of up to `components` PLS components per session, from the moments of the sessions before."""
    k = len(features) + 2
    rolled = _rolled(moments(df, features, label, date), session_index(df, date), [sessions], k * (k + 1) // 2, date, None)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = r["cells"]
                a = a + np.triu(a, 1).T
                mean = a[0, 1:] / a[0, 0]
                cov = a[1:, 1:] / a[0, 0] - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 1e-24, None))
                cor = cov / np.outer(sd, sd)
                xx, xy = cor[:-1, :-1], cor[:-1, -1]
                for c in range(components):
                    if np.linalg.norm(xy) < 1e-12:
                        break
                    w = xy / np.linalg.norm(xy)
                    p = xx @ w / (w @ xx @ w)
                    rows += [{date: r[date], "component": c + 1, "feature": f, "weight": float(v)} for f, v in zip(features, w, strict=True)]
                    out = np.eye(len(w)) - np.outer(p, w)
                    xy, xx = out @ xy, out @ xx @ out.T
            yield pd.DataFrame(rows, columns=[date, "component", "feature", "weight"])

    return rolled.mapInPandas(solve, f"{date} {dict(rolled.dtypes)[date]}, component int, feature string, weight double")


def grid_metrics(df: DataFrame, models: DataFrame, features: list[str], label: str, date="Date") -> DataFrame:
    """Per (n_training_days, alpha) of models: sessions and rows scored, and correlation and mean squared error of score and label."""
    keys = [date, "n_training_days", "alpha"]
    scored = df.join(coefficient_maps(models, keys), date).withColumn("_score", linear_score(F.col("coefficients"), F.col("intercept"), features))
    own = scored.filter(F.col("_score").isNotNull() & is_finite(F.col(label).cast("double")))
    return own.groupBy("n_training_days", "alpha").agg(F.countDistinct(date).alias("sessions"), F.count(F.lit(1)).alias("rows"), F.corr("_score", label).alias("corr"), F.avg(F.pow(F.col("_score") - F.col(label), 2)).alias("mse"))


def label_sweep(df: DataFrame, features: list[str], labels: list[str], windows: list[int], alphas: list[float], date="Date", screen: float = 0.0) -> DataFrame:
    """rolling_ridge of several labels on the rows that have all of them: the long table with a column label."""
    whole = df
    for c in labels:
        whole = whole.filter(is_finite(F.col(c).cast("double")))
    calendar = df.select(date).distinct()
    whole = calendar.join(whole, date, "left")  # sessions without such rows still count
    out = None
    for c in labels:
        own = rolling_ridge(whole, features, c, windows, alphas, date, screen=screen).withColumn("label", F.lit(c))
        out = own if out is None else out.unionByName(own)
    return out
