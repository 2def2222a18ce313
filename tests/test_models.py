"""Rolling models against numpy on the rows themselves."""

import numpy as np
import pandas as pd
import pytest

from tickweave.operators import model


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(12)
    n, names = 1200, list("abcde")
    x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5))
    df = pd.DataFrame(x, columns=names)
    df["y"] = x @ rng.normal(size=5) + rng.normal(size=n)
    df["Date"] = np.sort(rng.choice([f"s{k:02d}" for k in range(12)], n))
    return df, names


def test_both_pls_components_against_deflated_rows(spark, panel):
    df, names = panel
    found = model.pls_weights(spark.createDataFrame(df), names, "y", 5, components=2).toPandas()
    for day in ("s05", "s08", "s11"):
        days = sorted(df["Date"].unique())
        own = df[df["Date"].isin(days[days.index(day) - 5 : days.index(day)])]
        x, y = own[names].to_numpy(), own["y"].to_numpy()
        x, y = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
        for component in (1, 2):
            w = x.T @ y
            w /= np.linalg.norm(w)
            got = found[(found["Date"] == day) & (found["component"] == component)].set_index("feature")["weight"][names].to_numpy()
            assert np.allclose(got, w, atol=1e-8)
            t = x @ w
            x, y = x - np.outer(t, x.T @ t / (t @ t)), y - t * (y @ t) / (t @ t)


def test_ridge_of_five_features_against_numpy(spark, panel):
    df, names = panel
    found = model.rolling_ridge(spark.createDataFrame(df), names, "y", [3, 6], [0.5, 20.0]).toPandas()
    days = sorted(df["Date"].unique())
    for day, n, alpha in (("s06", 3, 0.5), ("s11", 6, 20.0)):
        own = df[df["Date"].isin(days[days.index(day) - n : days.index(day)])]
        x, y = own[names].to_numpy(), own["y"].to_numpy()
        sd = x.std(0)
        z = (x - x.mean(0)) / sd
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(5), z.T @ (y - y.mean())) / sd
        got = found[(found["Date"] == day) & (found["n_training_days"] == n) & (found["alpha"] == alpha)].set_index("feature")["coef"]
        assert np.allclose(got[names], beta) and got[""] == pytest.approx(y.mean() - x.mean(0) @ beta)
