"""Rates against an active-set solver, in and out of reach; many domains and features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import mixing


def active_set(a, b):
    """Least squares of a x - b over x >= 0, after Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max() <= 1e-9 * np.abs(b).max() * np.abs(a).max():
            break
        free[slope.argmax()] = True
        while True:
            best = np.zeros_like(x)
            best[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if best[free].min() > 0:
                break
            low = free & (best <= 0)
            step = (x[low] / (x[low] - best[low])).min()
            x = x + step * (best - x)
            free &= x > 1e-12
            x[~free] = 0
        x = best
    return x


def fitted(spark, p, n, goal):
    k = p.shape[1]
    members = spark.createDataFrame([(float(m), *map(float, q)) for m, q in zip(n, p)], "n_tokens double, " + ", ".join(f"p{d} double" for d in range(k)))
    rate, told = mixing.fit_rates(members, list(map(float, goal)))
    r = np.array([x["r"] for x in members.withColumn("r", rate).collect()])
    assert (r >= 0).all()
    totals = (r * n) @ p
    assert told["totals"] == pytest.approx(totals.tolist(), rel=1e-6) and told["residual"] == pytest.approx((totals - goal).tolist(), rel=1e-5, abs=1e-6 * sum(goal))
    return r, float(((totals - goal) ** 2).sum()), told


@pytest.mark.parametrize("shares", [(0.95, 0.05), (0.999, 0.001), (0.6, 0.4), (0.75, 0.25)])
def test_two_domains(spark, shares):
    rng = np.random.default_rng(5)
    first = rng.uniform(0.2, 0.8, 60)
    p, n = np.stack([first, 1 - first], 1), rng.integers(50, 2000, 60)
    goal = np.array(shares) * n.sum()
    r, squares, told = fitted(spark, p, n, goal)
    best = active_set((p * n[:, None]).T, goal)
    least = float((((p * n[:, None]).T @ best - goal) ** 2).sum())
    assert squares <= least * (1 + 1e-3) + (2e-4 * goal.sum()) ** 2
    assert told["reached"] == (least < 1e-9 * (goal**2).sum())
    if told["reached"]:
        assert (r > 0).mean() > 0.1, "rates stay spread over the documents"


def test_some_domains_in_and_out_of_reach(spark):
    rng = np.random.default_rng(6)
    for k, low in ((3, 0.0), (5, 0.4)):
        p = rng.dirichlet(np.ones(k), 200) * (1 - low) + low / k
        n = rng.integers(1, 3000, 200) * (rng.random(200) < 0.9)
        for share in (rng.dirichlet(np.ones(k)), np.eye(k)[0] * 0.98 + 0.02 / k):
            goal = share * n.sum()
            _, squares, _ = fitted(spark, p, n, goal)
            a = (p * n[:, None]).T
            least = float(((a @ active_set(a, goal) - goal) ** 2).sum())
            assert squares <= least * (1 + 1e-3) + k * (2e-4 * goal.sum()) ** 2


def test_many_domains_and_features(spark):
    """70 domains with 80 words each that tell."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(2100):
        d = i % 70
        rows.append((i, " ".join(f"w{d}x{j}" for j in rng.permutation(80)[:70])))
        labels.append((i, f"d{d:02d}"))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    model = mixing.fit_classifier(docs, known)
    assert len(model["domains"]) == 70 and sum(map(len, model["odds"])) > 5000
    weights = {f"d{d:02d}": 1.0 + d % 3 for d in range(70)}
    out = mixing.mix(docs, known, weights)
    found = out.select("doc_id", F.expr("array_position(posteriors, array_max(posteriors))").alias("best"), "rate", "n_tokens", "posteriors", "residual").collect()
    assert all(r["best"] == r["doc_id"] % 70 + 1 for r in found)
    totals = sum(np.array(r["posteriors"]) * r["rate"] * r["n_tokens"] for r in found)
    goal = np.array([weights[d] for d in model["domains"]]) / sum(weights.values()) * sum(r["n_tokens"] for r in found)
    assert np.abs(totals - goal).max() < 1e-3 * goal.sum() and np.abs(np.array(found[0]["residual"])).max() < 1e-3 * goal.sum()
