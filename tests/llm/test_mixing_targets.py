"""Rates against least squares in numpy, with a target of zero and with targets out of reach."""

import numpy as np
import pytest

from varloom.llm import mixing


def least_squares(n, p, goal, low):
    """The domains' tokens at the minimum of the same objective, by many plain projected steps over single documents."""
    base = (n[:, None] * p).sum(axis=0)
    r = np.maximum(np.ones(len(n)), low)
    for _ in range(20_000):
        gap = ((r * n) @ p - goal) / base
        r = np.maximum(low, r - p @ gap)
    return (r * n) @ p


@pytest.mark.parametrize(("weights", "low"), [({"x": 0.2, "y": 0.4, "z": 0.4}, 0.0), ({"x": 0.5, "y": 0.5}, 0.0), ({"x": 1.0}, 0.0), ({"x": 0.7, "y": 0.2, "z": 0.1}, 0.8)])
def test_rates_reach_the_least_squares(spark, weights, low):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.15, 0.15, 0.15), 150)
    n = rng.integers(5, 400, 150)
    rows = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "i int, __n long, __p array<double>")
    df, reached, goal, met = mixing.fit_rates(rows, ["x", "y", "z"], weights, low, passes=60, keep_every=20)
    want = least_squares(n.astype(float), p, np.array([goal[d] for d in "xyz"]), low)
    total = n.sum()
    assert abs(sum(goal.values()) - total) < 1e-6
    assert np.abs(np.array([reached[d] for d in "xyz"]) - want).max() <= 0.01 * total
    assert met == all(abs(reached[d] - goal[d]) <= mixing.CLOSE * total for d in "xyz")
    rates = np.array([r.rate for r in df.orderBy("i").collect()])
    assert rates.min() >= low and np.allclose((rates * n) @ p, [reached[d] for d in "xyz"])


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(1, 10, [0.5, 0.5])], "i int, __n long, __p array<double>")
    _, reached, goal, met = mixing.fit_rates(rows, ["a", "b"], {"a": 1.0}, passes=5)
    assert not met and goal == {"a": 10.0, "b": 0.0}
