"""Exact quantiles, ranks and running sums: the way for large tables gives what the way for small ones gives."""

import random

import numpy as np
import pytest

from longview.functions import order


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(order, "SMALL", 10)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    values = [rng.choice([-3.5, 0.0, -0.0, 2.0, 1e-300, 7e12]) if i % 3 else rng.gauss(0, 100) for i in range(400)] + [None] * 5
    return [(i, "ab"[i % 2] if i % 7 else None, v) for i, v in enumerate(values)]


def test_exact_quantiles(spark, rows, large):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = order.exact_quantiles(df, ["v", "i"], probs)
    assert got["v"] == pytest.approx(list(np.quantile([v for _, _, v in rows if v is not None], probs)))
    assert got["i"] == pytest.approx(list(np.quantile(range(405), probs)))
    assert order.exact_quantiles(df.where("v is null"), ["v"], probs) == {"v": [None] * 5}


def test_quantile_table(spark, rows, large):
    df = spark.createDataFrame(rows + [(900, "c", 1.0), (901, "d", None)], "i int, g string, v double")
    got = {r["g"]: r["v"] for r in order.quantile_table(df, ["v"], [0.25, 0.5], ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["d"] is None
    for g in ("a", "b", "c", None):
        own = [v for _, k, v in rows + [(900, "c", 1.0)] if k == g and v is not None]
        assert got[g] == pytest.approx(list(np.quantile(own, [0.25, 0.5])))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sum(spark, large, descending, inclusive):
    rng = random.Random(2)
    table = [(k, float(x), rng.randrange(5)) for k in ("a", None) for x in rng.sample(range(1000), 60)]
    got = order.running_sum(spark.createDataFrame(table, "k string, x double, n long"), "x", {"s": "n"}, ["k"], descending, inclusive)
    for r in got.collect():
        before = [n for k, x, n in table if k == r["k"] and ((x > r["x"]) if descending else (x < r["x"]))]
        assert r["s"] == sum(before) + (r["n"] if inclusive else 0)


def test_average_ranks(spark, rows, large):
    got = {r["value"]: r["rank"] for r in order.average_ranks(spark.createDataFrame(rows, "i int, g string, v double"), "v").collect()}
    values = np.array([v for _, _, v in rows if v is not None])
    assert got == {v: (values < v).sum() + ((values == v).sum() + 1) / 2 for v in set(values.tolist())}
