"""What larger tables and odd rows break: each case failed once."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from longview.functions import near
from longview.operators import causal, embedding, impute, ranking
from longview.plans import catalogue


def _arms(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = rng.uniform(size=n) < 1 / (1 + np.exp(-x))
    y = 3.0 * t + x + rng.normal(size=n)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, y, x, strict=True))]
    return causal.design(spark.createDataFrame(rows, "obs_id long, t double, y double, v double"), "t", ["v"], "y")


def test_aipw_has_plain_floats(spark):
    e = causal.aipw(_arms(spark))
    assert all(type(v) is float for v in (e.value, e.se, e.low, e.high))
    row = catalogue._effect(spark, e).first()
    assert row["se"] == e.se > 0 and row["low"] < 3 < row["high"] and row["high"] - row["low"] == pytest.approx(3.92 * e.se)


def test_wilcoxon_of_millions_of_rows(spark):
    n = 4_200_000  # the product of both groups' sizes and all rows is beyond a long
    got = {r["group"]: r for r in ranking.wilcoxon(spark.range(n).selectExpr("id % 2 as g", "id % 3 = 0 and id % 2 = 0 as v").selectExpr("g", "cast(v as int) as v"), "g", "v").collect()}
    ones, half = n // 6, n // 2
    low, high = (n - ones + 1) / 2, n - ones + (ones + 1) / 2
    want = {"0": (half - ones) * low + ones * high, "1": half * low}
    for g, s in want.items():
        assert got[g]["n"] == half and got[g]["rank_sum"] == s
        assert got[g]["z"] == pytest.approx((s - half * (n + 1) / 2) / (half * half * (n + 1) / 12.0) ** 0.5)


@pytest.mark.parametrize(("k", "estimand", "decimals", "rows"), [(1, "att", 8, 50), (3, "ate", 1, 10**6), (2, "ate", 2, 20)])
def test_matching_equals_brute_force(spark, monkeypatch, k, estimand, decimals, rows):
    monkeypatch.setattr(near, "ROWS", rows)
    rng = np.random.default_rng(k)
    v = np.round(rng.normal(size=300), decimals)
    t = (rng.uniform(size=300) < 1 / (1 + np.exp(-2 * v))).astype(float)
    data = [(i * 7919 % 300, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, 3 * t + v + rng.normal(size=300), v, strict=True))]
    table = causal.design(spark.createDataFrame(data, "obs_id long, t double, y double, v double"), "t", ["v"], "y")
    logit = F.log(F.col("ps") / (1 - F.col("ps")))
    scored = sorted(map(tuple, causal.propensity(table, (1e-6, 1 - 1e-6)).select("obs_id", "t", "y", logit).collect()))
    width, effects, dropped = 0.2 * np.std([r[3] for r in scored], ddof=1), [], 0
    for _, arm, y, at in scored:
        if arm == 1 or estimand == "ate":
            best = sorted((abs(at - r[3]), r[0], r[2]) for r in scored if r[1] != arm and abs(at - r[3]) <= width)[:k]
            effects += [(y - np.mean([b[2] for b in best])) * (1 if arm else -1)] if best else []
            dropped += not best
    got = causal.matching(table, k, estimand=estimand)
    assert got.value == pytest.approx(np.mean(effects)) and (got.n, got.dropped) == (len(effects), dropped)


@pytest.mark.parametrize("estimand", ["att", "ate"])
def test_matching_lists_no_pairs(spark, estimand):
    table = causal.design(spark.range(200_000).selectExpr("id as obs_id", "id % 2 as t", "double(id % 2 + id % 5) as y", "id div 2 % 3 as v"), "t", ["v"], "y")
    began = time.time()
    got = causal.matching(table, estimand=estimand)
    assert (got.n, got.dropped) == (200_000 if estimand == "ate" else 100_000, 0) and time.time() - began < 60


@pytest.mark.parametrize(("donors", "rows"), [(200, 10**6), (200, 20), (3, 10**6)])
def test_knn_by_one_anchor_equals_brute_force(spark, monkeypatch, donors, rows):
    monkeypatch.setattr(near, "ROWS", rows)
    rng = np.random.default_rng(8)
    anchors = [None if i % 17 == 0 else float("nan") if i % 29 == 0 else float(round(a, i % 3)) for i, a in enumerate(rng.normal(size=donors + 60))]
    data = [(i * 31 % 997, a, float(i) if i < donors else None) for i, a in enumerate(anchors)]
    got = {r["obs_id"]: r["y"] for r in impute.knn(spark.createDataFrame(data, "obs_id long, a double, y double"), ["y"], ["a"], k=5).collect()}

    def apart(a, b):
        return float("inf") if a is None or b is None or a != a or b != b else abs(a - b)

    known = [r for r in data if r[2] is not None]
    for i, a, y in data:
        best = sorted((apart(a, b), j, v) for j, b, v in known)[:5]
        assert got[i] == pytest.approx(np.mean([v for *_, v in best]) if y is None else y)


def test_knn_by_one_anchor_lists_no_pairs(spark):
    df = spark.range(600_000).selectExpr("id as obs_id", "double(id % 50) as a", "case when id % 11 > 0 then double(id) end as y")
    began = time.time()
    got = impute.knn(df, ["y"], ["a"]).where("obs_id % 11 = 0 and obs_id % 50 = 7").agg(F.min("y"), F.max("y")).first()
    want = np.mean([i for i in range(7, 600, 50) if i % 11][:5])
    assert tuple(got) == (want, want) and time.time() - began < 60


@pytest.mark.parametrize("metric", ["soft_dtw", "gak"])
def test_series_distances_by_blocks_equal_single_pairs(spark, metric):
    rng = np.random.default_rng(9)
    series = {(k, var): rng.normal(size=int(rng.integers(2, 12))) * (30 if k % 5 == 0 else 1) for k in range(30) for var in "uv"}
    long = spark.createDataFrame([(k, var, t, float(x)) for (k, var), s in series.items() for t, x in enumerate(s)], "obs_id long, var string, t int, value double")
    got = {(r["a"], r["b"]): r["distance"] for r in embedding.series_distances(long, long.where("obs_id % 10 = 0"), block=7, metric=metric).collect()}
    assert got.keys() == {(a, b) for a in (0, 10, 20) for b in range(30) if a != b}
    for (a, b), d in got.items():
        pairs = [(series[a, v], series[b, v]) for v in "uv" if min(len(series[a, v]), len(series[b, v])) >= 4]
        each = [embedding._apart(x, y[:, None], np.array([len(y)]), metric)[0] for x, y in pairs]
        assert d == pytest.approx(np.mean(each) if each else 0.0)


def test_soft_dtw_query_has_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    got = [(r["a"], r["b"]) for r in catalogue.queries()["soft_dtw_distances"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids for b in ids if a != b}


@pytest.mark.parametrize(("metric", "block"), [("soft_dtw", 4), ("soft_dtw", 1024), ("gak", 4)])
def test_all_series_distances_equal_those_of_queries(spark, metric, block):
    rng = np.random.default_rng(11)
    series = {(k, var): rng.normal(size=int(rng.integers(2, 12))) * (30 if k % 5 == 0 else 1) for k in range(40) for var in ("uv" if k % 3 else "u")}
    rows = [(k or None, var, t, float(x)) for (k, var), s in series.items() for t, x in enumerate(s)] + [(k or None, "u", 99, None) for k in range(41)]
    long = spark.createDataFrame(rows, "obs_id long, var string, t int, value double")
    found = [tuple(r) for r in embedding.series_distances_all(long, block=block, metric=metric).collect()]
    got = {(a, b): d for a, b, d in found}
    want = {(r["a"], r["b"]): r["distance"] for r in embedding.series_distances(long, long, metric=metric).collect()}
    want |= {(b, a): d for (a, b), d in want.items()}  # a null id is no query
    assert len(found) == len(got) == 41 * 40 and got == pytest.approx(want)


def test_long_series_keep_logarithms():
    a, b = np.linspace(0, 1, 400), np.linspace(0, 2, 350)[:, None]
    got = embedding._apart(a, b, np.array([350]), "gak")
    short = embedding._apart(a[:40], b[:35], np.array([35]), "gak")
    assert 0 < short[0] < 1 and 0 < got[0] <= 1


@pytest.mark.parametrize("metric", ["soft_dtw", "gak"])
def test_series_kernels_cost_a_few_times_dtw(metric):
    rng = np.random.default_rng(10)
    sizes = np.sort(np.clip(rng.poisson(7.6, 4096), 4, 18))[::-1].copy()
    grid, a = np.where(np.arange(18)[:, None] < sizes, rng.exponential(50, size=(18, 4096)), 0.0), rng.exponential(50, size=8)

    def seconds(metric):
        began = time.perf_counter()
        embedding._apart(a, grid, sizes, metric)
        return time.perf_counter() - began

    assert min(seconds(metric) for _ in range(3)) < 20 * min(seconds("dtw") for _ in range(3))
