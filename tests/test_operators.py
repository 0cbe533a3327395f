"""Exact small vectors for the operators over health data."""

import math

import numpy as np
import pytest

from longview.frame import HealthFrame, infer_feature_types, to_long
from longview.functions import stats
from longview.operators import association, embedding, encode, filters, impute, normalize, quality, ranking, survival
from longview.plans import catalogue


def col(df, name, key="obs_id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_qc_metrics(spark):
    df = spark.createDataFrame([(0, 0.21, None, 41.42), (1, None, None, 7.234)], "obs_id int, a double, b double, c double")
    var = {r["var"]: r for r in quality.qc_var(to_long(df, ["a", "b", "c"])).collect()}
    assert [var[v]["missing_values_abs"] for v in "abc"] == [1, 2, 0]
    assert [round(var[v]["missing_values_pct"], 4) for v in "abc"] == [50, 100, 0]
    assert var["a"]["entropy_of_missingness"] == pytest.approx(1) and var["b"]["entropy_of_missingness"] == pytest.approx(0, abs=1e-6)
    assert var["a"]["mean"] == 0.21 and var["b"]["mean"] is None and var["c"]["mean"] == pytest.approx(24.327)
    obs = quality.qc_obs(df, ["a", "b", "c"])
    assert col(obs, "missing_values_abs") == [1, 2]
    assert col(obs, "entropy_of_missingness") == pytest.approx([0.9183, 0.9183], abs=1e-4)


def test_normalisations(spark):
    df = spark.createDataFrame([(0, 3.4), (1, 5.4), (2, 5.7)], "obs_id int, x double")
    assert col(normalize.scale(df, ["x"]), "x") == pytest.approx([-1.4039999, 0.55506986, 0.84893], abs=1e-5)
    assert col(normalize.log(df, ["x"]), "x") == pytest.approx([1.4816046, 1.856298, 1.9021075], abs=1e-6)
    assert col(normalize.log(df, ["x"], offset=0.5), "x") == pytest.approx([1.3609766, 1.7749524, 1.8245492], abs=1e-6)
    both = spark.createDataFrame([(0, -1.0, 5.0), (1, -5.0, 6.0), (2, -10.0, -20.0)], "obs_id int, a double, b double")
    out = normalize.offset_negative(both, ["a", "b"])
    assert col(out, "a") == [19, 15, 10] and col(out, "b") == [25, 26, 0]
    same = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, None)], "obs_id int, x double")
    assert col(normalize.scale(same, ["x"]), "x") == [0, 0, None]


def test_locf(spark):
    rows = [(0, "v", t, x) for t, x in enumerate([1.0, None, 3.0, None])] + [(0, "w", t, x) for t, x in enumerate([None, 2.0, None, 4.0])]
    rows += [(1, "w", t, 1.0) for t in range(4)]
    df = spark.createDataFrame(rows, "obs_id int, var string, t int, value double")
    out = {(r["obs_id"], r["var"], r["t"]): r["value"] for r in impute.locf(df, ["obs_id"]).collect()}
    assert [out[0, "v", t] for t in range(4)] == [1, 1, 3, 3]
    assert [out[0, "w", t] for t in range(4)] == pytest.approx([10 / 6, 2, 2, 4])


def test_imputation_keeps_what_is_known(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.5), (2, None), (3, 7.0), (4, 7.0), (5, 2.5)], "obs_id int, x double")
    assert col(impute.simple(df, ["x"], "most_frequent"), "x") == [1.0, 2.5, 2.5, 7.0, 7.0, 2.5]
    assert col(impute.simple(df, ["x"], "median"), "x")[2] == 2.5
    with pytest.raises(ValueError):
        impute.simple(df, ["x"], "nothing")


def test_filters_and_limits(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(10, None)], "obs_id int, x double")
    assert col(filters.clip_values(df, ["x"], (2, 5)), "x") == [2, 2, 2, 3, 4, 5, 5, 5, 5, 5, None]
    assert col(filters.winsorize(df, ["x"], (0.2, 0.2)), "x") == [2, 2, 2, 3, 4, 5, 6, 7, 7, 7, None]
    with pytest.raises(ValueError):
        filters.filter_features(to_long(df, ["x"]))
    with pytest.raises(ValueError):
        filters.filter_features(to_long(df, ["x"]), min_obs=1, time_mode="proportion", prop=0.0)


def test_adjusted_p_values():
    assert stats.adjust([0.01, 0.02, 0.03, 1.0], "benjamini-hochberg") == pytest.approx([0.04, 0.04, 0.04, 1.0])
    assert stats.adjust([0.01, 0.02, 0.03, 1.0], "bonferroni") == pytest.approx([0.04, 0.08, 0.12, 1.0])
    assert stats.adjust([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])


def test_survival(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (4.0, 0)], "t double, e int")
    km = survival.kaplan_meier(df, "t", "e").orderBy("time").collect()
    assert [r["at_risk"] for r in km] == [5, 4, 2, 1]
    assert [r["survival"] for r in km] == pytest.approx([0.8, 0.6, 0.3, 0.3])
    assert [r["hazard"] for r in survival.nelson_aalen(df, "t", "e").orderBy("time").collect()] == pytest.approx([0.2, 0.45, 0.95, 0.95])


def test_encoding_and_sampling(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "obs_id int, c string")
    hot = encode.one_hot(df, ["c"]).orderBy("obs_id").collect()
    assert [tuple(r) for r in hot] == [(0, 1, 0, 0), (1, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3)]
    assert encode.balanced(df, "c").count() == 2 and encode.balanced(df, "c", over=True).count() == 4


def test_rank_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 5.0), (5.0, 9.0)], "a double, b double")
    r, n = association.correlation(df, "a", "b", "spearman")
    assert n == 4 and r == pytest.approx(0.8)
    few = association.correlations(df.limit(2), ["a", "b"]).first()
    assert few["corr"] is None and few["p"] == 1.0


def test_independence(spark):
    df = spark.createDataFrame([("x", "p")] * 30 + [("x", "q")] * 10 + [("y", "p")] * 10 + [("y", "q")] * 30, "a string, b string")
    value, dof, p = ranking.power_divergence(df, "a", "b", "chi-square")
    assert dof == 1 and value == pytest.approx(18.05) and p < 1e-4


def test_types(spark):
    frame = HealthFrame(x=spark.createDataFrame([(0, 1, "u", 0.5), (1, 0, "v", 1.5), (2, 1, "u", 2.5)], "obs_id int, flag int, s string, v double"))
    assert infer_feature_types(frame).types == {"flag": "categorical", "s": "categorical", "v": "numeric"}
    assert not math.isnan(1.0)


def test_series_are_compared_with_all_others(spark):
    rng = np.random.default_rng(0)
    held = {(i, v): rng.normal(size=rng.integers(2, 9)) for i in range(0, 120, 3) for v in "xy"}
    rows = [(i, v, t, float(x)) for (i, v), s in held.items() for t, x in enumerate(s)] + [(i, "x", 99, None) for i in range(0, 120, 3)] + [(200, "y", 1, None)]
    long = spark.createDataFrame(rows, "obs_id int, var string, t int, value double")
    ids, queries = [*range(0, 120, 3), 200], [0, 3, 60]
    expected = {}
    for a in queries:
        for b in ids:
            both = [embedding.dtw(held[a, v], held[b, v]) for v in "xy" if min(len(held.get((a, v), ())), len(held.get((b, v), ()))) >= 4]
            expected[a, b] = sum(both) / max(1, len(both))
    found = embedding.series_distances(long, long.where("obs_id in (0, 3, 60)"), block=16).collect()
    got = {(r["a"], r["b"]): r["distance"] for r in found}
    assert got == pytest.approx({k: d for k, d in expected.items() if k[0] != k[1]}) and len(found) == len(got)


def test_dtw_query_searches_every_series(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    pairs = {(r["a"], r["b"]) for r in catalogue.queries()["dtw_distances"](spark, sf).collect()}
    assert pairs == {(a, b) for a in ids for b in ids if a % 50 == 0 and a != b}


def test_group_graph_rests_on_all_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T + np.diag(np.full(90, np.inf))
    got = {(r["query"], r["neighbor"]) for r in embedding.nearest_all(table, 5, block=20).collect()}
    assert got == {(i, int(j)) for i in range(90) for j in np.argsort(d[i])[:5]}
    sf = "/root/testdata/sf0.001"
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    graph = catalogue.queries()["neighbor_groups"](spark, sf).collect()
    assert {r["g1"] for r in graph} == set(labels.values())
    # an edge weighs at most 1, so ten edges from each 50th vector alone could not weigh as much
    assert sum(r["weight"] for r in graph) > 10 * sum(i % 50 == 0 for i in labels)


def test_pca_uses_every_component(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x -= x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x)
    load = vectors[:, ::-1][:, :2]
    load = load * np.sign(load[np.abs(load).argmax(0), range(2)])
    got = catalogue.queries()["pca"](spark, sf).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [r["vec_id"] for r in rows]
    assert np.allclose([[r["pc1"], r["pc2"]] for r in got], x @ load, atol=1e-5)
