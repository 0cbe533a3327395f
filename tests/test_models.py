"""Models and graphs without SQL: known parameters, brute force, and small graphs."""

import numpy as np
import pytest

from longview.operators import cluster, embedding, encode, impute, normalize, quality, ranking, survival
from longview.plans import extended
from longview.sources import tables


def test_log_logistic_aft_finds_its_parameters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    u = rng.uniform(size=3000)
    t = np.exp(2.0 + 0.5 * x + 0.4 * np.log(u / (1 - u)))
    c = rng.exponential(40, size=3000)
    rows = [(float(min(a, b)), int(a <= b), float(v)) for a, b, v in zip(t, c, x, strict=True)]
    got = {r["term"]: r["coef"] for r in survival.log_logistic_aft(spark.createDataFrame(rows, "t double, e int, x double"), "t", "e", ["x"]).collect()}
    assert got["intercept"] == pytest.approx(2.0, abs=0.08) and got["x"] == pytest.approx(0.5, abs=0.06) and np.exp(got["log_scale"]) == pytest.approx(0.4, abs=0.04)


def test_adjusted_curves(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.exponential(10 / (1 + g))), 1, g, float(rng.normal())) for g in (0, 1) for _ in range(400)]
    out = survival.adjusted_curves(spark.createDataFrame(rows, "t double, e int, g int, x double"), "t", "e", ["x"], "g", points=5).collect()
    by = {(r["stratum"], round(r["time"], 6)): r for r in out}
    times = sorted({t for _, t in by})
    assert all(by["0", t]["survival"] > by["1", t]["survival"] for t in times[:3])
    assert all(r["low"] <= r["survival"] <= r["high"] for r in out)


def test_combat_equals_a_direct_computation(spark):
    rng = np.random.default_rng(5)
    batch = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 4)) * (1 + batch[:, None]) + batch[:, None] * [1, 2, 3, 4]
    rows = [(i, int(b), *map(float, v)) for i, (b, v) in enumerate(zip(batch, x, strict=True))]
    got = np.array([r[2:] for r in normalize.combat(spark.createDataFrame(rows, "i int, b int, c0 double, c1 double, c2 double, c3 double"), ["c0", "c1", "c2", "c3"], "b").orderBy("i").collect()])
    means = np.array([x[batch == b].mean(0) for b in range(3)])
    pooled, grand = np.sqrt(((x - means[batch]) ** 2).mean(0)), x.mean(0)
    z, want = (x - grand) / pooled, x.copy()
    for b in range(3):
        s = z[batch == b]
        gamma, delta, n = s.mean(0), s.var(0, ddof=1), len(s)
        t2, m, v = gamma.var(ddof=1), delta.mean(), delta.var(ddof=1)
        a, beta, g, d = (2 * v + m**2) / v, (m * v + m**3) / v, gamma, delta
        for _ in range(100):
            g = (t2 * n * gamma + d * gamma.mean()) / (t2 * n + d)
            d = (0.5 * ((s - g) ** 2).sum(0) + beta) / (n / 2 + a - 1)
        want[batch == b] = (s - g) / np.sqrt(d) * pooled + grand
    assert np.allclose(got, want, atol=1e-2)


def test_highly_variable(spark):
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal(size=(400, 12))) * np.arange(1, 13)
    x[:, 6] = rng.choice([0.1, 56.0], size=400, p=[0.9, 0.1])  # the mean of its neighbours, many times their variance
    names = [f"c{i}" for i in range(12)]
    out = quality.highly_variable(spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)), names, 1 / 12, span=1.0)
    assert [r["var"] for r in out.where("highly_variable").collect()] == ["c6"]


def test_linkage():
    d = np.array([[0, 2, 6, 10], [2, 0, 5, 9], [6, 5, 0, 4], [10, 9, 4, 0]], float)
    names = list("abcd")
    assert cluster.linkage(names, d, "single") == [(0, "a", "b", 2.0, 2), (1, "c", "d", 4.0, 2), (2, "a", "c", 5.0, 4)]
    assert cluster.linkage(names, d, "complete")[-1] == (2, "a", "c", 10.0, 4) and cluster.linkage(names, d)[-1] == (2, "a", "c", 7.5, 4)
    assert cluster.leaf_order(cluster.linkage(names, d), names) == names


@pytest.fixture(scope="module")
def two_rings(spark):
    pairs = [(k * 100 + i, k * 100 + (i + s) % 12) for k in (0, 1) for i in range(12) for s in (1, 2)] + [(0, 100)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "i long, j long, weight double")


def test_communities(two_rings):
    labels = cluster.modularity_communities(two_rings)
    found = {r["id"]: r["label"] for r in labels.collect()}
    assert len({found[i] for i in found if i < 100} & {found[i] for i in found if i >= 100}) == 0
    assert cluster.modularity(two_rings, labels) > 0.3


def test_diffusion_map_equals_dense_eigenvectors(two_rings):
    rows = two_rings.collect()
    ids = sorted({r["i"] for r in rows})
    w = np.zeros((len(ids),) * 2)
    for r in rows:
        w[ids.index(r["i"]), ids.index(r["j"])] += r["weight"]
    d = w.sum(1)
    q = w / np.outer(d, d)
    z = np.sqrt(q.sum(1))
    want = np.sort(np.linalg.eigvalsh(q / np.outer(z, z)))[::-1][:2]
    parts, values = cluster.diffusion_map(two_rings, 2, rounds=25)
    assert values == pytest.approx(list(want), abs=5e-3)
    time = {r["id"]: r["pseudotime"] for r in cluster.pseudotime(parts, values, 6).collect()}
    near, far = [time[i] for i in time if i < 100], [time[i] for i in time if i >= 100]
    assert time[6] == pytest.approx(0, abs=1e-9) and max(far) == 1 and np.mean(near) < 0.5 * np.mean(far)


def test_labels_are_encoded_alike_however_many(spark, monkeypatch):
    rows = [(i, None if i == 3 else f"{'é' if i % 5 == 0 else 'v'}{i % 17}") for i in range(60)]
    df = spark.createDataFrame(rows, "obs_id int, c string")
    few = sorted(map(tuple, encode.label_encode(df, ["c"]).collect()), key=str)
    monkeypatch.setattr(encode, "MANY", 2)
    assert sorted(map(tuple, encode.label_encode(df, ["c"]).collect()), key=str) == few


def test_encoding_over_time(spark):
    long = spark.createDataFrame([(1, "s", 0, "a"), (1, "s", 1, None), (1, "x", 0, "2.5")], "obs_id int, var string, t int, text string")
    got = {(r["var"], r["t"]): r["value"] for r in encode.encode_over_time(long, "s").collect()}
    assert got == {("cat_s_a", 0): 1.0, ("cat_s_a", 1): 0.0, ("cat_s_missing", 0): 0.0, ("cat_s_missing", 1): 1.0, ("x", 0): 2.5}


def test_queries_in_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=4)]) for i in range(60)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embedding.nearest(v, v, 3).collect()))
    monkeypatch.setattr(embedding, "QUERIES", 7)
    assert sorted(map(tuple, embedding.nearest(v, v, 3).collect())) == whole


def test_forest_imputation_fills_every_gap(spark):
    rows = [(i, float(i), None if i % 6 == 0 else 2.0 * i) for i in range(120)]
    out = impute.by_trees(spark.createDataFrame(rows, "obs_id int, a double, b double"), ["a", "b"], rounds=1, trees=10).collect()
    assert all(abs(r["b"] - 2 * r["a"]) < 40 for r in out)


def test_cohort_tracker_refuses_new_levels(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    tracker = ranking.CohortTracker(df, ["x"], ["c"])
    tracker(df, "all")
    with pytest.raises(ValueError, match="new categories"):
        tracker(spark.createDataFrame([(1.0, "z")], "x double, c string"), "odd")
    assert tracker.tracked_steps == 1 and extended.register is not None


def test_sources(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.csv").write_text("id,x,g\n1,2.5,u\n2,,v\n")
    frame = tables.read_csv(spark, str(tmp_path / "a.csv"), key="id", obs_only=["g"])
    assert frame.variables == ["x"] and [r["x"] for r in frame.x.orderBy("obs_id").collect()] == [2.5, None]
    (tmp_path / "b.json").write_text('{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p1"}}, {"resource": {"resourceType": "Observation", "id": "o1"}}]}')
    assert [r["id"] for r in tables.read_fhir(spark, str(tmp_path / "b.json"), "Patient").collect()] == ["p1"]
    back = tables.to_pandas(tables.from_pandas(spark, pd.DataFrame({"obs_id": [1, 2], "y": [0.5, float("nan")]}), "obs_id"))
    assert back["y"].isna().tolist() == [False, True]
    tables.write_parquet(frame, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "x")).count() == 2


@pytest.mark.parametrize("metric", ["soft_dtw", "gak"])
def test_series_kernels_equal_plain_recursions(metric):
    def plain(a, b):
        if metric == "soft_dtw":
            t = np.full((len(a) + 1, len(b) + 1), np.inf)
            t[0, 0] = 0
            for i in range(len(a)):
                for j in range(len(b)):
                    t[i + 1, j + 1] = (a[i] - b[j]) ** 2 - np.log(sum(np.exp(-x) for x in (t[i, j], t[i, j + 1], t[i + 1, j])))
            return t[-1, -1]
        t = np.zeros((len(a) + 1, len(b) + 1))
        t[0, 0] = 1
        for i in range(len(a)):
            for j in range(len(b)):
                k = np.exp(-((a[i] - b[j]) ** 2) / 2)
                t[i + 1, j + 1] = k / (2 - k) * (t[i, j] + t[i, j + 1] + t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(1)
    a, columns = rng.normal(size=6), [rng.normal(size=n) for n in (4, 7, 5)]
    grid = np.zeros((7, 3))
    for i, c in enumerate(columns):
        grid[: len(c), i] = c
    got = embedding._apart(a, grid, np.array([4, 7, 5]), metric)
    if metric == "soft_dtw":
        want = [plain(a, c) - (plain(a, a) + plain(c, c)) / 2 for c in columns]
    else:
        want = [1 - plain(a, c) / np.sqrt(plain(a, a) * plain(c, c)) for c in columns]
    assert got == pytest.approx(want)
