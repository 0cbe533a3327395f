"""Group ranking of features, baseline tables and cohort tracking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import stats
from longview.functions.order import average_ranks, running_sum
from longview.session import cut

#: Power-divergence family: name -> lambda.
LAMBDAS = {
    "chi-square": 1.0, "g-test": 0.0, "freeman-tukey": -0.5, "mod-log-likelihood": -1.0, "neyman": -2.0, "cressie-read": 2 / 3,
}


def group_moments(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, var, n, mean, variance, rest_n, rest_mean, rest_variance): each group against all others, from sums."""
    made = []
    for c in columns:
        x = F.col(c).cast("double")
        made += [F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum(x * x).alias(f"{c}_q")]
    groups = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg(*made)
    cells = groups.select(
        "group", F.explode(F.array(*(F.struct(F.lit(c).alias("var"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_s").alias("s"), F.col(f"{c}_q").alias("q")) for c in columns))).alias("c")
    ).select("group", "c.*")
    every = Window.partitionBy("var")
    for c in "nsq":
        cells = cells.withColumn(f"r{c}", F.sum(c).over(every) - F.col(c))
    mean = lambda p: F.col(f"{p}s") / F.nullif(F.col(f"{p}n"), F.lit(0))
    var = lambda p: (F.col(f"{p}q") - F.col(f"{p}s") * F.col(f"{p}s") / F.nullif(F.col(f"{p}n"), F.lit(0))) / F.nullif(F.col(f"{p}n") - 1, F.lit(0))
    return cells.select(
        "group", "var", "n", mean("").alias("mean"), var("").alias("variance"),
        F.col("rn").alias("rest_n"), mean("r").alias("rest_mean"), var("r").alias("rest_variance"),
    )


def welch(moments: DataFrame, overestimate: bool = False) -> DataFrame:
    """Welch's t and its degrees of freedom for each row of :func:`group_moments`."""
    n2 = F.col("n") if overestimate else F.col("rest_n")
    a, b = F.col("variance") / F.col("n"), F.col("rest_variance") / n2
    t = (F.col("mean") - F.col("rest_mean")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    dof = (a + b) * (a + b) / F.nullif(a * a / (F.col("n") - 1) + b * b / (n2 - 1), F.lit(0.0))
    return moments.withColumn("t", t).withColumn("df", dof)


def wilcoxon(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, rank_sum, z): rank-sum statistic of each group, average ranks for ties.

    Ranks come from one row per distinct value: running counts over that table, not over all rows.
    """
    rows = df.where(F.col(column).isNotNull() & F.col(group).isNotNull())
    cells = rows.groupBy(F.col(group).cast("string").alias("group"), F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    values = running_sum(cells.groupBy("v").agg(F.sum("k").alias("k")), "v", {"before": "k"}, inclusive=False)
    ranks = values.select("v", (F.col("before") + (F.col("k") + 1) / 2).alias("rank"))
    out = cells.join(ranks, "v").groupBy("group").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum"))
    total = F.sum("n").over(Window.partitionBy()).cast("double")  # products of three counts pass a long from 3.4 million rows
    n1, n2 = F.col("n"), total - F.col("n")
    z = (F.col("rank_sum") - n1 * (total + 1) / 2) / F.nullif(F.sqrt(n1 * n2 * (total + 1) / 12.0), F.lit(0.0))
    return out.withColumn("z", z)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def power_divergence(df: DataFrame, a: str, b: str, test: str = "g-test") -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of independence; Yates' correction for 2 x 2 tables."""
    rows = contingency(df, a, b).collect()  # one row per pair of categories
    xs, ys = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    seen = np.zeros((len(xs), len(ys)))
    for r in rows:
        seen[xs.index(r["a"]), ys.index(r["b"])] = r["n"]
    dof = (len(xs) - 1) * (len(ys) - 1)
    if dof <= 0:
        return 0.0, 0, 1.0
    expected = np.outer(seen.sum(1), seen.sum(0)) / seen.sum()
    if dof == 1:
        off = expected - seen
        seen = seen + np.sign(off) * np.minimum(0.5, np.abs(off))
    lam = LAMBDAS[test]
    with np.errstate(divide="ignore", invalid="ignore"):
        if lam == 0:
            terms = 2 * np.where(seen > 0, seen * np.log(seen / expected), 0)
        elif lam == -1:
            terms = 2 * expected * np.log(expected / seen)
        else:
            terms = 2 * seen * ((seen / expected) ** lam - 1) / (lam * (lam + 1))
    value = float(terms.sum())
    return value, dof, stats.chi2_sf(df.sparkSession, value, dof)


def rank_features(df: DataFrame, group: str, numeric: list[str], categorical: list[str] = (), test: str = "g-test", correction: str = "benjamini-hochberg") -> DataFrame:
    """(group, var, score, logfc, p, p_adj) of each feature in each group against all others, by adjusted p."""
    spark, rows = df.sparkSession, []
    for r in welch(group_moments(df, group, list(numeric))).collect() if numeric else []:
        p = stats.t_sf(spark, r["t"], r["df"]) if r["t"] is not None and r["df"] else 1.0
        fold = float(np.log2(r["mean"] / r["rest_mean"])) if r["mean"] and r["rest_mean"] and r["mean"] / r["rest_mean"] > 0 else None
        rows.append([r["group"], r["var"], r["t"], fold, p])
    if categorical:
        for g in sorted(x[0] for x in df.where(F.col(group).isNotNull()).select(F.col(group).cast("string")).distinct().collect()):
            marked = df.withColumn("_in", (F.col(group).cast("string") == g).cast("int"))
            for c in categorical:
                value, _, p = power_divergence(marked, c, "_in", test)
                rows.append([g, c, value, 1.0, p])
    out = []
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        for r, q in zip(own, stats.adjust([r[4] for r in own], correction), strict=True):
            out.append((*r, float(q)))
    frame = spark.createDataFrame(out, "group string, var string, score double, logfc double, p double, p_adj double")
    return frame.orderBy("group", "p_adj", "var")


def filter_ranked(ranked: DataFrame, p_below: float | None = None, fold_min: float | None = None, fold_max: float | None = None) -> DataFrame:
    out = ranked
    if p_below is not None:
        out = out.where(F.col("p_adj") < p_below)
    if fold_min is not None:
        out = out.where(F.col("logfc") >= fold_min)
    return out if fold_max is None else out.where(F.col("logfc") <= fold_max)


def importances(df: DataFrame, target: str, features: list[str], model: str = "rf", seed: int = 42) -> DataFrame:
    """(var, importance) for predicting ``target``: random forest, or coefficients of scaled linear models."""
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    rows = df.select(target, *features).na.drop()
    text = dict(rows.dtypes)[target] == "string"
    rows = StringIndexer(inputCol=target, outputCol="_y").fit(rows).transform(rows) if text else rows.withColumn("_y", F.col(target).cast("double"))
    train, _ = VectorAssembler(inputCols=features, outputCol="_r").transform(rows).randomSplit([0.8, 0.2], seed)
    train = StandardScaler(inputCol="_r", outputCol="_x", withMean=True).fit(train).transform(train)
    args = {"featuresCol": "_x", "labelCol": "_y"}
    if model == "rf":
        fitted = (RandomForestClassifier if text else RandomForestRegressor)(seed=seed, **args).fit(train)
        values = fitted.featureImportances.toArray()
    else:
        fitted = (LinearSVC if model == "svm" and text else LinearRegression)(**args).fit(train)
        values = fitted.coefficients.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "var string, importance double")


def table_one(df: DataFrame, group: str, continuous: list[str], categorical: list[str], nonnormal: list[str] = ()) -> DataFrame:
    """(var, level, group, n, value, spread_low, spread_high): mean and sd, median and quartiles, or share."""
    g = F.col(group).cast("string").alias("group")
    rows, made = df.where(F.col(group).isNotNull()), []
    for c in continuous:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts = [q[1], q[0], q[2]] if c in nonnormal else [F.avg(x), F.stddev_samp(x), F.lit(None).cast("double")]
        made.append(F.struct(F.lit(c).alias("var"), F.lit(None).cast("string").alias("level"), F.count(x).alias("n"), parts[0].alias("value"), parts[1].alias("spread_low"), parts[2].alias("spread_high")))
    out = rows.groupBy(g).agg(F.array(*made).alias("m")).select("group", F.explode("m").alias("m")).select("group", "m.*") if made else None
    if categorical:
        long = rows.select(g, *(F.col(c).cast("string").alias(c) for c in categorical)).unpivot(["group"], categorical, "var", "level")
        counts = long.where("level is not null").groupBy("group", "var", "level").agg(F.count(F.lit(1)).alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy("group", "var"))
        none = F.lit(None).cast("double")
        cells = counts.select("group", "var", "level", "n", share.alias("value"), none.alias("spread_low"), none.alias("spread_high"))
        out = cells if out is None else out.unionByName(cells)
    return out


def table_one_tests(df: DataFrame, group: str, continuous: list[str], categorical: list[str], nonnormal: list[str] = (), adjust: str | None = None) -> DataFrame:
    """(var, test, statistic, df1, df2, p, p_adj, smd): one test a variable, from sums by group.

    Two groups: Welch's t; more: one-way analysis of variance; ``nonnormal``: Kruskal-Wallis on average ranks with its
    correction for ties; categories: chi-square without Yates' correction. ``smd`` is the greatest standardised
    difference between two groups (numbers only).
    """
    spark, rows = df.sparkSession, df.where(F.col(group).isNotNull())
    out = []
    for c in continuous:
        x = F.col(c).cast("double")
        got = rows.where(x.isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).orderBy("g").collect()
        n, m, v = (np.array([r[k] if r[k] is not None else 0.0 for r in got], float) for k in "nmv")
        k, total = len(n), n.sum()
        pooled = np.sqrt((v[:, None] + v[None]) / 2)
        smd = float(np.max(np.abs(m[:, None] - m[None]) / np.where(pooled == 0, np.inf, pooled))) if k > 1 else None
        if k < 2:
            out.append((c, None, None, None, None, None, smd))
        elif c in nonnormal:
            ranks = average_ranks(rows, c)
            r = rows.where(x.isNotNull()).join(ranks.select(F.col("value").alias(c), "rank"), c).groupBy(F.col(group).cast("string").alias("g")).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n")).collect()
            ties = ranks.agg(F.sum(F.pow(F.col("k").cast("double"), 3) - F.col("k"))).first()[0] or 0.0
            h = 12 / (total * (total + 1)) * sum(q["s"] ** 2 / q["n"] for q in r) - 3 * (total + 1)
            h /= 1 - ties / (total**3 - total) if total > 1 else 1
            out.append((c, "kruskal-wallis", float(h), float(k - 1), None, stats.chi2_sf(spark, h, k - 1), smd))
        elif k == 2:
            a, b = v[0] / n[0], v[1] / n[1]
            t, dof = (m[0] - m[1]) / np.sqrt(a + b), (a + b) ** 2 / (a * a / (n[0] - 1) + b * b / (n[1] - 1))
            out.append((c, "welch", float(t), float(dof), None, float(stats.t_sf(spark, t, dof)), smd))
        else:
            grand = (n * m).sum() / total
            f = ((n * (m - grand) ** 2).sum() / (k - 1)) / (((n - 1) * v).sum() / (total - k))
            out.append((c, "anova", float(f), float(k - 1), float(total - k), stats.f_sf(spark, f, k - 1, total - k), smd))
    for c in categorical:
        cells = contingency(rows, group, c).collect()
        xs, ys = sorted({r["a"] for r in cells}), sorted({r["b"] for r in cells})
        seen = np.zeros((len(xs), len(ys)))
        for r in cells:
            seen[xs.index(r["a"]), ys.index(r["b"])] = r["n"]
        dof = (len(xs) - 1) * (len(ys) - 1)
        expected = np.outer(seen.sum(1), seen.sum(0)) / seen.sum() if dof > 0 else seen
        chi = float(((seen - expected) ** 2 / np.where(expected == 0, 1, expected)).sum())
        out.append((c, "chi-square", chi, float(dof), None, stats.chi2_sf(spark, chi, dof), None))
    adjusted = stats.adjust([1.0 if r[5] is None else r[5] for r in out], adjust)
    table = [(*r[:6], float(q), r[6]) for r, q in zip(out, adjusted, strict=True)]
    return spark.createDataFrame(table, "var string, test string, statistic double, df1 double, df2 double, p double, p_adj double, smd double")


class CohortTracker:
    """Sizes and summaries of a cohort after each step, as a tree of steps. Levels and tables stay in Spark."""

    def __init__(self, df: DataFrame, continuous: list[str], categorical: list[str]):
        self.continuous, self.categorical, self.steps = continuous, categorical, []
        self.known = cut(self._levels(df)) if categorical else None

    def _levels(self, df: DataFrame) -> DataFrame:
        wide = df.select(*(F.col(c).cast("string").alias(c) for c in self.categorical))
        return wide.unpivot([], self.categorical, "var", "level").where("level is not null").distinct()

    def __call__(self, df: DataFrame, label: str, operation: str = "", parent: str | None = None) -> DataFrame:
        labels = [s["label"] for s in self.steps]
        if parent is not None and labels.count(parent) != 1:
            raise ValueError(f"parent {parent!r} is unknown or ambiguous")
        if self.categorical:
            fresh = self._levels(df).join(self.known, ["var", "level"], "left_anti").orderBy("var", "level").limit(5).collect()
            if fresh:
                raise ValueError(f"new categories, among them {[tuple(r) for r in fresh]}")
        table = table_one(df.withColumn("_all", F.lit("all")), "_all", self.continuous, self.categorical).drop("group")
        if self.categorical:  # known levels that are gone count as none
            gone = self.known.join(table.select("var", "level"), ["var", "level"], "left_anti")
            gone = gone.select("var", "level", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("value"), F.lit(None).cast("double").alias("spread_low"), F.lit(None).cast("double").alias("spread_high"))
            table = table.unionByName(gone)
        n = df.count()
        self.steps.append({"label": label, "operation": operation, "parent": parent or (labels[-1] if labels else None), "n": n, "text": f"{label}\n (n={n})", "table": cut(table)})
        return df

    @property
    def tracked_steps(self) -> int:
        return len(self.steps)

    def tracked_tables(self, spark) -> DataFrame:
        out = None
        for i, s in enumerate(self.steps):
            part = s["table"].select(
                F.lit(i).alias("step"), F.lit(s["label"]).alias("label"), F.lit(s["parent"]).cast("string").alias("parent"), F.lit(s["n"]).cast("long").alias("cohort"),
                "var", "level", "n", "value", F.col("spread_low").alias("spread"),
            )
            out = part if out is None else out.union(part)
        return out if out is not None else spark.createDataFrame([], "step int, label string, parent string, cohort long, var string, level string, n long, value double, spread double")
