"""Average and conditional treatment effects, and their diagnostics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions.near import nearest_mean

CLIP = (0.01, 0.99)


@dataclass(frozen=True)
class Effect:
    method: str
    value: float
    se: float | None = None
    low: float | None = None
    high: float | None = None
    n: int = 0
    dropped: int = 0
    params: dict = field(default_factory=dict)


def design(df: DataFrame, treatment: str, covariates: list[str], outcome: str | None = None, key: str = "obs_id") -> DataFrame:
    """Complete cases as (key, t, y, x vector); text covariates become indicators without their first level."""
    if treatment in covariates or outcome in covariates:
        raise ValueError("treatment and outcome may not be covariates")
    rows = df.select(key, treatment, *([outcome] if outcome else []), *covariates).na.drop()
    levels = {r[0] for r in rows.select(F.col(treatment).cast("double")).distinct().limit(3).collect()}
    if levels != {0.0, 1.0}:
        raise ValueError("treatment must be 0 or 1, with both present")
    kinds, inputs = dict(rows.dtypes), []
    for c in covariates:
        if kinds[c] == "string":
            for v in sorted(r[0] for r in rows.select(c).distinct().collect())[1:]:  # a column of the design each, so all are needed here
                rows = rows.withColumn(f"{c}={v}", (F.col(c) == v).cast("double"))
                inputs.append(f"{c}={v}")
        else:
            inputs.append(c)
    rows = VectorAssembler(inputCols=inputs, outputCol="x").transform(rows)
    y = F.col(outcome).cast("double") if outcome else F.lit(None).cast("double")
    return rows.select(key, F.col(treatment).cast("double").alias("t"), y.alias("y"), "x")


def propensity(table: DataFrame, clip: tuple[float, float] | None = CLIP, weight: str | None = None) -> DataFrame:
    """``table`` with ``ps``, by ridge-penalised logistic regression (penalty 1 / n), rows counted by ``weight`` if given."""
    learner = LogisticRegression(featuresCol="x", labelCol="t", regParam=1.0 / max(1, table.count()), standardization=False)
    model = (learner.setWeightCol(weight) if weight else learner).fit(table)
    ps = vector_to_array("probability")[1]
    if clip:
        ps = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), ps))
    return model.transform(table).withColumn("ps", ps).drop("rawPrediction", "probability", "prediction")


def weights(stabilized: bool, share: float | Column) -> Column:
    share = F.lit(share) if not isinstance(share, Column) else share
    plain = F.when(F.col("t") == 1, 1 / F.col("ps")).otherwise(1 / (1 - F.col("ps")))
    return F.when(F.col("t") == 1, share / F.col("ps")).otherwise((1 - share) / (1 - F.col("ps"))) if stabilized else plain


def _hajek(w: Column) -> Column:
    arm = lambda k: F.sum(F.when(F.col("t") == k, w * F.col("y"))) / F.sum(F.when(F.col("t") == k, w))
    return arm(1) - arm(0)


def _drawn(replicate: int, seed: int) -> Column:
    """How often a bootstrap replicate draws a row: a Poisson(1) count from a hash of the row's id."""
    u = F.pmod(F.xxhash64("obs_id", F.lit(seed * 10_007 + replicate)), F.lit(1 << 24)) / float(1 << 24)
    return sum(((u > c).cast("int") for c in np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)])), F.lit(0))


def iptw(table: DataFrame, stabilized: bool = True, clip=CLIP, n_bootstrap: int = 0, seed: int = 0, refit: bool = True) -> Effect:
    """Weighted difference of means. A bootstrap replicate counts rows by Poisson draws, and fits its own propensities.

    Without ``refit`` replicates share one fit and are made in one aggregation.
    """
    table = table.persist()
    scored = propensity(table, clip).persist()
    try:
        share = scored.agg(F.avg("t")).first()[0]
        made = [_hajek(weights(stabilized, share)).alias("value"), F.count(F.lit(1)).alias("n")]
        if not refit:
            made += [_hajek(weights(stabilized, share) * _drawn(b, seed)).alias(f"b{b}") for b in range(n_bootstrap)]
        row = scored.agg(*made).first()
        if refit:
            draws = []
            for b in range(n_bootstrap):
                own = table.withColumn("_times", _drawn(b, seed).cast("double")).where("_times > 0")
                found = propensity(own, clip, "_times")
                ratio = found.agg(F.sum(F.col("t") * F.col("_times")) / F.sum("_times")).first()[0]
                draws.append(found.agg(_hajek(weights(stabilized, ratio) * F.col("_times"))).first()[0])
        else:
            draws = [row[f"b{b}"] for b in range(n_bootstrap)]
    finally:
        scored.unpersist()
        table.unpersist()
    draws = np.array(draws, float)
    spread = (float(draws.std(ddof=1)), *map(float, np.quantile(draws, [0.025, 0.975]))) if n_bootstrap > 1 else (None, None, None)
    return Effect("iptw", row["value"], *spread, n=row["n"])


def _outcomes(table: DataFrame, fit_on: DataFrame | None = None, with_treatment: bool = True) -> DataFrame:
    """``table`` with the outcome predicted under treatment and under control (mu1, mu0) by linear regression."""
    if with_treatment:
        both = VectorAssembler(inputCols=["t", "x"], outputCol="tx")
        model = LinearRegression(featuresCol="tx", labelCol="y", solver="normal").fit(both.transform(fit_on or table))
        coef, base = model.coefficients.toArray(), model.intercept
        x = sum((vector_to_array("x")[i] * float(c) for i, c in enumerate(coef[1:])), F.lit(float(base)))
        return table.withColumn("mu0", x).withColumn("mu1", x + float(coef[0]))
    out = table
    for arm in (0, 1):
        model = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(table.where(F.col("t") == arm))
        x = sum((vector_to_array("x")[i] * float(c) for i, c in enumerate(model.coefficients.toArray())), F.lit(float(model.intercept)))
        out = out.withColumn(f"mu{arm}", x)
    return out


def g_computation(table: DataFrame) -> Effect:
    row = _outcomes(table).agg(F.avg(F.col("mu1") - F.col("mu0")).alias("value"), F.count(F.lit(1)).alias("n")).first()
    return Effect("g-computation", row["value"], n=row["n"])


def aipw(table: DataFrame, clip=CLIP) -> Effect:
    """Doubly robust effect with its influence-function standard error."""
    t, y, ps = F.col("t"), F.col("y"), F.col("ps")
    psi = F.col("mu1") - F.col("mu0") + t * (y - F.col("mu1")) / ps - (1 - t) * (y - F.col("mu0")) / (1 - ps)
    row = _outcomes(propensity(table, clip)).agg(F.avg(psi).alias("v"), F.stddev_samp(psi).alias("s"), F.count(F.lit(1)).alias("n")).first()
    se = row["s"] / math.sqrt(row["n"])  # a plain float, as Spark's types refuse NumPy's
    return Effect("aipw", row["v"], se, row["v"] - 1.96 * se, row["v"] + 1.96 * se, row["n"])


def matching(table: DataFrame, k: int = 1, caliper: float = 0.2, key: str = "obs_id", estimand: str = "att") -> Effect:
    """Effect by the k nearest rows of the other arm in propensity logit within ``caliper`` standard deviations.

    ``att`` matches treated rows to controls, with replacement; ``ate`` also matches controls to treated rows and takes
    the mean over both. Rows with one logit have the same matches, so logits are matched, not rows.
    """
    logit = F.log(F.col("ps") / (1 - F.col("ps"))) + 0.0
    scored = propensity(table, (1e-6, 1 - 1e-6)).select(key, "t", "y", logit.alias("l")).persist()
    try:
        width = (scored.agg(F.stddev_samp("l")).first()[0] or 0.0) * caliper or 1e-9
        total, n, rows = 0.0, 0, 0
        for arm in (1, 0) if estimand == "ate" else (1,):
            own = scored.where(F.col("t") == arm).groupBy("l").agg(F.count(F.lit(1)).alias("n_own"), F.sum("y").alias("y_own"))
            others = scored.where(F.col("t") != arm).select(F.col("l").alias("v"), F.col(key).alias("key"), "y")
            near = nearest_mean(own.select(F.col("l").alias("q")), others, k, width)
            joined = own.join(near, F.col("l") == F.col("q"), "left")
            apart = F.sum(F.when(F.col("n") > 0, F.col("y_own") - F.col("n_own") * F.col("y")))
            row = joined.agg(apart.alias("s"), F.sum(F.when(F.col("n") > 0, F.col("n_own"))).alias("n"), F.sum("n_own").alias("rows")).first()
            total += (row["s"] or 0.0) * (1 if arm else -1)
            n, rows = n + (row["n"] or 0), rows + row["rows"]
    finally:
        scored.unpersist()
    return Effect("matching", total / n if n else None, n=n, dropped=rows - n)


def t_learner(table: DataFrame) -> DataFrame:
    return _outcomes(table, with_treatment=False).withColumn("cate", F.col("mu1") - F.col("mu0"))


def s_learner(table: DataFrame) -> DataFrame:
    return _outcomes(table).withColumn("cate", F.col("mu1") - F.col("mu0"))


def x_learner(table: DataFrame, clip=CLIP) -> DataFrame:
    """Imputed effects of both arms, blended by the propensity."""
    base = _outcomes(propensity(table, clip), with_treatment=False)
    d = F.when(F.col("t") == 1, F.col("y") - F.col("mu0")).otherwise(F.col("mu1") - F.col("y"))
    base = base.withColumn("d", d)
    for arm in (0, 1):
        model = LinearRegression(featuresCol="x", labelCol="d", solver="normal").fit(base.where(F.col("t") == arm))
        tau = sum((vector_to_array("x")[i] * float(c) for i, c in enumerate(model.coefficients.toArray())), F.lit(float(model.intercept)))
        base = base.withColumn(f"tau{arm}", tau)
    return base.withColumn("cate", F.col("ps") * F.col("tau0") + (1 - F.col("ps")) * F.col("tau1"))


def balance(df: DataFrame, treatment: str, covariates: list[str], weight: Column | None = None) -> DataFrame:
    """(covariate, smd, variance_ratio): unweighted moments with n - 1, or weighted ones over the sum of weights."""
    made, t = [], F.col(treatment).cast("int")
    for c in covariates:
        for arm in (0, 1):
            x = F.when(t == arm, F.col(c).cast("double"))
            if weight is None:
                made += [F.avg(x).alias(f"{c}|{arm}m"), F.var_samp(x).alias(f"{c}|{arm}v")]
            else:
                w = F.when(t == arm, weight)
                m = F.sum(w * x) / F.sum(w)
                made += [m.alias(f"{c}|{arm}m"), (F.sum(w * x * x) / F.sum(w) - m * m).alias(f"{c}|{arm}v")]
    row = df.agg(*made)
    cells = [
        F.struct(
            F.lit(c).alias("covariate"),
            F.coalesce((F.col(f"{c}|1m") - F.col(f"{c}|0m")) / F.nullif(F.sqrt((F.col(f"{c}|1v") + F.col(f"{c}|0v")) / 2), F.lit(0.0)), F.lit(0.0)).alias("smd"),
            (F.col(f"{c}|1v") / F.nullif(F.col(f"{c}|0v"), F.lit(0.0))).alias("variance_ratio"),
        )
        for c in covariates
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def positivity(table: DataFrame, eps: float = 0.05) -> DataFrame:
    """Propensity range, mean and percentiles by arm, and the share within [eps, 1 - eps]."""
    scored = propensity(table, None)
    return scored.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.min("ps").alias("min"), F.max("ps").alias("max"), F.avg("ps").alias("mean"),
        F.percentile("ps", F.lit(0.5)).alias("median"), F.percentile("ps", F.lit(0.05)).alias("p05"), F.percentile("ps", F.lit(0.95)).alias("p95"),
        F.avg(F.col("ps").between(eps, 1 - eps).cast("double")).alias("support"),
    )
