"""Survival curves, tests and regressions. Spark aggregates by event time; solvers see one row per time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import stats
from longview.functions.order import running_sum


def risk_table(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """(group,) time, observed, censored, removed, at_risk: one shuffle by time, then a running count."""
    keys = [group] if group else []
    both = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    by_time = both.groupBy(*keys, F.col(duration).cast("double").alias("time")).agg(
        F.sum(F.col(event).cast("long")).alias("observed"), F.count(F.lit(1)).alias("removed")
    )
    counted = running_sum(by_time, "time", {"at_risk": "removed"}, keys, descending=True)
    return counted.select(*keys, "time", "observed", (F.col("removed") - F.col("observed")).alias("censored"), "removed", "at_risk")


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """The risk table with ``survival`` and its Greenwood variance ``variance``; products are sums of logarithms."""
    keys = [group] if group else []
    d, n = F.col("observed"), F.col("at_risk")
    steps = risk_table(df, duration, event, group).withColumns(
        {"_l": F.when(n > d, F.log1p(-d / n)).otherwise(0.0), "_g": F.when(n > d, d / (n * (n - d))).otherwise(0.0), "_z": (n == d).cast("int")}
    )
    sums = running_sum(steps, "time", {"_sl": "_l", "_sg": "_g", "_sz": "_z"}, keys)
    survival = F.when(F.col("_sz") > 0, 0.0).otherwise(F.exp("_sl"))
    return sums.withColumn("survival", survival).withColumn("variance", F.col("survival") * F.col("survival") * F.col("_sg")).drop("_l", "_g", "_z", "_sl", "_sg", "_sz")


def kmf(df: DataFrame, durations: str, observed: str | None = None) -> DataFrame:
    """:func:`kaplan_meier` of bare durations; without ``observed`` every one of them is an event."""
    if observed is None:
        observed, df = "_observed", df.withColumn("_observed", F.lit(1))
    return kaplan_meier(df, durations, observed)


def nelson_aalen(df: DataFrame, duration: str, event: str, group: str | None = None, smooth: bool = True) -> DataFrame:
    """The risk table with the cumulative ``hazard``; tied events count one after another if ``smooth``."""
    keys = [group] if group else []
    step = (
        F.expr("aggregate(sequence(0, cast(greatest(observed, 1) as int) - 1), 0D, (a, i) -> a + 1D / (at_risk - i))") * (F.col("observed") > 0).cast("int")
        if smooth
        else F.col("observed") / F.col("at_risk")
    )
    table = risk_table(df, duration, event, group).withColumn("_step", step)
    return running_sum(table, "time", {"hazard": "_step"}, keys).drop("_step")


def logrank(df: DataFrame, duration: str, event: str, group: str, arm, weighting: str | None = None) -> tuple[float, float]:
    """(chi-square, p) of arm ``arm`` against all others, optionally weighted (wilcoxon, tarone-ware, peto)."""
    in_arm = F.coalesce(F.col(group) == arm, F.lit(False)).cast("long")
    both = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    e = F.col(event).cast("long")
    by_time = both.groupBy(F.col(duration).cast("double").alias("time")).agg(
        F.sum(e).alias("d"), F.count(F.lit(1)).alias("m"), F.sum(e * in_arm).alias("d1"), F.sum(in_arm).alias("m1")
    )
    risk = running_sum(by_time, "time", {"n": "m", "n1": "m1"}, descending=True)
    if weighting == "peto":
        risk = running_sum(risk.withColumn("_l", F.log1p(-F.col("d") / (F.col("n") + 1))), "time", {"_peto": "_l"})
    weight = {None: F.lit(1.0), "wilcoxon": F.col("n").cast("double"), "tarone-ware": F.sqrt("n"), "peto": F.exp("_peto") if weighting == "peto" else None}[weighting]
    risk = risk.withColumn("w", weight).where("d > 0")
    share = F.col("n1") / F.col("n")
    row = risk.agg(
        F.sum(F.col("w") * (F.col("d1") - F.col("d") * share)).alias("u"),
        F.sum(F.when(F.col("n") > 1, F.col("w") ** 2 * F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)).alias("v"),
    ).first()
    if not row["v"]:
        return 0.0, 1.0
    chi = row["u"] ** 2 / row["v"]
    return chi, stats.chi2_sf(df.sparkSession, chi, 1)


def cox(
    df: DataFrame, duration: str, event: str, covariates: list[str], rounds: int = 25, tolerance: float = 1e-7, strata: str | None = None, penalty: float = 0.0
) -> DataFrame:
    """(covariate, coef, exp_coef, se, z, p): proportional hazards by Newton steps, Efron's handling of ties.

    ``strata`` names a column whose groups have baselines of their own; ``penalty`` shrinks coefficients by their squares.

    Each step aggregates exp(xb), x exp(xb) and x x' exp(xb) by time; risk sets are reverse running sums of that
    table, and only numbers by time and covariate reach the driver.
    """
    spark, p = df.sparkSession, len(covariates)
    rows = df.select(duration, event, *covariates, *([strata] if strata else [])).na.drop()
    mean = rows.agg(*(F.avg(c).alias(c) for c in covariates), F.count(F.lit(1)).alias("_n")).first()
    x = [F.col(c).cast("double") - float(mean[c]) for c in covariates]
    rows = rows.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *(x[i].alias(f"x{i}") for i in range(p)), (F.col(strata).cast("string") if strata else F.lit("")).alias("s")).persist()
    beta = np.zeros(p)
    try:
        for _ in range(rounds):
            r = F.exp(sum((F.col(f"x{i}") * float(beta[i]) for i in range(p)), F.lit(0.0)))
            parts = [("r", r)] + [(f"r{i}", r * F.col(f"x{i}")) for i in range(p)] + [(f"r{i}_{j}", r * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
            sums = [F.sum(c).alias(n) for n, c in parts] + [F.sum(c * F.col("e")).alias(f"e{n}") for n, c in parts]
            sums += [F.sum(F.col(f"x{i}") * F.col("e")).alias(f"x{i}") for i in range(p)] + [F.sum("e").alias("d")]
            table = rows.groupBy("s", "t").agg(*sums).toPandas().sort_values(["s", "t"], ascending=[True, False])
            names = [n for n, _ in parts]
            risk, tied = table.groupby("s")[names].cumsum().to_numpy(), table[[f"e{n}" for n in names]].to_numpy()
            d, ex = table["d"].to_numpy(), table[[f"x{i}" for i in range(p)]].to_numpy()
            gradient, hessian = ex.sum(0), np.zeros((p, p))
            where = {n: k for k, n in enumerate(names)}
            for k in np.flatnonzero(d > 0):
                frac = np.arange(int(d[k])) / d[k]
                s = risk[k][None] - frac[:, None] * tied[k][None]
                m = s[:, 1 : p + 1] / s[:, :1]
                gradient = gradient - m.sum(0)
                for i in range(p):
                    for j in range(i, p):
                        h = (s[:, where[f"r{i}_{j}"]] / s[:, 0] - m[:, i] * m[:, j]).sum()
                        hessian[i, j] += h
                        hessian[j, i] = hessian[i, j]
            gradient, hessian = gradient - penalty * mean["_n"] * beta, hessian + penalty * mean["_n"] * np.eye(p)
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            beta = beta + step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0))
    z = np.divide(beta, se, out=np.zeros(p), where=se > 0)
    out = [(c, float(b), float(np.exp(b)), float(s), float(w), stats.normal_sf(spark, w)) for c, b, s, w in zip(covariates, beta, se, z, strict=True)]
    return spark.createDataFrame(out, "covariate string, coef double, exp_coef double, se double, z double, p double")


def weibull(df: DataFrame, duration: str, event: str, rounds: int = 60) -> tuple[float, float]:
    """(lambda, rho) of a two-parameter Weibull fit by Newton steps on aggregated sums; zero durations gain 1e-5."""
    t = F.when(F.col(duration) == 0, F.lit(1e-5)).otherwise(F.col(duration).cast("double"))
    rows = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull()).select(t.alias("t"), F.col(event).cast("double").alias("e"))
    base = rows.agg(F.sum("e").alias("d"), F.sum(F.col("e") * F.log("t")).alias("el")).first()
    by_time = rows.groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    rho, d = 1.0, base["d"] or 0.0
    if not d:
        return float("inf"), 1.0
    for _ in range(rounds):
        u = F.pow("t", F.lit(rho)) * F.col("k")
        row = by_time.agg(F.sum(u).alias("a"), F.sum(u * F.log("t")).alias("b"), F.sum(u * F.log("t") ** 2).alias("c")).first()
        g = d / rho + base["el"] - d * row["b"] / row["a"]
        h = -d / rho**2 - d * (row["c"] / row["a"] - (row["b"] / row["a"]) ** 2)
        step = g / h
        rho = max(rho - step, rho / 4)
        if abs(step) < 1e-9:
            break
    a = by_time.agg(F.sum(F.pow("t", F.lit(rho)) * F.col("k")).alias("a")).first()["a"]
    return float((a / d) ** (1 / rho)), float(rho)


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coef, se, t, p): least squares by one aggregation of cross products and a solve on the driver."""
    spark = df.sparkSession
    rows = df.select(y, *xs).na.drop()
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)] + [F.sum(F.col(y).cast("double") ** 2).alias("yy"), F.count(F.lit(1)).alias("n")]
    r = rows.agg(*sums).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([r[f"b{i}"] for i in range(k)], float)
    inverse = np.linalg.pinv(a)
    coef = inverse @ b
    s2 = (r["yy"] - coef @ b) / max(1, r["n"] - k)
    se = np.sqrt(np.maximum(s2 * np.diag(inverse), 0))
    out = [(n, float(c), float(e), float(c / e) if e else None, stats.t_sf(spark, c / e, r["n"] - k) if e else None) for n, c, e in zip(["intercept", *xs], coef, se, strict=True)]
    return spark.createDataFrame(out, "term string, coef double, se double, t double, p double")


def glm(df: DataFrame, y: str, xs: list[str], family: str = "gaussian"):
    """A fitted generalised linear model: gaussian, binomial, gamma, or inversegaussian (inverse squared link)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="_f").transform(df.select(y, *xs).na.drop())
    kind = {"family": "tweedie", "variancePower": 3.0, "linkPower": -2.0} if family.lower() == "inversegaussian" else {"family": family.lower()}
    return GeneralizedLinearRegression(featuresCol="_f", labelCol=y, **kind).fit(rows)


def aft(df: DataFrame, duration: str, event: str, covariates: list[str]):
    """A fitted Weibull accelerated-failure-time model with one shape; zero durations gain 1e-5."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    t = F.when(F.col(duration) == 0, F.lit(1e-5)).otherwise(F.col(duration).cast("double"))
    rows = df.select(duration, event, *covariates).na.drop().withColumn("_t", t).withColumn("_e", F.col(event).cast("double"))
    rows = VectorAssembler(inputCols=covariates, outputCol="_f").transform(rows)
    return AFTSurvivalRegression(featuresCol="_f", labelCol="_t", censorCol="_e").fit(rows)


def nested_f(spark, deviance_small: float, deviance_big: float, df_small: int, df_big: int, scale_big: float, n: int) -> float:
    """p-value of the F-test between nested linear models; ``df_`` are model degrees of freedom."""
    more = df_big - df_small
    return stats.f_sf(spark, (deviance_small - deviance_big) / (more * scale_big), more, n - df_big)


def anova(spark, small: DataFrame, big: DataFrame) -> DataFrame:
    """(model, df_resid, ssr, df_diff, ss_diff, f, p): two rows that compare nested fits of :func:`fit_summary`."""
    a, b = small.first(), big.first()
    more, gain = a["df_resid"] - b["df_resid"], a["ssr"] - b["ssr"]
    f = (gain / more) / (b["ssr"] / b["df_resid"]) if more and b["ssr"] else None
    p = stats.f_sf(spark, f, more, b["df_resid"]) if f is not None else None
    rows = [("small", a["df_resid"], a["ssr"], 0, None, None, None), ("big", b["df_resid"], b["ssr"], more, gain, f, p)]
    return spark.createDataFrame(rows, "model string, df_resid long, ssr double, df_diff long, ss_diff double, f double, p double")


def design_of(df: DataFrame, formula: str) -> tuple[DataFrame, str, list[str]]:
    """(rows, outcome, terms) of ``y ~ a + b + a:b + np.log(c) + C(d)``: products, logarithms and categories become columns.

    ``a*b`` stands for a + b + a:b; a category's first level is left out; rows with gaps are left out.
    """
    left, right = (part.strip() for part in formula.split("~"))
    terms: list[str] = []
    for term in (t.strip() for t in right.split("+")):
        if term == "1":
            continue
        if "*" in term:
            a, b = (x.strip() for x in term.split("*"))
            terms += [a, b, f"{a}:{b}"]
        else:
            terms.append(term)

    def column(term: str):
        if term.startswith(("np.log(", "log(")):
            return F.log(F.col(term[term.index("(") + 1 : -1]).cast("double"))
        return F.col(term).cast("double")

    out, names, kinds = df, [], dict(df.dtypes)
    for term in dict.fromkeys(terms):
        bare = term[2:-1] if term.startswith("C(") else term
        if term.startswith("C(") or kinds.get(bare) == "string":
            for v in sorted(r[0] for r in df.where(F.col(bare).isNotNull()).select(F.col(bare).cast("string")).distinct().collect())[1:]:
                out = out.withColumn(f"{bare}[T.{v}]", F.when(F.col(bare).isNotNull(), (F.col(bare).cast("string") == v).cast("double")))
                names.append(f"{bare}[T.{v}]")
            continue
        value = column(term) if ":" not in term else column(term.split(":")[0].strip()) * column(term.split(":")[1].strip())
        out = out.withColumn(f"_t{len(names)}", value)
        names.append(term)
    columns = [F.col(f"`{n}`") if n.endswith("]") else F.col(f"_t{i}") for i, n in enumerate(names)]
    rows = out.select(F.col(left).cast("double").alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(columns))).na.drop()
    return rows, "_y", names


def ols_formula(df: DataFrame, formula: str) -> DataFrame:
    """:func:`ols` of a formula."""
    rows, y, names = design_of(df, formula)
    fitted = ols(rows, y, [f"_x{i}" for i in range(len(names))])
    table = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (f"_x{i}", n))) if names else None
    return fitted.withColumn("term", F.coalesce(F.element_at(table, F.col("term")), F.col("term"))) if names else fitted


def fit_summary(df: DataFrame, formula: str) -> DataFrame:
    """(n, df_model, df_resid, ssr, r2) of a least-squares fit, from the same sums."""
    rows, y, names = design_of(df, formula)
    xs = [f"_x{i}" for i in range(len(names))]
    coef = {r["term"]: r["coef"] for r in ols(rows, y, xs).collect()}
    fitted = sum((F.col(x) * float(coef[x]) for x in xs), F.lit(float(coef["intercept"])))
    k = len(xs)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y) - fitted) ** 2).alias("ssr"), (F.var_pop(y) * F.count(F.lit(1))).alias("_t")).select(
        "n", F.lit(k).cast("long").alias("df_model"), (F.col("n") - k - 1).alias("df_resid"), "ssr", (1 - F.col("ssr") / F.col("_t")).alias("r2")
    )


def log_logistic_aft(df: DataFrame, duration: str, event: str, covariates: list[str], rounds: int = 50, tolerance: float = 1e-8, penalty: float = 0.0) -> DataFrame:
    """(term, coef, se, z, p): log-logistic accelerated failure times, log t = xb + s w with w logistic; ``log_scale`` is log s.

    Newton steps on one row of sums a round; zero durations gain 1e-5 and rows with gaps are left out.
    """
    spark, k = df.sparkSession, len(covariates) + 1
    t = F.when(F.col(duration) == 0, F.lit(1e-5)).otherwise(F.col(duration).cast("double"))
    rows = df.select(duration, event, *covariates).na.drop()
    rows = rows.select(F.log(t).alias("l"), F.col(event).cast("double").alias("e"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(covariates))).persist()
    try:
        first = rows.agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"), F.count(F.lit(1)).alias("n")).first()
        theta = np.zeros(k + 1)
        theta[0], theta[k] = first["m"] or 0.0, np.log(max(first["s"] or 1.0, 1e-3) * np.sqrt(3) / np.pi)
        for _ in range(rounds):
            scale = float(np.exp(theta[k]))
            w = (F.col("l") - sum((F.col(f"x{i}") * float(theta[i]) for i in range(k)), F.lit(0.0))) / scale
            w = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), w))
            p = 1 / (1 + F.exp(-w))
            r, q = F.col("e") - (1 + F.col("e")) * p, (1 + F.col("e")) * p * (1 - p)
            x = [F.col(f"x{i}") / scale for i in range(k)]
            sums = [F.sum(-x[i] * r).alias(f"g{i}") for i in range(k)] + [F.sum(-F.col("e") - w * r).alias(f"g{k}")]
            sums += [F.sum(-q * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            sums += [F.sum(x[i] * (r - q * w)).alias(f"h{i}_{k}") for i in range(k)] + [F.sum(w * r - q * w * w).alias(f"h{k}_{k}")]
            row = rows.agg(*sums).first()
            g = np.array([row[f"g{i}"] for i in range(k + 1)])
            h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
            ridge = np.array([0.0] + [penalty * first["n"]] * (k - 1) + [0.0])
            g, h = g - ridge * theta, h - np.diag(ridge)
            low, vectors = np.linalg.eigh(-h)
            step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(low), 1e-9))  # uphill even where not yet concave
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
            theta = theta + step
            if np.abs(step).max() < tolerance:
                break
    finally:
        rows.unpersist()
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-h)), 0))
    names = ["intercept", *covariates, "log_scale"]
    out = [(n, float(c), float(s), float(c / s) if s else None, stats.normal_sf(spark, c / s) if s else None) for n, c, s in zip(names, theta, se, strict=True)]
    return spark.createDataFrame(out, "term string, coef double, se double, z double, p double")


def baseline_hazard(df: DataFrame, duration: str, event: str, coef: dict[str, float]) -> DataFrame:
    """(time, hazard): Breslow's cumulative baseline hazard, at covariates of zero."""
    risk = F.exp(sum((F.col(c).cast("double") * float(b) for c, b in coef.items()), F.lit(0.0)))
    rows = df.select(duration, event, *coef).na.drop()
    by_time = rows.groupBy(F.col(duration).cast("double").alias("time")).agg(F.sum(F.col(event).cast("double")).alias("d"), F.sum(risk).alias("r"))
    steps = running_sum(by_time, "time", {"n": "r"}, descending=True).withColumn("_h", F.col("d") / F.col("n"))
    return running_sum(steps, "time", {"hazard": "_h"}).select("time", "hazard")


def adjusted_curves(
    df: DataFrame, duration: str, event: str, covariates: list[str], strata: str, method: str = "average", points: int = 50, alpha: float = 0.05, profile: dict[str, float] | None = None
) -> DataFrame:
    """(stratum, time, survival, low, high): Cox curves had everyone been in each stratum, at ``points`` times.

    ``average`` standardises over all rows, with normal bounds of that mean; ``conditional`` gives the curve of one
    ``profile`` (by default the means), without bounds. ``strata`` is a covariate of few values.
    """
    spark = df.sparkSession
    inputs = [strata, *(c for c in covariates if c != strata)]
    rows = df.select(duration, event, *inputs).na.drop()
    coef = {r["covariate"]: r["coef"] for r in cox(rows, duration, event, inputs).collect()}
    curve = baseline_hazard(rows, duration, event, coef)
    last = rows.where(F.col(event) == 1).agg(F.max(F.col(duration).cast("double"))).first()[0]
    grid = [float(last) * (i + 1) / points for i in range(points)]
    found = curve.agg(*(F.max(F.when(F.col("time") <= g, F.col("hazard"))).alias(f"h{i}") for i, g in enumerate(grid))).first()
    hazard = [float(found[f"h{i}"] or 0.0) for i in range(points)]
    z, out = stats.normal_quantile(spark, 1 - alpha / 2), []
    mean = rows.agg(*(F.avg(c).alias(c) for c in inputs)).first().asDict() | (profile or {})
    for v in sorted(r[0] for r in rows.select(strata).distinct().collect()):
        fixed = {strata: F.lit(float(v))} | ({c: F.lit(float(mean[c])) for c in inputs if c != strata} if method == "conditional" else {})
        risk = F.exp(sum((fixed.get(c, F.col(c).cast("double")) * float(b) for c, b in coef.items()), F.lit(0.0)))
        made = [a for i, h in enumerate(hazard) for a in (F.avg(F.exp(-risk * h)).alias(f"m{i}"), F.stddev_samp(F.exp(-risk * h)).alias(f"s{i}"))]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *made).first()
        for i, g in enumerate(grid):
            m, half = row[f"m{i}"], z * (row[f"s{i}"] or 0.0) / np.sqrt(row["n"])
            bounds = (None, None) if method == "conditional" else (max(0.0, m - half), min(1.0, m + half))
            out.append((str(v), g, float(m), *(b if b is None else float(b) for b in bounds)))
    return spark.createDataFrame(out, "stratum string, time double, survival double, low double, high double")
