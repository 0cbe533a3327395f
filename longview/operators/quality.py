"""Quality-control metrics, laboratory outlier checks and group summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.frame import to_long
from longview.functions.order import average_ranks, quantile_table


def entropy(missing: Column, total: Column) -> Column:
    """Binary entropy in bits of the share missing, with the share kept within [1e-10, 1 - 1e-10]."""
    p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), missing / total))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def qc_var(long: DataFrame) -> DataFrame:
    """Metrics of each variable of a long table (var, value): one row of sums and one of quartiles a variable."""
    base = long.groupBy("var").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("standard_deviation"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    base = base.join(quantile_table(long, ["value"], [0.25, 0.5, 0.75], ["var"]).withColumnRenamed("value", "q"), "var")
    missing = F.col("total") - F.col("n")
    q1, q3 = F.col("q")[0], F.col("q")[2]
    spread = 1.5 * (q3 - q1)
    return base.select(
        "var",
        missing.alias("missing_values_abs"),
        (missing / F.col("total") * 100).alias("missing_values_pct"),
        entropy(missing, F.col("total")).alias("entropy_of_missingness"),
        "mean",
        F.col("q")[1].alias("median"),
        "standard_deviation",
        "min",
        "max",
        ((F.col("min") < q1 - spread) | (F.col("max") > q3 + spread)).alias("iqr_outliers"),
        F.when(F.col("mean") != 0, F.col("standard_deviation") / F.col("mean")).alias("coefficient_of_variation"),
        (F.col("min") == F.col("max")).alias("is_constant"),
        F.when(F.col("mean") != 0, (F.col("max") - F.col("min")) / F.col("mean") * 100).alias("range_ratio"),
    )


def qc_obs(df: DataFrame, columns: list[str], key: str = "obs_id") -> DataFrame:
    """Missing-value metrics of each row, as row expressions: no shuffle."""
    missing = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    total = F.lit(len(columns))
    return df.select(
        key,
        missing.alias("missing_values_abs"),
        (missing / total * 100).alias("missing_values_pct"),
        entropy(missing, total).alias("entropy_of_missingness"),
    )


def qc_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of categorical variables, and their share of the values present."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "var", "value")
    return long.groupBy("var").agg(
        F.count_distinct("value").alias("unique_values_abs"),
        (F.count_distinct("value") / F.count("value")).alias("unique_values_ratio"),
    )


def qc_lab(df: DataFrame, column: str, method: str = "iqr", score: str = "zscore", group: str | None = None) -> DataFrame:
    """``df`` with ``{column}_outlier`` and ``{column}_score``, optionally within groups.

    Parameters come from one aggregation by group and are joined back (small: one row per group), rather
    than from windows that would bring a group into one task. Fewer than two values: no flag, no score.
    """
    keys = [group] if group else []
    x = F.col(column).cast("double")
    table = df.groupBy(*keys) if keys else df.groupBy()
    stats = table.agg(
        F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"),
    )
    quantiles = quantile_table(df, [column], [0.025, 0.25, 0.5, 0.75, 0.975], keys).withColumnRenamed(column, "_q")
    stats = stats.join(quantiles, keys) if keys else stats.crossJoin(F.broadcast(quantiles))  # one row each
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    iqr = F.col("_q")[3] - F.col("_q")[1]
    enough = (F.col("_n") >= 2) & x.isNotNull()
    if method == "modified_zscore":
        off = joined.select(*keys, F.abs(x - F.col("_q")[2]).alias("_off"))
        mad = quantile_table(off, ["_off"], [0.5], keys).select(*keys, F.col("_off")[0].alias("_mad"))
        joined = joined.join(mad, keys) if keys else joined.crossJoin(F.broadcast(mad))
    flag = {
        "iqr": lambda: (x < F.col("_q")[1] - 1.5 * iqr) | (x > F.col("_q")[3] + 1.5 * iqr),
        "quantile": lambda: (x < F.col("_q")[0]) | (x > F.col("_q")[4]),
        "zscore": lambda: (F.col("_s") > 0) & (F.abs(x - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) > 3),
        "modified_zscore": lambda: F.abs(0.6745 * (x - F.col("_q")[2]) / F.nullif(F.col("_mad"), F.lit(0.0))) > 3.5,
    }[method]()
    if score == "percentile":
        ranks = average_ranks(df.select(*keys, x.alias("_x")), "_x", keys).select(*keys, F.col("value").alias("_x"), F.col("rank").alias("_rank"))
        joined = joined.withColumn("_x", x).join(ranks, [*keys, "_x"], "left")
        value = F.col("_rank") / F.col("_n") * 100
    elif score == "iqr":
        value = (x - F.col("_q")[2]) / F.nullif(iqr, F.lit(0.0))
    else:
        value = (x - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    out = joined.withColumns(
        {f"{column}_outlier": F.coalesce(enough & flag, F.lit(False)), f"{column}_score": F.when(enough, value)}
    )
    return out.select(*df.columns, f"{column}_outlier", f"{column}_score")


def summarize_measurements(df: DataFrame, key: str, columns: list[str], statistics: tuple[str, ...] = ("min", "max", "mean")) -> DataFrame:
    """{column}_{statistic} of rows that share an observation."""
    made = {"min": F.min, "max": F.max, "mean": F.avg}
    return df.groupBy(key).agg(*(made[s](c).alias(f"{c}_{s}") for c in columns for s in statistics))


def qc_var_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    return qc_var(to_long(df.withColumn("_k", F.lit(0)), columns, ["_k"]))


def _smooth(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression of y on x with tricube weights over the nearest ``span`` of the points."""
    n = max(min(len(x), 4), int(np.ceil(span * len(x))))
    out = np.empty(len(x))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        reach = np.sort(d)[min(n, len(x)) - 1] or 1.0
        w = np.sqrt(np.clip(1 - (d / (reach * 1.0001)) ** 3, 0, None) ** 3)
        powers = np.stack([np.ones(len(x)), x - at, (x - at) ** 2], 1)
        out[i] = np.linalg.lstsq(powers * w[:, None], y * w, rcond=None)[0][0]
    return out


def highly_variable(df: DataFrame, columns: list[str], top: float = 0.2, span: float = 0.3) -> DataFrame:
    """(var, mean, variance, variance_norm, rank, highly_variable): columns whose variance is most above what their mean suggests.

    The expected variance is a smooth curve of log variance over log mean; values are standardised by it, clipped at
    the square root of the rows, and their variance ranks the columns. Two aggregations; one row a column on the driver.
    """
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.var_samp(F.col(c).cast("double")).alias(f"v{i}")))).first()
    n, m, v = (np.array([row[f"{k}{i}"] if row[f"{k}{i}"] is not None else 0.0 for i in range(len(columns))], float) for k in "nmv")
    vary = (v > 0) & (m > 0)
    expected = np.zeros(len(columns))
    if vary.any():
        expected[vary] = 10 ** _smooth(np.log10(m[vary]), np.log10(v[vary]), span)
    made = []
    for i, c in enumerate(columns):
        top_value = float(np.sqrt(expected[i] * max(n[i], 1)) + m[i])
        x = F.least(F.col(c).cast("double"), F.lit(top_value))
        made += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    row = df.agg(*made).first()
    s, q = (np.array([row[f"{k}{i}"] or 0.0 for i in range(len(columns))], float) for k in "sq")
    norm = np.where(vary, (n * m**2 + q - 2 * m * s) / np.where(vary, np.maximum(n - 1, 1) * expected, 1), 0.0)
    order, keep = np.argsort(-norm, kind="stable"), int(np.ceil(top * len(columns)))
    place = np.empty(len(columns), int)
    place[order] = np.arange(len(columns))
    rows = [(c, float(m[i]), float(v[i]), float(norm[i]), int(place[i]) + 1, bool(place[i] < keep)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "var string, mean double, variance double, variance_norm double, rank int, highly_variable boolean")
