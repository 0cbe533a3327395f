"""Distribution functions on the JVM, and multiple-testing corrections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _distributions(spark: SparkSession):
    return spark._jvm.org.apache.commons.math3.distribution


def t_sf(spark: SparkSession, t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if not np.isfinite(t) or not df > 0:
        return float("nan")
    return 2 * _distributions(spark).TDistribution(float(df)).cumulativeProbability(-abs(float(t)))


def chi2_sf(spark: SparkSession, x: float, df: float) -> float:
    return 1 - _distributions(spark).ChiSquaredDistribution(float(df)).cumulativeProbability(float(x)) if df > 0 else 1.0


def f_sf(spark: SparkSession, x: float, df1: float, df2: float) -> float:
    return 1 - _distributions(spark).FDistribution(float(df1), float(df2)).cumulativeProbability(float(x))


def normal_sf(spark: SparkSession, z: float) -> float:
    """Two-sided p-value of a normal statistic."""
    return 2 * _distributions(spark).NormalDistribution(0.0, 1.0).cumulativeProbability(-abs(float(z)))


def normal_quantile(spark: SparkSession, q: float) -> float:
    return _distributions(spark).NormalDistribution(0.0, 1.0).inverseCumulativeProbability(float(q))


def adjust(p: list[float], method: str) -> list[float]:
    """Adjusted p-values of a small family: bonferroni, holm, benjamini-hochberg (fdr_bh), fdr_tsbh or none."""
    p = np.asarray(p, float)
    m, order = len(p), np.argsort(p, kind="stable")
    if not m or method in (None, "none"):
        return p.tolist()
    out = np.empty(m)
    if method == "bonferroni":
        out = np.minimum(1, p * m)
    elif method == "holm":
        out[order] = np.minimum(1, np.maximum.accumulate(p[order] * (m - np.arange(m))))
    elif method in ("fdr_bh", "benjamini-hochberg"):
        out[order] = np.minimum(1, np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1])
    elif method == "fdr_tsbh":
        first = np.asarray(adjust(p, "fdr_bh"))
        null = m - int((first <= 0.05 / 1.05).sum())
        out = np.minimum(1, first * max(null, 1) / m * 1.05)
    else:
        raise ValueError(f"unknown correction {method!r}")
    return out.tolist()


def benjamini_hochberg(df: DataFrame, p: str, group: str | None = None, out: str = "p_adj") -> DataFrame:
    """The same as windows over a table of p-values, within groups."""
    keys = [group] if group else [F.lit(0)]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(p))).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    down = Window.partitionBy(*keys).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")
