"""The tables behind plots: each function returns what a figure would draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions.order import quantile_table


def presence_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "var", "v").groupBy("var").agg(F.count("v").alias("present"))


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of missingness indicators; columns that never vary give NULL."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    null = lambda c: F.col(c).isNull().cast("double")
    row = df.agg(*(F.corr(null(a), null(b)).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs))).alias("c")).select("c.*")


def group_means(df: DataFrame, group: str, columns: list[str], cutoff: float = 0.0) -> DataFrame:
    """(group, var, mean, fraction above cutoff): matrix and dot plots."""
    long = df.select(F.col(group).cast("string").alias("group"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["group"], columns, "var", "v")
    return long.groupBy("group", "var").agg(F.avg("v").alias("mean"), F.avg((F.col("v") > cutoff).cast("double")).alias("fraction"))


def group_quantiles(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, low, q1, median, q3, high): what a violin or box shows."""
    names = ("low", "q1", "median", "q3", "high")
    rows = df.select(F.col(group).cast("string").alias("group"), F.col(column).cast("double").alias("q"))
    return quantile_table(rows, ["q"], [0.0, 0.25, 0.5, 0.75, 1.0], ["group"]).select("group", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins))).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc()).limit(n)
