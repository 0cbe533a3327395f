"""Correlations, bias reports and tests of missingness."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions import stats
from longview.functions.order import average_ranks


def _ranked(df: DataFrame, a: str, b: str) -> DataFrame:
    """Average ranks of both columns over the rows that have both."""
    pair = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    out = pair
    for c in "ab":  # ranks of distinct values: running counts over one row per value
        out = out.join(average_ranks(pair, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")), c)
    return out.select(F.col("ra").alias(a), F.col("rb").alias(b))


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> tuple[float | None, int]:
    """(coefficient, pairs) over rows that have both values."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    if method == "kendall":
        return _kendall(df.where(both), a, b)
    table = df.where(both) if method == "pearson" else _ranked(df, a, b)
    row = table.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    return row["r"], row["n"]


def _kendall(df: DataFrame, a: str, b: str) -> tuple[float | None, int]:
    """Tau-b from the table of distinct value pairs (its size squared is the work: bin continuous data first)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    x, y = cells.alias("x"), cells.alias("y")
    sign = F.signum(F.col("y.b") - F.col("x.b"))
    row = x.join(y, F.col("x.a") < F.col("y.a")).agg(F.sum(F.col("x.k") * F.col("y.k") * sign).alias("s")).first()
    n = cells.agg(F.sum("k")).first()[0] or 0
    ties = [cells.groupBy(c).agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0 for c in "ab"]
    pairs = n * (n - 1) / 2
    below = np.sqrt((pairs - ties[0]) * (pairs - ties[1])) if n else 0
    return (float(row["s"] or 0) / below if below else None), n


def correlations(df: DataFrame, columns: list[str], method: str = "pearson", correction: str = "bonferroni", alpha: float = 0.05) -> DataFrame:
    """(a, b, corr, p, p_adj, significant) for each pair of columns; fewer than three pairs: no value, p = 1."""
    spark, rows = df.sparkSession, []
    if method == "pearson":  # one pass for all pairs
        aggregates = []
        for a, b in combinations(columns, 2):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggregates += [F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias(f"{a}|{b}|r"), F.sum(both.cast("long")).alias(f"{a}|{b}|n")]
        got = df.agg(*aggregates).first().asDict()
        found = {(a, b): (got[f"{a}|{b}|r"], got[f"{a}|{b}|n"] or 0) for a, b in combinations(columns, 2)}
    else:
        found = {(a, b): correlation(df, a, b, method) for a, b in combinations(columns, 2)}
    for (a, b), (r, n) in found.items():
        if r is None or n < 3 or not np.isfinite(r):
            rows.append((a, b, None, 1.0))
            continue
        if method == "kendall":
            p = stats.normal_sf(spark, 3 * r * np.sqrt(n * (n - 1)) / np.sqrt(2 * (2 * n + 5)))
        else:
            p = 0.0 if abs(r) >= 1 else stats.t_sf(spark, r * np.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, float(r), float(p)))
    adjusted = stats.adjust([r[3] for r in rows], correction)
    out = [(*r, float(q), bool(q < alpha)) for r, q in zip(rows, adjusted, strict=True)]
    return spark.createDataFrame(out, "a string, b string, corr double, p double, p_adj double, significant boolean")


def standardized_differences(df: DataFrame, sensitive: str, columns: list[str]) -> DataFrame:
    """(value, var, smd): each group of ``sensitive`` against the rest, from sums by group (one shuffle)."""
    sums = [F.count(c).alias(f"{c}_n") for c in columns] + [F.sum(F.col(c).cast("double")).alias(f"{c}_s") for c in columns]
    sums += [F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"{c}_q") for c in columns]
    groups = df.where(F.col(sensitive).isNotNull()).groupBy(F.col(sensitive).cast("string").alias("value")).agg(*sums)
    cells = groups.select("value", F.explode(F.array(*(F.struct(F.lit(c).alias("var"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_s").alias("s"), F.col(f"{c}_q").alias("q")) for c in columns))).alias("c")).select("value", "c.*")
    every = Window.partitionBy("var")
    for c in "nsq":
        cells = cells.withColumn(f"r{c}", F.sum(c).over(every) - F.col(c))
    var = lambda n, s, q: (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
    enough = cells.where("n > 1 and rn > 1")
    pooled = F.sqrt((var("n", "s", "q") + var("rn", "rs", "rq")) / 2)
    return enough.select("value", "var", ((F.col("s") / F.col("n") - F.col("rs") / F.col("rn")) / F.nullif(pooled, F.lit(0.0))).alias("smd"))


def category_shares(df: DataFrame, sensitive: str, comp: str) -> DataFrame:
    """(value, category, share, ratio): a category's share in a group, and against its share in the rest."""
    cells = df.where(F.col(sensitive).isNotNull() & F.col(comp).isNotNull()).groupBy(F.col(sensitive).cast("string").alias("value"), F.col(comp).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("k"))
    kinds = cells.agg(F.collect_set("category").alias("categories"))  # categories only: one row
    grid = cells.select("value").distinct().crossJoin(F.broadcast(kinds)).select("value", F.explode("categories").alias("category"))
    full = grid.join(cells, ["value", "category"], "left").na.fill(0, ["k"])
    by_value, by_category, every = Window.partitionBy("value"), Window.partitionBy("category"), Window.partitionBy()
    n, rest = F.sum("k").over(by_value), F.sum("k").over(every) - F.sum("k").over(by_value)
    other = (F.sum("k").over(by_category) - F.col("k")) / F.nullif(rest, F.lit(0))
    return full.select("value", "category", (F.col("k") / n).alias("share"), (F.col("k") / n / F.nullif(other, F.lit(0.0))).alias("ratio"))


def mcar_t_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(missing, var, t, df, p): Welch's test of ``var`` between rows where ``missing`` is absent and present."""
    spark, aggregates = df.sparkSession, []
    for m in columns:
        for v in columns:
            if m != v:
                for side, cond in (("a", F.col(m).isNull()), ("p", F.col(m).isNotNull())):
                    x = F.when(cond, F.col(v).cast("double"))
                    aggregates += [F.count(x).alias(f"{m}|{v}|{side}n"), F.avg(x).alias(f"{m}|{v}|{side}m"), F.var_samp(x).alias(f"{m}|{v}|{side}v")]
    row, out = df.agg(*aggregates).first().asDict(), []
    for m in columns:
        for v in columns:
            if m == v:
                continue
            (n1, m1, v1), (n2, m2, v2) = ([row[f"{m}|{v}|{s}{k}"] for k in "nmv"] for s in "ap")
            if min(n1, n2) < 2 or v1 + v2 == 0:
                out.append((m, v, None, None, None))
                continue
            a, b = v1 / n1, v2 / n2
            t, dof = (m1 - m2) / np.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
            out.append((m, v, float(t), float(dof), float(stats.t_sf(spark, t, dof))))
    return spark.createDataFrame(out, "missing string, var string, t double, df double, p double")


def little_test(df: DataFrame, columns: list[str]) -> tuple[float, float, float]:
    """(statistic, degrees of freedom, p) of Little's test: patterns are aggregated, only their means reach the driver."""
    p = len(columns)
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centered = df.select(*(F.col(c).cast("double") - F.lit(float(means[c] or 0.0)) for c in columns)).toDF(*columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    products = []
    for i, j in pairs:
        x = F.col(columns[i]) * F.col(columns[j])
        products += [F.sum(x).alias(f"s{i}_{j}"), F.count(x).alias(f"n{i}_{j}")]
    row, sigma = centered.agg(*products).first(), np.zeros((p, p))
    for i, j in pairs:
        sigma[i, j] = sigma[j, i] = (row[f"s{i}_{j}"] or 0.0) / max(1, row[f"n{i}_{j}"] - 1)
    mask = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    patterns = centered.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns)).collect()
    if all("1" not in r["mask"] for r in patterns):
        return 0.0, 0.0, 1.0
    total, used = 0.0, 0
    for r in patterns:
        seen = [i for i, c in enumerate(r["mask"]) if c == "0"]
        if seen:
            d = np.array([r[columns[i]] for i in seen])
            total += r["n"] * d @ np.linalg.pinv(sigma[np.ix_(seen, seen)]) @ d
            used += len(seen)
    dof = used - p
    return float(total), float(dof), 1.0 if dof <= 0 else stats.chi2_sf(df.sparkSession, total, dof)


def detect_bias(
    df: DataFrame, sensitive: list[str], numeric: list[str], categorical: list[str] = (), method: str = "spearman", corr_above: float = 0.5, smd_above: float = 0.5, ratio_above: float = 2.0, importance_above: float | None = None
) -> dict[str, DataFrame]:
    """The reports on ``sensitive`` columns, each sorted by how strong the finding is.

    ``correlations``: sensitive numbers (text by its sorted codes) against ``numeric``, above ``corr_above``;
    ``differences``: standardised differences of a group against the rest, above ``smd_above``; ``shares``: categories
    whose share in a group is over ``ratio_above`` times that in the rest, or under its inverse; ``importances``: features
    a forest uses to predict a sensitive column, above ``importance_above``, if given.
    """
    from longview.operators import encode, ranking

    spark, out, kinds = df.sparkSession, {}, dict(df.dtypes)
    found = []
    for s in sensitive:
        if kinds[s] == "string":
            coded = encode.label_encode(df.select(s, *numeric), [s], prefix="code").withColumnRenamed(f"code_{s}", "_s")
        else:
            coded = df.select(F.col(s).cast("double").alias("_s"), *numeric)
        for c in numeric:
            r, n = correlation(coded, "_s", c, method) if c != s else (None, 0)
            if r is not None and n > 2 and abs(r) > corr_above:
                found.append((s, c, float(r)))
    out["correlations"] = spark.createDataFrame(found, "sensitive string, var string, corr double").orderBy(F.abs("corr").desc(), "sensitive", "var")
    named = lambda name, frame: frame.select(F.lit(name).alias("sensitive"), *frame.columns)
    together = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(together(frames[1:]))
    differences = [named(s, standardized_differences(df, s, [c for c in numeric if c != s])) for s in sensitive]
    out["differences"] = together(differences).where(F.abs("smd") > smd_above).orderBy(F.abs("smd").desc(), "sensitive", "value", "var")
    shares = [named(s, category_shares(df, s, c)).withColumn("var", F.lit(c)) for s in sensitive for c in categorical if c != s]
    if shares:
        far = F.greatest(F.col("ratio"), 1 / F.col("ratio"))
        out["shares"] = together(shares).where(far > ratio_above).orderBy(far.desc(), "sensitive", "value", "category")
    if importance_above is not None:
        parts = [named(s, ranking.importances(df, s, [c for c in numeric if c != s])) for s in sensitive]
        out["importances"] = together(parts).where(F.col("importance") > importance_above).orderBy(F.col("importance").desc(), "sensitive", "var")
    return out
