"""Column scalings. Statistics come from one aggregation (by group if asked) and are joined back by broadcast-sized tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import stats
from longview.functions.order import average_ranks, exact_quantiles, quantile_table


def _scaled(df: DataFrame, columns: list[str], group: str | None, stats, formula) -> DataFrame:
    aggregates = [a.alias(f"_{c}_{k}") for c in columns for k, a in stats(F.col(c).cast("double")).items()]
    keys = [group] if group else []
    table = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggregates)
    if group:  # null groups are a group of their own
        right = table.withColumnRenamed(group, "_g")
        joined = df.join(right, F.col(group).eqNullSafe(F.col("_g")))
    else:
        joined = df.crossJoin(F.broadcast(table))  # one row
    new = {
        c: formula(F.col(c).cast("double"), {k: F.col(f"_{c}_{k}") for k in stats(F.col(c))}) for c in columns
    }
    return joined.withColumns(new).select(*df.columns)


def _over(c: Column) -> Column:
    """A zero scale divides by one."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def scale(df, columns, group=None, with_mean=True, with_std=True):
    """(x - mean) / standard deviation, of the population."""
    return _scaled(
        df, columns, group, lambda c: {"m": F.avg(c), "s": F.stddev_pop(c)},
        lambda x, s: (x - s["m"] if with_mean else x) / (_over(s["s"]) if with_std else F.lit(1.0)),
    )


def minmax(df, columns, group=None, feature_range=(0.0, 1.0)):
    low, high = feature_range
    return _scaled(
        df, columns, group, lambda c: {"lo": F.min(c), "hi": F.max(c)},
        lambda x, s: (x - s["lo"]) / _over(s["hi"] - s["lo"]) * (high - low) + low,
    )


def maxabs(df, columns, group=None):
    return _scaled(df, columns, group, lambda c: {"a": F.max(F.abs(c))}, lambda x, s: x / _over(s["a"]))


def robust(df, columns, group=None):
    """(x - median) / interquartile range, by exact quantiles."""
    keys = [group] if group else []
    table = quantile_table(df, columns, [0.25, 0.5, 0.75], keys).withColumnsRenamed({c: f"_{c}_q" for c in columns})
    joined = df.join(table.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))) if group else df.crossJoin(F.broadcast(table))  # one row
    return joined.withColumns({c: (F.col(c).cast("double") - F.col(f"_{c}_q")[1]) / _over(F.col(f"_{c}_q")[2] - F.col(f"_{c}_q")[0]) for c in columns}).select(*df.columns)


def log(df: DataFrame, columns: list[str], base: float | None = None, offset: float = 1.0) -> DataFrame:
    """log(x + offset); values for which x + offset is negative are an error, and log(0) is NULL."""
    lows = df.agg(*(F.min(c).cast("double").alias(c) for c in columns)).first().asDict()
    if any(v is not None and v + offset < 0 for v in lows.values()):
        raise ValueError("x + offset must not be negative")
    scale_by = math.log(base) if base else 1.0
    value = lambda c: F.when(F.col(c) + offset > 0, F.log1p(F.col(c).cast("double")) if offset == 1 else F.log(F.col(c) + offset))
    return df.withColumns({c: value(c) / scale_by for c in columns})


def offset_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the absolute value of the least cell of all columns, if it is negative."""
    lows = df.agg(*(F.min(c).cast("double").alias(c) for c in columns)).first()
    least = min((v for v in lows if v is not None), default=0.0)
    return df.withColumns({c: F.col(c) + abs(least) for c in columns}) if least < 0 else df


def quantile(df: DataFrame, columns: list[str], points: int = 1000, output: str = "uniform", group: str | None = None) -> DataFrame:
    """Empirical quantile of each value on a grid of exact quantiles, ties at the middle of their range.

    ``output`` "normal" gives the standard normal value of that quantile, kept within 5.2 either way. With ``group``,
    whose groups are few, each group has its own grid.
    """
    if group is not None:
        out = None
        for r in df.select(group).distinct().collect():
            part = quantile(df.where(F.col(group).eqNullSafe(F.lit(r[0]))), columns, points, output)
            out = part if out is None else out.union(part)
        return out if out is not None else df
    grid = np.linspace(0, 1, points)
    found = exact_quantiles(df, columns, grid.tolist())
    for c in columns:
        at = found[c]
        if at[0] is None:
            continue
        q, inverse = np.array(at), []
        for side in ("left", "right"):
            value, first = np.unique(q, return_index=True)
            last = np.searchsorted(q, value, "right") - 1
            inverse.append(grid[first] if side == "left" else grid[last])
        value = np.unique(q)
        middle = (inverse[0] + inverse[1]) / 2
        if output == "normal":
            z = [stats.normal_quantile(df.sparkSession, min(max(m, 1e-7), 1 - 1e-7)) for m in middle]
            middle = np.array(z)
        df = df.withColumn(c, _interpolated(F.col(c).cast("double"), value.tolist(), middle.tolist()))
    return df


def _interpolated(x: Column, at: list[float], to: list[float]) -> Column:
    a, b = F.array(*map(F.lit, at)), F.array(*map(F.lit, to))
    n = len(at)
    if n == 1:
        return F.when(x.isNotNull(), F.lit(to[0]))
    k = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.size(F.filter(a, lambda v: v <= x))))
    x0, x1, y0, y1 = a[k - 1], a[k], b[k - 1], b[k]
    inside = y0 + (x - x0) / (x1 - x0) * (y1 - y0)
    return F.when(x <= at[0], F.lit(to[0])).when(x >= at[-1], F.lit(to[-1])).when(x.isNotNull(), inside)


def percent_rank(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(rank - 1) / (n - 1): the quantile transform of values without ties."""
    keys = [group] if group else []
    ranks = average_ranks(df, column, keys)
    sizes = ranks.groupBy(*keys).agg(F.sum("k").alias("_all"))
    ranks = ranks.join(sizes, keys) if keys else ranks.crossJoin(F.broadcast(sizes))  # one row
    share = F.when(F.col("_all") > 1, F.col("before") / (F.col("_all") - 1)).otherwise(0.0)
    table = ranks.select(*(F.col(k).alias(f"_g{k}") for k in keys), F.col("value").alias("_v"), share.alias("_share"))
    joined = df.join(table, [F.col(column) == F.col("_v"), *(F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in keys)], "left")
    return joined.withColumn(column, F.col("_share")).select(*df.columns)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def power(df: DataFrame, columns: list[str], standardize: bool = True, group: str | None = None) -> DataFrame:
    """Yeo-Johnson with the lambda of greatest likelihood: each pass scores a grid of lambdas for all columns at once.

    With ``group``, whose groups are few, each group has its own lambdas.
    """
    if group is not None:
        out = None
        for r in df.select(group).distinct().collect():
            part = power(df.where(F.col(group).eqNullSafe(F.lit(r[0]))), columns, standardize)
            out = part if out is None else out.union(part)
        return out if out is not None else df
    best = {c: (-4.0, 4.0) for c in columns}
    for _ in range(4):
        grids = {c: np.linspace(*best[c], 17) for c in columns}
        aggregates = []
        for c in columns:
            x = F.col(c).cast("double")
            aggregates.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{c}_j"))
            aggregates.append(F.count(x).alias(f"{c}_n"))
            aggregates += [F.var_pop(yeo_johnson(x, float(g))).alias(f"{c}_{k}") for k, g in enumerate(grids[c])]
        row = df.agg(*aggregates).first()
        for c in columns:
            n, j = row[f"{c}_n"], row[f"{c}_j"] or 0.0
            like = [-n / 2 * math.log(max(row[f"{c}_{k}"] or 1e-300, 1e-300)) + (g - 1) * j for k, g in enumerate(grids[c])]
            k = int(np.argmax(like))
            best[c] = (float(grids[c][max(0, k - 1)]), float(grids[c][min(16, k + 1)]))
    out = df.withColumns({c: yeo_johnson(F.col(c).cast("double"), sum(best[c]) / 2) for c in columns})
    return scale(out, columns) if standardize else out


def combat(df: DataFrame, columns: list[str], batch: str, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Columns without the location and scale of their ``batch``, shrunk by empirical Bayes across columns.

    One aggregation gives counts, sums and squares by batch; the prior's iteration runs on that table (batches by
    columns), and each row is corrected by an expression. Rows without a batch, and gaps, stay as they are.
    """
    made = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.sum(F.col(c).cast("double")).alias(f"s{i}"), F.sum(F.col(c).cast("double") ** 2).alias(f"q{i}"))]
    rows = df.where(F.col(batch).isNotNull()).groupBy(batch).agg(*made).orderBy(batch).collect()
    if len(rows) < 2:
        return df
    n, s, q = (np.array([[r[f"{k}{i}"] or 0 for i in range(len(columns))] for r in rows], float) for k in "nsq")
    count = np.maximum(n, 1)
    mean, total = s / count, np.maximum(n.sum(0), 1)
    grand = s.sum(0) / total
    pooled = np.sqrt(np.maximum((q - count * mean**2).sum(0) / total, 1e-300))
    gamma = (mean - grand) / pooled
    squares = (q - 2 * grand * s + n * grand**2) / pooled**2  # of standardised values, by batch
    delta = np.maximum(squares - n * gamma**2, 0) / np.maximum(n - 1, 1)
    shift, scale_by = np.zeros_like(gamma), np.ones_like(delta)
    for b in range(len(rows)):
        bar, t2 = gamma[b].mean(), gamma[b].var(ddof=1) if len(columns) > 1 else 0.0
        m, v = delta[b].mean(), delta[b].var(ddof=1) if len(columns) > 1 else 0.0
        if t2 <= 0 or v <= 0:  # nothing to borrow from other columns
            shift[b], scale_by[b] = gamma[b], delta[b]
            continue
        a, beta = (2 * v + m**2) / v, (m * v + m**3) / v
        g, d = gamma[b].copy(), delta[b].copy()
        for _ in range(rounds):
            new_g = (t2 * n[b] * gamma[b] + d * bar) / (t2 * n[b] + d)
            rest = squares[b] - 2 * new_g * n[b] * gamma[b] + n[b] * new_g**2
            new_d = (0.5 * rest + beta) / (n[b] / 2 + a - 1)
            change = max(np.abs((new_g - g) / np.where(g == 0, 1, g)).max(), np.abs((new_d - d) / np.where(d == 0, 1, d)).max())
            g, d = new_g, new_d
            if change < tolerance:
                break
        shift[b], scale_by[b] = g, d
    table = [(r[batch], *map(float, shift[b]), *map(float, np.sqrt(np.maximum(scale_by[b], 1e-300)))) for b, r in enumerate(rows)]
    names = [f"_g{i}" for i in range(len(columns))] + [f"_d{i}" for i in range(len(columns))]
    kind = df.select(batch).schema[0].dataType.simpleString()
    small = df.sparkSession.createDataFrame(table, ", ".join([f"_b {kind}", *(f"{x} double" for x in names)]))  # one row a batch
    joined = df.join(F.broadcast(small), F.col(batch) == F.col("_b"), "left")
    value = lambda i, c: ((F.col(c).cast("double") - float(grand[i])) / float(pooled[i]) - F.col(f"_g{i}")) / F.col(f"_d{i}") * float(pooled[i]) + float(grand[i])
    return joined.withColumns({c: F.coalesce(value(i, c), F.col(c).cast("double")) for i, c in enumerate(columns)}).select(*df.columns)
