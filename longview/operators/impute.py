"""Imputation of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.functions.near import nearest_mean
from longview.functions.order import quantile_table


def explicit(df: DataFrame, columns: list[str], replacement, empty_strings: bool = True) -> DataFrame:
    """A constant, or one per column (key ``default`` for the others), in place of missing values."""

    def value(c: str):
        return replacement.get(c, replacement.get("default")) if isinstance(replacement, dict) else replacement

    def filled(c: str) -> Column:
        missing = F.col(c).isNull()
        if empty_strings and dict(df.dtypes)[c] == "string":
            missing = missing | (F.col(c) == "")
        return F.when(missing, F.lit(value(c))).otherwise(F.col(c))

    return df.withColumns({c: filled(c) for c in columns if value(c) is not None})


def statistic(c: Column, strategy: str) -> Column:
    if strategy == "mean":
        return F.avg(c)
    if strategy == "median":
        return F.percentile(c, F.lit(0.5))
    if strategy == "most_frequent":
        return F.mode(c, True)
    raise ValueError(f"unknown strategy {strategy!r}")


def simple(df: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    """The mean, median or most frequent value (the least of equals) of each column, from one aggregation."""
    if strategy == "median":
        stats = quantile_table(df, columns, [0.5]).select(*(F.col(c)[0].alias(f"_{c}") for c in columns))
    else:
        stats = df.agg(*(statistic(F.col(c), strategy).alias(f"_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns})
    return out.select(*df.columns)


def locf(long: DataFrame, keys: list[str], time: str = "t", var: str = "var", value: str = "value", fallback: str | None = "mean") -> DataFrame:
    """Last observation carried forward in each series; leading gaps by a statistic of the variable's
    original values (mean, median, most_frequent), by the next value (bfill), or not at all (None)."""
    series = Window.partitionBy(*keys, var).orderBy(time)
    ahead = series.rowsBetween(0, Window.unboundedFollowing)
    filled = F.last(value, ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0))
    if fallback == "bfill":
        filled = F.coalesce(filled, F.first(value, ignorenulls=True).over(ahead))
    out = long.withColumn("_filled", filled)
    if fallback in ("mean", "median", "most_frequent"):
        stats = long.groupBy(var).agg(statistic(F.col(value), fallback).alias("_stat"))
        out = out.join(stats, var).withColumn("_filled", F.coalesce("_filled", "_stat"))
    elif fallback not in ("bfill", None):
        raise ValueError(f"unknown fallback {fallback!r}")
    return out.withColumn(value, F.col("_filled")).select(*long.columns)


def knn(df: DataFrame, columns: list[str], anchors: list[str], key: str = "obs_id", k: int = 5, block: int = 4096) -> DataFrame:
    """Missing cells of ``columns`` by the mean of the ``k`` nearest rows that have them, by complete anchors.

    Rows with a gap are the query set. By one anchor, donors are sorted (:func:`nearest_mean`). By several, they are
    scanned in blocks with NumPy (one matrix product a block), and each query keeps its k nearest per block, so what
    is shuffled is k rows a block and query, not pairs. Without a finite anchor, donors come last, and queries take the
    first by key.
    """
    for column in columns:
        if len(anchors) == 1:
            df = _knn_line(df, column, anchors[0], key, k)
            continue
        queries = df.where(F.col(column).isNull()).select(key, F.array(*(F.col(a).cast("double") for a in anchors)).alias("q"))
        n = queries.count()
        parts, done = -(-n // 100_000), df
        for part in range(parts):  # so many rows at a time are sent to every task
            done = _knn_part(df, done, queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part), column, anchors, key, k, block)
        df = done
    return df


def _knn_line(df: DataFrame, column: str, anchor: str, key: str, k: int) -> DataFrame:
    """``df`` with the gaps of ``column`` filled by one anchor."""
    if df.where(F.col(column).isNull()).isEmpty():
        return df
    x = F.col(anchor).cast("double")
    at = F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x + 0.0)
    donors = df.where(F.col(column).isNotNull()).select(at.alias("v"), F.col(key).cast("long").alias("key"), F.col(column).cast("double").alias("y"))
    placed = donors.where(F.col("v").isNotNull())
    first = [r["y"] for r in donors.orderBy("key").limit(k).collect()]
    n = placed.limit(k).count()
    rest = [r["y"] for r in donors.where(F.col("v").isNull()).orderBy("key").limit(k - n).collect()] if n < k else []
    near = nearest_mean(df.where(F.col(column).isNull() & at.isNotNull()).select(at.alias("q")), placed, k)
    near = near.select(F.col("q").alias("_q"), ((F.col("y") * F.col("n") + F.lit(float(sum(rest)))) / (F.col("n") + len(rest)) if rest else F.col("y")).alias("_y"))
    else_ = F.lit(sum(first) / len(first) if first else None).cast("double")
    return df.join(near, at == F.col("_q"), "left").withColumn(column, F.coalesce(F.col(column), F.col("_y"), else_)).select(*df.columns)


def _knn_part(df: DataFrame, into: DataFrame, queries: DataFrame, column: str, anchors: list[str], key: str, k: int, block: int) -> DataFrame:
    """``into`` with the gaps of ``queries`` in ``column`` filled from rows of ``df``."""
    import numpy as np

    rows = queries.orderBy(key).collect()  # a part of about 100,000
    if not rows:
        return into
    ids, q = [r[0] for r in rows], np.array([r[1] for r in rows], float)

    def nearest(batches, ids=ids, q=q):
        import pandas as pd

        for pdf in batches:
            pdf = pdf.sort_values("k")
            x = np.stack(pdf["a"]).astype(float)
            for lo in range(0, len(q), block):
                part = q[lo : lo + block]
                d = ((part**2).sum(1)[:, None] - 2 * part @ x.T + (x**2).sum(1)[None]).clip(0)
                m = min(k, d.shape[1])
                at = np.argsort(d, axis=1, kind="stable")[:, :m]  # of equally near donors the first by key
                yield pd.DataFrame(
                    {
                        "i": np.repeat(np.arange(lo, lo + len(part)), m),
                        "d": np.take_along_axis(d, at, 1).ravel(),
                        "donor": pdf["k"].to_numpy()[at].ravel(),
                        "y": pdf["y"].to_numpy()[at].ravel(),
                    }
                )

    donors = df.where(F.col(column).isNotNull()).select(
        F.array(*(F.col(a).cast("double") for a in anchors)).alias("a"), F.col(column).cast("double").alias("y"), F.col(key).cast("long").alias("k")
    )
    found = donors.mapInPandas(nearest, "i long, d double, donor long, y double")
    w = Window.partitionBy("i").orderBy("d", "donor")
    mean = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("i").agg(F.avg("y").alias("_y"))
    names = df.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "i long, _k long")
    into = (
        into.join(mean.join(names, "i").select("_k", "_y"), F.col(key) == F.col("_k"), "left")
        .withColumn(column, F.coalesce(F.col(column), F.col("_y")))
        .drop("_k", "_y")
    )
    return into


def by_trees(df: DataFrame, columns: list[str], rounds: int = 3, trees: int = 20, boosted: bool = False, seed: int = 0) -> DataFrame:
    """Iterated regression of each incomplete column on the others (random forest, or boosted trees)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    masks = {c: f"_{c}_missing" for c in columns}
    out = df.withColumns({m: F.col(c).isNull() for c, m in masks.items()})
    gaps = out.agg(*(F.sum(F.col(m).cast("long")).alias(c) for c, m in masks.items())).first().asDict()
    out = simple(out, columns, "mean")
    for _ in range(rounds):
        for c in sorted((c for c in columns if gaps[c]), key=lambda c: gaps[c]):
            features = VectorAssembler(inputCols=[x for x in columns if x != c], outputCol="_f")
            common = {"featuresCol": "_f", "labelCol": c, "predictionCol": "_p", "seed": seed}
            model = GBTRegressor(maxIter=trees, **common) if boosted else RandomForestRegressor(numTrees=trees, **common)
            table = features.transform(out)
            fitted = model.fit(table.where(~F.col(masks[c])))
            out = fitted.transform(table).withColumn(c, F.when(F.col(masks[c]), F.col("_p")).otherwise(F.col(c))).drop("_f", "_p")
    return out.select(*df.columns)
