"""Filters by presence, clipping, winsorizing and missing-value masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_bounds(c: Column, low: int | None, high: int | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return ok


def _kept(long: DataFrame, axis: str, low, high, time_mode: str, prop: float | None, time: str | None) -> DataFrame:
    if low is None and high is None:
        raise ValueError("give a lower or an upper bound")
    if time_mode not in ("all", "any", "proportion"):
        raise ValueError(f"unknown time_mode {time_mode!r}")
    if time_mode == "proportion" and not (prop is not None and 0 < prop <= 1):
        raise ValueError("prop must lie in (0, 1]")
    by = [axis, time] if time else [axis]
    counts = long.groupBy(*by).agg(F.count("value").alias("n")).withColumn("ok", _in_bounds(F.col("n"), low, high))
    rule = {
        "all": F.bool_and("ok"),
        "any": F.bool_or("ok"),
        "proportion": F.avg(F.col("ok").cast("double")) >= (prop or 1.0),
    }[time_mode]
    return counts.groupBy(axis).agg(F.sum("n").alias("n_nonmissing"), rule.alias("kept")).where("kept").drop("kept")


def filter_features(long: DataFrame, min_obs=None, max_obs=None, time_mode: str = "all", prop: float | None = None, time: str | None = None) -> DataFrame:
    """Variables of a long table (var, value, ...) whose present values are within bounds, with their count.

    With ``time`` the bounds hold in each time step and are combined over all, any, or a share of them.
    """
    return _kept(long, "var", min_obs, max_obs, time_mode, prop, time)


def filter_observations(long: DataFrame, min_vars=None, max_vars=None, time_mode: str = "all", prop: float | None = None, time: str | None = None) -> DataFrame:
    """The same along observations."""
    return _kept(long, "obs_id", min_vars, max_vars, time_mode, prop, time)


def clip_values(df: DataFrame, columns: list[str], limits: tuple[float, float]) -> DataFrame:
    """Columns clipped to absolute limits; missing values stay missing."""
    low, high = limits
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))) for c in columns}
    )


def winsorize(df: DataFrame, columns: list[str], limits: tuple[float, float] = (0.01, 0.01)) -> DataFrame:
    """The lowest and highest shares of each column replaced by the nearest value kept.

    The boundary values are found by exact order statistics: the ``int(share * n)``-th smallest and largest
    of the values present, from one aggregation by value, so equal values shrink to one row each.
    """
    for c in columns:
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("k"))
        total = values.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
        if not total:
            continue
        low_at, high_at = int(limits[0] * total), total - int(limits[1] * total) - 1
        edges = values.agg(
            F.expr(f"percentile(v, {low_at / max(1, total - 1)!r}D, k)").alias("lo"),
            F.expr(f"percentile(v, {high_at / max(1, total - 1)!r}D, k)").alias("hi"),
        ).first()
        # percentile interpolates: snap to the value on the kept side
        lo = values.where(F.col("v") >= edges["lo"] - abs(edges["lo"]) * 1e-12).agg(F.min("v")).first()[0]
        hi = values.where(F.col("v") <= edges["hi"] + abs(edges["hi"]) * 1e-12).agg(F.max("v")).first()[0]
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))))
    return df


def missing_mask(df: DataFrame, columns: list[str], sentinels: list | None = None) -> DataFrame:
    """Columns replaced by whether their value is missing or one of ``sentinels``."""

    def mask(c: str) -> Column:
        missing = F.col(c).isNull()
        if sentinels:
            missing = missing | F.coalesce(F.col(c).isin(sentinels), F.lit(False))
        return missing

    return df.withColumns({c: mask(c) for c in columns})


def transitions(long: DataFrame, keys: list[str], time: str, state: str) -> DataFrame:
    """Counts of (state, next state) between consecutive present times of a series."""
    order = Window.partitionBy(*keys).orderBy(time)
    pairs = long.where(F.col(state).isNotNull()).select(F.col(state).alias("state"), F.lead(state).over(order).alias("next_state"))
    return pairs.where("next_state is not null").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))


def flows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of value pairs in consecutive columns: (step, source, target, n)."""
    out = None
    for step, (a, b) in enumerate(zip(columns, columns[1:], strict=False)):
        part = df.groupBy(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(step).alias("step"), "source", "target", "n")
        out = part if out is None else out.unionByName(part)
    return out
