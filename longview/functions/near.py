"""Nearest rows along one number, by sorting: pairs are never listed, so large groups of equal values cost no more than others."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.session import cut

#: Distinct values (those asked for, and donors) that one task sorts, and how many tasks at most.
ROWS, PARTS = 250_000, 512


def nearest_mean(asked: DataFrame, donors: DataFrame, k: int, within: float | None = None) -> DataFrame:
    """(q, y, n): for each distinct ``q`` of ``asked`` the mean ``y`` of the ``k`` nearest of ``donors`` (v, key, y), and how many they are.

    Equally near donors go by ``key``, then ``y``; none is farther than ``within``. ``q`` and ``v`` are finite; a ``q`` without donors is left out.
    Of a value only the first ``k`` donors by key can be among the nearest. What is left is cut into ranges, and each
    range also gets the ``k`` donors next to it on either side, which reach it by way of the driver.
    """
    asked = cut(asked.select((F.col("q") + 0.0).alias("q")).distinct())
    first = F.row_number().over(Window.partitionBy("v").orderBy("key", "y"))
    held = cut(donors.select((F.col("v") + 0.0).alias("v"), "key", "y").withColumn("_r", first).where(F.col("_r") <= k).drop("_r"))
    values = asked.select(F.col("q").alias("v")).union(held.select("v"))
    parts = min(PARTS, -(-values.count() // ROWS))
    cuts = values.agg(F.percentile_approx("v", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10_000))).first()[0] if parts > 1 else []
    beside: dict[int, tuple[list, list]] = {}
    if cuts:
        splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
        place = lambda df, c: Bucketizer(splits=splits, inputCol=c, outputCol="_part").transform(df)
        asked, held = place(asked, "q"), place(held, "v")
        rows = {}
        for side, order in (("low", F.col("v").asc()), ("high", F.col("v").desc())):
            w = Window.partitionBy("_part").orderBy(order, "key", "y")
            ends = held.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).collect()  # k a range
            for r in sorted(ends, key=lambda r: (r["_part"], r["_r"])):
                rows.setdefault((side, int(r["_part"])), []).append((r["v"], r["key"], r["y"]))
        below, above = [], []
        for p in range(len(splits) - 1):
            beside[p] = below, []
            below = (rows.get(("high", p), []) + below)[:k]
        for p in reversed(range(len(splits) - 1)):
            beside[p] = beside[p][0], above
            above = (rows.get(("low", p), []) + above)[:k]
    else:
        asked, held = asked.withColumn("_part", F.lit(0.0)), held.withColumn("_part", F.lit(0.0))

    def nearest(part, mine, near):
        import numpy as np
        import pandas as pd

        more = pd.DataFrame([x for side in beside.get(int(part[0]), ()) for x in side], columns=["v", "key", "y"])
        near = pd.concat([x for x in (near[["v", "key", "y"]], more) if len(x)] or [more])
        found = [pd.DataFrame({"q": np.zeros(0), "y": np.zeros(0), "n": np.zeros(0, "int64")})]
        v, y, m = near["v"].to_numpy(float), near["y"].to_numpy(float), len(near)
        place = pd.factorize(near["key"], sort=True)[0]
        up, down = np.lexsort((y, place, v)), np.lexsort((y, place, -v))
        block, step = max(1, 1_000_000 // k), np.arange(min(k, m))
        for low in range(0, len(mine) if m else 0, block):
            q = mine["q"].to_numpy(float)[low : low + block]
            upto = np.searchsorted(v[up], q, "right")
            left, right = (m - upto)[:, None] + step, upto[:, None] + step
            there = np.hstack([left < m, right < m])
            at = np.hstack([down[np.minimum(left, m - 1)], up[np.minimum(right, m - 1)]])
            d = np.abs(q[:, None] - v[at])
            if within is not None:
                there &= d <= within
            best = np.lexsort((y[at], place[at], d, ~there), axis=1)[:, :k]
            taken = np.take_along_axis(there, best, 1)
            n = taken.sum(1)
            mean = np.where(taken, y[np.take_along_axis(at, best, 1)], 0).sum(1) / np.maximum(n, 1)
            found.append(pd.DataFrame({"q": q, "y": mean, "n": n})[n > 0])
        return pd.concat(found)

    return asked.groupBy("_part").cogroup(held.groupBy("_part")).applyInPandas(nearest, "q double, y double, n long")
