"""Exact quantiles, ranks and running sums without a task that holds a whole column.

Small tables (``SMALL`` rows at most, which is counted, not assumed) take Spark's own window or percentile; larger
ones are cut at probe values that the driver knows, and only counts by probe reach it. Both ways give the same numbers.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may hold.
SMALL = 2_000_000
#: Probes a round for each open quantile, and parts of a running sum.
PROBES, PARTS = 64, 512


def _code(x: float) -> int:
    """A double as an integer that sorts alike."""
    (bits,) = struct.unpack("<q", struct.pack("<d", x + 0.0))
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _value(code: int) -> float:
    (x,) = struct.unpack("<d", struct.pack("<q", code if code >= 0 else -(2**63) | -code))
    return x + 0.0


def _needed(n: int, probs: list[float]) -> set[int]:
    """Ranks from zero of the values that quantiles of ``n`` values lie between."""
    return {r for p in probs for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}


def _search(df: DataFrame, column: Column, wanted: dict[int, tuple[int, int]], n: int) -> dict[int, float]:
    """The values at ``wanted`` ranks, each in its range of codes (low, high]: counts between probes, a pass a round."""
    while any(hi - lo > 1 for lo, hi in wanted.values()):
        probes = sorted({lo + (hi - lo) * k // PROBES for lo, hi in wanted.values() for k in range(1, PROBES)} - {lo for lo, _ in wanted.values()})
        at = F.array(*(F.lit(_value(p)) for p in probes))
        # the number of probes below a value, by bisection in the array
        below = F.aggregate(
            F.sequence(F.lit(0), F.lit(max(0, len(probes) - 1).bit_length())),
            F.struct(F.lit(0).alias("a"), F.lit(len(probes)).alias("b")),
            lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
                F.when(F.element_at(at, F.floor((s["a"] + s["b"]) / 2).cast("int") + 1) < column, F.struct((F.floor((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b")))
                .otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))
            ),
            lambda s: s["a"],
        )
        counts = {r["g"]: r["k"] for r in df.where(column.isNotNull()).groupBy(below.alias("g")).agg(F.count(F.lit(1)).alias("k")).collect()}
        upto, total = [], 0
        for i in range(len(probes)):
            total += counts.get(i, 0)
            upto.append(total)  # values at or below probe i
        for r, (lo, hi) in wanted.items():
            for p, k in zip(probes, upto, strict=True):
                if lo < p < hi:
                    if k > r:
                        hi = p
                        break
                    lo = p
            wanted[r] = lo, hi
    return {r: _value(hi) for r, (_, hi) in wanted.items()}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column by linear interpolation between neighbours, nulls left out; null for no values."""
    made = [a for i, c in enumerate(columns) for a in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.min(F.col(f"`{c}`").cast("double")).alias(f"l{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"h{i}"))]
    row = df.agg(*made).first()
    small = [c for i, c in enumerate(columns) if row[f"n{i}"] <= SMALL]
    out: dict[str, list[float | None]] = {}
    if small:
        q = F.array(*map(F.lit, probs))
        got = df.agg(*(F.percentile(F.col(f"`{c}`").cast("double"), q).alias(f"q{i}") for i, c in enumerate(small))).first()
        out = {c: list(got[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(small)}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if c in out:
            continue
        low, high = _code(row[f"l{i}"]) - 1, _code(row[f"h{i}"])
        at = _search(df, F.col(f"`{c}`").cast("double"), {r: (low, high) for r in _needed(n, probs)}, n)
        out[c] = []
        for p in probs:
            k, part = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
            a, b = at[k], at[min(k + 1, n - 1)]
            out[c].append(a + (b - a) * part)
    return out


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, one array of quantiles a column, under the column's name), by group.

    Groups of at most ``SMALL`` rows take Spark's percentile; those above, at most rows / ``SMALL`` of them, are searched
    one by one with :func:`exact_quantiles`.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.greatest(*(F.count(F.col(f"`{c}`")) for c in columns), F.lit(0)).alias("_n"))
    large = sizes.where(F.col("_n") > SMALL).collect()
    q = F.array(*map(F.lit, probs))
    rows = df
    same = [[F.col(f"`{k}`").eqNullSafe(F.lit(r[k])) for k in keys] for r in large]
    for cond in same:
        rows = rows.where(~_all(cond))
    out = rows.groupBy(*keys).agg(*(F.percentile(F.col(f"`{c}`").cast("double"), q).alias(c) for c in columns))
    if large:
        out = out.where(F.lit(bool(keys)))  # without keys the one row is the large one's
        made = []
        for r, cond in zip(large, same, strict=True):
            found = exact_quantiles(df.where(_all(cond)), columns, probs)
            made.append((*(r[k] for k in keys), *(None if found[c][0] is None else [float(v) for v in found[c]] for c in columns)))
        out = out.unionByName(df.sparkSession.createDataFrame(made, out.schema))
    return out


def _all(conditions: list[Column]) -> Column:
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return whole


def running_sum(table: DataFrame, by: str, sums: dict[str, str], keys: list[str] = (), descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``table`` with running sums (new name -> column) in the order of ``by``, which has no repeats within ``keys``.

    A large table is cut by approximate percentiles of ``by``: a part's rows are summed in order by one task, and sums
    of the parts before it, at most ``PARTS`` a key, are joined on.
    """
    keys = list(keys)
    order = F.col(by).desc() if descending else F.col(by).asc()
    end = 0 if inclusive else -1
    row = table.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(by).cast("double"), F.array(*(F.lit(k / PARTS) for k in range(1, PARTS))), F.lit(10_000)).alias("q")).first()
    if row["n"] <= SMALL:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return table.withColumns({new: F.coalesce(F.sum(c).over(w), F.lit(0)) for new, c in sums.items()})
    cuts = F.array(*(F.lit(float(v)) for v in sorted(set(row["q"]))))
    cut = table.withColumn("_part", F.size(F.filter(cuts, lambda v: v <= F.col(by).cast("double"))))
    totals = cut.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_{new}") for new, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if descending else F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    totals = totals.withColumnsRenamed({k: f"_{k}" for k in keys} | {"_part": "_same"})
    joined = cut.join(totals, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_part") == F.col("_same")])
    return joined.select(*table.columns, *((F.col(f"_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(new) for new, c in sums.items()))


def average_ranks(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """(keys, value, k, before, rank): a row for each distinct value: how often it occurs, how many are below it, and its mean rank from one."""
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    ranked = running_sum(values, "value", {"before": "k"}, keys, inclusive=False)
    return ranked.withColumn("rank", F.col("before") + (F.col("k") + 1) / 2)
