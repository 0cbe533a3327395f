"""Categorical encodings and sampling."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.functions.order import running_sum

PREFIX = "cat"


#: Categories up to which a label is looked up in the plan; beyond, labels are joined.
MANY = 1_000


def categories(df: DataFrame, column: str) -> list:
    """The sorted distinct values of a column as text, NULL last: as many as there are columns to make."""
    rows = df.select(F.col(column).cast("string").alias("v")).distinct().collect()
    values = sorted(r["v"] for r in rows if r["v"] is not None)
    return values + ([None] if any(r["v"] is None for r in rows) else [])


def one_hot(df: DataFrame, columns: list[str], prefix: str = PREFIX, values: dict[str, list] | None = None) -> DataFrame:
    """0/1 columns ``{prefix}_{column}_{value}`` before the other columns; a missing value is its own category."""
    new = []
    for c in columns:
        for v in (values or {}).get(c) or categories(df, c):
            hit = F.col(c).isNull() if v is None else F.coalesce(F.col(c).cast("string") == v, F.lit(False))
            new.append(hit.cast("float").alias(f"{prefix}_{c}_{'missing' if v is None else v.strip()}"))
    return df.select(*new, *(x for x in df.columns if x not in columns))


def label_encode(df: DataFrame, columns: list[str], prefix: str = PREFIX) -> DataFrame:
    """``{prefix}_{column}``: the place of each value among the sorted ones, a missing value last."""
    rest, names = [c for c in df.columns if c not in columns], []
    out = df
    for c in columns:
        name = f"{prefix}_{c}"
        names.append(name)
        values = df.select(F.col(c).cast("string").alias("v")).distinct()
        n = values.count()
        if n <= MANY:
            code = F.lit(None).cast("float")
            for i, v in enumerate(categories(df, c)):
                hit = F.col(c).isNull() if v is None else F.col(c).cast("string") == v
                code = F.when(hit, F.lit(float(i))).otherwise(code)
            out = out.withColumn(name, code.cast("float"))
            continue
        marked = values.where("v is not null").withColumn("k", F.lit(1))
        # text has no order that percentiles know, so parts are cut by the first three bytes, and summed in their order
        lead = F.conv(F.hex(F.substring(F.rpad(F.encode("v", "UTF-8"), 3, F.lit(b"\x00")), 1, 3)), 16, 10).cast("long")
        parts = marked.withColumn("part", lead)
        before = running_sum(parts.groupBy("part").agg(F.sum("k").alias("k")), "part", {"before": "k"}, inclusive=False)
        place = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
        codes = parts.withColumn("place", place).join(before.select("part", "before"), "part").select(F.col("v").alias("_v"), (F.col("before") + F.col("place")).cast("float").alias(name))
        out = out.join(codes, F.col(c).cast("string") == F.col("_v"), "left").withColumn(name, F.coalesce(name, F.when(F.col(c).isNull(), F.lit(float(n - 1))))).drop("_v")
    return out.select(*names, *rest)


@dataclass(frozen=True)
class Encoded:
    """A table with some columns encoded, which remembers the originals: it can be encoded again, or undone.

    ``original`` is the table before any encoding; ``modes`` says how each encoded column is ("one-hot" or "label").
    """

    original: DataFrame
    modes: dict[str, str]
    prefix: str = PREFIX

    @staticmethod
    def detect(df: DataFrame, mode: str = "one-hot", key: str = "obs_id", prefix: str = PREFIX) -> Encoded:
        """Every text column but the key is encoded."""
        return Encoded(df, {c: mode for c, kind in df.dtypes if kind == "string" and c != key}, prefix)

    def encode(self, modes: dict[str, str]) -> Encoded:
        """Encoded so instead: named columns change, others stay as they were."""
        unknown = set(modes) - set(self.original.columns)
        if unknown or not set(modes.values()) <= {"one-hot", "label"}:
            raise ValueError(f"unknown columns {sorted(unknown)} or modes {sorted(modes.values())}")
        return replace(self, modes={**self.modes, **modes})

    @property
    def frame(self) -> DataFrame:
        """Encoded columns first, then the others; the originals are in ``original``."""
        hot = [c for c, m in self.modes.items() if m == "one-hot"]
        label = [c for c, m in self.modes.items() if m == "label"]
        out = one_hot(self.original, hot, self.prefix) if hot else self.original
        return label_encode(out, label, self.prefix) if label else out

    def undo(self, columns: list[str] | None = None) -> DataFrame:
        """The table with ``columns`` (all of them by default) as they were."""
        left = {c: m for c, m in self.modes.items() if columns is not None and c not in columns}
        return replace(self, modes=left).frame


def encode_over_time(long: DataFrame, variable: str, prefix: str = PREFIX) -> DataFrame:
    """A long table in which the text variable ``variable`` (column ``text``) has become 0/1 variables by category and time."""
    rows = long.where(F.col("var") == variable)
    made = None
    for v in categories(rows, "text"):
        hit = F.col("text").isNull() if v is None else F.coalesce(F.col("text") == v, F.lit(False))
        part = rows.select("obs_id", F.lit(f"{prefix}_{variable}_{'missing' if v is None else v.strip()}").alias("var"), "t", hit.cast("double").alias("value"))
        made = part if made is None else made.union(part)
    rest = long.where(F.col("var") != variable).select("obs_id", "var", "t", F.col("text").cast("double").alias("value"))
    return rest if made is None else made.union(rest)


def sample(df: DataFrame, fraction: float | None = None, n: int | None = None, replace: bool = False, weight: str | None = None, seed: int = 0) -> DataFrame:
    """A share or an exact number of rows; with ``weight`` rows are drawn without replacement in proportion."""
    if (fraction is None) == (n is None):
        raise ValueError("give fraction or n")
    if fraction is not None and not weight:
        return df.sample(withReplacement=replace, fraction=fraction, seed=seed)
    if n is None:
        n = int(df.count() * fraction)
    key = F.rand(seed) if not weight else -F.log(F.rand(seed)) / F.col(weight)
    out = df.where(F.col(weight) > 0) if weight else df
    return out.orderBy(key).limit(n)


def balanced(df: DataFrame, key: str, over: bool = False, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has, or (``over``) drawn with replacement, as the largest has."""
    sizes = {r[key]: r["n"] for r in df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.limit(0)
    target = max(sizes.values()) if over else min(sizes.values())
    order = Window.partitionBy(key).orderBy(F.rand(seed))
    numbered = df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(order))
    if not over:
        return numbered.where(F.col("_r") <= target).drop("_r")
    spark = df.sparkSession
    draws = None
    for k, n in sizes.items():
        part = spark.range(target).select(F.lit(k).alias("_k"), (F.floor(F.rand(seed) * n) + 1).cast("int").alias("_r"))
        draws = part if draws is None else draws.union(part)
    return numbered.join(draws.withColumnRenamed("_k", key), [key, "_r"]).drop("_r")
