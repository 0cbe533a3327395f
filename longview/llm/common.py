"""Shared building blocks of the training-data operators.

* ``cut`` ends a lineage with a reliable checkpoint in the folder that all executors share.
* ``Scratch`` keeps intermediate tables (Parquet) in that folder and removes them when their work is done.
* ``components`` finds connected components with alternating large-star and small-star rounds.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(name: str) -> None:
    """Send functions of module ``name`` to executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where it is absent and all runs in one process.

    On a cluster without that setting this raises: a machine-local folder would scatter the tables.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="longview-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage (never ``localCheckpoint``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that live only while an operator runs.

    >>> with Scratch(spark) as scratch:
    ...     small = scratch.table(expensive)      # written once, read as often as needed
    ...     result = cut(small.groupBy("k").count())
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int | None = None) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.root if n is None else f"{self.root}/{n}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *exc) -> None:
        self.drop()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of(c: Column) -> Column:
    """crc32 of a column's text form (unsigned), used for hold-out folds."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named inputs, under private names: extra and clashing columns of a caller can't interfere."""
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, rows: int) -> DataFrame:
    """``many`` joined with ``one`` (one row per key), where a key may hold any share of the rows of ``many``.

    ``counts`` has (keys, n) of ``many``, and ``rows`` their sum. Keys with many rows are dealt out in salted parts of
    about 256, their row of ``one`` once for each. At most 100,000 keys can hold more than rows / 100,000 rows, so the
    list of them is small by proof and is broadcast.
    """
    salt, parts = unused(many, "salt", "parts")
    large = counts.where(F.col("n") > max(256, rows // 100_000)).select(*keys, F.ceil(F.col("n") / 256).cast("int").alias(parts))
    own = many.join(F.broadcast(large), keys, "left")
    own = own.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*(F.col(c) for c in many.columns)), parts).cast("int"), F.lit(0))).drop(parts)
    each = one.join(F.broadcast(large), keys, "left")
    each = each.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts) - 1, F.lit(0))))).drop(parts)
    return own.join(each, [*keys, salt]).drop(salt)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: one row (node, component) per node with an edge.

    Large-star and small-star rounds (Kiveris et al., 2014) move every edge towards the smallest node in
    reach; each is an aggregation by node, pre-aggregated before its shuffle, and an equi-join whose hot
    keys AQE may split. Rounds are logarithmic in practice. Lineage is cut after each round; the driver
    sees a count and a checksum only.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = cut(edges.distinct())
    state = _state(edges)
    if state[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.distinct())
        previous, state = state, _state(edges)
        if state == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.select(F.col("u").alias("node"), "component").union(roots)


def steps(batch, column: str, size: int, rows: int = 512) -> Iterator:
    """``batch`` in slices of at most ``rows`` rows and about ``size`` bytes of the string ``column`` (one row at least)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def runs(batches: Iterator, key: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Yield the rows of each run of equal ``key`` from Arrow batches sorted by it, as NumPy columns.

    A run may span batches; memory is one run and one batch.
    """
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]) if held else pa.Table.from_batches([batch])
        keys = [table.column(k).to_numpy() for k in key]
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        starts = [0, *(np.flatnonzero(new) + 1)]
        whole = table.combine_chunks()
        for a, b in zip(starts, starts[1:], strict=False):
            yield _columns(whole.slice(a, b - a))
        held = whole.slice(starts[-1]).to_batches()
    if held:
        yield _columns(pa.Table.from_batches(held))


def _columns(table) -> dict[str, np.ndarray]:
    return {
        name: table.column(name).to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0)
        for name in table.column_names
    }
