"""Near-duplicate embeddings: sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.llm.common import Scratch, components, cut, only, runs, ship

ship(__name__)


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Hash tables of ``bits`` hyperplanes needed to meet a pair at ``threshold`` with probability ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _encoder(bits: int, tables: int, seed: int):
    """Vectors to (row id, dimension, content key, sign codes, the vector).

    The vector goes on as four bytes a component where that loses nothing, else eight; equal directions share a key.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, by_dim = batch.column("id").to_pylist(), {}
                vectors = batch.column("vec").to_numpy(zero_copy_only=False)
                for i, v in enumerate(vectors):
                    by_dim.setdefault(len(v), []).append(i)
                out = {k: [] for k in ("id", "dim", "k1", "k2", "codes", "packed", "vec")}
                for dim, rows in by_dim.items():
                    x = np.stack([np.asarray(vectors[i], np.float64) for i in rows]) + 0.0
                    top = np.abs(x).max(1)
                    good = np.isfinite(top) & (top > 0)
                    x, rows = x[good], [r for r, g in zip(rows, good, strict=True) if g]
                    if not len(rows):
                        continue
                    unit = _units(x)
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                    signs = (unit @ planes[dim] >= 0).reshape(len(rows), tables, bits)
                    codes = (signs * powers).sum(2).astype(np.int32)
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    same = (short == x).all(1)
                    for i, u, c, v, w, brief in zip(rows, unit, codes, x, short, same, strict=True):
                        digest = xxhash.xxh3_128_digest(u.tobytes())
                        out["id"].append(ids[i])
                        out["dim"].append(dim)
                        out["k1"].append(int.from_bytes(digest[:8], "big", signed=True))
                        out["k2"].append(int.from_bytes(digest[8:], "big", signed=True))
                        out["codes"].append(c)
                        out["packed"].append((c.astype(np.int16) if bits < 16 else c).tobytes())
                        out["vec"].append((w if brief else v).tobytes())
                types = {"id": pa.int64(), "dim": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "codes": pa.list_(pa.int32()), "packed": pa.binary(), "vec": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    return encode


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, the same whatever rows are beside them."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None] + 0.0


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in reach of each of n nodes through links a-b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linker(threshold: float, bits: int):
    """Exact cosine inside each bucket block; a pair counts in the first table where its codes agree."""

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, counts, roots, kind = [], [], [], np.int16 if bits < 16 else np.int32

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
                    for x in (ids, counts, roots)
                ],
                names=["node", "links", "root"],
            )
            for x in (ids, counts, roots):
                x.clear()
            return batch

        for run in runs(batches, ("dim", "tbl", "code", "ci", "cj")):
            n = len(run["node"])
            if n < 2:
                continue
            order = np.argsort(run["node"], kind="stable")
            one, weight, chunk = run["node"][order], run["weight"][order], run["chunk"][order]
            dim = int(run["dim"][0])
            units = _units(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in run["vec"][order]]))
            codes = np.stack([np.frombuffer(c, kind) for c in run["packed"][order]])
            table, split = int(run["tbl"][0]), run["ci"][0] != run["cj"][0]
            linked_a, linked_b, count = [], [], np.zeros(n, np.int64)
            for i in range(0, n - 1, 256):
                a, b = np.nonzero(units[i : i + 256] @ units.T >= threshold)
                a = a + i
                fit = (b > a) & (chunk[a] != chunk[b] if split else True)
                a, b = a[fit], b[fit]
                if not len(a):
                    continue
                # a pair counts in the first table where its codes agree; a local tree of links is handed on
                for lo in range(0, len(a), 1 << 16):
                    p, q = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                    first = (codes[p, :table] != codes[q, :table]).all(1)
                    count += np.bincount(p[first], weight[q[first]], n).astype(np.int64)
                    count += np.bincount(q[first], weight[p[first]], n).astype(np.int64)
                linked_a.append(a)
                linked_b.append(b)
            if linked_a:
                a, b = np.concatenate(linked_a), np.concatenate(linked_b)
                root = _local_roots(n, a, b)
                seen = np.unique(np.concatenate([a, b]))
                ids.append(one[seen])
                counts.append(count[seen])
                roots.append(one[root[seen]])
            if sum(map(len, ids)) > 20_000:
                yield flush()
        yield flush()

    return link


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    recall: float = 0.9995,
    bucket: int = 768,
    block: int = 2048,
    seed: int = 7,
) -> DataFrame:
    """Vectors within ``threshold`` cosine of each other, and the groups they form.

    Returns (vec_id, n_links, component_id, kept, n_copies), one row per input row. Random hyperplanes give
    each vector a sign code in each of several tables; the number of bits follows the number of vectors, so
    that buckets of even data hold about ``bucket``, and the number of tables follows from ``recall``, the chance to
    meet a pair that lies exactly at the threshold (closer pairs meet more surely). Vectors of one bucket are
    compared by cosine in double precision, so no reported link is below the threshold. Exact copies (same
    direction and same bytes once normalised) are compared once and counted by weight. A bucket above
    ``block`` vectors is compared as pairs of blocks in separate tasks; nothing is dropped.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0,
    component_id their own id. Vectors of different lengths never link. A repeated row counts as another
    vector, and so does another vector with the same id: each row has its own links, and ids are smallest ids of
    the linked rows. Rows without id form no links and keep a null component. An empty table gives no rows, and
    columns other than the two play no part.
    """
    spark = vectors.sparkSession
    rows = only(vectors, id=id_col, vec=vec_col).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    usable = F.coalesce(
        F.expr("id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vec, x -> x <> 0)"),
        F.lit(False),
    )
    good, rest = rows.where(usable), rows.where(~usable)
    n = max(1, good.select("id").count())
    bits = min(30, max(4, math.ceil(math.log2(n / bucket)) if n > bucket else 4))
    tables = tables_for(threshold, bits, recall)
    key = ["dim", "k1", "k2"]

    with Scratch(spark) as scratch:
        encoded = scratch.table(
            good.mapInArrow(_encoder(bits, tables, seed), "id long, dim int, k1 long, k2 long, codes array<int>, packed binary, vec binary")
        )
        # one node per class of copies, numbered where it is written
        classes = encoded.groupBy(*key).agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min(F.struct("codes", "packed", "vec")).alias("one")
        )
        nodes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()))
        slots = nodes.select("node", "dim", "weight", F.col("one.vec").alias("vec"), F.col("one.packed").alias("packed"), F.posexplode("one.codes").alias("tbl", "code"))
        by = ["dim", "tbl", "code"]
        large = scratch.table(
            nodes.select("dim", F.posexplode("one.codes").alias("tbl", "code"))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
            .select(*by, F.ceil(F.col("m") / block).cast("int").alias("chunks"))
        )
        few = large.count() <= 100_000  # so many rows of four numbers are a few MB; beyond, the join is a shuffle
        dealt = (
            slots.join(F.broadcast(large) if few else large, by, "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("node", *by, F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "weight", "packed", "vec")
        )
        by = [*by, "ci", "cj"]
        found = scratch.table(
            dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_linker(threshold, bits), "node long, links long, root long")
        )
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        reach = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
        placed = nodes.select(*key, "node", "rep", "weight").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
        per_class = placed.join(links, "node", "left").join(least, "component").select(
            *key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.col("weight").alias("n_copies")
        )
        linked = encoded.select("id", *key).join(per_class, key).select("id", "n_links", "component_id", "n_copies")
        alone = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
        return cut(
            linked.union(alone).select(
                F.col("id").alias("vec_id"), "n_links", "component_id",
                F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_copies",
            )
        )

