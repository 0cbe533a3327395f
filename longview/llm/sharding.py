"""Sharding by histogram sort: exact byte counts below probe keys refine the splitters, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import Scratch, cut, unused

LOW, HIGH = -(2**63), 2**63 - 1
#: Probes per open splitter and round.
PROBES = 8


def _below(keys: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes with a key below each probe (sorted): one pre-aggregated count per gap."""
    table = F.array(*(F.lit(p).cast("long") for p in probes))
    gap = F.size(F.filter(table, lambda p: p <= F.col("key")))
    found = {r["gap"]: r["b"] for r in keys.groupBy(gap.alias("gap")).agg(F.sum("bytes").alias("b")).collect()}
    out, total = [], 0
    for i in range(len(probes)):
        total += found.get(i, 0)
        out.append(total)
    return out


def splitters(keys: DataFrame, targets: list[int], tolerance: int, most_rounds: int = 40) -> list[int]:
    """Keys below which about ``targets`` bytes lie (rising), each within ``tolerance`` or at a single key.

    Each open splitter keeps the range of keys it must lie in and the bytes below both ends; a round
    counts the bytes below probes inside all open ranges at once, half of them around the place that
    interpolation suggests.
    """
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    state = [{"lo": LOW, "lo_b": 0, "hi": HIGH, "hi_b": total, "best": LOW, "best_b": 0} for _ in targets]
    for _ in range(most_rounds):
        probes: set[int] = set()
        for s, t in zip(state, targets, strict=True):
            if abs(s["best_b"] - t) <= tolerance or s["hi"] - s["lo"] <= 1:
                continue
            width, share = s["hi"] - s["lo"], (t - s["lo_b"]) / max(1, s["hi_b"] - s["lo_b"])
            guess = s["lo"] + int(width * min(1.0, max(0.0, share)))
            step = max(1, width // 4096)
            near = [guess + step * d for d in (-16, -2, 0, 2, 16)]
            even = [s["lo"] + width * k // PROBES for k in range(1, PROBES)]
            probes.update(p for p in near + even if s["lo"] < p < s["hi"])
        if not probes:
            break
        at = sorted(probes)
        for p, b in zip(at, _below(keys, at), strict=True):
            for s, t in zip(state, targets, strict=True):
                if b <= t and p > s["lo"]:
                    s["lo"], s["lo_b"] = p, b
                if b > t and p < s["hi"]:
                    s["hi"], s["hi_b"] = p, b
                if abs(b - t) < abs(s["best_b"] - t):
                    s["best"], s["best_b"] = p, b
    return [s["best"] for s in state]


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    tolerance: float = 0.001,
    runs_of: int = 50_000,
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (null).

    Shards are near equal in bytes, where a row's size is its UTF-8 bytes plus one (a null text: one).
    Rows are ordered by a hash of the text; splitters are found by histogram sort, so rows move once.
    Equal texts share a shard. Only a group of copies that fits whole into no shard's equal share is
    spread over the key space by its ids (rows that repeat an id and a text stay together); groups above
    ``tolerance`` of a shard (at most shards / tolerance of them reach the driver) are placed whole first,
    the largest into the emptiest shard, and the splitters fill each shard up to its equal share.

    A null text counts as empty: size 1, the CRC of no bytes, and one group with empty texts. ``slot`` numbers a shard's rows from 0 without gaps. It is a running count over runs of about
    ``runs_of`` rows, so no task holds a shard. Null ids and repeated rows are rows like others; an empty
    table gives no rows. Columns of ``docs`` are kept, but for those named like the new ones.
    """
    text = F.col(f"`{text_col}`").cast("string")
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    taken = [c for c in docs.columns if c.lower() not in new]
    t, u, own, run, n_, ahead, seat = unused(docs, "t", "u", "own", "run", "n", "ahead", "seat")
    rows = docs.select(
        *(F.col(f"`{c}`") for c in taken),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias(t),
        F.xxhash64(F.coalesce(text, F.lit("")), F.col(f"`{id_col}`")).alias(u),
    )
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.table(
            rows.select(t, "size").groupBy(t).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        )
        total, n = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        share = max(1, total // shards)
        heavy = texts.where(F.col("bytes") > max(1, int(share * tolerance))).collect()
        load, whole, spread = [0] * shards, {}, []
        for r in sorted(heavy, key=lambda r: (-r["bytes"], r[t])):
            least = min(range(shards), key=lambda k: (load[k], k))
            if load[least] + r["bytes"] > share:
                spread.append(r[t])
            else:
                whole[r[t]] = least
                load[least] += r["bytes"]
        placed = F.lit(None).cast("int")
        if whole:
            table = F.create_map(*(F.lit(x) for kv in whole.items() for x in kv))
            placed = F.try_element_at(table, F.col(t))
        key = F.when(F.col(t).isin(spread), F.col(u)).otherwise(F.col(t)) if spread else F.col(t)
        # the keys that the splitters divide: one row per text, and per row of a spread group
        free = texts.where(placed.isNull() & ~F.col(t).isin(spread)) if spread else texts.where(placed.isNull())
        keys = free.select(F.col(t).alias("key"), "bytes")
        if spread:
            keys = keys.union(rows.where(F.col(t).isin(spread)).select(F.col(u).alias("key"), F.col("size").alias("bytes")))
        keys = scratch.table(keys)
        room, targets, at = [max(0, share - x) for x in load], [], 0
        left = total - sum(load)
        scale = left / max(1, sum(room))
        for k in range(shards - 1):
            at += room[k] * scale
            targets.append(int(at))
        cuts = splitters(keys, targets, max(1, int(share * tolerance)))
        by_key = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col(own))) if cuts else F.lit(0)
        parts = max(32, -(-n // (shards * runs_of)))
        out = (
            rows.withColumn(own, key)
            .withColumn("shard", F.coalesce(placed, by_key).cast("int"))
            .withColumn(run, F.pmod(F.xxhash64(F.col(f"`{id_col}`"), t, F.lit(5)), F.lit(parts)).cast("int"))
        )
        sizes = out.groupBy("shard", run).agg(F.count(F.lit(1)).alias(n_))
        # shards * parts rows: small, and bounded by rows / runs_of
        before = cut(
            sizes.withColumn(
                ahead,
                F.sum(n_).over(Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)),
            ).select("shard", run, F.coalesce(ahead, F.lit(0)).alias(ahead))
        )
        inside = Window.partitionBy("shard", run).orderBy(u, F.col(f"`{id_col}`"))
        numbered = out.withColumn(seat, F.row_number().over(inside)).join(before, ["shard", run])
        return numbered.select(
            *(F.col(f"`{c}`") for c in taken),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col(ahead) + F.col(seat) - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shard ``docs`` and write each shard as a folder of Parquet files in slot order (columns and text kept)."""
    shard(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
