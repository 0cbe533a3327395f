"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import Scratch, cut, ship, spread_join, steps, unused

ship(__name__)

#: Characters that do not count when texts are compared: space and \x09-\x0D.
IGNORED = b" \t\n\x0b\x0c\r"
#: The columns that tell distinct rows apart (id with null filled, code points, leading digest bytes).
KEY = ["k1", "points", "s"]
NO_ID = -(2**63)
#: Bytes of blocks, with what Python adds to each, that a worker remembers to leave repeats out before the shuffle.
REMEMBERED = 1 << 23
#: Bytes of text in one outgoing batch, about.
STEP = 1 << 21


def _reader(block_bytes: int, hash_bits: int, want: str):
    """Arrow batches of (id, text) to what ``want`` names.

    ``rows``: key, digest and block hashes of each row. ``blocks``: the (hash, block) pairs, repeats near each
    other left out. ``pieces``: key, position, hash and block of every block.
    """

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        shift, seen, held = 64 - hash_bits, set(), 0
        signed = lambda raw: int.from_bytes(raw, "big", signed=True)
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                texts = batch.column("text")
                points = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
                out: dict[str, list] = {k: [] for k in ("k1", "points", "s", "id", "sha", "raw", "hs", "pos", "h", "block")}
                raws = batch.column("raw").to_pylist()
                for i, text, n, raw in zip(batch.column("id").to_pylist(), texts.cast(pa.binary()).to_pylist(), points, raws, strict=True):
                    clean = (text or b"").translate(None, IGNORED)
                    blocks = [clean[a : a + block_bytes] for a in range(0, max(1, len(clean)), block_bytes)]
                    hs = [signed(xxhash.xxh3_64_digest(b)) >> shift for b in blocks]
                    if want == "blocks":
                        for h, b in zip(hs, blocks, strict=True):
                            if (h, b) not in seen:
                                seen.add((h, b))
                                held += len(b) + 200
                                out["h"].append(h)
                                out["block"].append(b)
                        continue
                    digest = hashlib.sha256(clean)
                    key = (NO_ID if i is None else i, n, signed(digest.digest()[:8]))
                    if want == "rows":
                        for k, v in zip(("k1", "points", "s", "id", "sha", "raw", "hs"), (*key, i, digest.hexdigest(), raw, hs), strict=True):
                            out[k].append(v)
                    else:
                        for pos, (h, b) in enumerate(zip(hs, blocks, strict=True)):
                            for k, v in zip(("k1", "points", "s", "pos", "h", "block"), (*key, pos, h, b), strict=True):
                                out[k].append(v)
                if held > REMEMBERED:  # copies are told apart within these, the rest after the shuffle
                    seen, held = set(), 0
                types = {"k1": pa.int64(), "points": pa.int64(), "s": pa.int64(), "id": pa.int64(), "sha": pa.string(), "raw": pa.int64(), "hs": pa.list_(pa.int64()), "pos": pa.int32(), "h": pa.int64(), "block": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[k], types[k]) for k in FIELDS[want]], names=list(FIELDS[want])
                )

    return read


FIELDS = {
    "rows": {"k1": "long", "points": "long", "s": "long", "id": "long", "sha": "string", "raw": "long", "hs": "array<long>"},
    "blocks": {"h": "long", "block": "binary"},
    "pieces": {"k1": "long", "points": "long", "s": "long", "pos": "int", "h": "long", "block": "binary"},
}


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Give distinct rows integer names: each hash partition sorts its keys and numbers them.

    A name is (partition number, rank in the partition). Callers write the result before they use it, so
    names never change when an executor is lost.
    """
    return keys.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4096,
    hash_bits: int = 64,
) -> DataFrame:
    """The class of equal texts that each row belongs to, and the row that stays.

    Fixed-size blocks of the normalised UTF-8 bytes are sorted into integer names; adjacent names are
    paired and the pairs named, level by level, until every text has one name. Equal names mean equal
    texts. A row is known by its id, code points and 64 leading bits of its digest, so only rows that share all
    three are taken as one (a null id is one with the smallest long). The text is shuffled once, as distinct blocks (deduplicated
    before the shuffle); after that a block travels as a hash of ``hash_bits`` bits. Blocks that differ
    but share a hash are noticed, and their rows look names up by the bytes themselves.

    Texts are equal when identical after deleting space and \\x09-\\x0D; null counts as empty. Of equal
    texts the row with the most code points in its original text stays, then the smallest id (a null id
    last). Returns (doc_id, keep_id, group_size, kept, text_sha256, text_hash), one row per input row, dropped ones
    too. Repeated rows that agree in id and text are each returned with the same values. An empty table
    gives no rows. Classes of any size are counted by pre-aggregated shuffles, and large ones get their result back
    in salted parts, so no task holds a class.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = source.withColumn("raw", F.xxhash64("text"))

    def read(want: str) -> DataFrame:
        schema = ", ".join(f"{k} {v}" for k, v in FIELDS[want].items())
        return source.mapInArrow(_reader(block_bytes, hash_bits, want), schema)

    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(read("rows"))
        names = scratch.table(_named(read("blocks").repartition("h").distinct(), "h", "block").withColumn("block", _unless_shared()))
        level = _first_level(rows, names, read, scratch)
        final = _collapse(level, scratch)
        members = scratch.table(rows.select(*KEY, "id", "sha", "raw").join(final, KEY))
        # ~id falls as the id rises, without overflow; a null id comes last
        best = members.groupBy("depth", "name").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct("points", F.bitwise_not(F.coalesce("id", F.lit(2**63 - 1))).alias("last"))).alias("best"),
        )
        kept_id = F.bitwise_not(F.col("best.last"))
        best = scratch.table(best)
        joined = spread_join(members, best, ["depth", "name"], best.withColumnRenamed("group_size", "n"), members.count())
        out = joined.select(
            F.col("id").alias("doc_id"),
            F.when(kept_id != 2**63 - 1, kept_id).alias("keep_id"),
            "group_size",
            ((F.col("points") == F.col("best.points")) & (F.coalesce("id", F.lit(2**63 - 1)) == kept_id)).alias("kept"),
            F.col("sha").alias("text_sha256"),
            F.col("raw").alias("text_hash"),
        )
        return cut(out)


def _unless_shared():
    """Block bytes are stored with a name only if the block's hash is shared by another block."""
    return F.when(F.count(F.lit(1)).over(Window.partitionBy("h")) > 1, F.col("block"))


def _first_level(rows: DataFrame, names: DataFrame, read, scratch: Scratch) -> DataFrame:
    level = (
        rows.select(*KEY, F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
        .distinct()
        .join(names.where("block is null").select("h", "name"), "h")
        .select(*KEY, "n", "pos", "name")
    )
    shared = names.where("block is not null")
    if shared.limit(1).count():
        sizes = rows.select(*KEY, F.size("hs").alias("n")).distinct()
        by_bytes = (
            read("pieces").join(shared.select("h").distinct(), "h", "left_semi").distinct().join(shared, ["h", "block"])
        )
        level = level.union(by_bytes.join(sizes, KEY).select(*KEY, "n", "pos", "name"))
    return scratch.table(level)


def _collapse(level: DataFrame, scratch: Scratch) -> DataFrame:
    """Name adjacent pairs until each text has one name; (key, depth, name) is its identity."""
    most, depth = level.agg(F.max("n")).first()[0] or 1, 0
    final = level.where("n = 1").select(*KEY, F.lit(0).alias("depth"), "name")
    level = level.where("n > 1")
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        pairs = level.groupBy(*KEY, "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("case when pos % 2 = 0 then name end")).alias("a"),
            F.coalesce(F.max(F.expr("case when pos % 2 = 1 then name end")), F.lit(-1)).alias("b"),
        )
        pairs = scratch.table(pairs.withColumn("n", F.expr("(n + 1) div 2").cast("int")))
        named = scratch.table(_named(pairs.select("a", "b").distinct(), "a", "b"))
        level = scratch.table(pairs.join(named, ["a", "b"]).select(*KEY, "n", "pos", "name"))
        final = final.union(level.where("n = 1").select(*KEY, F.lit(depth).alias("depth"), "name"))
        level = level.where("n > 1")
    return final


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Where rows agree in id and normalised text, the longest original text stays; rows that repeat each
    other wholly all stay or go together.
    """
    k, h = unused(docs, "k", "h")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    gone = (
        exact_duplicates(docs, id_col, text_col)
        .where("not kept")
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias(k), F.col("text_hash").alias(h))
        .distinct()
    )
    keyed = docs.withColumns({k: key, h: F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    return keyed.join(gone, [k, h], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
