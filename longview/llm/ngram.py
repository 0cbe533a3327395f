"""Jaccard join on word shingles with adaptive multi-match prefixes: links of each document, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.llm.common import Scratch, components, cut, runs, ship, steps, unused
from longview.llm.words import Words, shingle_sets

ship(__name__)

#: Bits of the table that orders shingles by how common they are (one byte each; 4 MB whatever the corpus).
ORDER_BITS = 22
#: Bits of the filter that lets a later scan skip documents that are in no candidate pair (1 MB).
FILTER_BITS = 23
#: The most extra prefix tokens a costly document takes.
MOST_MATCHES = 12
#: Documents that share a prefix token from which it counts as common.
COMMON = 32
#: Classes of a group that are compared at a time: larger groups are dealt out as pairs of chunks of about this size.
CHUNK = 256
#: Shingles in one matrix product.
TILE = 4096


def _small(batches: Iterator) -> Iterator:
    """The same rows in batches that keep a worker's memory low."""
    for whole in batches:
        yield from steps(whole, "text", 1 << 21)


def _repeats(width: int):
    """(slot, times) for the shingles that several documents of one partition share."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, held, size = Words(), [], 0
        kept = np.zeros(1 << ORDER_BITS, np.int32)

        def settle():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            more = times > 1
            np.maximum.at(kept, (values[more] >> np.uint64(64 - ORDER_BITS)).astype(np.int64), times[more].astype(np.int32))
            held.clear()

        for batch in batches:
            for own in shingle_sets(batch.column("text"), width, words):
                held.append(own)
                size += len(own)
                if size > 1_000_000:
                    settle()
                    size = 0
        if held:
            settle()
        slots = np.flatnonzero(kept)
        for at in range(0, len(slots), 1 << 16):
            some = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(kept[some], pa.int64())], names=["slot", "times"])

    return read


def _key(own: np.ndarray) -> tuple[int, int]:
    """The 128-bit key of a set."""
    import xxhash

    digest = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _prefixes(width: int, percent: int, levels: bytes):
    """Per document: set size, a 128-bit key of the set, and its prefix, rarest shingles first."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, level = Words(), np.frombuffer(levels, np.uint8)
        for batch in _small(batches):
            ids = batch.column("id")
            n, k1, k2, prefix = [], [], [], []
            for own in shingle_sets(batch.column("text"), width, words):
                for keys, k in zip((k1, k2), _key(own), strict=True):
                    keys.append(k)
                n.append(len(own))
                take = len(own) - (percent * len(own) + 99) // 100 + MOST_MATCHES
                rank = level[own >> np.uint64(64 - ORDER_BITS)]
                order = np.argsort(rank, kind="stable")[:take]  # own is sorted: ties go by hash
                prefix.append(own[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                names=["id", "n", "k1", "k2", "prefix"],
            )

    return read


def _sets(width: int, wanted: bytes):
    """(id, key, shingles) of the documents whose slot is set in the filter ``wanted``."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, bits = Words(), np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little")
        for batch in _small(batches):
            fit = [i is not None and bool(bits[_slot(i)]) for i in batch.column("id").to_pylist()]
            batch = batch.filter(pa.array(fit, pa.bool_()))
            own = list(shingle_sets(batch.column("text"), width, words))
            keys = [_key(x) for x in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2)),
                    pa.array([x.tobytes() for x in own], pa.binary()),
                ],
                names=["id", "k1", "k2", "own"],
            )

    return read


def _slot(i: int) -> int:
    return ((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)


def _slots(batches: Iterator) -> Iterator:
    """The filter slots of ids, as (word, bits) pairs of 64-bit words."""
    import pyarrow as pa

    for batch in batches:
        slots = np.array([_slot(i) for i in batch.column("id").to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], names=["slot"])


def _verify(percent: int):
    """Keep the pairs whose exact Jaccard similarity reaches percent / 100."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, cache, last = [], None, None
            for k, (x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True)):
                if x != last:  # not by id: rows that share one may have different sets
                    cache, last = np.frombuffer(x, np.uint64), x
                other = np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(cache, other, assume_unique=True))
                if 100 * both >= percent * (len(cache) + len(other) - both):
                    keep.append(k)
            out = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield out

    return read


def _sets_of(ids: DataFrame, source: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(id, k1, k2, own): shingle sets of the documents in ``ids``, and of some others."""
    slots = ids.mapInArrow(_slots, "slot long").distinct()
    # at most 2^FILTER_BITS bits, folded to words: 1 MB however many documents there are
    words = slots.groupBy(F.expr("slot div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for w, b in words.collect():
        bits[w] = b
    return scratch.table(source.mapInArrow(_sets(width, bits.tobytes()), "id long, k1 long, k2 long, own binary"))


def _linked(pairs: DataFrame, source: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by their whole shingle sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(ids, source, width, scratch)
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a"
    )
    return scratch.table(joined.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"))


def _overlaps(own: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the sets before ``split`` with those after it; of all with all where it is 0."""
    _, at, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[at]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])[keep]
    column = (np.cumsum(shared) - 1)[at][keep]
    order = np.argsort(column, kind="stable")
    row, column, total = row[order], column[order], int(shared.sum())
    out = np.zeros((split or len(own), len(own) - split), np.int64)
    for low in range(0, total, TILE):
        a, b = np.searchsorted(column, [low, low + TILE])
        has = np.zeros((len(own), min(TILE, total - low)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        out += np.rint((has[:split] if split else has) @ has[split:].T).astype(np.int64)
    return out


def _counter(percent: int):
    """Links of each class with the others of its chunk, or of the other chunk, weighted by their sizes."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, held = ("k1", "k2", "links"), []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held, strict=True)], names=list(names))
            held.clear()
            return batch

        for run in runs(batches, ("component", "ci", "cj")):
            order = np.argsort(run["chunk"], kind="stable")
            whole = run["ci"][0] == run["cj"][0]
            split = 0 if whole else int((run["chunk"] == run["ci"]).sum())
            if len(order) < 2 or not whole and split in (0, len(order)):
                continue
            own, weight = [np.frombuffer(x, np.uint64) for x in run["own"][order]], run["size"][order]
            n, both = np.array([len(x) for x in own]), _overlaps(own, split)
            a, b = n[:split] if split else n, n[split:]
            close = 100 * both >= percent * (a[:, None] + b[None] - both)
            if whole:
                np.fill_diagonal(close, False)
                links = close @ weight
            else:
                links = np.concatenate((close @ weight[split:], close.T @ weight[:split]))
            held.append((run["k1"][order], run["k2"][order], links.astype(np.int64)))
            if sum(len(x[0]) for x in held) > 8192:
                yield flush()
        if held:
            yield flush()

    return read


def _links(classes: DataFrame, source: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, links): rows of other classes that each of ``classes`` (k1, k2, rep, size, component) links with.

    Links join no two components, so all pairs of each component are compared. What is handed on are counts,
    and a component of k classes is dealt out as pairs of its k / CHUNK chunks.
    """
    sets = _sets_of(classes.select(F.col("rep").alias("id")), source, width, scratch)
    sets = sets.dropDuplicates(["id", "k1", "k2"]).withColumnRenamed("id", "rep")
    large = classes.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(f"k > {CHUNK}")
    chunks = F.coalesce(F.ceil(F.col("k") / CHUNK), F.lit(1)).cast("int")
    dealt = (
        classes.join(F.broadcast(large), "component", "left")
        .withColumn("m", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("m")).cast("int"))
        .join(sets, ["rep", "k1", "k2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("component", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "k1", "k2", "size", "own")
    )
    by = ("component", "ci", "cj")
    counted = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_counter(percent), "k1 long, k2 long, links long")
    return counted.groupBy("k1", "k2").agg(F.sum("links").alias("links"))


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    count_links: bool = True,
) -> DataFrame:
    """Links of each document, and groups of documents connected by Jaccard similarity of word shingles.

    Two documents link when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles. Returns (doc_id, n_shingles, component_id, n_links), one row per input row; component_id is the
    smallest id reachable by links, itself included; n_links is the number of other rows, of those with an id,
    that the row links with, equal sets included (left out without ``count_links``). Empty and null texts have no shingles and link with
    nothing; texts with fewer words have one shingle, the whole sequence. Rows with equal sets are one
    class, joined once. Rows that share an id are one node. A null id joins no group (null component).

    All shingles have one global order: those that several documents of a partition share come later, by
    how many share them, from a table of fixed size. A document's prefix holds the rarest of its
    shingles: with ``n - ceil(t n) + l`` of them, documents that link share at least ``l``. First members
    of posting lists are compared with the most central one, where they share a quarter of a prefix. What stays apart is joined on shared prefix
    tokens: each document takes its own ``l`` by the estimated number of candidates of its prefix, and a
    pair needs the smaller ``l`` of the two before its whole sets are compared. Pairs that are already
    connected are skipped, so components of a large group of near copies cost links by its size, not by its
    square, and are the same as with every pair. Links are then counted over all pairs inside each component.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        counted = source.mapInArrow(_repeats(width), "slot int, times long").groupBy("slot").agg(F.sum("times").alias("t"))
        levels = np.zeros(1 << ORDER_BITS, np.uint8)  # at most 2^ORDER_BITS rows reach the driver
        for part in counted.select("slot", F.floor(F.log2("t")).cast("int").alias("t")).toArrow().to_batches():
            levels[part.column("slot").to_numpy()] = part.column("t").to_numpy()
        table = scratch.table(
            source.mapInArrow(
                _prefixes(width, percent, levels.tobytes()), "id long, n long, k1 long, k2 long, prefix array<long>"
            )
        )
        classes = scratch.table(
            table.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
        )
        reps = classes.select(F.col("rep").alias("id"), "k1", "k2")
        base = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)  # prefix length for l matches: base + l
        heads = table.join(reps, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"])
        heads = heads.select("id", "n", base.cast("int").alias("base"), "prefix")
        postings = heads.select("id", "n", "base", F.posexplode("prefix").alias("pos", "token"))
        by_token = Window.partitionBy("token")
        lists = scratch.table(postings.withColumn("df", F.count(F.lit(1)).over(by_token)).where("df > 1"))
        # a list's center is the member with the most shared tokens: of near copies, the one they were made from
        central = lists.groupBy("id").agg(F.count(F.lit(1)).alias("central"))
        center = F.max(F.struct("central", F.bitwise_not("id").alias("last"), "id", "n")).over(by_token)
        shared = scratch.table(lists.join(central, "id").withColumn("first", center).drop("central"))
        alike = f"100 * n >= {percent} * first.n and 100 * first.n >= {percent} * n"
        star = (
            shared.where(f"id <> first.id and {alike}")
            .groupBy(F.col("first.id").alias("a"), F.col("id").alias("b"))
            .agg(F.count(F.lit(1)).alias("met"), F.min("base").alias("base"))
            .where("4 * met > base")
            .select("a", "b")
        )
        links = _linked(scratch.table(star), source, width, percent, scratch)
        near = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

        # what is left: pairs of different components that share enough of their adaptive prefixes
        placed = shared.join(near.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        cost = shared.groupBy("id").agg(
            F.sum(F.when(F.col("pos") <= F.col("base"), F.col("df") - 1)).alias("cost"),
            # a longer prefix must not reach a common token, which would cost more than the extra match saves
            F.min(F.when((F.col("pos") > F.col("base")) & (F.col("df") > COMMON), F.col("pos"))).alias("wall"),
        )
        wants = F.least(F.lit(MOST_MATCHES), 1 + F.floor(F.coalesce("cost", F.lit(0)) / 16), F.col("n") - F.col("base"))
        placed = placed.join(cost, "id").withColumn("l", F.greatest(F.lit(1), F.least(wants, F.coalesce(F.col("wall") - F.col("base"), wants))).cast("int"))
        placed = scratch.table(
            placed.where("pos < base + l").select("token", "id", "n", "l", "component", "pos")
        )
        mixed = (
            placed.groupBy("token")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo <> hi")
            .select("token")
        )
        # where one shared token is enough, a pair is made at its first: not where the tokens before are the same
        in_order = Window.partitionBy("id").orderBy("pos")
        open_lists = placed.join(mixed, "token", "left_semi").withColumn("prev", F.lag("token").over(in_order))
        open_lists = scratch.table(open_lists)
        x, y = open_lists.alias("x"), open_lists.alias("y")
        pairs = (
            x.join(
                y,
                F.expr(
                    "x.token = y.token and x.id < y.id and x.component <> y.component "
                    "and (least(x.l, y.l) > 1 or coalesce(x.prev <> y.prev, true) "
                    # nothing before the first shared token is shared: what follows must be enough
                    f"and (100 + {percent}) * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)) "
                    f"and 100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
                ),
            )
            .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
            .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("x.l", "y.l")).alias("l"))
            .where("met >= l")
            .select("a", "b")
        )
        more = _linked(scratch.table(pairs), source, width, percent, scratch)
        edges = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
        reach = components(edges)
        same_rep = F.count(F.lit(1)).over(Window.partitionBy("rep"))  # more than one where rows share an id
        by_class = classes.join(reach, F.col("rep") == F.col("node"), "left").select(
            "k1", "k2", "n", "rep", "size", F.coalesce("component", "rep").alias("component"),
            (F.col("node").isNotNull() | (same_rep > 1)).alias("company"),
        )
        if count_links:
            by_class = scratch.table(by_class)
            counts = _links(by_class.where("company"), source, width, percent, scratch)
            by_class = by_class.join(counts, ["k1", "k2"], "left")
        n_links = F.when(F.col("id").isNotNull(), F.col("size") - 1 + F.coalesce("links", F.lit(0)))
        out = table.join(by_class, ["k1", "k2", "n"], "left").select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
            *([F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links")] if count_links else []),
        )
        return cut(out)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without id stay."""
    groups = jaccard_groups(docs, id_col, text_col, width, percent, count_links=False)
    (k,) = unused(docs, "k")
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(k)).distinct()
    keyed = docs.withColumn(k, F.col(f"`{id_col}`").cast("long"))
    return keyed.join(gone, k, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
