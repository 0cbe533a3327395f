"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import crc_of, ship
from longview.llm.words import Words, slices

ship(__name__)

#: Token separators: every ASCII byte that is neither letter nor digit.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Lengths in bytes of the word beginnings that may be cues, next to whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12)
#: Tokens in one training sequence.
SEQUENCE = 128
#: Training sequences whose forward and backward passes are in memory at a time.
CHUNK = 2048
MOST_EVIDENCE = 6.0


@dataclass
class Tagger:
    """A fitted model. Without cues every text gets the prior."""

    cues: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted hashes
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))  # their log odds
    emission: np.ndarray = field(default_factory=lambda: np.zeros(5))
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))  # start, 0->1, 1->0, 1->1 (0->0 is 0)
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))


class Features:
    """Hashes of each token and its beginnings; evidence of each token under a tagger."""

    def __init__(self):
        self.words = Words(SEPARATORS)

    def tokens(self, data: np.ndarray, bounds: np.ndarray):
        """(start of each token, its end, first token of each text, hashes: of the tokens, then of their beginnings)."""
        starts, ends, total = self.words.spans(data, bounds)
        return starts, ends, np.searchsorted(starts, bounds), self._parts(starts, ends, total)

    def _parts(self, starts: np.ndarray, ends: np.ndarray, total: np.ndarray) -> Iterator[np.ndarray]:
        yield self.words.part(total, starts, ends, 1)
        for n in BEGINNINGS:
            yield np.where(ends - starts > n, self.words.part(total, starts, np.minimum(starts + n, ends), n + 1), np.uint64(0))


def _evidence(parts: Iterator[np.ndarray], tagger: Tagger, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of the whole token, greatest log odds of its beginnings); 0 where nothing is a cue."""
    word = begin = None
    for part in parts:
        e = np.zeros(len(part), np.float32)
        at = np.flatnonzero(quick[part >> np.uint64(44)])
        if len(at) and len(tagger.cues):
            k = np.minimum(np.searchsorted(tagger.cues, part[at]), len(tagger.cues) - 1)
            hit = tagger.cues[k] == part[at]
            e[at[hit]] = tagger.weight[k[hit]]
        if word is None:
            word, begin = e, np.zeros(len(e), np.float32)
        else:
            np.maximum(begin, e, out=begin)
    return word, begin


def _quick(tagger: Tagger) -> np.ndarray:
    quick = np.zeros(1 << 20, bool)
    quick[(tagger.cues >> np.uint64(44)).astype(np.int64)] = True
    return quick


def design(word: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Token features: one, evidence of the token, of its beginnings, of the token before and the one after."""
    best = np.maximum(word, begin)
    x = np.zeros((len(word), 5), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = 1, word, begin
    x[1:, 3], x[:-1, 4] = best[:-1], best[1:]
    starts = first[:-1][first[:-1] < len(word)]
    x[starts, 3] = 0
    ends = first[1:][first[1:] > 0] - 1
    x[ends, 4] = 0
    return x / MOST_EVIDENCE * np.array([MOST_EVIDENCE, 1, 1, 1, 1], np.float32)


def marginals(score: np.ndarray, fresh: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(token is toxic) for a run of chains laid end to end; ``fresh`` marks each chain's first token.

    Forward and backward are products of 2x2 matrices. The run is folded into lanes that advance together,
    and the lanes are then chained, so Python loops over the square root of the tokens only.
    """
    n = len(score)
    if not n:
        return np.empty(0)
    steps = int(np.ceil(np.sqrt(n)))
    lanes = -(-n // steps)
    start, up, down, stay = moves
    m = np.empty((lanes * steps, 2, 2))
    m[:] = np.eye(2)
    on = np.exp(np.clip(score, -40, 40))
    m[:n, 0, 0], m[:n, 1, 0] = 1, np.exp(down)
    m[:n, 0, 1], m[:n, 1, 1] = np.exp(up) * on, np.exp(stay) * on
    m[:n][fresh, 0, 0] = m[:n][fresh, 1, 0] = 1
    both = np.exp(start) * on[fresh]
    at = np.flatnonzero(fresh)
    m[at, 0, 0] = m[at, 1, 0] = 1
    m[at, 0, 1] = m[at, 1, 1] = both
    m = m.reshape(lanes, steps, 2, 2)
    product = np.broadcast_to(np.eye(2), (lanes, 2, 2)).copy()
    for t in range(steps):
        product = product @ m[:, t]
        product /= product.sum((1, 2), keepdims=True)
    enter, leave = np.ones((lanes, 2)), np.ones((lanes, 2))
    for k in range(1, lanes):
        enter[k] = enter[k - 1] @ product[k - 1]
        enter[k] /= enter[k].sum()
    for k in range(lanes - 2, -1, -1):
        leave[k] = product[k + 1] @ leave[k + 1]
        leave[k] /= leave[k].sum()
    alpha, beta = np.empty((lanes, steps, 2)), np.empty((lanes, steps, 2))
    a, b = enter, leave
    for t in range(steps):
        a = np.einsum("li,lij->lj", a, m[:, t])
        a = a / a.sum(1, keepdims=True)
        alpha[:, t] = a
    for t in range(steps - 1, -1, -1):
        beta[:, t] = b
        b = np.einsum("lij,lj->li", m[:, t], b)
        b = b / b.sum(1, keepdims=True)
    p = (alpha * beta).reshape(-1, 2)[:n]
    return p[:, 1] / p.sum(1)


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, tokens, features) and the mask of what is no padding."""
    shape = len(xs), max(map(len, xs))
    grid, valid = np.zeros((*shape, xs[0].shape[1]), np.float32), np.zeros(shape)
    for i, x in enumerate(xs):
        grid[i, : len(x)], valid[i, : len(x)] = x, 1
    return grid, valid


def expected(x: np.ndarray, mask: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chain: what it expects under weights ``theta`` (features of marked tokens, marked starts, moves up,
    down and on), and the log of its total weight. The chain without a marked token weighs one."""
    n, steps, width = x.shape
    on = np.exp(np.clip(x @ theta[:width], -40, 40)) * mask
    begin, up, down, stay = np.exp(theta[width:])
    down = np.where(mask > 0, down, 1.0)  # padding goes back to unmarked at no cost
    a, log_total = np.empty((n, steps, 2)), np.zeros(n)
    a[:, 0, 0], a[:, 0, 1] = 1, begin * on[:, 0]
    for t in range(steps):
        if t:
            a[:, t, 0] = a[:, t - 1, 0] + a[:, t - 1, 1] * down[:, t]
            a[:, t, 1] = (a[:, t - 1, 0] * up + a[:, t - 1, 1] * stay) * on[:, t]
        size = a[:, t].sum(1)
        a[:, t] /= size[:, None]
        log_total += np.log(size)
    b = np.ones((n, 2))
    p1, moves = np.zeros((n, steps)), np.zeros((n, 3))
    for t in range(steps - 1, -1, -1):
        both = a[:, t] * b
        p1[:, t] = both[:, 1] / both.sum(1)
        if t:
            high = on[:, t] * b[:, 1]
            w = np.stack([a[:, t - 1, 0] * b[:, 0], a[:, t - 1, 0] * up * high, a[:, t - 1, 1] * down[:, t] * b[:, 0], a[:, t - 1, 1] * stay * high], 1)
            w /= w.sum(1, keepdims=True)
            moves += w[:, 1:] * mask[:, t, None]
            b = np.stack([b[:, 0] + up * high, down[:, t] * b[:, 0] + stay * high], 1)
            b /= b.sum(1, keepdims=True)
    p1 *= mask
    return np.concatenate([np.einsum("nsf,ns->nf", x, p1), p1[:, :1], moves], 1), log_total


def fit_chain(xs: list[np.ndarray], held: np.ndarray, toxic: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood (with weight decay) of the emission and transition weights, from labels of documents.

    ``xs`` holds the different sequences, and a row (document, sequence, times) of ``held`` says how often a document
    holds one. A clean document's tokens are labelled untouched; of a toxic one's, one at least is toxic, and the
    chain itself infers which: with P0 its probability that none is, the document's likelihood is 1 - P0. Adam climbs
    the sum of logarithms until the weights settle.
    """
    chunks = [(slice(at, at + CHUNK), *_padded(xs[at : at + CHUNK])) for at in range(0, len(xs), CHUNK)]
    document, sequence, times = held.T
    width, total = xs[0].shape[1], max(1, len(toxic))
    theta = np.zeros(width + 4)
    theta[0], theta[1:3], theta[width + 3] = -5.0, 1.0, 0.5
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        sums, log_total = np.empty((len(xs), width + 4)), np.empty(len(xs))
        for rows, x, mask in chunks:
            sums[rows], log_total[rows] = expected(x, mask, theta)
        none = np.exp(-np.bincount(document, times * log_total[sequence], len(toxic)))
        pull = np.where(toxic > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        share = np.bincount(sequence, times * pull[document], len(xs))
        gradient = share @ sums / total - decay * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.98 * second + 0.02 * gradient**2
        move = 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
        theta = theta + move
        if np.abs(move).max() < 0.01:
            break
    return theta[:width], theta[width:]


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - decay * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def summary(m: np.ndarray, tokens: int) -> list[float]:
    """A document's features from its token marginals."""
    total, top = (float(m.sum()), float(m.max())) if len(m) else (0.0, 0.0)
    return [1.0, np.log(0.01 + top), np.log1p(total), np.log(0.0005 + total / (tokens + 20))]


def _counter():
    """(feature, toxic documents, clean documents) of the sample, summed within the partition."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in batches:
            toxic, found, label = batch.column("toxic").to_numpy(), [], []
            for at, end, data, bounds in slices(batch.column("text")):
                _, _, first, parts = features.tokens(data, bounds)
                parts = list(parts)
                for i in range(end - at):
                    own = np.unique(np.concatenate([p[first[i] : first[i + 1]] for p in parts]))
                    own = own[own != 0]
                    found.append(own)
                    label.append(np.full(len(own), toxic[at + i], np.int8))
            if not found:
                continue
            key, where = np.unique(np.concatenate(found), return_inverse=True)
            ones = np.bincount(where, weights=np.concatenate(label), minlength=len(key)).astype(np.int64)
            every = np.bincount(where, minlength=len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ones), pa.array(every - ones)], names=["f", "a", "b"]
            )

    return read


def _sequences(tagger: Tagger):
    """Evidence of each token of the sampled documents: (key, toxic, word evidence, beginning evidence)."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, quick = Features(), _quick(tagger)
        for batch in batches:
            word, begin = [], []
            for at, end, data, bounds in slices(batch.column("text")):
                _, _, first, parts = features.tokens(data, bounds)
                e, p = _evidence(parts, tagger, quick)
                for i in range(end - at):
                    word.append(e[first[i] : first[i + 1]].astype(np.float16).tobytes())
                    begin.append(p[first[i] : first[i + 1]].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("toxic"), pa.array(word, pa.binary()), pa.array(begin, pa.binary())],
                names=["key", "toxic", "word", "begin"],
            )

    return read


def held_out(c: Column) -> Column:
    return F.coalesce(crc_of(c) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_toxic: int = 1200,
    most_clean: int = 2400,
    least_documents: int = 4,
    seed: int = 3,
) -> Tagger:
    """Fit on about ``most_toxic`` + ``most_clean`` labelled documents, drawn by a hash of their id.

    That bound is the only sampling, rows whose crc32(id as text) mod 5 is 0 are never used, and neither are ids with
    labels at odds. Words and word beginnings that are more common in toxic documents are the chain's evidence.
    Tokens are labelled by their documents: untouched throughout a clean one, and toxic somewhere in a toxic one,
    where the chain infers the place (:func:`fit_chain`). A logistic model on the marginals of whole documents gives
    the score, with the true share of toxic rows.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    marked = marked.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        base = 12.0 if sizes.get(1) else -12.0
        return Tagger(document=np.array([base, 0, 0, 0]))
    share = F.when(F.col("toxic") == 1, min(1.0, most_toxic / sizes[1])).otherwise(min(1.0, most_clean / sizes[0]))
    drawn = marked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    # proven small: about most_toxic + most_clean rows of two numbers
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(drawn), "id")
    sample = sample.select(F.xxhash64("id", "text").alias("key"), "toxic", "text")
    counts = (
        sample.mapInArrow(_counter(), "f long, a long, b long")
        .groupBy("f")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where(F.col("a") >= least_documents)
    )
    n1, n0 = sizes[1] * min(1.0, most_toxic / sizes[1]), sizes[0] * min(1.0, most_clean / sizes[0])
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    cues = counts.select("f", odds.alias("w")).where("w > 1").toPandas()
    tagger = Tagger()
    key = cues["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    tagger.cues, tagger.weight = key[order], np.minimum(cues["w"].to_numpy(np.float32)[order], MOST_EVIDENCE)
    rows = sample.mapInArrow(_sequences(tagger), "key long, toxic int, word binary, begin binary").toPandas().sort_values(["key", "toxic"])
    if not len(rows):
        return Tagger(document=np.array([np.log(sizes[1] / sizes[0]), 0, 0, 0]))
    windows, held, documents = {}, [], []  # equal windows are one, with the documents that hold it
    for d, (word, begin) in enumerate(zip(rows["word"], rows["begin"], strict=True)):
        e, p = np.frombuffer(word, np.float16).astype(np.float32), np.frombuffer(begin, np.float16).astype(np.float32)
        x = design(e, p, np.array([0, len(e)]))
        documents.append(x)
        own: dict[int, int] = {}
        for at in range(0, len(e), SEQUENCE):
            k = windows.setdefault(x[at : at + SEQUENCE].tobytes(), len(windows))
            own[k] = own.get(k, 0) + 1
        held += [(d, k, n) for k, n in own.items()]
    if windows:
        xs = [np.frombuffer(w, np.float32).reshape(-1, documents[0].shape[1]) for w in windows]
        tagger.emission, tagger.moves = fit_chain(xs, np.array(held), rows["toxic"].to_numpy())
    windows.clear()
    summaries = []
    for x in documents:
        fresh = np.zeros(len(x), bool)
        fresh[:1] = True
        summaries.append(summary(marginals(x @ tagger.emission, fresh, tagger.moves), len(x)))
    toxic = rows["toxic"].to_numpy(float)
    tagger.document = fit_logistic(np.array(summaries), toxic)
    drawn_odds = np.log(max(1.0, toxic.sum()) / max(1.0, (1 - toxic).sum()))
    tagger.document[0] += np.log(sizes[1] / sizes[0]) - drawn_odds
    return tagger


def _scorer(tagger: Tagger, spans: bool):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, quick = Features(), _quick(tagger)
        for batch in batches:
            score, offsets = [], []
            for at, end, data, bounds in slices(batch.column("text")):
                starts, ends, first, parts = features.tokens(data, bounds)
                word, begin = _evidence(parts, tagger, quick)
                fresh = np.zeros(len(word), bool)
                fresh[first[:-1][first[:-1] < first[1:]]] = True
                m = marginals(design(word, begin, first) @ tagger.emission, fresh, tagger.moves)
                rows = np.array([summary(m[first[i] : first[i + 1]], int(first[i + 1] - first[i])) for i in range(end - at)])
                score.append(1 / (1 + np.exp(-np.clip(rows @ tagger.document, -30, 30))))
                if spans:
                    bad = np.flatnonzero(m >= 0.5)
                    by = np.searchsorted(first[1:], bad, "right")
                    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(bad) else None
                    for i in range(end - at):
                        own = bad[np.searchsorted(by, i) : np.searchsorted(by, i, "right")]
                        offsets.append([{"start": int(lead[starts[k]] - lead[bounds[i]]), "end": int(lead[ends[k]] - lead[bounds[i]])} for k in own])
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            keep.append(pa.array(np.concatenate(score) if score else np.empty(0), pa.float64()))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            keep.append(pa.array(offsets if spans else [None] * batch.num_rows, kind))
            yield pa.RecordBatch.from_arrays(keep, names=[*names, "score", "spans"])

    return read


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, spans) of every row, in whole: ``spans`` are code-point offsets of tokens marked toxic.

    A token's probability comes from forward and backward passes over its whole text, with cues or without; the
    score is a logistic function of the document's greatest and summed marginals. Null and empty texts get the
    score of a text without any sign of toxicity, and no spans. Rows keep their number, repeated ones and those
    without id too; other columns of ``docs`` play no part, and an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(tagger, spans), "id long, score double, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)
