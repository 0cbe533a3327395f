"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.llm.common import crc_of, ship, steps

ship(__name__)

#: Hash buckets of character n-grams.
BUCKETS = 1 << 13
#: Code points read at a time.
PIECE = 1 << 18
#: Powers of two of the number of grams, by which texts are called far from every centroid.
BANDS = 40
#: Lengths in code points of the pieces of training texts that show how close short texts come.
PIECES = (4, 8, 16, 32, 64, 128, 256, 512)
UNKNOWN = "und"


class Grams:
    """Counts of hashed character 1-, 2- and 3-grams of letters (lower-cased; other runs count as one gap)."""

    def __init__(self):
        import unicodedata

        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                letter[c] = True
                low = chr(c).lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        self.code = np.where(letter, lower, 32).astype(np.uint64)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Bucket counts, or None where the text has no letter. A long text is read piece by piece."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        counts, held, letters = np.zeros(BUCKETS, np.int64), np.array([32], np.uint64), False
        for at in range(0, len(points) + 1, PIECE):
            c = self.code[points[at : at + PIECE]]
            gap = c == 32
            letters |= not gap.all()
            again = gap.copy()
            again[1:] &= gap[:-1]
            again[:1] &= held[-1] == 32
            c = c[~again]
            if at + PIECE > len(points) and (c[-1] if len(c) else held[-1]) != 32:  # the end counts as a gap
                c = np.append(c, np.uint64(32))
            known, held = len(held), np.concatenate((held, c))
            self._add(counts, held, known if at else 0)
            held = held[-2:]
        return counts if letters else None

    @staticmethod
    def _add(counts: np.ndarray, c: np.ndarray, known: int) -> None:
        """Add the grams that end at or after position ``known``."""
        k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        two = (c[:-1] * k1) ^ (c[1:] * k2)
        three = (two[:-1] * k1) ^ (c[2:] * k2)
        for n, each in ((1, c * k2), (2, two * k2), (3, three * k1)):
            counts += np.bincount((each[max(0, known - n + 1) :] >> np.uint64(64 - 13)).astype(np.int64), minlength=BUCKETS)


@dataclass
class Centroids:
    """A fitted model: ``center`` rows are unit vectors, ``lang`` names each row's language."""

    idf: np.ndarray
    center: np.ndarray
    lang: list[str]
    least: np.ndarray  # cosine below which a text is rejected, by the power of two of its grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32))
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best centroid, cosine, whether it is too far) of rows of counts."""
        cosine = self.vectors(counts) @ self.center.T
        best = cosine.argmax(1)
        top = cosine[np.arange(len(best)), best]
        return best, np.clip(top, 0, 1).astype(float), top < self.least[bands(counts)]


def bands(counts: np.ndarray) -> np.ndarray:
    """The power of two below the number of grams of each row."""
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(int), BANDS - 1)


def nothing() -> Centroids:
    return Centroids(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros(BANDS))


def fit(lang: list[str], counts: np.ndarray, pieces: Iterator[np.ndarray], per_language: int, seed: int, reject: float, slack: float) -> Centroids:
    """Spherical k-means inside each language; limits are low quantiles, by length, of the cosines of texts and of their pieces."""
    df = (counts > 0).sum(0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
    model = nothing()
    model.idf = idf
    x = model.vectors(counts)
    names, rng = np.array(lang), np.random.default_rng(seed)
    centers, owners = [], []
    for name in sorted(set(lang)):
        own = x[names == name]
        k = min(per_language, len(own))
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centers.append(c)
        owners += [name] * k
    model.center, model.lang = np.concatenate(centers).astype(np.float32), owners
    top, band = [], []
    for rows in chain([counts], pieces):
        top.append((model.vectors(rows) @ model.center.T).max(1))
        band.append(bands(rows))
    top, band = np.concatenate(top), np.concatenate(band)
    for k in range(BANDS):  # longer texts come closer to a centroid: a limit holds until a later one is measured
        own = top[band == k]
        here = float(np.quantile(own, reject)) * slack if len(own) >= 1 / reject / 4 else 0.0
        model.least[k] = max(here, model.least[k - 1] if k else 0.0)
    return model


def _featurise(batches: Iterator) -> Iterator:
    """(lang, buckets, counts, piece) of the sampled texts, and of one piece of each length of every text that is longer."""
    import hashlib

    import pyarrow as pa

    grams = Grams()
    for batch in batches:
        lang, where, times, piece = [], [], [], []
        for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            draw = int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:7], "big")
            cuts = [text[(at := draw % (len(text) - n)) : at + n] for n in PIECES if len(text) > n]
            for i, part in enumerate([text, *cuts]):
                counts = grams(part)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    lang.append(name)
                    where.append(at.astype(np.int16).tobytes())
                    times.append(counts[at].astype(np.int32).tobytes())
                    piece.append(i > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(where, pa.binary()), pa.array(times, pa.binary()), pa.array(piece, pa.bool_())],
            names=["lang", "at", "n", "piece"],
        )


def _predictor(model: Centroids):
    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grams, owner = Grams(), np.array(model.lang)
        for whole in batches:
            for batch in steps(whole, "text", 1 << 20, 64):
                counts = [grams(t) for t in batch.column("text").to_pylist()]
                some = [i for i, c in enumerate(counts) if c is not None]
                lang, score, rejected = [UNKNOWN] * len(counts), [0.0] * len(counts), [True] * len(counts)
                if some and len(owner):
                    for i, b, s, r in zip(some, *model.nearest(np.stack([counts[i] for i in some])), strict=True):
                        lang[i], score[i], rejected[i] = str(owner[b]), float(s), bool(r)
                keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*names, "lang_pred", "score", "rejected"],
                )

    return predict


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_language: int = 400,
    centroids: int = 4,
    reject: float = 0.002,
    slack: float = 0.6,
    seed: int = 11,
) -> Centroids:
    """Fit on about ``texts_per_language`` texts of each language, drawn by a hash of the id.

    That bound is the only sampling: features are counted on executors over whole texts, and at most
    ``BUCKETS`` counts a sampled text (and one piece of it by each of ``PIECES``) reach the driver. Rows whose
    crc32(id as text) mod 4 is 2 are held out. A text is called far if its cosine is below ``slack`` times the
    ``reject`` quantile of training texts and pieces of about its length; lengths with too few of them to have
    that quantile take the limit of the next shorter length.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return nothing()
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, texts_per_language / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    table = drawn.mapInArrow(_featurise, "lang string, at binary, n binary, piece boolean").toPandas()
    if table["piece"].all():
        return nothing()
    table = table.sort_values(["lang", "at", "n"])  # whatever order the tasks ended in
    whole, pieces = table[~table["piece"]], table[table["piece"]]
    parts = (_dense(pieces.iloc[at : at + 256]) for at in range(0, len(pieces), 256))
    return fit(list(whole["lang"]), _dense(whole), parts, centroids, seed, reject, slack)


def _dense(rows) -> np.ndarray:
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        counts[i, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.int32)
    return counts


def held_out(c):
    return F.coalesce(crc_of(c) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, rejected) of every row.

    ``score`` is the cosine of the text's TF-IDF vector with its nearest centroid. A text that is null or
    has no letter is 'und', with score 0, and rejected. Other texts, of any length, get the nearest centroid's
    language; they are rejected when they are farther from it than nearly all training texts of about their
    length (with slack). A model fitted on no text calls everything 'und'. Repeated rows each get a row, equal
    cosines go to the first language by name, and columns of ``docs`` other than the id and ``keep`` play no part.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    out = rows.mapInArrow(_predictor(model), ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns, whatever their names; ids may be null or repeat."""
    model = train(docs, id_col, text_col, lang_col)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        predict = _predictor(model)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            flags = [x for out in predict(iter([texts])) for x in out.column("rejected").to_pylist()]
            yield batch.filter(pa.array([not x for x in flags], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
