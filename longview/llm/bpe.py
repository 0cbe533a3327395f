"""Byte-pair encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.llm.common import ship, steps
from longview.llm.words import Words, slices

ship(__name__)

#: Bytes of fragments and their ids, with what Python adds to each, that a worker remembers.
REMEMBERED = 48 << 20
#: Bytes of text handled at a time; a longer text is handled alone.
STEP = 1 << 19
BLANKS = " \t\n\x0b\x0c\r"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ids = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        known = all(c in alphabet for c in token)
        out[i] = bytes(alphabet[c] for c in token) if known else token.encode()
    return out


def check_rules(path: str) -> None:
    """Cuts are certain under the pre-tokenising rules they were worked out for; a file with others is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules = spec.get("pre_tokenizer") or {}
    plain = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if rules.get("type") != "ByteLevel" or rules.get("add_prefix_space") or not rules.get("use_regex", True) or spec.get("normalizer") or not plain:
        raise ValueError(f"{path}: only byte-level vocabularies with their own word pattern, no prefix space and no normaliser are cut")


def certain(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: True for the pairs of bytes that never occur inside any token of the vocabulary.

    Every merge that joins two bytes makes a token that holds them side by side, so between the bytes of such a
    pair there is always a token boundary, and what stands on either side never takes part in a merge of the other.
    Special tokens count, so none is ever cut.
    """
    free = np.ones((256, 256), bool)
    raw = np.frombuffer(b"\0".join(tokens), np.uint8)
    inside = np.ones(max(0, len(raw) - 1), bool)
    ends = np.cumsum([len(t) + 1 for t in tokens])[:-1] - 1
    inside[ends] = inside[ends - 1] = False  # the separators belong to no token
    free[raw[:-1][inside], raw[1:][inside]] = False
    return free


class Splitter:
    """Finds the forced boundaries of texts, on their UTF-8 bytes.

    A pair of :func:`certain` is a boundary of tokens wherever it stands. The text may be cut there if the word
    pattern also finds the same words in both parts. It does before a blank that follows text, where a new word
    always starts. Elsewhere it does unless the pair holds a blank or an apostrophe (a blank joins the word that
    follows, an apostrophe starts a contraction). Characters are never cut, and characters whose first bytes
    they share with blanks beyond ASCII's keep their neighbours.
    """

    def __init__(self, tokens: list[bytes]):
        cut = certain(tokens)
        blanks, control = list(BLANKS.encode()), [0x1C, 0x1D, 0x1E, 0x1F]
        cut[[*blanks, *control, ord("'")], :] = False  # nothing is cut after these
        cut[:, [*control, ord("'")]] = False  # nor before these
        cut[:, 0x80:0xC0] = False  # inside a character
        self.cut, self.odd = cut.ravel(), np.zeros(1 << 16, bool)
        for pair in ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
            self.odd[pair[0] << 8 | pair[1]] = True

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """Positions in ``data`` before which it may be cut."""
        pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
        cut = self.cut[pairs]
        odd = np.flatnonzero(self.odd[pairs])
        if len(odd):
            near = np.zeros(len(data) + 3, bool)
            for k in range(3):
                near[odd + k] = True
            cut &= ~(near[: len(cut)] | near[1 : len(cut) + 1])
        return np.flatnonzero(cut) + 1


class Encoder:
    """Ids of texts: the fragments between certain cuts are encoded independently, remembered, and concatenated."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_rules(path)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.split, self.words, self.known, self.held = Splitter(token_bytes(path)), Words(b""), {}, 0

    def __call__(self, column):
        """(ids, their bounds by text) of an Arrow string column, nulls empty."""
        found, ends = [], [0]
        for data, last in self._pieces(column):
            ids, counts = self._encode(data, last)
            found.append(ids)
            ends.extend((ends[-1] + np.cumsum(counts)).tolist() if len(last) else [])
            if not len(last):  # a long text goes on: its ids so far count towards its end
                self.open += len(ids)
            elif self.open:
                ends[-len(last) :] = [e + self.open for e in ends[-len(last) :]]
                self.open = 0
        return (np.concatenate(found) if found else np.empty(0, np.int32)), np.array(ends, np.int64)

    open = 0

    def _pieces(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bytes, ends of the texts that end in them): whole texts, or parts of a text of more than ``STEP`` bytes."""
        for _, _, data, bounds in slices(column, STEP):
            while len(bounds) == 2 and len(data) > STEP:
                width, at = STEP, 0
                while not at and width < len(data):
                    cuts = self.split(data[:width])
                    cuts = cuts[cuts < width - 4]  # what follows may matter to the last few
                    at, width = int(cuts[-1]) if len(cuts) else 0, 2 * width
                if not at:
                    break
                yield data[:at], bounds[:0]
                data, bounds = data[at:], np.array([0, len(data) - at])
            yield data, bounds[1:]

    def _encode(self, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of ``data``, where texts end at ``last``."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(last), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[self.split(data)] = True
        edge[0] = edge[last] = edge[-1] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        key = self.words.part(self.words.sums(data), starts, ends, 1) ^ (ends - starts).astype(np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        if not self._alike(data, starts, ends, first[which]):
            first = which = np.arange(len(starts))  # two fragments share a key: each is looked up by its bytes
        raw = data.tobytes()
        own = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self._learn(own)
        codes = list(map(self.known.__getitem__, own))
        size = np.array([len(c) for c in codes], np.int64) // 4
        flat, offset = np.frombuffer(b"".join(codes), np.int32), np.cumsum(size) - size
        counts = size[which]
        total = np.cumsum(counts)
        if not len(total) or not total[-1]:
            return np.empty(0, np.int32), np.zeros(len(last), np.int64)
        take = np.repeat(offset[which] - (total - counts), counts) + np.arange(total[-1])
        by_text = np.concatenate(([0], total))[np.searchsorted(at, last)]
        return flat[take], np.diff(by_text, prepend=0)

    @staticmethod
    def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> bool:
        """Whether each fragment equals the one that stands for it."""
        if not (ends - starts == (ends - starts)[first]).all():
            return False
        there = np.repeat(starts[first] - starts, ends - starts) + np.arange(len(data))
        return bool((data[there] == data).all())

    def _learn(self, own: list[bytes]) -> None:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        known = self.known
        fresh = [f for f in dict.fromkeys(own) if f not in known]
        for group in _groups(fresh):
            for f, e in zip(group, self.many([f.decode() for f in group], add_special_tokens=False), strict=True):
                known[f] = array("i", e.ids).tobytes()
                self.held += len(f) + len(known[f]) + 200


def _groups(fragments: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of fragments with about ``most`` bytes."""
    group, size = [], 0
    for f in fragments:
        group.append(f)
        size += len(f)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _listed(ids: np.ndarray, ends: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def _encoder(path: str):
    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(path)
        for whole in batches:
            for batch in steps(whole, "text", STEP, 256):
                keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*keep, _listed(*encoder(batch.column("text")))], names=[*names, "ids"])

    return encode


def _decoder(path: str):
    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = pa.array(token_bytes(path), pa.large_binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield batch.append_column("decoded", _texts(batch.column("ids"), table))

    return decode


def _texts(ids, table):
    """The text of each list of ``ids``: one gather of the tokens' bytes, cut at the lists' ends."""
    import numpy as np
    import pyarrow as pa

    ends = ids.offsets.to_numpy()
    tokens = table.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
    if tokens.null_count:
        raise ValueError("ids hold nulls")
    at = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][ends - ends[0]] if len(tokens) else np.zeros(len(ends), np.int64)
    raw = bytes(memoryview(tokens.buffers()[2])[at[0] : at[-1]]) if at[-1] > at[0] else b""
    bounds = at - at[0]
    parts = [None if null else raw[a:b] for a, b, null in zip(bounds[:-1], bounds[1:], ids.is_null().to_pylist(), strict=True)]
    return pa.array([None if p is None else p.decode("utf-8", "replace") for p in parts], pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, as the tokenizers library gives them without special tokens added.

    Texts are cut at forced boundaries (:class:`Splitter`), the fragments are encoded independently and
    remembered, and their ids concatenated; a text without a blank is cut too, wherever two of its bytes are side
    by side in no token. A null text counts as empty and has no ids; rows keep their order and number. ``path`` names
    the vocabulary file, which every executor must be able to read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(path or default_path()), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the text of each list of ids; ids that form no valid UTF-8 give U+FFFD, null gives null."""
    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    out = rows.mapInArrow(_decoder(path or default_path()), "id long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def _digester(path: str):
    """(id, number of ids, digest of the ids, digest of the decoded text) in one worker: ids are decoded where they are made."""

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        encoder, table = Encoder(path), pa.array(token_bytes(path), pa.large_binary())
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for whole in batches:
            for batch in steps(whole, "text", STEP, 256):
                ids, ends = encoder(batch.column("text"))
                decoded = _texts(_listed(ids, ends), table).to_pylist()
                own = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([sha(",".join(map(str, x)).encode()) for x in own], pa.string()),
                        pa.array([sha(t.encode()) for t in decoded], pa.string()),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return read


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip: what :func:`encode` and :func:`decode` give, in one pass.

    A null text counts as empty; ids and other columns of ``docs`` play no part, and repeated rows each get a row.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_digester(path or default_path()), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", "doc_id")
