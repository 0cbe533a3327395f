"""Words and shingles of many texts at once, as 64-bit hashes, in NumPy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from longview.llm.common import ship

ship(__name__)

BASE = 0x2127599BF4325C37  # odd, so that it has an inverse modulo 2^64
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes handled at once; a longer text is handled alone.
STEP = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


class Words:
    """Hashes of the words (runs between space and \\x09-\\x0D, with A-Z lower-cased) of texts.

    A word's hash is a polynomial of random byte values modulo 2^64, read off running sums, so that the
    cost is a few vector operations per byte and does not depend on how many different words there are.
    """

    def __init__(self, blanks: bytes = SPACES):
        value = np.random.default_rng(20240601).integers(1, 2**64, 256, dtype=np.uint64)
        if blanks:  # without blanks to split at, bytes are told apart as they are
            for a in range(ord("A"), ord("Z") + 1):
                value[a] = value[a + 32]
        self.value, self.space = value, np.zeros(256, bool)
        self.space[list(blanks)] = True
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of each text's first word and the end), of texts data[bounds[i]:bounds[i+1]]."""
        starts, ends, total = self.spans(data, bounds)
        hashes = (total[ends] - total[starts]) * self.down[starts]
        return _mixed(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each word, its end, running sums) in bytes; see :meth:`part` for hashes."""
        n = len(data)
        self._powers(n + 1)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        blank = self.space[data]
        inside = ~blank
        edge = np.empty(n, bool)
        edge[:1], edge[1:] = True, blank[:-1]
        starts = np.flatnonzero(inside & (edge | fresh[:-1]))
        edge[-1:], edge[:-1] = True, blank[1:]
        ends = np.flatnonzero(inside & (edge | fresh[1:])) + 1
        return starts, ends, self.sums(data)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums, from which :meth:`part` reads hashes off."""
        n = len(data)
        self._powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.value[data] * self.up[:n], out=total[1:])
        return total

    def part(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the bytes from ``starts`` to ``ends``; ``salt`` tells kinds of parts apart."""
        return _mixed(((total[ends] - total[starts]) * self.down[starts]) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def slices(column, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of pieces of an Arrow string column, each about ``step`` bytes."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        end = min(end, len(column), at + 4096)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(column, width: int, words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence is one shingle if it is shorter."""
    for at, end, data, bounds in slices(column):
        h, first = words(data, bounds)
        m = len(h) - width + 1
        out = np.full(max(m, 0), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(width if m > 0 else 0):
            out = _mixed(out ^ h[k : k + m])
        for i in range(end - at):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                own = np.sort(out[a : b - width + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    one = _mixed(one ^ x)
                yield one
            else:
                yield np.empty(0, np.uint64)
