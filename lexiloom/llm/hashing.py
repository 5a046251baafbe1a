"""Hashes of words and shingles of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

from lexiloom.llm.common import WORD_BYTES

#: Bytes hashed together; longer texts are hashed in parts cut between words.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, base in enumerate((_BASE, np.uint64(inverse))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any substrings of one byte array, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _parts(raw: bytes) -> list[bytes]:
    """A long normalised text cut at spaces."""
    out, at = [], 0
    while len(raw) - at > CHUNK:
        cut = raw.rfind(b" ", at, at + CHUNK)
        if cut <= at:
            cut = raw.find(b" ", at + CHUNK)
            if cut < 0:
                break
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and offsets of each text's words (one more than texts)."""
    found, counts = [], np.zeros(len(raws), np.int64)
    todo: list[tuple[int, bytes]] = []
    waiting = 0

    def flush() -> None:
        if not todo:
            return
        joined = np.frombuffer(b" ".join(p for _, p in todo) + b" ", np.uint8)
        is_word = joined != 32
        edge = np.flatnonzero(np.diff(is_word, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        found.append(Rolling(joined).of(starts, ends))
        bounds = np.cumsum([len(p) + 1 for _, p in todo])
        own = np.diff(np.searchsorted(starts, bounds), prepend=0)
        np.add.at(counts, [i for i, _ in todo], own)
        todo.clear()

    for i, raw in enumerate(raws):
        for part in _parts(raw.translate(WORD_BYTES)):
            todo.append((i, part))
            waiting += len(part) + 1
            if waiting > CHUNK:
                flush()
                waiting = 0
    flush()
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words; of all words, if there are fewer but some."""
    size = min(n, len(hashes))
    if not size:
        return hashes
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : len(hashes) - size + 1 + k]
    return mix(total)


def window_hashes(rolling: Rolling, size: int) -> np.ndarray:
    """Hashes of all substrings of one length, by start."""
    n = len(rolling.sums) - size
    return mix((rolling.sums[size:] - rolling.sums[:n]) * rolling.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
