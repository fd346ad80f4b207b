"""Words of many texts at once, named by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .suffix_dedup import Names

_U = np.uint64
#: Bytes of text tokenised at a time.
CHUNK_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words [^\\x20\\x09-\\x0D]+.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def groups(texts: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts in groups of about CHUNK_BYTES; a longer text is a group of its own."""
    numbers: list[int] = []
    size = 0
    for i, view in enumerate(texts):
        if numbers and size + len(view) > CHUNK_BYTES:
            yield numbers, [texts[k] for k in numbers]
            numbers, size = [], 0
        numbers.append(i)
        size += len(view) + 1
    if numbers:
        yield numbers, [texts[k] for k in numbers]


class Words:
    """Words of some texts: text number, name, and where they lie in the lower-cased bytes."""

    def __init__(self, numbers: list[int], texts: list[np.ndarray], letters: np.ndarray):
        gap = np.full(1, 32, np.uint8)
        self.data = LOWER[np.concatenate([x for t in texts for x in (t, gap)])] if texts else np.empty(0, np.uint8)
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        at = 0
        while at < len(self.data):  # part by part, so that a long text needs little room
            end = self._cut(at + CHUNK_BYTES, letters)
            part = self.data[at:end]
            step = np.diff(np.concatenate([[False], letters[part], [False]]).view(np.int8))
            starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            found.append((starts + at, ends + at, Names(part).at(starts, ends - starts)))
            at = end
        self.starts, self.ends, self.names = (np.concatenate(x) for x in zip(*found, strict=True))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.asarray(numbers, np.int64)[np.searchsorted(bounds, self.starts, "right")]

    def _cut(self, end: int, letters: np.ndarray) -> int:
        """The next place outside a word."""
        while end < len(self.data):
            look = letters[self.data[end : end + 4096]]
            if not look.all():
                return end + int(np.argmin(look))
            end += len(look)
        return len(self.data)

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(text number, first word, end) of each text that has words."""
        edges = [0, *(np.flatnonzero(np.diff(self.text)) + 1).tolist(), len(self.text)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield int(self.text[lo]), lo, hi

    def string(self, lo: int, hi: int) -> str:
        """Words lo to hi, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)).decode("utf-8", "replace")


def shingle_names(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of ``size`` words."""
    n = len(names) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = names[:n].copy()
    for k in range(1, size):
        out *= _U(0xD1342543DE82EF95)
        out += names[k : k + n]
    return mix(out + _U(size))
