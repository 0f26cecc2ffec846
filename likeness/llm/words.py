"""Words of a pack as arrays: where they stand in its bytes, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

from likeness.llm.packs import Pack, mix

#: ASCII white space.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A table for ``bytes.translate`` that lower-cases A-Z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


_KEPT: dict = {}  # a task makes these arrays once


def _up_to(base: int, n: int) -> np.ndarray:
    """The powers of an odd number, at least ``n`` of them."""
    if base not in _KEPT or len(_KEPT[base]) < n:
        powers = np.full((int(n) // 2**16 + 1) * 2**16, base, "u8")
        powers[0] = 1
        _KEPT[base] = np.cumprod(powers, out=powers)
    return _KEPT[base]


def hashes_of(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial over the bytes of each stretch, scrambled."""
    raw = np.frombuffer(data, "u1")
    total = np.zeros(len(raw) + 1, "u8")
    terms = mix(np.arange(1, 257, dtype="u8"))[raw]
    terms *= _up_to(_ODD, len(raw))[: len(raw)]
    np.cumsum(terms, out=total[1:])
    return mix((total[end] - total[begin]) * _up_to(_INVERSE, len(raw) + 1)[begin])


class WordSpans:
    """``begin`` and ``end`` of each word in the pack's bytes; ``starts`` says where each document's words begin."""

    def __init__(self, pack: Pack, data: bytes | None = None):
        self.data = pack.data if data is None else data
        raw = np.frombuffer(self.data, "u1")
        n = len(raw)
        blank = np.zeros(256, bool)
        blank[list(SPACES)] = True
        word = ~blank[raw]
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = ~word[: n - 1]
        fresh[pack.starts] = True
        self.begin = np.flatnonzero(word & fresh[:n])
        ends = np.ones(n, bool)
        ends[: n - 1] = ~word[1:]
        ends |= fresh[1:]
        self.end = np.flatnonzero(word & ends) + 1
        self.starts = np.searchsorted(self.begin, pack.starts)

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        return hashes_of(self.data, self.begin, self.end)

    def join(self, a: int, b: int) -> bytes:
        """The words from ``a`` to ``b`` (exclusive), joined by one space. They are of one document."""
        return b" ".join(self.data[self.begin[a] : self.end[b - 1]].split()) if a < b else b""
