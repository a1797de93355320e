"""Hashes of the words of a text, computed for the whole text at once."""

from __future__ import annotations

from pastward.llm.shared import SPACES


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, lower-cased in A-Z; the same in every process."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        self.np = np
        draw = np.random.Generator(np.random.PCG64(20240229))
        self.of_byte = draw.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES.encode())] = True
        self.base = np.uint64(self.BASE)
        self._grow(1 << 14)

    def _grow(self, size: int) -> None:
        np = self.np
        inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]), dtype=np.uint64)

    def mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def __call__(self, text: str | None):
        np = self.np
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        gap = self.space[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.of_byte[data] * self.up[:len(data)], dtype=np.uint64)])
        return self.mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_hasher: list[WordHasher] = []


def hasher() -> WordHasher:
    """The hasher of this worker process."""
    if not _hasher:
        _hasher.append(WordHasher())
    return _hasher[0]
