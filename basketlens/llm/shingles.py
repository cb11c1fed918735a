"""Sets of 5-word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import LOWER

GAP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier
TURN = np.uint64(0xD6E8FEB86659FD93)  # fixed value: odd multiplier


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; equal numbers stay equal, different ones different."""
    x = (x ^ (x >> np.uint64(32))) * TURN
    x = (x ^ (x >> np.uint64(29))) * TURN
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Shingle sets of texts; word hashes are kept for the task."""

    def __init__(self, size: int = 5, cached: int = 100_000):
        self.size, self.cached, self.known = size, cached, {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        return [self.of(t) for t in texts]

    def of(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest
        words = text.encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.cached:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        size = min(self.size, len(h))
        total = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = mix(total * GAP + h[k:len(h) - size + 1 + k])
        return np.unique(total)


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set, as a signed number; sets with equal shingles have equal names."""
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
