"""Compressed presence bitmaps over shared key ordinals."""

from __future__ import annotations

import numpy as np

#: Ordinals of one container, and the count from which it is kept as bits.
SPAN = 1 << 16
DENSE = 4096


class PresenceBitmap:
    """A set of ordinals, by container of 65,536: sorted 16-bit offsets where few, packed bits where many."""

    def __init__(self, containers: dict[int, np.ndarray]):
        self.containers = containers

    @classmethod
    def of(cls, ordinals: np.ndarray) -> PresenceBitmap:
        """The set of the given ordinals, in any order, repeats allowed."""
        ordinals = np.unique(np.asarray(ordinals, dtype=np.int64))
        high = ordinals >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(p[0] >> 16): cls._pack((p & 0xFFFF).astype(np.uint16)) for p in np.split(ordinals, cuts) if len(p)})

    @staticmethod
    def _pack(offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < DENSE:
            return offsets
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[offsets] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(container: np.ndarray | None) -> np.ndarray:
        if container is None:
            return np.zeros(SPAN // 8, dtype=np.uint8)
        if container.dtype == np.uint8:
            return container
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[container] = 1
        return np.packbits(bits)

    def _with(self, other: PresenceBitmap, operation, keys) -> PresenceBitmap:
        out = {}
        for k in keys:
            offsets = np.flatnonzero(np.unpackbits(operation(self._bits(self.containers.get(k)), self._bits(other.containers.get(k)))))
            if len(offsets):
                out[k] = self._pack(offsets.astype(np.uint16))
        return PresenceBitmap(out)

    def and_not(self, other: PresenceBitmap) -> PresenceBitmap:
        """Ordinals here and not there."""
        return self._with(other, lambda a, b: a & ~b, self.containers)

    def intersect(self, other: PresenceBitmap) -> PresenceBitmap:
        """Ordinals in both."""
        return self._with(other, np.bitwise_and, self.containers.keys() & other.containers.keys())

    def to_array(self) -> np.ndarray:
        """The ordinals, ascending."""
        parts = [np.flatnonzero(np.unpackbits(self._bits(c))) + (k << 16) for k, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
