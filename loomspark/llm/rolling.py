"""Vectorised hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base, its inverse modulo 2**64, and the multipliers of a 64-bit mixing function.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column one after the other, and the borders of its texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8, offsets[-1] - offsets[0], offsets[0]) if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ranges_of(borders: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts between borders that hold about ``most`` bytes each, one text at least."""
    out, start, n = [], 0, len(borders) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(borders, borders[start] + most, "right")) - 1)
        out.append((start, stop))
        start = stop
    return out


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of text each, one row at least."""
    return ranges_of(flat(texts)[1], most)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


class Spans:
    """Hashes of any spans of a byte string: sums of bytes times powers of the base, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        sizes = (stops - starts).astype(np.uint64)
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts] + sizes * MIX_2)


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the runs without ASCII white space, and the number of the first word of each text (one more at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACES[data]
    change = solid[1:] != solid[:-1]
    starts_at, stops_at = change & solid[1:], change & solid[:-1]
    inner = borders[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[solid[inner] & solid[inner + 1]]
    starts_at[both] = True
    stops_at[both] = True
    starts, stops = np.flatnonzero(starts_at), np.flatnonzero(stops_at)
    return starts, stops, np.searchsorted(starts, borders)
