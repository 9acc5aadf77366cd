"""MD5 of many short texts at once, by numpy: the bits that ``operators.resampling.draw`` takes, without a call for each draw."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: What ends a message; texts carry it, so none ends in a zero byte.
END = b"\x80"

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_SHIFTS = np.array([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], np.uint32)


def _block(state: Sequence[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The states after a block of sixteen words each."""
    a, b, c, d = (x.copy() for x in state)
    mixed, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            word = i
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            word = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            word = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            word = 7 * i % 16
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        mixed += a
        mixed += words[word]
        mixed += _SINES[i]
        shift = _SHIFTS[i // 16, i % 4]
        np.left_shift(mixed, shift, out=turned)
        mixed >>= np.uint32(32) - shift
        mixed |= turned
        mixed += b
        a, b, c, d, mixed = d, mixed, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def first_bits(texts: np.ndarray) -> np.ndarray:
    """The first 52 bits (13 hex digits) of the MD5 of each text of an array of bytes; every text has ``END`` behind it."""
    sizes = np.strings.str_len(texts) - 1
    blocks = (sizes + 8) // 64 + 1
    most = int(blocks.max(initial=1))
    words = texts.astype(f"S{64 * most}").view("<u4").reshape(len(texts), 16 * most)
    words[np.arange(len(texts)), 16 * blocks - 2] = 8 * sizes
    words = np.ascontiguousarray(words.T).astype(np.uint32, copy=False)
    state = [np.full(len(texts), x, np.uint32) for x in _START]
    for i in range(most):
        after = _block(state, words[16 * i : 16 * i + 16])
        state = [np.where(i < blocks, new, old) for new, old in zip(after, state, strict=True)]
    return (state[0].byteswap().astype(np.int64) << 20) | (state[1].byteswap() >> np.uint32(12))
