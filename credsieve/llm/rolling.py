"""Content-defined anchors: the same choice of positions wherever the same content stands.

A window of ``length`` symbols holds a fixed number of grams of ``gram`` symbols; its anchor
is the gram with the smallest hash, the leftmost of equal ones.  Two windows with equal
content therefore have equal anchors at equal offsets, so windows need to be compared only
with windows of the same anchor gram.  Neighbouring windows mostly share their anchor,
which leaves about 2 / (number of grams + 1) anchors per symbol.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
# Windows looked at together; bounds the memory whatever the length of a text.
BLOCK_BITS = 17
BLOCK = 1 << BLOCK_BITS
_LOW = np.uint64((1 << (BLOCK_BITS + 1)) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(MULTIPLIER), of(INVERSE)


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive values (unsigned 64-bit numbers, at most BLOCK-sized)."""
    up, down = _powers(1 << max(10, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    n = len(values) - gram + 1
    return mix((sums[gram:] - sums[:n]) * down[:n])


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(values: np.ndarray, gram: int, length: int):
    """(position, low, high, hash) arrays: windows starting at position - s for s in
    low..high have their anchor at ``position``, whose gram has that hash."""
    out = ([], [], [], [])
    width = length - gram + 1
    windows = len(values) - length + 1
    for low in range(0, windows, BLOCK):
        part = values[low : min(len(values), low + BLOCK + length - 1)]
        hashes = gram_hashes(part, gram)
        index = np.arange(len(hashes), dtype=np.uint64)
        least = _window_minima((hashes & ~_LOW) | index, width)
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        spot = at[first]
        out[0].append(spot + low)
        out[1].append(spot - last)
        out[2].append(spot - first)
        out[3].append(hashes[spot].view(np.int64))
    if not out[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in out)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def byte_values(data: bytes) -> np.ndarray:
    return _byte_values()[np.frombuffer(data, np.uint8)]


def byte_anchors(data: bytes, gram: int, length: int):
    """``anchors`` of a byte string, a slice at a time."""
    out = ([], [], [], [])
    raw = np.frombuffer(data, np.uint8)
    windows = len(raw) - length + 1
    table = _byte_values()
    for low in range(0, windows, BLOCK):
        part = table[raw[low : min(len(raw), low + BLOCK + length - 1)]]
        found = anchors(part, gram, length)
        out[0].append(found[0] + low)
        for kept, new in zip(out[1:], found[1:]):
            kept.append(new)
    if not out[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in out)
