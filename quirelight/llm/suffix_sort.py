"""Suffix sorting of byte segments in one task, in two stages, and what it shows to repeat.

Stage one sorts directly only the suffixes that are smaller than their successors (type
S); stage two induces the others (type L) by scanning the buckets of first bytes from
left to right: whatever precedes a suffix just passed and is of type L comes next in its
own bucket. Common prefixes of neighbours then tell which strings occur twice.

The array is sparse: it holds the starts of whole windows, and behind the last of them
as many positions as it takes to reach one of type S. Order is by the first ``length``
bytes, which is all that the common prefixes are asked for.
"""

from __future__ import annotations

import numpy as np

_END = b"\xff"  # in no UTF-8 text; above all its bytes, so a segment's last suffix is of type S


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor. The last byte must be _END."""
    n = len(s)
    at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where equal bytes end
    at = np.minimum(at, n - 2)
    return np.append(s[at] < s[at + 1], True)


def sparse_suffix_array(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(starts in order, base of each segment, buffer): starts of all strings of
    ``length`` bytes within segments, sorted."""
    buffer = _END.join(segments) + _END * (length + 8)
    s = np.frombuffer(buffer, np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = np.maximum(sizes - length + 1, 0)
    small = _types(s)
    valid = np.zeros(len(s) + 1, np.int8)
    has = windows > 0
    np.add.at(valid, base[has], 1)
    np.add.at(valid, (base + windows)[has], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    next_small = np.minimum.accumulate(np.where(small, np.arange(len(s)), len(s))[::-1])[::-1]
    taken = valid.copy()
    for a, b in zip((base + windows)[has], next_small[(base + windows - 1)[has]]):  # up to a suffix of type S
        taken[a : b + 1] = True

    direct = np.flatnonzero(taken & small)
    direct = direct[np.argsort(s[direct], kind="stable")]
    of_small: list[list[int]] = []
    for part in np.split(direct, np.searchsorted(s[direct], np.arange(1, 256))):  # by first byte, so that few keys are held at a time
        mine = part.tolist()
        mine.sort(key=lambda i: buffer[i : i + length])
        of_small.append(mine)
    large = (taken & ~small).astype(np.uint8).tobytes()
    of_large: list[list[int]] = [[] for _ in range(256)]
    order: list[int] = []
    for c in range(256):
        mine = of_large[c]
        for i in mine:  # grows meanwhile
            if large[i - 1] and i:
                of_large[buffer[i - 1]].append(i - 1)
        order += mine
        for i in of_small[c]:
            if large[i - 1] and i:
                of_large[buffer[i - 1]].append(i - 1)
        order += of_small[c]
        of_large[c] = of_small[c] = []
    found = np.array(order, np.int64)
    return found[valid[found]] if len(found) else found, base, buffer


def common_prefixes(order: np.ndarray, buffer: bytes, most: int) -> np.ndarray:
    """Of each start and the one before it, the common prefix's bytes, ``most`` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    left = np.arange(1, len(order))
    for at in range(0, most, 8):
        x = words[order[left] + at] ^ words[order[left - 1] + at]
        ended = x != 0
        low = x[ended]
        zeros = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        out[left[ended]] = at + zeros
        left = left[~ended]
    out[left] = most
    return np.minimum(out, most)


def repeated_starts(segments: list[bytes], document: np.ndarray, begin: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each string of ``length`` bytes that starts in two places or
    more. A place is (document, begin of the segment + offset), so that segments of one
    document may overlap; a segment of more than one copy has all its strings twice."""
    order, base, buffer = sparse_suffix_array(segments, length)
    if not len(order):
        return order, order
    same = common_prefixes(order, buffer, length) >= length
    segment = np.searchsorted(base, order, "right") - 1
    offset = order - base[segment]
    first = np.flatnonzero(~same)
    place_d, place_o = document[segment], begin[segment] + offset
    differ = copies[segment] > 1
    differ[1:] |= same[1:] & ((place_d[1:] != place_d[:-1]) | (place_o[1:] != place_o[:-1]))
    again = np.logical_or.reduceat(differ, first)
    again = np.repeat(again, np.diff(np.append(first, len(order))))
    return segment[again], offset[again]
