"""The archive members' LZSS codec: eight items to a flag byte, window 1024, matches of 2 to 65 bytes."""

from __future__ import annotations

import numpy as np

from .binary import Malformed

WINDOW, SHORTEST, LONGEST = 1024, 2, 65
#: Matches up to this size are found for all places of a piece at once, pieces (less than 1 << 20 with the window before them).
KNOWN, PIECE = 8, 1 << 18
#: Bit order of flag bytes is reversed.
REVERSED, BITS = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256)), tuple(1 << bit for bit in range(8))


def decompress(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        flags = REVERSED[data[at]]
        at += 1
        if flags == 0xFF:
            out += data[at : at + 8]
            at += 8
            continue
        for bit in BITS:
            if at >= end:
                break
            if flags & bit:
                out.append(data[at])
                at += 1
                continue
            if at + 2 > end:
                raise Malformed(at, "the stream ends within a back-reference")
            high = data[at + 1]
            count, source = (high >> 2) + SHORTEST, len(out) - WINDOW + (data[at] | (high & 3) << 8)
            at += 2
            if source < 0:
                raise Malformed(at, "a back-reference leaves the window")
            gap = len(out) - source  # 1 at least
            if gap >= count:
                out += out[source : source + count]
            else:  # the match runs into what it makes: its period repeats
                out += (bytes(out[source:]) * (count // gap + 1))[:count]
    if len(out) != size:
        raise Malformed(min(at, end), f"{len(out)} bytes came out, {size} were declared")
    return bytes(out)


def _matches(raw: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the size of its longest match within the window, `KNOWN` at most and 0 without any, and the nearest place of that match."""
    n, low20 = len(raw), np.uint64(0xFFFFF)
    size, where, code, gram = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64), raw.astype(np.uint64)
    place = np.arange(n)
    for k in range(SHORTEST, KNOWN + 1):
        place = place[place <= n - k]
        if k <= 4:
            gram = gram[:-1] << 8 | raw[k - 1 :]
            key = gram[place]
        else:  # two runs of 4 bytes cover k; one that is nowhere near has no code
            place = place[code[place + k - 4] > 0]
            key = code[place] << 20 | code[place + k - 4]
        if len(place) < 2:
            break
        key = key << 20 | place.astype(np.uint64)
        key.sort()
        place = (key & low20).astype(np.int64)
        key >>= 20
        same = key[1:] == key[:-1]
        near = same & (np.diff(place) <= WINDOW)
        own = place[1:][near]
        size[own], where[own] = k, place[:-1][near]
        keep = np.append(False, near)
        keep[:-1] |= near
        if k == 4:
            code[place[keep]] = np.cumsum(np.append(True, ~same))[keep]
        place = place[keep]
    return size.tolist(), where.tolist()


def compress(data: bytes) -> bytes:
    """Greedy longest matches, of equal ones the nearest. For longer ones than `KNOWN` the window is searched backwards for what the best so far doesn't reach."""
    data = bytes(data)
    n, out, at, find = len(data), bytearray(), 0, data.rfind
    raw, first, end, sizes, places = np.frombuffer(data, np.uint8), 0, 0, [], []
    while at < n:
        flags, block = 0, bytearray()
        for bit in range(8):
            if at >= n:
                break
            if at >= end:
                first, end = max(0, at - WINDOW), min(n, at + PIECE)
                sizes, places = _matches(raw[first : min(n, end + KNOWN)])
            size = sizes[at - first]
            if size:
                where = first + places[at - first]
                if size == KNOWN:
                    # a nearer place than the one found last matches no further than that one
                    most, low, place = min(LONGEST, n - at), max(0, at - WINDOW), where
                    while place >= 0:
                        where = place
                        while size < most and data[place + size] == data[at + size]:
                            size += 1
                        if size == most:
                            break
                        place = find(data[at : at + size + 1], low, place + size)
                        size += place >= 0
                word = WINDOW - (at - where) | size - SHORTEST << 10
                block.append(word & 0xFF)
                block.append(word >> 8)
                at += size
            else:
                flags |= 1 << bit
                block.append(data[at])
                at += 1
        out.append(REVERSED[flags])
        out += block
    return bytes(out)
