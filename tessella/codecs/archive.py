"""Archives of compressed members (SPC)."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import lzss
from .binary import Buffer, Cursor, Malformed

STORED, PACKED = 1, 2


@dataclass
class Member:
    name: bytes
    flag: int
    unknown: int
    data: bytes


@dataclass
class Spc:
    unknown1: bytes = bytes(36)
    unknown2: int = 0
    members: list[Member] = field(default_factory=list)

    def get(self, name: str) -> Member | None:
        """The first member of a name; names that are no UTF-8 never match."""
        return next((m for m in self.members if m.name == name.encode()), None)


def read_spc(data: bytes) -> Spc:
    c = Cursor(data)
    if data[:4] == b"$CMP":
        raise Malformed(0, "the $CMP variant is not supported")
    c.magic(b"CPS.")
    a = Spc(c.take(36))
    count, a.unknown2 = c.unpack("<II")
    c.skip(16)
    c.magic(b"Root")
    c.skip(12)
    for _ in range(count):
        flag, unknown, size, full, length = c.unpack("<hhiii")
        c.skip(16)
        name = c.take(length)
        if c.take(1) != b"\0":
            raise Malformed(c.at - 1, "a name without its final zero")
        c.skip(-(length + 1) % 16)
        raw = c.take(size)
        if flag == STORED:
            if size != full:
                raise Malformed(c.at, f"a stored member of {size} bytes that declares {full}")
        elif flag == PACKED:
            raw = lzss.decompress(raw, full)
        else:
            raise Malformed(c.at, f"unknown compression flag {flag}")
        c.skip(-size % 16)
        a.members.append(Member(name, flag, unknown, raw))
    return a


def write_spc(a: Spc) -> bytes:
    if len(a.unknown1) != 36:
        raise Malformed(4, f"{len(a.unknown1)} header bytes instead of 36")
    b = Buffer(b"CPS." + a.unknown1)
    b.put("<II16x", len(a.members), a.unknown2)
    b += b"Root" + bytes(12)
    for m in a.members:
        if m.flag not in (STORED, PACKED):
            raise Malformed(len(b), f"unknown compression flag {m.flag}")
        raw = lzss.compress(m.data) if m.flag == PACKED else m.data
        b.put("<hhiii16x", m.flag, m.unknown, len(raw), len(m.data), len(m.name))
        b += m.name + b"\0"
        b.pad(16)
        b += raw
        b.pad(16)
    return bytes(b)
