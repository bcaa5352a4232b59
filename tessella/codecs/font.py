"""Block trees (SRD), glyph tables (SpFt) and their textures."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from .binary import Buffer, Cursor, Malformed, align_up, utf16

IN_SRDI, IN_SRDV, OFFSET = 0x20000000, 0x40000000, 0x1FFFFFFF
LAST_READ = 0xD800
TXR = ("unknown_10", "swizzle", "width", "height", "scanline", "format", "unknown_1d", "palette", "palette_id")
RSI = ("unknown_10", "unknown_11", "unknown_12", "fallback_count", "count", "fallback_size", "size", "unknown_1a")
BC4, ARGB = 0x16, 0x01


@dataclass
class Block:
    magic: bytes
    unknown_0c: int = 0
    data: bytes = b""
    children: list["Block"] = field(default_factory=list)
    txr: dict | None = None
    rsi: dict | None = None


def read_srd(data: bytes) -> list[Block]:
    blocks, c = [], Cursor(data)
    while c.at < len(data):
        magic = c.take(4)
        size, sub, unknown = c.unpack(">III")
        body = c.take(size)
        c.align(16)
        children = read_srd(c.take(sub))
        c.align(16)
        b = Block(magic, unknown, body, children)
        if (magic, size, unknown) in ((b"$CFH", 0, 1), (b"$CT0", 0, 0)):
            if children:
                raise Malformed(c.at, f"{magic.decode()} with blocks in it")
        elif magic == b"$TXR" and not unknown:
            b.txr, b.data = dict(zip(TXR, Cursor(body).unpack("<i4H4B"))), b""
        elif magic == b"$RSI" and not unknown:
            b.rsi, b.data = _read_rsi(body), b""
        blocks.append(b)
    return blocks


def _read_rsi(body: bytes) -> dict:
    c = Cursor(body)
    r = dict(zip(RSI, c.unpack("<4B4h")))
    strings = c.unpack("<i")
    count, size = r["count"] or r["fallback_count"], r["size"] or r["fallback_size"]
    if count < 0 or size < 0 or size % 4:
        raise Malformed(0, f"{count} resource entries of {size} bytes")
    r["info"] = [list(struct.unpack(f"<{size // 4}I", c.take(size))) for _ in range(count)]
    if not c.at <= strings <= len(body):
        raise Malformed(12, f"strings at {strings:#x}")
    r["data"] = c.take(strings - c.at)
    rest = c.take(len(body) - strings)
    if rest and rest[-1]:
        raise Malformed(strings, "unterminated resource string")
    r["strings"] = rest.split(b"\0")[:-1]
    return r


def write_srd(blocks: list[Block]) -> bytes:
    b = Buffer()
    for k in blocks:
        body = Buffer(k.data)
        if k.txr is not None:
            body.put("<i4H4B", *(k.txr[n] for n in TXR))
        elif k.rsi is not None:
            if k.rsi["size"] % 4:
                raise Malformed(0, f"resource entries of {k.rsi['size']} bytes")
            body.put("<4B4h4x", *(k.rsi[n] for n in RSI))
            for entry in k.rsi["info"]:
                body.put(f"<{len(entry)}I", *entry)
            body += k.rsi["data"]
            body.patch(12, "<i", len(body))
            body += b"".join(s + b"\0" for s in k.rsi["strings"])
        sub = write_srd(k.children)
        b += k.magic
        b.put(">III", len(body), len(sub), k.unknown_0c)
        b += body
        b.pad(16)
        b += sub
        b.pad(16)
    return bytes(b)


def flatten(blocks: list[Block]) -> list[dict]:
    """The tree as rows, parents before children: node, parent (-1 at the top), depth, ord among its siblings."""
    rows: list[dict] = []

    def walk(blocks: list[Block], parent: int, depth: int) -> None:
        for ord, b in enumerate(blocks):
            node = len(rows)
            rows.append({"node_id": node, "parent_id": parent, "depth": depth, "ord": ord, "magic": b.magic.decode("latin-1"), "unknown_0c": b.unknown_0c, "txr": b.txr, "rsi": b.rsi, "data": b.data})
            walk(b.children, node, depth + 1)

    walk(blocks, -1, 0)
    return rows


def unflatten(rows: list[dict]) -> list[Block]:
    made = {r["node_id"]: Block(r["magic"].encode("latin-1"), r["unknown_0c"], bytes(r["data"] or b""), [], r["txr"], r["rsi"]) for r in rows}
    top: list[Block] = []
    for r in sorted(rows, key=lambda r: (r["parent_id"], r["ord"])):
        (made[r["parent_id"]].children if r["parent_id"] >= 0 else top).append(made[r["node_id"]])
    return top


@dataclass
class Font:
    name: str
    unknown6: int = 6
    flags: int = 0
    scale: int = 0
    #: (codepoint, x, y, width, height, left, right, vertical kerning)
    glyphs: list[tuple[int, ...]] = field(default_factory=list)


def pack_xy(x: int, y: int) -> bytes:
    """Two 12-bit numbers in three bytes; larger ones are refused."""
    if not (0 <= x < 4096 and 0 <= y < 4096):
        raise Malformed(0, f"position ({x}, {y}) has no 12 bits")
    return bytes((x & 0xFF, (y & 15) << 4 | x >> 8, y >> 4))


def unpack_xy(raw: bytes) -> tuple[int, int]:
    return raw[0] | (raw[1] & 15) << 8, raw[1] >> 4 | raw[2] << 4


def read_spft(data: bytes) -> Font:
    c = Cursor(data)
    c.magic(b"SpFt")
    unknown6, flags, _, name_at, count, boxes_at, bits_at, index_at, scale, _ = c.unpack("<10I")
    if bits_at != 0x2C:
        raise Malformed(0x1C, f"bit flags at {bits_at:#x}")
    c.seek(bits_at)
    bits = np.frombuffer(c.take(-(-flags // 8)), np.uint8)
    chars = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    seen: dict[int, int] = {}
    c.seek(boxes_at)
    boxes = [c.take(8) for _ in range(count)]
    font = Font("", unknown6, flags, scale)
    for cp in chars[chars < LAST_READ].tolist():
        window = cp // 32 * 4
        i = Cursor(data)
        i.seek(index_at + window)
        at = i.unpack("<I") + seen.get(window, 0)
        seen[window] = seen.get(window, 0) + 1
        if at >= count:
            raise Malformed(boxes_at, f"glyph {at} of {count}")
        font.glyphs.append((cp, *unpack_xy(boxes[at]), *struct.unpack_from("<BBbbb", boxes[at], 3)))
    c.seek(name_at)
    font.name = c.cstring16()
    return font


def write_spft(f: Font) -> bytes:
    """Glyphs are sorted by code point, which must be unique and readable."""
    glyphs = sorted(f.glyphs)
    codes = [g[0] for g in glyphs]
    if len(set(codes)) < len(codes):
        raise Malformed(0, "a code point has two glyphs")
    if codes and not 0 <= codes[-1] < LAST_READ:
        raise Malformed(0, f"no reader takes code point {codes[-1]:#x}")
    flags = max([f.flags, *(c + 1 for c in codes[-1:])])
    bits = np.zeros(align_up(flags, 8), np.uint8)
    bits[codes] = 1
    index = bytearray(max([c // 32 * 4 for c in codes], default=0) + 4)
    for i in range(len(codes) - 1, -1, -1):  # the first glyph of a window is written last
        struct.pack_into("<I", index, codes[i] // 32 * 4, i)
    index_at = 0x2C + len(bits) // 8
    boxes_at = index_at + len(index)
    names_at = boxes_at + 8 * len(glyphs)
    b = Buffer(b"SpFt")
    b.put("<10I", f.unknown6, flags, len(utf16(f.name)) // 2, names_at + 16, len(glyphs), boxes_at, 0x2C, index_at, f.scale, names_at)
    b += np.packbits(bits, bitorder="little").tobytes() + index
    for _, x, y, *rest in glyphs:
        b += pack_xy(x, y)
        b.put("<BBbbb", *rest)
    b.put("<4I", *[names_at + 16] * 4)
    return bytes(b + utf16(f.name) + b"\0\0")


def bc4_size(width: int, height: int) -> int:
    return -(-width // 4) * -(-height // 4) * 8


def decode_bc4(data: bytes, width: int, height: int) -> bytes:
    """8 bytes hold 4 x 4 pixels: two end points and a 3-bit place on the ramp between them for each."""
    across, down = -(-width // 4), -(-height // 4)
    if len(data) < bc4_size(width, height):
        raise Malformed(0, f"{len(data)} bytes for {width} x {height}")
    pixels = decode_blocks(np.frombuffer(data, np.uint8, across * down * 8).reshape(-1, 8))
    return pixels.reshape(down, across, 4, 4).transpose(0, 2, 1, 3).reshape(down * 4, across * 4)[:height, :width].tobytes()


def decode_blocks(raw: np.ndarray) -> np.ndarray:
    """(blocks, 16) pixels of any number of BC4 blocks (blocks, 8)."""
    raw = raw.astype(np.int64)
    a, b = raw[:, 0], raw[:, 1]
    ramp = np.empty((len(raw), 8), np.int64)
    ramp[:, 0], ramp[:, 1] = a, b
    for i in range(2, 8):
        short = ((6 - i) * a + (i - 1) * b) // 5 if i < 6 else np.full(len(a), (i - 6) * 255)
        ramp[:, i] = np.where(a > b, ((8 - i) * a + (i - 1) * b) // 7, short)
    word = (raw[:, 2:] << np.arange(0, 48, 8)).sum(axis=1)
    return np.take_along_axis(ramp, word[:, None] >> np.arange(0, 48, 3) & 7, axis=1).astype(np.uint8)


def encode_argb(alpha: bytes) -> bytes:
    return np.repeat(np.frombuffer(alpha, np.uint8), 4).tobytes()


def decode_argb(data: bytes, width: int, height: int) -> bytes:
    if len(data) < width * height * 4:
        raise Malformed(0, f"{len(data)} bytes for {width} x {height}")
    return bytes(data[: width * height * 4 : 4])


def decode_atlas(format: int, data: bytes, width: int, height: int) -> bytes:
    if format == BC4:
        return decode_bc4(data, width, height)
    if format == ARGB:
        return decode_argb(data, width, height)
    raise Malformed(0, f"unknown texture format {format:#x}")


def blit(atlas: np.ndarray, x: int, y: int, glyph: np.ndarray) -> None:
    """Overwrites a part of the atlas."""
    h, w = glyph.shape
    if x < 0 or y < 0 or x + w > atlas.shape[1] or y + h > atlas.shape[0]:
        raise Malformed(0, f"a glyph of {w} x {h} at ({x}, {y}) leaves the atlas")
    atlas[y : y + h, x : x + w] = glyph
