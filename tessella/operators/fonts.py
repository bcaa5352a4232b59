"""Patching of font members: glyph metadata are merged or replaced, and the atlas redrawn, grown or rebuilt."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..codecs import archive, font
from .patching import PatchError


@dataclass
class Glyph:
    codepoint: int
    position: tuple[int, int] | None = None
    size: tuple[int, int] | None = None
    kerning: tuple[int, int, int] | None = None
    alpha: bytes | None = None


@dataclass
class FontPatch:
    replace: bool = False
    atlas: tuple[int, int] | None = None
    name: str | None = None
    glyphs: list[Glyph] = field(default_factory=list)


COUNTERS = ("font_glyphs_added", "font_glyphs_changed", "font_glyphs_removed", "font_atlas_writes", "font_atlas_grows", "font_atlas_replaces")


def merge_glyphs(old: list[tuple], patches: list[Glyph], count: dict[str, int]) -> list[tuple]:
    """Upsert by code point; what a new glyph doesn't say is 0."""
    glyphs = {g[0]: g for g in old}
    for p in patches:
        before = glyphs.get(p.codepoint)
        x, y, w, h, *kern = before[1:] if before else (0,) * 7
        after = (p.codepoint, *(p.position or (x, y)), *(p.size or (w, h)), *(p.kerning or kern))
        if before is None:
            count["font_glyphs_added"] += 1
        elif after != before:
            count["font_glyphs_changed"] += 1
        glyphs[p.codepoint] = after
    return list(glyphs.values())


def find_glyph_block(blocks: list[font.Block]) -> font.Block | None:
    """The first resource block that holds a glyph table: at the top, or right under a texture block."""
    for b in blocks:
        for c in [b] if b.rsi else b.children if b.txr else []:
            if c.rsi and c.rsi["data"].startswith(b"SpFt"):
                return c
    return None


def target_extent(patch: FontPatch, width: int, height: int) -> tuple[int, int]:
    if patch.atlas is None:
        return width, height
    if patch.atlas[0] != width:
        raise PatchError(f"ATLAS_WIDTH: {patch.atlas[0]} instead of {width}")
    if not patch.replace and patch.atlas[1] < height:
        raise PatchError(f"ATLAS_SHRINK: {patch.atlas[1]} below {height}")
    if patch.replace and not patch.atlas[1]:
        raise PatchError("ATLAS_GEOMETRY: no height")
    return patch.atlas


def patch_font(spc: archive.Spc, member: str, patch: FontPatch, count: dict[str, int]) -> None:
    """Changes a font member, and the resource member that holds its pixels, in place."""
    index = {m.name: m for m in spc.members}  # of members with one name the last
    target = index[member.encode()]
    blocks = font.read_srd(target.data)
    holder = find_glyph_block(blocks)
    if holder is None:
        raise PatchError(f"NO_GLYPHS: {member}")
    table = font.read_spft(holder.rsi["data"])
    table.name = patch.name if patch.name is not None else table.name
    if patch.replace:
        count["font_glyphs_removed"] += len(table.glyphs)
        table.glyphs = []
    table.glyphs = merge_glyphs(table.glyphs, patch.glyphs, count)
    holder.rsi["data"] = font.write_spft(table)
    if patch.replace or patch.atlas or any(g.alpha is not None for g in patch.glyphs):
        _patch_atlas(spc, blocks, holder, member, patch, count)
    target.data = font.write_srd(blocks)


def _patch_atlas(spc: archive.Spc, blocks: list[font.Block], holder: font.Block, member: str, patch: FontPatch, count: dict[str, int]) -> None:
    texture = next((b.txr for b in blocks if b.txr), None)
    if texture is None:
        raise PatchError(f"ATLAS_GEOMETRY: {member} has no texture")
    width, height = texture["width"], texture["height"]
    to_width, to_height = target_extent(patch, width, height)
    drawn = [g for g in patch.glyphs if g.alpha is not None]
    if not patch.replace and to_height == height and not drawn:
        return
    name = member[:-4] if member.lower().endswith((".stx", ".srd")) else member
    sidecar = next((m for m in spc.members if m.name == f"{name}.srdv".encode()), None)
    if sidecar is None:
        raise PatchError(f"NO_SIDECAR: {name}.srdv")
    for g in drawn:
        w, h = g.size or (0, 0)
        if len(g.alpha) != w * h:
            raise PatchError(f"GLYPH_SIZE: U+{g.codepoint:04X} has {len(g.alpha)} pixels of {w} x {h}")
        x, y = g.position or (0, 0)
        if x + w > to_width or y + h > to_height:
            raise PatchError(f"GLYPH_OVERFLOW: U+{g.codepoint:04X}")
    pixels = np.zeros((to_height, to_width), np.uint8)
    if patch.replace:
        count["font_atlas_replaces"] += 1
    else:
        kind = texture["format"]
        need = {font.BC4: width // 4 * 8 * -(-height // 4), font.ARGB: width * height * 4}.get(kind)
        if need is None:
            raise PatchError(f"ATLAS_FORMAT: {kind:#x}")
        if len(sidecar.data) != need:
            raise PatchError(f"ATLAS_GEOMETRY: {len(sidecar.data)} bytes of {need}")
        pixels[:height] = np.frombuffer(font.decode_atlas(kind, sidecar.data, width, height), np.uint8).reshape(height, width)
        count["font_atlas_grows"] += to_height > height
    for g in drawn:
        font.blit(pixels, *(g.position or (0, 0)), np.frombuffer(g.alpha, np.uint8).reshape(g.size[1], g.size[0]))
        count["font_atlas_writes"] += 1
    sidecar.data = font.encode_argb(pixels.tobytes())
    entry = next((e for e in holder.rsi["info"] if len(e) > 1 and e[0] & font.IN_SRDV), None)
    if entry is None:
        raise PatchError(f"NO_RESOURCE_ENTRY: {member}")
    entry[1] = len(sidecar.data)
    texture["format"], texture["height"] = font.ARGB, to_height


def png_alpha(raw: bytes) -> tuple[int, int, bytes]:
    """(width, height, alpha) of a PNG of 8 bits a channel; images without transparency are opaque."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise PatchError("BAD_IMAGE: no PNG")
    at, data, head, clear = 8, b"", None, b""
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        elif kind == b"tRNS":
            clear = body
    if head is None or head[2] != 8 or head[6]:
        raise PatchError("BAD_IMAGE: only 8-bit images without interlace")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        rows = zlib.decompress(data)
    except zlib.error as e:
        raise PatchError(f"BAD_IMAGE: {e}") from None
    stride, above, out = width * channels, bytearray(width * channels), []
    if len(rows) < height * (stride + 1):
        raise PatchError("BAD_IMAGE: pixels are missing")
    for y in range(height):
        kind, line = rows[y * (stride + 1)], bytearray(rows[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for i in range(stride):
            a, b = line[i - channels] if i >= channels else 0, above[i]
            c = above[i - channels] if i >= channels else 0
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind]
            line[i] = (line[i] + near) & 0xFF
        out.append(bytes(line))
        above = line
    flat = b"".join(out)
    if head[3] in (4, 6):
        return width, height, flat[channels - 1 :: channels]
    if head[3] == 3 and clear:
        table = clear.ljust(256, b"\xff")
        return width, height, flat.translate(table)
    return width, height, b"\xff" * (width * height)
