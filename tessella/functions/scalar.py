"""Column expressions for paths, packed numbers and text encodings; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def split_path(path: Column) -> tuple[Column, Column]:
    """(directory, file): at the last slash; without one the directory is empty."""
    cut = F.length(path) - F.instr(F.reverse(path), "/")
    has = F.instr(path, "/") > 0
    return F.when(has, F.substring(path, F.lit(1), cut)).otherwise(""), F.when(has, F.substring(path, cut + 2, F.length(path))).otherwise(path)


def strict_path(path: Column) -> Column:
    """The path, or an error where it is absolute or has a backslash or an empty, `.` or `..` part."""
    bad = F.contains(path, F.lit("\\")) | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(bad, F.raise_error(F.concat(F.lit("UNSAFE_PATH: "), path)).cast("string")).otherwise(path)


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def utf16_bytes(text: Column) -> Column:
    """Bytes of a text in UTF-16."""
    return F.octet_length(F.encode(text, "UTF-16LE"))


def align_up(n: Column, to: int) -> Column:
    return n + F.pmod(F.lit(to) - n % F.lit(to), F.lit(to))


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    """Bytes of a trimmed even-length hex text; an error for any other."""
    raw = F.unhex(F.trim(text))
    bad = (F.length(F.trim(text)) % 2 != 0) | raw.isNull()
    return F.when(text.isNotNull() & bad, F.raise_error(F.concat(F.lit("BAD_HEX: "), text)).cast("binary")).otherwise(raw)


def pack_xy(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Two 12-bit numbers as three bytes."""
    return x.bitwiseAND(0xFF), F.shiftleft(y.bitwiseAND(15), 4).bitwiseOR(F.shiftright(x, 8).bitwiseAND(15)), F.shiftright(y, 4).bitwiseAND(0xFF)


def unpack_xy(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    return a.bitwiseOR(F.shiftleft(b.bitwiseAND(15), 8)), F.shiftright(b, 4).bitwiseAND(15).bitwiseOR(F.shiftleft(c, 4))


def sidecar_name(name: Column) -> Column:
    """The resource file that belongs to a font member."""
    return F.concat(F.regexp_replace(name, r"(?i)\.(stx|srd)$", ""), F.lit(".srdv"))


def char_matches(char: Column, codepoint: Column) -> Column:
    return (F.char_length(char) == 1) & (F.ascii(char) == codepoint)


def file_kind(path: Column, content: Column) -> Column:
    """Format of a file by its extension, and by its first bytes where that is shared."""
    magic = F.substring(content, 1, 4)
    at = lambda m: magic == F.lit(m)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(ext == "stx", F.when(at(b"STXT"), "stx").when(at(b"SpFt"), "spft").otherwise("srd"))
        .when(ext.isin("srd", "wrd", "dat", "spc", "cpk", "spft"), ext)
        .when(at(b"CPK "), "cpk").when(at(b"CPS."), "spc").when(at(b"STXT"), "stx").when(at(b"@UTF"), "utf").when(at(b"SpFt"), "spft").when(at(b"$CFH"), "srd")
    )


def same_bits(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def bc4_size(width: Column, height: Column) -> Column:
    """Bytes of an atlas: whole blocks across, begun ones down."""
    return F.floor(width / 4) * F.ceil(height / 4) * 8
