"""Self-describing tables (@UTF) and the archives built of them (CPK)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any

from .binary import Buffer, Cursor, Malformed, align_up

TYPES = ("u8", "s8", "u16", "s16", "u32", "s32", "u64", "s64", "f32", "f64", "string", "data")
FORMS = dict(zip(TYPES, "BbHhIiQqfdI")) | {"data": "II"}
SIZES = {t: struct.calcsize(">" + f) for t, f in FORMS.items()}
#: Storage classes by the high half of a column's flag byte.
STORAGE = {0x00: "none", 0x10: "zero", 0x30: "constant", 0x50: "per_row", 0x70: "constant2"}
UNSIGNED = ("u8", "u16", "u32", "u64")


@dataclass
class Column:
    name: str | None
    storage: str
    type: str
    constant: Any = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    rows: list[dict[str, Any]] = field(default_factory=list)

    def kind(self, name: str) -> str | None:
        return next((c.type for c in reversed(self.columns) if c.name == name), None)

    def unsigned(self, row: dict, name: str) -> int | None:
        """A number of an unsigned column; signed ones don't count."""
        return row.get(name) if self.kind(name) in UNSIGNED else None


def zero(type: str):
    return "" if type == "string" else b"" if type == "data" else 0.0 if type[0] == "f" else 0


def read_utf(data: bytes) -> Table:
    c = Cursor(data)
    c.magic(b"@UTF")
    size = c.unpack(">I")
    if 8 + size > len(data):
        raise Malformed(4, f"a table of {size} bytes in a buffer of {len(data)}")
    rows_at, strings_at, data_at, name_at, n_columns, row_size, n_rows = c.unpack(">IIIIHHI")
    rows_at, strings_at, data_at = rows_at + 8, strings_at + 8, data_at + 8
    if not n_columns:
        raise Malformed(0x18, "a table without columns")
    if not strings_at <= data_at <= 8 + size:
        raise Malformed(8, "sections out of order")
    pool, blob = data[strings_at:data_at], data[data_at : 8 + size]

    def text(at: int) -> str:
        if at >= len(pool):
            raise Malformed(strings_at + at, "string past the pool")
        end = pool.find(b"\0", at)
        try:
            return pool[at : end if end >= 0 else len(pool)].decode()
        except UnicodeDecodeError:
            raise Malformed(strings_at + at, "no UTF-8") from None

    def value(c: Cursor, type: str):
        v = c.unpack(">" + FORMS[type])
        if type == "string":
            return text(v)
        if type == "data":
            if v[0] + v[1] > len(blob):
                raise Malformed(c.at, "data past the blob")
            return blob[v[0] : v[0] + v[1]]
        return v

    table = Table(text(name_at), [])
    for _ in range(n_columns):
        flag = c.take(1)[0]
        storage = STORAGE.get(flag & 0xF0)
        if storage is None or flag & 15 >= len(TYPES):
            raise Malformed(c.at - 1, f"unknown column flag {flag:#x}")
        col = Column(None, storage, TYPES[flag & 15])
        if storage != "none":
            col.name = text(c.unpack(">I"))
        if storage.startswith("constant"):
            col.constant = value(c, col.type)
        table.columns.append(col)
    stored = [col for col in table.columns if col.storage == "per_row"]
    if (have := sum(SIZES[col.type] for col in stored)) != row_size:
        raise Malformed(0x1A, f"rows of {row_size} bytes, the schema has {have}")
    for i in range(n_rows):
        r = Cursor(data)
        r.seek(rows_at + i * row_size)
        row = {}
        for col in table.columns:  # of columns with one name the last one's value stays
            if col.storage == "per_row":
                row[col.name] = value(r, col.type)
            elif col.storage != "none":
                row[col.name] = col.constant if col.constant is not None else zero(col.type)
        table.rows.append(row)
    return table


def write_utf(t: Table) -> bytes:
    pool: dict[str, int] = {}
    chars, blob = Buffer(), Buffer()

    def text(s: str) -> int:
        if s not in pool:
            pool[s] = len(chars)
            chars.extend(s.encode() + b"\0")
        return pool[s]

    def put(b: Buffer, type: str, v) -> None:
        if v is None or (type == "string") != isinstance(v, str) or (type == "data") != isinstance(v, (bytes, bytearray)):
            raise Malformed(0, f"{v!r} is no {type}")
        if type == "string":
            v = text(v)
        if type == "data":
            b.put(">II", len(blob) if v else 0, len(v))
            blob.extend(v)
        else:
            b.put(">" + FORMS[type], v)

    text("")
    text(t.name)
    for c in t.columns:
        if (c.storage != "none") != (c.name is not None):
            raise Malformed(0, f"a column stored as {c.storage} named {c.name!r}")
        if c.name is not None:
            text(c.name)
        if c.storage.startswith("constant") and c.type == "string":
            text(c.constant)
    stored = [c for c in t.columns if c.storage == "per_row"]
    schema, rows = Buffer(), Buffer()
    bits = {s: b for b, s in STORAGE.items()}
    for c in t.columns:
        schema.put(">B", bits[c.storage] | TYPES.index(c.type))
        if c.name is not None:
            schema.put(">I", text(c.name))
        if c.storage.startswith("constant"):
            put(schema, c.type, c.constant)
    for i, row in enumerate(t.rows):
        for c in stored:
            if c.name not in row:
                raise Malformed(0, f"row {i} lacks {c.name!r}")
            put(rows, c.type, row[c.name])
    at = 24 + len(schema)
    b = Buffer(b"@UTF")
    b.put(">IIIIIHHI", at + len(rows) + len(chars) + len(blob), at, at + len(rows), at + len(rows) + len(chars), pool[t.name], len(t.columns), sum(SIZES[c.type] for c in stored), len(t.rows))
    return bytes(b + schema + rows + chars + blob)


KNOWN = ("DirName", "FileName", "FileSize", "ExtractSize", "FileOffset", "ID", "UserString")
#: Compressed bodies of this kind are recognised and refused.
REFUSED = bytes.fromhex("4352494c41594c41")
TOC_COLUMNS = [Column(n, "per_row", t) for n, t in zip(KNOWN, ("string", "string", "u32", "u32", "u64", "u32", "string"))]
EXTRA_PACKETS = ("Etoc", "Itoc", "Gtoc")


@dataclass
class File:
    dir: str
    name: str
    id: int = 0
    user: str = ""
    extra: dict[str, Any] = field(default_factory=dict)
    data: bytes = b""

    @property
    def path(self) -> str:
        return f"{self.dir}/{self.name}" if self.dir else self.name


@dataclass
class Cpk:
    header: Table
    toc_columns: list[Column] = field(default_factory=lambda: list(TOC_COLUMNS))
    files: list[File] = field(default_factory=list)
    #: Opaque packets by name (Etoc, Itoc, Gtoc).
    packets: dict[str, bytes] = field(default_factory=dict)

    def get(self, dir: str, name: str) -> File | None:
        """The first file of a path."""
        return next((f for f in self.files if (f.dir, f.name) == (dir, name)), None)


def _packet(data: bytes, at: int, magic: bytes) -> Table:
    c = Cursor(data)
    c.seek(at)
    c.magic(magic)
    _, size = c.unpack("<IQ")
    return read_utf(c.take(size))


def read_toc(read, length: int) -> tuple[Table, Table, list[tuple[File, int, int]], dict[str, bytes]]:
    """Header, table of contents, (file without its body, place, size) of each file, and the opaque packets.

    `read(at, n)` gives bytes of the archive: bodies are never asked for."""

    def packet(at: int, magic: bytes) -> Table:
        head = read(at, 16)
        if len(head) < 16:
            raise Malformed(at, "a packet past the end")
        size = struct.unpack_from("<Q", head, 8)[0]
        if at + 16 + size > length:
            raise Malformed(at, "a packet past the end")
        return _packet(head + read(at + 16, size), 0, magic)

    header = packet(0, b"CPK ")
    if len(header.rows) != 1:
        raise Malformed(0, f"{len(header.rows)} header rows instead of one")
    head = header.rows[0]

    def number(name: str, needed: bool = False) -> int:
        n = header.unsigned(head, name)
        if n is None and needed:
            raise Malformed(0, f"the header lacks {name}")
        return n or 0

    content, toc_at = number("ContentOffset", True), number("TocOffset", True)
    if not toc_at:
        raise Malformed(0, "an archive without a table of contents")
    toc = packet(toc_at, b"TOC ")
    packets = {}
    for name in EXTRA_PACKETS:
        at, size = number(name + "Offset"), number(name + "Size")
        if at:
            if at + size > length:
                raise Malformed(at, f"the {name} packet is past the end")
            packets[name] = read(at, size)
    base = offset_base([(toc.unsigned(r, "FileOffset") or 0, toc.unsigned(r, "FileSize") or 0) for r in toc.rows], toc_at, content, length)
    files = []
    for r in toc.rows:
        name, size, at = r.get("FileName") if toc.kind("FileName") == "string" else None, toc.unsigned(r, "FileSize"), toc.unsigned(r, "FileOffset")
        for column, v in (("FileName", name), ("FileSize", size), ("FileOffset", at)):
            if v is None:
                raise Malformed(toc_at, f"a row lacks {column}")
        full = toc.unsigned(r, "ExtractSize")
        if base + at + size > length:
            raise Malformed(base + at, "a body past the end")
        if full is not None and full != size:
            packed = read(base + at, len(REFUSED)) == REFUSED
            raise Malformed(base + at, "compressed bodies are not supported" if packed else f"{size} bytes that declare {full}")
        id = toc.unsigned(r, "ID")
        text = lambda k: r.get(k, "") if toc.kind(k) == "string" else ""  # noqa: B023, E731
        files.append((File(text("DirName"), name, id if id is not None and id < 1 << 32 else 0, text("UserString"), {k: v for k, v in r.items() if k not in KNOWN}), base + at, size))
    return header, toc, files, packets


def offset_base(rows: list[tuple[int, int]], toc: int, content: int, length: int) -> int:
    """What offsets count from: the base under which every body lies in the content, first the one whose first body begins it."""
    best = None
    for base in (toc, content):
        if all(base + at >= content and base + at + size <= length for at, size in rows):
            score = bool(rows) and base + rows[0][0] == content
            if best is None or score > best[0]:
                best = score, base
    if best is None:
        raise Malformed(toc, "no offset base keeps all bodies inside the content")
    return best[1]


def read_cpk(data: bytes) -> Cpk:
    header, toc, files, packets = read_toc(lambda at, n: bytes(data[at : at + n]), len(data))
    for f, at, size in files:
        f.data = bytes(data[at : at + size])
    return Cpk(header, toc.columns, [f for f, _, _ in files], packets)


def layout(sizes: list[int], header_size: int, toc_size: int, align: int, pad: bool, packets: dict[str, int]) -> tuple[dict[str, int], list[int]]:
    """Header fields, and the place of each body. The table of contents and the bodies begin on `align`; Etoc comes last."""
    out = {"TocOffset": align_up(header_size, align), "TocSize": toc_size}
    at = align_up(out["TocOffset"] + toc_size, 16)
    for name in ("Itoc", "Gtoc"):
        out |= {name + "Offset": at if name in packets else 0, name + "Size": packets.get(name, 0)}
        if name in packets:
            at = align_up(at + packets[name], 16)
    at = out["ContentOffset"] = align_up(at, align)
    places = []
    for n in sizes:
        places.append(at)
        at = align_up(at + n, align) if pad else at + n
    out["ContentSize"] = at - out["ContentOffset"]
    out |= {"EtocOffset": at if "Etoc" in packets else 0, "EtocSize": packets.get("Etoc", 0)}
    return out, places


def write_cpk(a: Cpk) -> bytes:
    head = a.header.rows[0] if a.header.rows else {}
    wide = lambda name, other: head[name] if a.header.kind(name) in ("u16", "u32") and name in head else other
    align, pad = wide("Align", 0x800), wide("Sorted", 1) != 0
    if align < 1 or align & align - 1:
        raise Malformed(0, f"an alignment of {align}")
    if not a.toc_columns:
        raise Malformed(0, "no columns for the table of contents")

    def toc(offsets: list[int]) -> bytes:
        rows = []
        for f, at in zip(a.files, offsets):
            own = {"DirName": f.dir, "FileName": f.name, "UserString": f.user, "FileSize": len(f.data), "ExtractSize": len(f.data), "FileOffset": at, "ID": f.id}
            rows.append(f.extra | own)
        for c in a.toc_columns:
            if c.name in ("FileSize", "ExtractSize", "FileOffset", "ID") and c.storage == "per_row" and c.type not in ("u32", "u64"):
                raise Malformed(0, f"{c.name} as {c.type}")
        return write_utf(Table("CpkTocInfo", a.toc_columns, rows))

    def headed(fields: dict[str, int]) -> bytes:
        return write_utf(Table("CpkHeader", a.header.columns, [head | fields | {"Files": len(a.files)}]))

    sizes, packets = [len(f.data) for f in a.files], {k: len(v) for k, v in a.packets.items()}
    names = [n + s for n in ("Content", "Toc", *EXTRA_PACKETS) for s in ("Offset", "Size")]
    toc_size, header_size = len(toc([0] * len(sizes))) + 16, len(headed(dict.fromkeys(names, 0))) + 16
    fields, places = layout(sizes, header_size, toc_size, align, pad, packets)
    b = Buffer()
    for magic, body in ((b"CPK ", headed(fields)), (b"TOC ", toc([p - fields["TocOffset"] for p in places]))):
        b += magic
        b.put("<IQ", 0xFF, len(body))
        b += body
        b.pad(align if magic == b"CPK " else 16)
    for name in ("Itoc", "Gtoc"):
        if name in a.packets:
            b += a.packets[name]
            b.pad(16)
    b.pad(align)
    for f in a.files:
        b += f.data
        if pad:
            b.pad(align)
    return bytes(b + a.packets.get("Etoc", b""))
