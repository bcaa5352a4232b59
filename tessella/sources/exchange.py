"""JSON forms of the formats, strict in both directions: unknown, missing and mistyped fields are refused.

A document's `schema` says its format and version (`stx/v1`); what stands before it, up to a dash, is left to its producer.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..codecs import archive, dat, font, text, utf


class BadDocument(ValueError):
    pass


def tag(kind: str, prefix: str = "") -> str:
    return f"{prefix}-{kind}/v1" if prefix else f"{kind}/v1"


def check_tag(doc: dict, kind: str) -> None:
    if not isinstance(doc, dict) or not re.fullmatch(rf"(?:[\w.]+-)?{kind}/v1", str(doc.get("schema"))):
        raise BadDocument(f"schema {doc.get('schema') if isinstance(doc, dict) else None!r} where {kind}/v1 is wanted")


def fields(doc: Any, needed: dict[str, Any], optional: dict[str, Any] | None = None, what: str = "document") -> dict:
    """The object's fields with their types checked; optional ones are null where missing."""
    optional = optional or {}
    if not isinstance(doc, dict):
        raise BadDocument(f"{what}: no object")
    for k in doc:
        if k not in needed and k not in optional:
            raise BadDocument(f"{what}: unknown field {k!r}")
    for k, kind in (needed | optional).items():
        v = doc.get(k)
        if v is None and k in optional:
            continue
        if k not in doc:
            raise BadDocument(f"{what}: {k} is missing")
        if not isinstance(v, kind) or isinstance(v, bool):
            raise BadDocument(f"{what}: {k} is {v!r}")
    return {k: doc.get(k) for k in needed | optional}


def whole(v: Any, low: int, high: int, what: str) -> int:
    if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
        raise BadDocument(f"{what} is {v!r}")
    return v


def dumps(doc: Any) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=2, allow_nan=False)


def stx_to_json(tables: list[text.StringTable], prefix: str = "") -> dict:
    return {"schema": tag("stx", prefix), "tables": [{"unknown": t.unknown, "entries": [{"id": i, "text": s} for i, s in t.entries]} for t in tables]}


def stx_from_json(doc: dict) -> list[text.StringTable]:
    check_tag(doc, "stx")
    out = []
    for t in fields(doc, {"schema": str, "tables": list})["tables"]:
        t = fields(t, {"unknown": int, "entries": list}, what="table")
        entries = [fields(e, {"id": int, "text": str}, what="entry") for e in t["entries"]]
        out.append(text.StringTable(whole(t["unknown"], 0, 2**32 - 1, "unknown"), [(whole(e["id"], 0, 2**32 - 1, "id"), e["text"]) for e in entries]))
    return out


def dat_to_json(d: dat.Dat, prefix: str = "") -> dict:
    return {
        "schema": tag("dat", prefix),
        "columns": [{"name": n, "type": k, "count": c} for n, k, c in d.schema],
        "rows": [[{"type": k, "values": cell} for (_, k, _), cell in zip(d.schema, row)] for row in d.rows],
    }


def dat_from_json(doc: dict) -> dat.Dat:
    check_tag(doc, "dat")
    doc = fields(doc, {"schema": str, "columns": list, "rows": list})
    columns = [fields(c, {"name": str, "type": str, "count": int}, what="column") for c in doc["columns"]]
    schema = [(c["name"], c["type"], whole(c["count"], 0, 65535, "count")) for c in columns]
    rows = []
    for row in doc["rows"]:
        cells = [fields(c, {"type": str, "values": list}, what="cell") for c in row]
        if len(cells) != len(schema) or any(c["type"] != k or len(c["values"]) != n for c, (_, k, n) in zip(cells, schema)):
            raise BadDocument("a row that its columns don't describe")
        rows.append([c["values"] for c in cells])
    return dat.Dat(schema, rows)


def wrd_to_json(s: text.Script, prefix: str = "") -> dict:
    out = {
        "schema": tag("wrd", prefix), "unknown1": s.unknown, "external_string_count": s.external, "commands": [{"opcode": o, "args": a} for o, a in s.commands], "local_branches": [{"id": a, "offset": b} for a, b in s.branches],
        "label_offsets": [at for _, at in s.labels], "label_names": [n for n, _ in s.labels], "parameters": s.params,
    }
    return out | ({"internal_strings": s.strings} if s.strings is not None else {})


def wrd_from_json(doc: dict) -> text.Script:
    check_tag(doc, "wrd")
    d = fields(doc, {"schema": str, "unknown1": int, "external_string_count": int, "commands": list, "local_branches": list, "label_offsets": list, "label_names": list, "parameters": list}, {"internal_strings": list})
    if len(d["label_names"]) != len(d["label_offsets"]):
        raise BadDocument("label_names and label_offsets differ in length")
    short = lambda v, what: whole(v, 0, 65535, what)
    commands = [fields(c, {"opcode": int, "args": list}, what="command") for c in d["commands"]]
    branches = [fields(b, {"id": int, "offset": int}, what="branch") for b in d["local_branches"]]
    return text.Script(
        whole(d["unknown1"], 0, 2**32 - 1, "unknown1"), [(whole(c["opcode"], 0, 255, "opcode"), [short(a, "argument") for a in c["args"]]) for c in commands], [(short(b["id"], "id"), short(b["offset"], "offset")) for b in branches],
        list(zip(d["label_names"], (short(v, "label offset") for v in d["label_offsets"]))), d["parameters"], d["internal_strings"], short(d["external_string_count"], "external_string_count"),
    )


def spft_to_json(f: font.Font, prefix: str = "") -> dict:
    glyphs = [{"codepoint": c, "position": {"x": x, "y": y}, "size": {"width": w, "height": h}, "kerning": {"left": a, "right": b, "vertical": v}} for c, x, y, w, h, a, b, v in f.glyphs]
    return {"schema": tag("spft", prefix), "unknown6": f.unknown6, "bit_flag_count": f.flags, "scale_flag": f.scale, "font_name": f.name, "glyphs": glyphs}


def position(doc: Any) -> tuple[int, int]:
    d = fields(doc, {"x": int, "y": int}, what="position")
    return whole(d["x"], 0, 65535, "x"), whole(d["y"], 0, 65535, "y")


def size(doc: Any) -> tuple[int, int]:
    d = fields(doc, {"width": int, "height": int}, what="size")
    return whole(d["width"], 0, 255, "width"), whole(d["height"], 0, 255, "height")


def kerning(doc: Any) -> tuple[int, int, int]:
    d = fields(doc, {"left": int, "right": int, "vertical": int}, what="kerning")
    return tuple(whole(d[k], -128, 127, k) for k in ("left", "right", "vertical"))


def spft_from_json(doc: dict) -> font.Font:
    check_tag(doc, "spft")
    d = fields(doc, {"schema": str, "unknown6": int, "bit_flag_count": int, "scale_flag": int, "font_name": str, "glyphs": list})
    glyphs = [fields(g, {"codepoint": int, "position": dict, "size": dict, "kerning": dict}, what="glyph") for g in d["glyphs"]]
    return font.Font(d["font_name"], d["unknown6"], d["bit_flag_count"], d["scale_flag"], [(g["codepoint"], *position(g["position"]), *size(g["size"]), *kerning(g["kerning"])) for g in glyphs])


def value_to_json(kind: str, v: Any) -> dict:
    return {kind: v.hex() if kind == "data" else v}


def value_from_json(doc: Any) -> tuple[str, Any]:
    if not isinstance(doc, dict) or len(doc) != 1:
        raise BadDocument(f"value {doc!r}")
    kind, v = next(iter(doc.items()))
    if kind not in utf.TYPES:
        raise BadDocument(f"unknown type {kind!r}")
    if kind == "data":
        try:
            v = bytes.fromhex(v.strip())
        except (ValueError, AttributeError):
            raise BadDocument(f"no hex: {v!r}") from None
    return kind, v


def column_to_json(c: utf.Column) -> dict:
    out = {"name": c.name, "storage": c.storage, "type": c.type}
    return out | ({"constant": value_to_json(c.type, c.constant)} if c.storage.startswith("constant") else {})


def column_from_json(doc: Any) -> utf.Column:
    d = fields(doc, {"storage": str, "type": str}, {"name": str, "constant": dict}, "column")
    if d["storage"] not in utf.STORAGE.values() or d["type"] not in utf.TYPES:
        raise BadDocument(f"column {doc!r}")
    constant = None
    if d["constant"] is not None:
        kind, constant = value_from_json(d["constant"])
        if kind != d["type"]:
            raise BadDocument(f"a constant of type {kind} in a column of type {d['type']}")
    return utf.Column(d["name"], d["storage"], d["type"], constant)


def strict_path(path: str) -> tuple[str, str]:
    """(directory, file); absolute paths, backslashes and empty, `.` and `..` parts are refused."""
    parts = path.split("/")
    if "\\" in path or any(p in ("", ".", "..") for p in parts):
        raise BadDocument(f"unsafe path {path!r}")
    return "/".join(parts[:-1]), parts[-1]


def cpk_to_json(a: utf.Cpk, prefix: str = "") -> dict:
    """The manifest: all but bodies and opaque packets, which lie beside it."""
    head = {k: value_to_json(a.header.kind(k), v) for k, v in sorted(a.header.rows[0].items())}
    kinds = {c.name: c.type for c in a.toc_columns}
    files = [{"path": f.path, "id": f.id, "user_string": f.user} | ({"extra": {k: value_to_json(kinds[k], v) for k, v in sorted(f.extra.items())}} if f.extra else {}) for f in a.files]
    out = {"schema": tag("cpk", prefix), "header": {"columns": [column_to_json(c) for c in a.header.columns], "row": head}, "toc_columns": [column_to_json(c) for c in a.toc_columns], "files": files}
    return out | {f"{n.lower()}_packet": f"_{n.lower()}.bin" for n in utf.EXTRA_PACKETS if n in a.packets}


def cpk_from_json(doc: dict, body) -> utf.Cpk:
    """An archive from its manifest; `body(path)` gives bodies and packets. All paths are checked before any is read."""
    check_tag(doc, "cpk")
    packets = {n: f"{n.lower()}_packet" for n in utf.EXTRA_PACKETS}
    d = fields(doc, {"schema": str, "header": dict, "toc_columns": list, "files": list}, dict.fromkeys(packets.values(), str))
    head = fields(d["header"], {"columns": list, "row": dict}, what="header")
    files = []
    for f in d["files"]:
        f = fields(f, {"path": str, "id": int, "user_string": str}, {"extra": dict}, "file")
        files.append(utf.File(*strict_path(f["path"]), whole(f["id"], 0, 2**32 - 1, "id"), f["user_string"], {k: value_from_json(v)[1] for k, v in (f["extra"] or {}).items()}))
    for n in packets.values():
        if d[n] is not None:
            strict_path(d[n])
    header = utf.Table("CpkHeader", [column_from_json(c) for c in head["columns"]], [{k: value_from_json(v)[1] for k, v in head["row"].items()}])
    for f in files:
        f.data = body(f.path)
    return utf.Cpk(header, [column_from_json(c) for c in d["toc_columns"]], files, {n: body(d[k]) for n, k in packets.items() if d[k] is not None})


COMPRESSION = {archive.STORED: "stored", archive.PACKED: "lzss"}


def spc_to_json(a: archive.Spc, prefix: str = "") -> dict:
    """The manifest; names that are no UTF-8 and unknown compression flags are refused rather than changed."""
    entries = []
    for m in a.members:
        if m.flag not in COMPRESSION:
            raise BadDocument(f"compression flag {m.flag}")
        entries.append({"name": m.name.decode(), "compression": COMPRESSION[m.flag], "unknown_flag": m.unknown})
    return {"schema": tag("spc", prefix), "unknown1": a.unknown1.hex(), "unknown2": a.unknown2, "entries": entries}


def spc_from_json(doc: dict, bodies: list[bytes]) -> archive.Spc:
    check_tag(doc, "spc")
    d = fields(doc, {"schema": str, "unknown1": str, "unknown2": int, "entries": list})
    raw = bytes.fromhex(d["unknown1"].strip())
    if len(raw) != 36:
        raise BadDocument(f"unknown1 has {len(raw)} bytes instead of 36")
    if len(bodies) != len(d["entries"]):
        raise BadDocument(f"{len(bodies)} bodies of {len(d['entries'])}")
    flags = {v: k for k, v in COMPRESSION.items()}
    members = []
    for e, b in zip(d["entries"], bodies):
        e = fields(e, {"name": str, "compression": str, "unknown_flag": int}, what="entry")
        if e["compression"] not in flags:
            raise BadDocument(f"compression {e['compression']!r}")
        members.append(archive.Member(e["name"].encode(), flags[e["compression"]], whole(e["unknown_flag"], -32768, 32767, "unknown_flag"), b))
    return archive.Spc(raw, whole(d["unknown2"], 0, 2**32 - 1, "unknown2"), members)
