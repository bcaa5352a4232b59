"""String tables (STX) and scripts (WRD)."""

from __future__ import annotations

from dataclasses import dataclass, field

from .binary import Buffer, Cursor, Malformed, pascal, utf16

MARKER = 0x70
#: Script opcodes that dialogue needs: two set the speaker, one says a line.
SPEAKER_OPCODES, LINE_OPCODE = (0x1D, 0x22), 0x4B
OPCODES = {0x14: "LAB", 0x1D: "CHN", 0x22: "CHR", 0x4B: "LOC", 0x0A: "CHK"}


@dataclass
class StringTable:
    unknown: int = 0
    entries: list[tuple[int, str]] = field(default_factory=list)

    def get(self, id: int) -> str | None:
        """The first entry's text of an id."""
        return next((t for i, t in self.entries if i == id), None)


def read_stx(data: bytes) -> list[StringTable]:
    c = Cursor(data)
    c.magic(b"STXTJPLL")
    n, index = c.unpack("<II")
    heads = []
    for _ in range(n):
        heads.append(c.unpack("<II"))
        c.skip(8)
    c.seek(index)
    tables = []
    for unknown, count in heads:
        t = StringTable(unknown)
        for _ in range(count):
            id, at = c.unpack("<II")
            t.entries.append((id, Cursor(data, _inside(data, at)).cstring16()))
        tables.append(t)
    return tables


def _inside(data: bytes, at: int) -> int:
    if at > len(data):
        raise Malformed(at, "string past the end")
    return at


def write_stx(tables: list[StringTable]) -> bytes:
    """Equal texts of a table are stored once."""
    b = Buffer(b"STXTJPLL")
    b.put("<II", len(tables), 16 + 16 * len(tables))
    for t in tables:
        b.put("<II8x", t.unknown, len(t.entries))
    slot = len(b)
    b += bytes(8 * sum(len(t.entries) for t in tables))
    for t in tables:
        at: dict[str, int] = {}
        for id, text in t.entries:
            if text not in at:
                at[text] = len(b)
                b += utf16(text) + b"\0\0"
            b.patch(slot, "<II", id, at[text])
            slot += 8
    return bytes(b)


@dataclass
class Script:
    unknown: int = 0
    commands: list[tuple[int, list[int]]] = field(default_factory=list)
    branches: list[tuple[int, int]] = field(default_factory=list)
    labels: list[tuple[str, int]] = field(default_factory=list)
    params: list[str] = field(default_factory=list)
    #: Texts within the script; None where they are in a string table elsewhere.
    strings: list[str] | None = None
    external: int = 0


def read_wrd(data: bytes) -> Script:
    c = Cursor(data)
    n_strings, n_labels, n_params, n_branches = c.unpack("<4H")
    s = Script(unknown=c.unpack("<I"), external=n_strings)
    branches, offsets, names, params, strings = c.unpack("<5I")
    if branches > len(data):
        raise Malformed(12, "byte code past the end")
    while c.at < branches:
        at = c.at
        marker, opcode = c.unpack("2B")
        if marker != MARKER:
            raise Malformed(at, f"{marker:#x} where a command should begin")
        args = []
        # an argument whose first byte is the marker ends the list: that is how the format is read
        while c.at + 2 <= branches and data[c.at] != MARKER:
            args.append(c.unpack(">H"))
        s.commands.append((opcode, args))
    c.seek(branches)
    s.branches = [c.unpack("<2H") for _ in range(n_branches)]
    c.seek(offsets)
    at = [c.unpack("<H") for _ in range(n_labels)]
    c.seek(names)
    s.labels = list(zip([c.pascal() for _ in range(n_labels)], at))
    c.seek(params)
    s.params = [c.pascal() for _ in range(n_params)]
    if strings:
        c.seek(strings)
        s.strings = [c.cstring16() for _ in range(n_strings)]
    return s


def write_wrd(s: Script) -> bytes:
    b = Buffer(32)
    for opcode, args in s.commands:
        b.put(f">BB{len(args)}H", MARKER, opcode, *args)
    places = [len(b)]
    for branch in s.branches:
        b.put("<2H", *branch)
    places.append(len(b))
    for _, at in s.labels:
        b.put("<H", at)
    places.append(len(b))
    b += b"".join(pascal(name) for name, _ in s.labels)
    places.append(len(b))
    b += b"".join(map(pascal, s.params))
    places.append(0 if s.strings is None else len(b))
    for text in s.strings or ():
        b += utf16(text) + b"\0\0"
    n = s.external if s.strings is None else len(s.strings)
    b.patch(0, "<4HI5I", n, len(s.labels), len(s.params), len(s.branches), s.unknown, *places)
    return bytes(b)


def dialogue(commands: list[tuple[int, list[int]]]) -> list[tuple[int | None, int]]:
    """(speaker parameter, string id) of each line: the last speaker command before it, whose missing argument means none."""
    speaker, lines = None, []
    for opcode, args in commands:
        if opcode in SPEAKER_OPCODES:
            speaker = args[0] if args else None
        elif opcode == LINE_OPCODE and args:
            lines.append((speaker, args[0]))
    return lines
