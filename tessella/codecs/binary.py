"""Bounds-checked reading and back-patching writing of byte buffers."""

from __future__ import annotations

import struct


class Malformed(ValueError):
    """Bytes that are not what their format says, with the position."""

    def __init__(self, at: int, what: str):
        super().__init__(f"{what} (at {at:#x})")
        self.at, self.what = at, what

    def __reduce__(self):
        return Malformed, (self.at, self.what)


def align_up(n: int, to: int) -> int:
    return -(-n // to) * to


def utf16(text: str) -> bytes:
    return text.encode("utf-16-le")


class Cursor:
    """A place in a buffer. Counts taken from the buffer never size an allocation before the bytes are there."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = memoryview(data), at

    def take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise Malformed(self.at, f"{n} bytes wanted, {max(0, len(self.data) - self.at)} left")
        out = bytes(self.data[self.at : end])
        self.at = end
        return out

    def seek(self, at: int) -> None:
        if not 0 <= at <= len(self.data):
            raise Malformed(at, "seek past the end")
        self.at = at

    def skip(self, n: int) -> None:
        self.take(n)

    def align(self, to: int) -> None:
        self.seek(align_up(self.at, to))

    def unpack(self, form: str):
        values = struct.unpack(form, self.take(struct.calcsize(form)))
        return values if len(values) != 1 else values[0]

    def magic(self, wanted: bytes) -> None:
        got = self.take(len(wanted))
        if got != wanted:
            raise Malformed(self.at - len(wanted), f"magic {got!r} instead of {wanted!r}")

    def cstring(self) -> str:
        start = self.at
        end = bytes(self.data[start:]).find(b"\0")
        if end < 0:
            raise Malformed(start, "unterminated string")
        self.at = start + end + 1
        return _decode(self.data[start : start + end], "utf-8", start)

    def cstring16(self) -> str:
        start = end = self.at
        while True:
            if end + 2 > len(self.data):
                raise Malformed(start, "unterminated string")
            if self.data[end] == 0 and self.data[end + 1] == 0:
                break
            end += 2
        self.at = end + 2
        return _decode(self.data[start:end], "utf-16-le", start)

    def pascal(self) -> str:
        """A length byte, the text and a zero."""
        start = self.at
        raw = self.take(self.take(1)[0])
        if self.take(1) != b"\0":
            raise Malformed(start, "string without its final zero")
        return _decode(raw, "utf-8", start)


def _decode(raw, encoding: str, at: int) -> str:
    try:
        return bytes(raw).decode(encoding)
    except UnicodeDecodeError as e:
        raise Malformed(at, f"no {encoding}: {e.reason}") from None


def pascal(text: str) -> bytes:
    raw = text.encode()
    if len(raw) > 255:
        raise Malformed(0, f"string of {len(raw)} bytes has no one-byte length")
    return bytes([len(raw)]) + raw + b"\0"


class Buffer(bytearray):
    def put(self, form: str, *values) -> None:
        try:
            self.extend(struct.pack(form, *values))
        except struct.error as e:
            raise Malformed(len(self), str(e)) from None

    def pad(self, to: int, fill: int = 0) -> None:
        self.extend(bytes([fill]) * (align_up(len(self), to) - len(self)))

    def patch(self, at: int, form: str, *values) -> None:
        try:
            struct.pack_into(form, self, at, *values)
        except struct.error as e:
            raise Malformed(at, str(e)) from None
