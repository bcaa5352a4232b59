"""Byte-exact vectors, round trips and hostile input for every codec."""

import random
import time
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessella.codecs import archive, dat, font, lzss, text, utf
from tessella.codecs.binary import Malformed

_FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()


def golden(name: str) -> bytes:
    return bytes.fromhex(re.search(re.escape(f"**{name}**") + r".*?`([0-9a-f]{20,})`", _FIXTURES, re.S).group(1))


SCRIPT = text.Script(0xCAFEBABE, [(0x14, [0]), (0x1D, [1]), (0x4B, [1]), (0x4B, [2]), (0x22, [2, 5]), (0x4B, [3]), (0x0A, [6])], [(1, 16)], [("start", 0)], ["", "C001_", "C002_"], None, 3)


@pytest.mark.parametrize("raw, packed", [(b"", ""), (b"B", "8042"), (b"ABABABABABABABAB!", "d04142fe3321"), (b"A" * 400, "8041ffffffffffffffffffffffffff1f"), (b"the cat sat on the mat, the cat sat on the hat", "ff7468652063617420ba73fc076f6e20f10b6df503902cf70fe83768f503")])
def test_lzss_vectors(raw, packed):
    assert lzss.compress(raw).hex() == packed
    assert lzss.decompress(bytes.fromhex(packed), len(raw)) == raw


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abcabc", b"\x00", b"xyz" * 30, b"q" * 70]), max_size=80).map(b"".join))
def test_lzss_round_trip_and_greedy_choice(raw):
    packed = lzss.compress(raw)
    assert lzss.decompress(packed, len(raw)) == raw
    assert packed == slow_compress(raw)


def slow_compress(raw: bytes) -> bytes:
    """The same encoding by trying every place of the window."""
    items, at = [], 0
    while at < len(raw):
        best, where = 0, 0
        for place in range(at - 1, max(0, at - 1024) - 1, -1):
            n = 0
            while n < min(65, len(raw) - at) and raw[place + n] == raw[at + n]:
                n += 1
            if n > best:
                best, where = n, place
        if best >= 2:
            items.append((False, ((1024 - (at - where)) | (best - 2) << 10).to_bytes(2, "little")))
            at += best
        else:
            items.append((True, raw[at : at + 1]))
            at += 1
    out = bytearray()
    for i in range(0, len(items), 8):
        out.append(sum(1 << (7 - k) for k, (literal, _) in enumerate(items[i : i + 8]) if literal))
        out += b"".join(x for _, x in items[i : i + 8])
    return bytes(out)


@pytest.mark.parametrize("packed, size", [("80", 1), ("0000", 3), ("00ff03", 5), ("8042", 2), ("000000", 4)])
def test_lzss_refuses_broken_streams(packed, size):
    with pytest.raises(Malformed):
        lzss.decompress(bytes.fromhex(packed), size)


@pytest.mark.parametrize("block, pixels", [("c83c88c6fa88c6fa", "c83cb4a08c786450"), ("3cc888c6fa88c6fa", "3cc8587490ac00ff")])
def test_bc4_vectors(block, pixels):
    assert font.decode_bc4(bytes.fromhex(block), 4, 4).hex() == pixels * 2


def test_bc4_crops_and_orders_blocks():
    blocks = b"".join(bytes([v, v, 0, 0, 0, 0, 0, 0]) for v in (1, 2, 3, 4))
    got = np.frombuffer(font.decode_bc4(blocks, 6, 5), np.uint8).reshape(5, 6)
    assert got[0].tolist() == [1, 1, 1, 1, 2, 2] and got[4].tolist() == [3, 3, 3, 3, 4, 4]
    with pytest.raises(Malformed):
        font.decode_bc4(blocks[:-1], 8, 8)
    assert font.decode_argb(font.encode_argb(b"\1\2\3\4"), 2, 2) == b"\1\2\3\4"


def test_stx():
    tables = [text.StringTable(0xDEADBEEF, [(0, "Hi"), (1, "Hi"), (99, "é😀")])]
    assert text.write_stx(tables) == golden("STX") and text.read_stx(golden("STX")) == tables
    more = [text.StringTable(1, []), text.StringTable(2, [(7, "first"), (7, "second"), (1, "")])]
    assert text.read_stx(text.write_stx(more)) == more
    assert more[1].get(7) == "first" and more[1].get(5) is None


def test_wrd():
    assert text.write_wrd(SCRIPT) == golden("WRD") and text.read_wrd(golden("WRD")) == SCRIPT
    assert text.dialogue(SCRIPT.commands) == [(1, 1), (1, 2), (2, 3)]
    own = text.Script(1, [], [], [], [], ["a", "ü"], 0)
    assert text.read_wrd(text.write_wrd(own)).strings == ["a", "ü"]


def test_an_argument_that_begins_with_the_marker_ends_the_list():
    s = text.read_wrd(text.write_wrd(text.Script(commands=[(0x4B, [0x7012]), (0x4B, [1])])))
    assert s.commands == [(0x4B, []), (0x12, []), (0x4B, [1])]


def test_a_speaker_command_without_arguments_resets_the_speaker():
    assert text.dialogue([(0x1D, [3]), (0x1D, []), (0x4B, [9, 8]), (0x4B, [])]) == [(None, 9)]


def test_spc():
    a = archive.Spc(b"\xaa" * 36, 0xCAFEBABE, [archive.Member(b"a.stx", 1, 0, b"raw"), archive.Member(b"b.wrd", 2, 4, b"ABABABABABABABAB!")])
    assert archive.write_spc(a) == golden("SPC") and archive.read_spc(golden("SPC")) == a
    assert a.get("a.stx").data == b"raw" and a.get("x") is None
    for broken in (b"$CMP" + golden("SPC")[4:], golden("SPC")[:-20], b"CPS.", golden("SPC").replace(b"Root", b"Toor")):
        with pytest.raises(Malformed):
            archive.read_spc(broken)
    with pytest.raises(Malformed):
        archive.write_spc(archive.Spc(members=[archive.Member(b"x", 3, 0, b"")]))


def test_dat():
    d = dat.Dat([("id", "u32", 1), ("tags", "utf16", 2), ("key", "label", 1), ("w", "f32", 1)], [[[1], ["red", "é"], ["k1"], [1.25]], [[2], ["é", "red"], ["k1"], [-0.5]]])
    assert dat.write_dat(d) == golden("DAT") and dat.read_dat(golden("DAT")) == d
    numbers = dat.Dat([(k, k, 1) for k in dat.NUMBERS], [[[v] for v in (0xFF, 0xBEEF, 2**32 - 1, 0xDEADBEEFDEADBEEF, -1, -2, -5, -3, 0.5, 3.14)]])
    assert dat.read_dat(dat.write_dat(numbers)) == numbers
    assert dat.read_dat(dat.write_dat(dat.Dat([("a", "u8", 0), ("a", "u8", 1)], [[[], [1]]]))).rows == [[[], [1]]]


@pytest.mark.parametrize("bad", [dat.Dat([("a", "u8", 1)], []), dat.Dat([("a", "u8", 1)], [[[256]]]), dat.Dat([("a", "u8", 1)], [[[1, 2]]]), dat.Dat([("a", "ascii", 1)], [[[5]]]), dat.Dat([("a", "u8", 1)], [[[1], [2]]]), dat.Dat([("a", "what", 1)], [[[1]]])])
def test_dat_refuses_what_does_not_fit(bad):
    with pytest.raises(Malformed):
        dat.write_dat(bad)


def test_dat_pools_hold_65535_texts():
    with pytest.raises(Malformed):
        dat.write_dat(dat.Dat([("a", "utf16", 1)], [[[str(i)]] for i in range(65_537)]))


def utf_table():
    C = utf.Column
    return utf.Table("T", [C("P", "per_row", "u32"), C("S", "per_row", "string"), C("D", "per_row", "data"), C("Z", "zero", "u64"), C("K", "constant", "u16", 0x800)], [{"P": 7, "S": "str", "D": b"\1\2\3", "Z": 0, "K": 0x800}])


def test_utf():
    assert utf.write_utf(utf_table()) == golden("@UTF") and utf.read_utf(golden("@UTF")) == utf_table()
    C = utf.Column
    every = utf.Table("E", [C(None, "none", "u8"), C("c2", "constant2", "string", "x"), C("z", "zero", "data"), *(C(t, "per_row", t) for t in utf.TYPES)], [dict(zip(("c2", "z", *utf.TYPES), ("x", b"", 1, -1, 2, -2, 3, -3, 2**64 - 1, -4, 0.5, 0.25, "é", b"ab")))])
    assert utf.read_utf(utf.write_utf(every)) == every
    twice = utf.Table("D", [C("k", "per_row", "u8"), C("k", "constant", "u8", 2)], [{"k": 1}])
    assert utf.read_utf(utf.write_utf(twice)).rows == [{"k": 2}]
    for bad in (utf.Table("x", [C("a", "per_row", "u8")], [{}]), utf.Table("x", [C("a", "per_row", "u8")], [{"a": "s"}]), utf.Table("x", [C(None, "per_row", "u8")])):
        with pytest.raises(Malformed):
            utf.write_utf(bad)


def cpk(align=16, sorted=1, files=(), **packets):
    C = utf.Column
    names = [n + s for n in ("Content", "Toc", *utf.EXTRA_PACKETS) for s in ("Offset", "Size")]
    header = utf.Table("CpkHeader", [C(n, "per_row", "u64") for n in names] + [C("Files", "per_row", "u32"), C("Align", "per_row", "u16"), C("Sorted", "per_row", "u16")], [{"Align": align, "Sorted": sorted}])
    return utf.Cpk(header, files=list(files), packets=packets)


def test_cpk():
    a = utf.read_cpk(golden("CPK"))
    assert [(f.path, f.id, f.data) for f in a.files] == [("r.bin", 0, b"abc"), ("d/e/x.spc", 1, b"0123456789abcdefX")]
    assert utf.write_cpk(a) == golden("CPK")
    files = [utf.File("", "a", 1, "u", {}, b"x" * 100), utf.File("d", "b", 2, "", {}, b""), utf.File("d", "b", 3, "", {}, b"yy")]
    for sorted in (0, 1):
        made = utf.read_cpk(utf.write_cpk(cpk(64, sorted, files, Etoc=b"e" * 5, Itoc=b"i", Gtoc=b"g" * 17)))
        assert made.files == files and made.packets == {"Etoc": b"e" * 5, "Itoc": b"i", "Gtoc": b"g" * 17}
        head = made.header.rows[0]
        assert head["TocOffset"] % 64 == head["ContentOffset"] % 64 == 0 and head["EtocOffset"] == head["ContentOffset"] + head["ContentSize"]
    assert made.get("d", "b").id == 2
    with pytest.raises(Malformed):
        utf.write_cpk(cpk(24))


def test_cpk_refuses_compressed_and_missing_bodies():
    a = cpk(16, 1, [utf.File("", "a", data=utf.REFUSED + b"....")])
    raw = utf.write_cpk(a)
    toc = utf.read_toc(lambda at, n: raw[at : at + n], len(raw))
    assert toc[2][0][2] == 12
    small = raw.replace((12).to_bytes(4, "big") * 2, (12).to_bytes(4, "big") + (99).to_bytes(4, "big"))
    with pytest.raises(Malformed, match="compressed"):
        utf.read_cpk(small)
    with pytest.raises(Malformed):
        utf.read_cpk(raw[:-8])


def test_offset_base_prefers_the_one_whose_first_body_begins_the_content():
    assert utf.offset_base([(0, 5)], 100, 200, 300) == 200
    assert utf.offset_base([(100, 5)], 100, 200, 400) == 100
    with pytest.raises(Malformed):
        utf.offset_base([(500, 5)], 100, 200, 300)


def test_srd():
    blocks = font.read_srd(golden("SRD"))
    assert [(r["magic"], r["parent_id"], r["depth"]) for r in font.flatten(blocks)] == [("$CFH", -1, 0), ("$TXR", -1, 0), ("$RSI", 1, 1), ("$CT0", -1, 0)]
    assert font.write_srd(blocks) == golden("SRD") == font.write_srd(font.unflatten(font.flatten(blocks)))
    other = font.read_srd(font.write_srd([font.Block(b"$TXR", 7, b"kept as bytes")]))
    assert other[0].txr is None and other[0].data == b"kept as bytes"


def test_spft():
    f = font.Font("F", 6, 0x60, 20, [(0x41, 0xABC, 0x123, 8, 12, -1, 0, 2), (0x21, 1, 2, 8, 12, -1, 0, 2)])
    assert font.write_spft(f) == golden("SpFt") and font.read_spft(golden("SpFt")).glyphs == sorted(f.glyphs)
    r = random.Random(1)
    big = font.Font("ü", 1, 0, 0, [(c, r.randrange(4096), r.randrange(4096), 1, 2, -3, 4, -5) for c in sorted(r.sample(range(0xD800), 400))])
    assert font.read_spft(font.write_spft(big)).glyphs == big.glyphs
    for glyphs in ([(65, 5000, 0, 1, 1, 0, 0, 0)], [(65, 0, 0, 1, 1, 0, 0, 0)] * 2, [(0xE000, 0, 0, 1, 1, 0, 0, 0)]):
        with pytest.raises(Malformed):
            font.write_spft(font.Font("x", glyphs=glyphs))


READERS = [(text.read_stx, "STX"), (text.read_wrd, "WRD"), (archive.read_spc, "SPC"), (dat.read_dat, "DAT"), (utf.read_utf, "@UTF"), (utf.read_cpk, "CPK"), (font.read_srd, "SRD"), (font.read_spft, "SpFt")]


@pytest.mark.parametrize("read, name", READERS)
def test_hostile_input_raises_and_nothing_else(read, name):
    raw, r = golden(name), random.Random(7)
    for k in range(len(raw)):
        try:
            read(raw[:k])
        except Malformed:
            pass
    for _ in range(600):
        b = bytearray(raw)
        for _ in range(r.randrange(1, 4)):
            b[r.randrange(len(b))] = r.choice([0, 1, 0x7F, 0xFF, r.randrange(256)])
        try:
            read(bytes(b))
        except Malformed:
            pass


def test_dat_by_columns_is_the_same_table():
    d = dat.Dat([("id", "u32", 1), ("tags", "utf16", 2), ("key", "label", 1), ("w", "f32", 1), ("k2", "ascii", 1), ("big", "u64", 1)], [[[1], ["red", "é"], ["k1"], [1.25], ["z"], [2**64 - 1]], [[2], ["é", "red"], ["k1"], [-0.5], ["k1"], [3]]])
    columns = [np.array([r[i] for r in d.rows], dtype=object if k in ("utf16", "label", "ascii", "u64") else None) for i, (_, k, _) in enumerate(d.schema)]
    assert dat.write_columns(d.schema, columns) == dat.write_dat(d)
    schema, got = dat.read_columns(dat.write_dat(d))
    assert schema == d.schema and [[list(c[r]) for c in got] for r in range(2)] == d.rows
    for bad in ([[256]], [[-1]], [[1, 2]], [[1.5]]):
        with pytest.raises(Malformed):
            dat.write_columns([("a", "u8", 1)], [np.array(bad)])


def test_lzss_finds_the_same_matches_piece_by_piece(monkeypatch):
    def chained(data):  # the nearest of the longest matches, by looking at every place of the window
        at, out = 0, []
        while at < len(data):
            best, where = 0, -1
            for place in range(at - 1, max(0, at - lzss.WINDOW) - 1, -1):
                size = 0
                while size < min(lzss.LONGEST, len(data) - at) and data[place + size] == data[at + size]:
                    size += 1
                if size > best:
                    best, where = size, place
            out.append((best, at - where) if best >= 2 else data[at])
            at += best if best >= 2 else 1
        return out

    def parsed(packed):
        at, out = 0, []
        while at < len(packed):
            flags, at = lzss.REVERSED[packed[at]], at + 1
            for bit in range(8):
                if at >= len(packed):
                    break
                if flags >> bit & 1:
                    out.append(packed[at])
                    at += 1
                else:
                    word = packed[at] | packed[at + 1] << 8
                    out.append(((word >> 10) + 2, lzss.WINDOW - (word & 0x3FF)))
                    at += 2
        return out

    r = random.Random(5)
    for piece in (50, 1 << 18):
        monkeypatch.setattr(lzss, "PIECE", piece)
        for k, letters in ((2, b"ab"), (700, b"abc"), (3000, b"abcdefgh"), (1500, bytes(range(256))), (66, b"a")):
            raw = bytes(r.choices(letters, k=k))
            assert parsed(lzss.compress(raw)) == chained(raw)
            assert lzss.decompress(lzss.compress(raw), len(raw)) == raw


def test_lzss_takes_no_step_for_each_place_that_might_match(sf_dir):
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    n = sum(map(len, texts))
    began = time.process_time()
    assert [lzss.decompress(lzss.compress(raw), len(raw)) for raw in texts] == texts
    took, began = time.process_time() - began, time.process_time()
    for _ in range(40 * n):  # a bound that goes with the machine
        pass
    assert took < time.process_time() - began


def test_bc4_blocks_are_decoded_together():
    raw = np.random.default_rng(1).integers(0, 256, (500, 8), dtype=np.uint8)
    assert [bytes(p) for p in font.decode_blocks(raw)] == [font.decode_bc4(bytes(b), 4, 4) for b in raw]
    assert font.decode_blocks(raw[:0]).shape == (0, 16)
