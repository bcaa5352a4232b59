"""The patch engine, its documents, fonts, sources and command line."""

import json
import struct
import zlib

import numpy as np
import pytest

from tessella import cli
from tessella.codecs import archive, dat, font, text, utf
from tessella.operators import fonts, patching
from tessella.operators.patching import PatchError
from tessella.plans import apply as plan
from tessella.sources import exchange, files, members, tables
from tessella.sources.tables import new_archive

KEYS = ("a.cpk", "d/x.spc", "m.stx", 0)
SLOTS = "cpk string, cpk_path string, spc_member string, table_idx int, pos int, id bigint, text string"


def slots(spark, *rows):
    return spark.createDataFrame([(*KEYS, *r) for r in rows], SLOTS)


def entries(spark, *rows):
    return spark.createDataFrame([(*KEYS, id, i, s, t) for i, (id, s, t) in enumerate(rows)], plan.ENTRIES)


def outcome(spark, s, e, policy="warn"):
    hit, missing = patching.resolve(e, s)
    d = patching.decide(hit, policy)
    return patching.report(d, missing, e).first().asDict(), [r.text for r in patching.updated(s, d).orderBy("pos").collect()], sorted(map(tuple, missing.collect()), key=str)


def test_the_last_of_duplicate_slots_is_the_target(spark):
    r, texts, _ = outcome(spark, slots(spark, (0, 7, "first"), (1, 7, "second")), entries(spark, (7, "second", "PATCHED")))
    assert texts == ["first", "PATCHED"] and (r["applied"], r["drift"]) == (1, 0)


@pytest.mark.parametrize("policy, applied, already, skipped", [("warn", 1, 1, 0), ("skip", 0, 0, 1)])
def test_applying_again_is_drift_before_it_is_done(spark, policy, applied, already, skipped):
    r, texts, _ = outcome(spark, slots(spark, (0, 1, "B")), entries(spark, (1, "A", "B")), policy)
    assert (r["applied"], r["already"], r["skipped"], r["drift"], texts) == (applied, already, skipped, 1, ["B"])


def test_error_policy_names_the_first_drift(spark):
    s, e = slots(spark, (0, 1, "x"), (1, 2, "y")), entries(spark, (2, "other", "t"), (1, "other", "t"))
    with pytest.raises(PatchError, match="id 2"):
        outcome(spark, s, e, "error")


def test_entries_for_one_slot_apply_in_order(spark):
    r, texts, _ = outcome(spark, slots(spark, (0, 1, "A")), entries(spark, (1, "A", "B"), (1, "A", "C")))
    assert texts == ["C"] and (r["applied"], r["drift"]) == (2, 1)
    r, texts, _ = outcome(spark, slots(spark, (0, 1, "A")), entries(spark, (1, "A", "B"), (1, "A", "C")), "skip")
    assert texts == ["B"] and (r["applied"], r["skipped"]) == (1, 1)


def test_missing_records_by_group_and_by_entry(spark):
    rows = [("a.cpk", "no/file.spc", "m.stx", 0, 1), ("a.cpk", "no/file.spc", "m.stx", 0, 2), ("a.cpk", "d/x.spc", "no.stx", 0, 1), ("a.cpk", "/d/x.spc", "no.stx", 0, 2), (*KEYS[:3], 9, 1), (*KEYS, 5)]
    e = spark.createDataFrame([(*r, i, "s", "t") for i, r in enumerate(rows)], plan.ENTRIES)
    got = sorted(map(tuple, patching.resolve(e, slots(spark, (0, 1, "x")))[1].collect()), key=str)
    assert got == sorted([("a.cpk", "no/file.spc", "", None, None), ("a.cpk", "d/x.spc", "no.stx", None, None), (*KEYS[:3], 9, 1), (*KEYS, 5)], key=str)


def test_archive_names_are_checked(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "cpk string")
    with pytest.raises(PatchError, match="DUPLICATE"):
        patching.check_archives(names("a"), names("a", "a"))
    with pytest.raises(PatchError, match="UNKNOWN"):
        patching.check_archives(names("b"), names("a"))
    patching.check_archives(names("a"), names("a"))


def glyph_font(kind=font.BC4, width=8, height=8):
    glyphs = font.write_spft(font.Font("F", 6, 0, 1, [(65, 0, 0, 4, 4, 0, 0, 0), (32, 4, 0, 1, 1, 0, 0, 0)]))
    rsi = dict.fromkeys(font.RSI, 0) | {"count": 1, "size": 8, "info": [[font.IN_SRDV, 32]], "data": glyphs, "strings": [b"n"]}
    txr = dict.fromkeys(font.TXR, 0) | {"width": width, "height": height, "format": kind}
    blocks = [font.Block(b"$CFH", 1), font.Block(b"$TXR", txr=txr, children=[font.Block(b"$RSI", rsi=rsi)]), font.Block(b"$CT0")]
    pixels = bytes([9, 9, 0, 0, 0, 0, 0, 0]) * 4
    return [archive.Member(b"f.stx", 1, 0, font.write_srd(blocks)), archive.Member(b"f.srdv", 1, 0, pixels)]


def read_font(spc):
    blocks = font.read_srd(spc.get("f.stx").data)
    return font.read_spft(fonts.find_glyph_block(blocks).rsi["data"]), blocks[1].txr, fonts.find_glyph_block(blocks).rsi


def test_font_merge_grows_and_draws():
    spc, count = archive.Spc(members=glyph_font()), dict.fromkeys(fonts.COUNTERS, 0)
    patch = fonts.FontPatch(atlas=(8, 12), name="N", glyphs=[fonts.Glyph(65, kerning=(1, 0, 0)), fonts.Glyph(66, (4, 8), (2, 2), alpha=b"\1\2\3\4")])
    fonts.patch_font(spc, "f.stx", patch, count)
    table, txr, rsi = read_font(spc)
    assert table.name == "N" and table.glyphs == [(32, 4, 0, 1, 1, 0, 0, 0), (65, 0, 0, 4, 4, 1, 0, 0), (66, 4, 8, 2, 2, 0, 0, 0)]
    assert (txr["format"], txr["height"], rsi["info"][0][1]) == (font.ARGB, 12, 8 * 12 * 4)
    pixels = np.frombuffer(font.decode_argb(spc.get("f.srdv").data, 8, 12), np.uint8).reshape(12, 8)
    assert (pixels[:8] == 9).all() and pixels[8:10, 4:6].tolist() == [[1, 2], [3, 4]] and pixels[8:].sum() == 10
    assert count == {"font_glyphs_added": 1, "font_glyphs_changed": 1, "font_glyphs_removed": 0, "font_atlas_writes": 1, "font_atlas_grows": 1, "font_atlas_replaces": 0}


def test_font_replace_starts_from_nothing():
    spc, count = archive.Spc(members=glyph_font(kind=0x99)), dict.fromkeys(fonts.COUNTERS, 0)
    fonts.patch_font(spc, "f.stx", fonts.FontPatch(True, (8, 4), glyphs=[fonts.Glyph(67, (0, 0), (1, 1), (0, 0, 0), b"\7")]), count)
    table, txr, _ = read_font(spc)
    assert [g[0] for g in table.glyphs] == [67] and txr["height"] == 4
    assert sum(font.decode_argb(spc.get("f.srdv").data, 8, 4)) == 7 and count["font_glyphs_removed"] == 2


def test_a_merge_that_changes_no_pixels_leaves_them():
    spc, count = archive.Spc(members=glyph_font(kind=0x99)), dict.fromkeys(fonts.COUNTERS, 0)
    before = spc.get("f.srdv").data
    fonts.patch_font(spc, "f.stx", fonts.FontPatch(atlas=(8, 8), glyphs=[fonts.Glyph(70)]), count)
    assert spc.get("f.srdv").data == before and read_font(spc)[0].glyphs[-1] == (70,) + (0,) * 7


@pytest.mark.parametrize(
    "patch, error",
    [
        (fonts.FontPatch(atlas=(9, 8)), "ATLAS_WIDTH"), (fonts.FontPatch(atlas=(8, 4)), "ATLAS_SHRINK"), (fonts.FontPatch(True, (8, 0)), "ATLAS_GEOMETRY"),
        (fonts.FontPatch(glyphs=[fonts.Glyph(65, alpha=b"x")]), "GLYPH_SIZE"), (fonts.FontPatch(glyphs=[fonts.Glyph(65, (7, 7), (2, 1), alpha=b"xx")]), "GLYPH_OVERFLOW"),
    ],
)
def test_font_errors(patch, error):
    with pytest.raises(PatchError, match=error):
        fonts.patch_font(archive.Spc(members=glyph_font()), "f.stx", patch, dict.fromkeys(fonts.COUNTERS, 0))


def png(width, height, rgba, kind=6):
    channels = {6: 4, 2: 3}[kind]
    rows = b"".join(b"\0" + rgba[y * width * channels : (y + 1) * width * channels] for y in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_alpha():
    assert fonts.png_alpha(png(2, 1, bytes(range(8)))) == (2, 1, b"\3\7")
    assert fonts.png_alpha(png(1, 1, b"abc", 2)) == (1, 1, b"\xff")
    for bad in (b"x", png(2, 2, b"")):
        with pytest.raises(PatchError):
            fonts.png_alpha(bad)


def make_archives(folder):
    stx = text.write_stx([text.StringTable(1, [(0, "Hello"), (1, "World"), (0, "again")])])
    spc = archive.write_spc(archive.Spc(members=[archive.Member(b"t.stx", 2, 4, stx), *glyph_font(), archive.Member(b"k.bin", 1, 0, b"keep")]))
    (folder / "in").mkdir()
    for name, extra in (("one.cpk", [utf.File("d", "old.spc", data=b"first"), utf.File("d", "old.spc", data=spc)]), ("two.cpk", [utf.File("d", "a.spc", 5, data=b"two's")])):
        a = new_archive([utf.File("d", "a.spc", 1, data=spc), utf.File("", "r.bin", 2, data=b"raw"), *extra], 64)
        (folder / "in" / name).write_bytes(utf.write_cpk(new_archive(extra, 64) if name == "two.cpk" else a))
    return [str(folder / "in" / n) for n in ("one.cpk", "two.cpk")]


def document(folder, name, groups, **more):
    path = folder / name
    path.write_text(json.dumps({"schema": "any-translate/v1", "files": groups} | more))
    return str(path)


def texts(path, *rows, cpk="one.cpk", member="t.stx"):
    return {"format": "stx", "cpk": cpk, "cpk_path": path, "spc_member": member, "entries": [{"table": t, "index": i, "source": s, "target": n} for t, i, s, n in rows]}


def test_apply_end_to_end(spark, tmp_path):
    tables.register(spark)
    paths = make_archives(tmp_path)
    (tmp_path / "g.png").write_bytes(png(1, 2, b"\0\0\0\5\0\0\0\6"))
    glyph = {"codepoint": 228, "char": "ä", "image_path": "g.png", "position": {"x": 7, "y": 6}, "size": {"width": 1, "height": 2}}
    fontg = {"format": "font", "cpk": "one.cpk", "cpk_path": "/d/a.spc", "spc_member": "f.stx", "mode": "merge", "glyphs": [glyph]}
    doc = document(tmp_path, "p.json", [texts("d/a.spc", (0, 0, "again", "wieder"), (0, 1, "Wrld", "Welt"), (0, 9, "a", "b")), texts("d/old.spc", (0, 1, "World", "Welt")), texts("d/none.spc", (0, 0, "a", "b")), fontg], target_language="de")
    patch = plan.load([doc])
    out = plan.apply(spark, patch, plan.archives(spark, paths))
    report = plan.write(out, paths, str(tmp_path / "out"))
    assert (report["applied"], report["already_translated"], report["skipped"], len(report["drift"]), len(report["missing"])) == (3, 0, 0, 1, 2)
    assert report["drift"][0]["on_disk_source"] == "World" and report["font_glyphs_added"] == report["font_atlas_writes"] == 1
    a = utf.read_cpk((tmp_path / "out" / "one.cpk").read_bytes())
    spc = archive.read_spc(a.get("d", "a.spc").data)
    assert text.read_stx(spc.get("t.stx").data)[0].entries == [(0, "Hello"), (1, "Welt"), (0, "wieder")]
    assert spc.get("k.bin").data == b"keep" and [f.data for f in a.files[1:3]] == [b"raw", b"first"]
    assert text.read_stx(archive.read_spc(a.files[3].data).get("t.stx").data)[0].entries[1] == (1, "Welt")
    assert read_font(spc)[0].glyphs[-1] == (228, 7, 6, 1, 2, 0, 0, 0)
    same = utf.read_cpk((tmp_path / "out" / "two.cpk").read_bytes())
    assert same.get("d", "a.spc").data == b"two's"
    tree = plan.write(out, paths, str(tmp_path / "tree"), "extract")
    assert (tmp_path / "tree/d/a.spc").read_bytes() == b"two's" and {"path": "d/a.spc", "kept_from_cpk": "two.cpk", "replaced_from_cpk": "one.cpk"} in tree["extract_collisions"]
    found, clean = plan.validate(spark, patch, plan.archives(spark, paths))
    assert not clean and found["applied"] == 2 and found["skipped"] == 1
    assert plan.summary(patch) == {"one.cpk": {"stx": 3, "merge": 1, "replace": 0}}
    with pytest.raises(PatchError, match="DRIFT"):
        plan.apply(spark, patch, plan.archives(spark, paths), "error")
    with pytest.raises(PatchError, match="OVERLAP"):
        plan.write(out, paths, str(tmp_path / "in" / "sub"))
    with pytest.raises(PatchError, match="UNKNOWN_ARCHIVE"):
        plan.apply(spark, plan.load([document(tmp_path, "u.json", [texts("d/a.spc", (0, 0, "a", "b"), cpk="x.cpk")])]), plan.archives(spark, paths))
    with pytest.raises(PatchError, match="DUPLICATE_ARCHIVE"):
        plan.archives(spark, [paths[0], paths[0]])


@pytest.mark.parametrize(
    "groups",
    [
        [texts("p", (0, 0, "a", "b"), (0, 0, "a", "c"))], [{"format": "what"}], [texts("p") | {"more": 1}],
        [{"format": "font", "cpk": "a", "cpk_path": "b", "spc_member": "c", "mode": "replace", "glyphs": [{"codepoint": 1}]}],
        [{"format": "font", "cpk": "a", "cpk_path": "b", "spc_member": "c", "mode": "replace", "atlas": {"width": 1, "height": 1}, "glyphs": [{"codepoint": 1}]}],
        [{"format": "font", "cpk": "a", "cpk_path": "b", "spc_member": "c", "mode": "merge", "glyphs": [{"codepoint": 65}, {"codepoint": 65}]}],
        [{"format": "font", "cpk": "a", "cpk_path": "b", "spc_member": "c", "mode": "merge", "glyphs": [{"codepoint": 65, "char": "B"}]}],
        [{"format": "font", "cpk": "a", "cpk_path": "b", "spc_member": "c", "mode": "merge", "glyphs": [{"codepoint": 65, "size": {"width": 300, "height": 1}}]}],
    ],
)
def test_documents_are_strict(tmp_path, groups):
    with pytest.raises(exchange.BadDocument):
        plan.load([document(tmp_path, "d.json", groups)])


def test_languages_are_the_first_that_are_given(tmp_path):
    docs = [document(tmp_path, f"{i}.json", [], **m) for i, m in enumerate(({}, {"source_language": "en"}, {"source_language": "fr", "target_language": "de"}))]
    patch = plan.load(docs)
    assert (patch.source_language, patch.target_language) == ("en", "de")
    with pytest.raises(exchange.BadDocument):
        plan.load([document(tmp_path, "s.json", [], schema="translate/v2")])


def test_exchange_round_trips(tmp_path):
    stx = [text.StringTable(1, [(0, "é"), (0, "x")])]
    wrd = text.Script(5, [(75, [1, 2])], [(1, 16)], [("start", 0)], ["p"], ["s"], 1)
    d = dat.Dat([("a", "u32", 1), ("b", "utf16", 2)], [[[1], ["x", "y"]]])
    f = font.Font("F", 6, 100, 1, [(65, 1, 2, 3, 4, -5, 6, -7)])
    for kind, value in (("stx", stx), ("wrd", wrd), ("dat", d), ("spft", f)):
        _, _, to_json, from_json = cli.FORMS[kind]
        doc = json.loads(exchange.dumps(to_json(value)))
        assert from_json(doc) == value
        with pytest.raises(exchange.BadDocument):
            from_json(doc | {"schema": f"{kind}/v2"})
        with pytest.raises(exchange.BadDocument):
            from_json(doc | {"unknown": 1})
    a = new_archive([utf.File("d", "x", 3, "u", {"k": b"\1"}, b"body")], 64, [utf.Column("k", "per_row", "data")])
    a.packets = {"Etoc": b"e"}
    back = exchange.cpk_from_json(json.loads(exchange.dumps(exchange.cpk_to_json(a))), {"d/x": b"body", "_etoc.bin": b"e"}.get)
    assert utf.write_cpk(back) == utf.write_cpk(a)
    for path in ("/abs", "../up", "a//b", "a\\b", "."):
        doc = exchange.cpk_to_json(a)
        doc["files"][0]["path"] = path
        with pytest.raises(exchange.BadDocument):
            exchange.cpk_from_json(doc, None)


def test_command_line(tmp_path, capsys):
    paths = make_archives(tmp_path)
    assert cli.main(["cpk", "list", paths[0]]) == 0 and "4 files" in capsys.readouterr().out
    assert cli.main(["cpk", "extract", paths[0], str(tmp_path / "x")]) == 0
    assert cli.main(["cpk", "pack", str(tmp_path / "x"), str(tmp_path / "again.cpk")]) == 0
    assert [f.path for f in utf.read_cpk((tmp_path / "again.cpk").read_bytes()).files] == ["d/a.spc", "r.bin", "d/old.spc", "d/old.spc"]
    spc = str(tmp_path / "x/d/a.spc")
    assert cli.main(["spc", "extract", spc, str(tmp_path / "s")]) == 0 and cli.main(["spc", "pack", str(tmp_path / "s"), str(tmp_path / "s.spc")]) == 0
    assert (tmp_path / "s.spc").read_bytes() == open(spc, "rb").read()
    assert cli.main(["stx", "dump", str(tmp_path / "s/t.stx"), str(tmp_path / "t.json")]) == 0 and cli.main(["stx", "build", str(tmp_path / "t.json"), str(tmp_path / "t.stx")]) == 0
    assert (tmp_path / "t.stx").read_bytes() == (tmp_path / "s/t.stx").read_bytes()
    assert cli.main(["roundtrip", spc, str(tmp_path / "t.stx"), str(tmp_path / "s/f.stx"), paths[0]]) == 0
    (tmp_path / "w.wrd").write_bytes(text.write_wrd(text.Script(commands=[(0x1D, [0]), (0x4B, [3]), (0x1D, []), (0x4B, [4])], params=["C001"])))
    capsys.readouterr()
    assert cli.main(["wrd", "dialogue", str(tmp_path / "w.wrd")]) == 0 and capsys.readouterr().out == "C001\t3\n<unknown>\t4\n"
    assert cli.main(["srd", "inspect", str(tmp_path / "s/f.stx")]) == 0 and "  $RSI" in capsys.readouterr().out
    bad = archive.write_spc(archive.Spc(members=[archive.Member(b"../escaped.txt", 1, 0, b"x")]))
    (tmp_path / "bad.spc").write_bytes(bad)
    assert cli.main(["spc", "extract", str(tmp_path / "bad.spc"), str(tmp_path / "o/p")]) == 1 and not (tmp_path / "o/escaped.txt").exists()


def test_sources(spark, tmp_path):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "é", [1.5, 2.0], 2**40), (2, "", [0.0, -1.0], -1)], "a int, s string, v array<float>, big bigint")
    rows = rows.withMetadata("v", {"dat.type": "f32", "dat.count": 2}).coalesce(1)
    rows.write.format("dat").mode("append").save(str(tmp_path / "dat"))
    back = spark.read.format("dat").load(str(tmp_path / "dat"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert back.schema["v"].metadata == {"dat.type": "f32", "dat.count": 2}
    make_archives(tmp_path)
    toc = spark.read.format("cpk").option("includeData", "false").load(str(tmp_path / "in"))
    assert toc.count() == 5 and toc.where("data is not null").count() == 0
    spark.read.format("cpk").option("partitionBytes", 10).load(str(tmp_path / "in/one.cpk")).write.format("cpk").mode("append").save(str(tmp_path / "copy"))
    copy = utf.read_cpk((tmp_path / "copy/one.cpk").read_bytes())
    assert copy.files == utf.read_cpk((tmp_path / "in/one.cpk").read_bytes()).files
    t = utf.Table("T", [utf.Column("u", "per_row", "u64"), utf.Column("c", "constant", "string", "k"), utf.Column("u", "per_row", "u64")], [{"u": 2**64 - 1}])
    (tmp_path / "t.utf").write_bytes(utf.write_utf(t))
    got = spark.read.format("utf").load(str(tmp_path / "t.utf")).first()
    assert int(got.u) == 2**64 - 1 and got.c == "k"
    again = spark.read.format("utf").load(str(tmp_path / "t.utf")).coalesce(1)
    again.write.format("utf").mode("append").save(str(tmp_path / "utf"))
    back = spark.read.format("utf").load(str(tmp_path / "utf"))
    assert back.collect() == again.collect() and back.schema["c"].metadata["utf.storage"] == "constant"


def test_whole_file_formats_round_trip_through_spark(spark, tmp_path):
    spc = archive.write_spc(archive.Spc(b"\1" * 36, 7, [archive.Member(b"a", 2, 3, b"abcabcabc"), archive.Member(b"\xff", 1, 0, b"")]))
    wrd = text.write_wrd(text.Script(1, [(75, [1]), (1, [])], [(2, 3)], [("l", 4)], ["p", "q"], None, 9))
    every = {"spc": spc, "wrd": wrd, "stx": text.write_stx([text.StringTable(1, [(5, "x")])]), "srd": glyph_font()[0].data, "spft": font.write_spft(font.Font("F", glyphs=[(65, 1, 2, 3, 4, -5, 6, -7)]))}
    for kind, raw in every.items():
        content = spark.createDataFrame([(f"f.{kind}", bytearray(raw))], "path string, content binary")
        back = getattr(members, f"build_{kind}")(getattr(members, f"parse_{kind}")(content))
        assert tuple(files.round_trip(content, back).first()) == (f"f.{kind}", True, None), kind
    named = members.parse_wrd(spark.createDataFrame([("w", bytearray(wrd))], "path string, content binary"))
    assert members.params(named).count() == 2 and members.commands(named).count() == 2
    files.write_files(spark.createDataFrame([("d/x.bin", bytearray(b"1"))], "path string, content binary"), str(tmp_path / "o"))
    assert (tmp_path / "o/d/x.bin").read_bytes() == b"1"
    for bad in ("/a", "../a", "a/../b", "a\\b", ""):
        with pytest.raises(ValueError):
            files.inside("/tmp/x", bad)
    textures = spark.createDataFrame([(font.BC4, 4, 4, bytearray([5, 5, 0, 0, 0, 0, 0, 0]))], "format int, width int, height int, data binary")
    assert bytes(members.decode_textures(textures).first().alpha) == b"\5" * 16


def test_no_task_gets_all_entries_of_a_member(spark):
    import re

    e = spark.createDataFrame([("a.cpk", "/f", "m", 0, k, k, f"s{k}", "t") for k in range(50)], "cpk string, cpk_path string, spc_member string, table_idx int, id bigint, ord bigint, source string, target string")
    s = spark.createDataFrame([("a.cpk", "f", "m", 0, k, k, f"s{k}") for k in range(0, 50, 2)], "cpk string, cpk_path string, spc_member string, table_idx int, pos bigint, id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit, missing = patching.resolve(e, s)
        shuffled = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", hit._jdf.queryExecution().executedPlan().toString())
        assert shuffled and all(re.search(r"\bid#", keys) for keys in shuffled)
        assert sorted(r.id for r in hit.collect()) == list(range(0, 50, 2))
        assert sorted(r.id for r in missing.collect()) == list(range(1, 50, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
