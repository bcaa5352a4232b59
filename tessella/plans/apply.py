"""Patch documents over archives: load, validate, plan as joins, apply, report and write.

Only members that a patch names are unpacked; all others keep their bytes. Text entries
are joined with string-table slots; fonts and containers are rebuilt one SPC to a task.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codecs import archive, text, utf
from ..operators import fonts, patching
from ..operators.patching import PatchError
from ..sources import exchange
from ..sources.exchange import BadDocument, check_tag, fields, whole
from ..sources.files import found, inside, local, overlap

ENTRIES = "cpk string, cpk_path string, spc_member string, table_idx int, id bigint, ord bigint, source string, target string"


@dataclass
class Patch:
    entries: list[tuple] = field(default_factory=list)
    #: (cpk, cpk_path, spc_member, font patch), in order.
    fonts: list[tuple[str, str, str, fonts.FontPatch]] = field(default_factory=list)
    source_language: str = ""
    target_language: str = ""
    #: (cpk, kind) of each group, for the summary.
    groups: list[tuple[str, str]] = field(default_factory=list)


def load(paths: list[str]) -> Patch:
    """Documents in order, as one patch. Slots that two entries name, and inconsistent glyphs, are refused."""
    patch, seen = Patch(), set()
    for path in paths:
        with open(local(path), encoding="utf-8") as f:
            doc = json.load(f)
        check_tag(doc, "translate")
        d = fields(doc, {"schema": str, "files": list}, dict.fromkeys(("source_language", "target_language", "created_at", "title"), str))
        patch.source_language = patch.source_language or d["source_language"] or ""
        patch.target_language = patch.target_language or d["target_language"] or ""
        for group in d["files"]:
            kind = group.get("format") if isinstance(group, dict) else None
            if kind == "stx":
                _load_texts(group, patch, seen)
            elif kind == "font":
                _load_font(group, patch, os.path.dirname(local(path)))
            else:
                raise BadDocument(f"unknown format {kind!r}")
    return patch


def _load_texts(group: dict, patch: Patch, seen: set) -> None:
    g = fields(group, {"format": str, "cpk": str, "cpk_path": str, "spc_member": str, "entries": list}, what="group")
    for e in g["entries"]:
        e = fields(e, {"table": int, "index": int, "source": str, "target": str}, {"context": str}, "entry")
        key = (g["cpk"], g["cpk_path"], g["spc_member"], whole(e["table"], 0, 2**31 - 1, "table"), whole(e["index"], 0, 2**32 - 1, "index"))
        if key in seen:
            raise BadDocument(f"duplicate entry {key}")
        seen.add(key)
        patch.entries.append((*key, len(patch.entries), e["source"], e["target"]))
    patch.groups.append((g["cpk"], "stx"))


def _load_font(group: dict, patch: Patch, base: str) -> None:
    g = fields(group, {"format": str, "cpk": str, "cpk_path": str, "spc_member": str, "mode": str, "glyphs": list}, {"font_name": str, "atlas": dict}, "group")
    if g["mode"] not in ("merge", "replace"):
        raise BadDocument(f"unknown mode {g['mode']!r}")
    made = fonts.FontPatch(g["mode"] == "replace", None, g["font_name"])
    if g["atlas"] is not None:
        a = fields(g["atlas"], {"width": int, "height": int}, what="atlas")
        made.atlas = whole(a["width"], 0, 65535, "width"), whole(a["height"], 0, 65535, "height")
    if made.replace and (made.atlas is None or not g["glyphs"]):
        raise BadDocument("a group that replaces a font needs its atlas and glyphs")
    codes = set()
    for raw in g["glyphs"]:
        p = fields(raw, {"codepoint": int}, {"char": str, "image_path": str, "position": dict, "size": dict, "kerning": dict}, "glyph")
        code = whole(p["codepoint"], 0, 0x10FFFF, "codepoint")
        if code in codes:
            raise BadDocument(f"duplicate glyph U+{code:04X}")
        codes.add(code)
        if p["char"] is not None and (len(p["char"]) != 1 or ord(p["char"]) != code):
            raise BadDocument(f"glyph U+{code:04X} is not {p['char']!r}")
        if made.replace and (lacks := [k for k in ("position", "size", "kerning", "image_path") if p[k] is None]):
            raise BadDocument(f"glyph U+{code:04X} lacks {', '.join(lacks)}")
        glyph = fonts.Glyph(code, *(None if p[k] is None else f(p[k]) for k, f in (("position", exchange.position), ("size", exchange.size), ("kerning", exchange.kerning))))
        if p["image_path"] is not None:
            with open(os.path.join(base, p["image_path"]), "rb") as f:
                width, height, glyph.alpha = fonts.png_alpha(f.read())
            if glyph.size is not None and glyph.size != (width, height):
                raise BadDocument(f"glyph U+{code:04X} is {width} x {height}, not {glyph.size}")
        made.glyphs.append(glyph)
    patch.fonts.append((g["cpk"], g["cpk_path"], g["spc_member"], made))
    patch.groups.append((g["cpk"], g["mode"]))


@dataclass
class Outcome:
    report: dict
    #: (cpk, ord, path, content): rebuilt SPC files.
    changed: DataFrame


def _wanted(spark: SparkSession, patch: Patch, archives: DataFrame) -> DataFrame:
    """SPC files that the patch names: of files with one path the last. Their bodies are the only ones that are read on."""
    paths = sorted({(c, p.lstrip("/")) for c, p, *_ in [*patch.entries, *patch.fonts]})
    keys = spark.createDataFrame(paths, "archive string, path string")
    path = F.when(F.col("dir_name") == "", F.col("file_name")).otherwise(F.concat_ws("/", "dir_name", "file_name"))
    # the keys are those of hand-made documents, held by the driver already
    hit = archives.withColumn("path", path).join(F.broadcast(keys), ["archive", "path"])
    last = hit.groupBy("archive", "path").agg(F.max("ord").alias("ord"))
    return hit.join(last, ["archive", "path", "ord"]).select("archive", "path", "ord", "data")


def _members(files: DataFrame, names: list[str]) -> DataFrame:
    """String-table slots of the named members; an empty one for a member without any, so that it counts as there."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                index = {m.name: m for m in archive.read_spc(r["data"]).members}
                for name in names:
                    m = index.get(name.encode())
                    if m is None:
                        continue
                    rows.append((r["archive"], r["path"], name, None, None, None, None))
                    if m.data[:4] == b"STXT":
                        for k, t in enumerate(text.read_stx(m.data)):
                            rows += [(r["archive"], r["path"], name, k, i, id, s) for i, (id, s) in enumerate(t.entries)]
            kinds = [pa.string()] * 3 + [pa.int32(), pa.int32(), pa.int64(), pa.string()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["cpk", "cpk_path", "spc_member", "table_idx", "pos", "id", "text"])

    return files.select("archive", "path", "data").mapInArrow(run, "cpk string, cpk_path string, spc_member string, table_idx int, pos int, id bigint, text string")


def apply(spark: SparkSession, patch: Patch, archives: DataFrame, policy: str = "warn") -> Outcome:
    """Applies a patch to the files of archives (as `read.format("cpk")` gives them); nothing is written here."""
    names = [r.archive for r in archives.select("archive").distinct().orderBy("archive").collect()]
    unknown = sorted({c for c, _ in patch.groups} - set(names))
    if unknown:
        raise PatchError(f"UNKNOWN_ARCHIVE: {unknown[0]}")
    files = _wanted(spark, patch, archives).persist()
    entries = spark.createDataFrame(patch.entries, ENTRIES)
    slots = _members(files, sorted({e[2] for e in [*patch.entries, *patch.fonts]}))
    present = slots.select(*patching.MEMBER).distinct().persist()
    hit, missing = patching.resolve(entries, slots)
    decided = patching.decide(hit, policy).persist()
    there = {tuple(r) for r in present.collect()}
    paths = {(r.archive, r.path) for r in files.select("archive", "path").collect()}
    lost = [tuple(r) for r in missing.orderBy("cpk", "cpk_path", "spc_member", "table_idx", "id").collect()]
    by_file: dict[tuple[str, str], list] = {}
    for cpk, path, member, made in patch.fonts:
        path = path.lstrip("/")
        if (cpk, path) not in paths:
            lost.append((cpk, path, "", None, None))
        elif (cpk, path, member) not in there:
            lost.append((cpk, path, member, None, None))
        else:
            by_file.setdefault((cpk, path), []).append((member, made))
    new = decided.where("applied").groupBy("cpk", "cpk_path").agg(F.collect_list(F.struct("spc_member", "table_idx", "pos", "ord", "new_text")).alias("new"))
    work = files.join(new.withColumnsRenamed({"cpk": "archive", "cpk_path": "path"}), ["archive", "path"], "left")

    def rebuild(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                todo = by_file.get((r["archive"], r["path"]), [])
                if not r["new"] and not todo:
                    continue
                spc = archive.read_spc(r["data"])
                index, count = {m.name: m for m in spc.members}, dict.fromkeys(fonts.COUNTERS, 0)
                tables = {}
                for e in sorted(r["new"] or [], key=lambda e: e["ord"]):
                    name = e["spc_member"].encode()
                    tables.setdefault(name, None if name in tables else text.read_stx(index[name].data))
                    t = tables[name][e["table_idx"]].entries
                    t[e["pos"]] = (t[e["pos"]][0], e["new_text"])
                for name, t in tables.items():
                    index[name].data = text.write_stx(t)
                for member, made in todo:
                    fonts.patch_font(spc, member, made, count)
                rows.append((r["archive"], r["ord"], r["path"], archive.write_spc(spc), json.dumps(count)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["archive", "ord", "path", "content", "counts"])

    changed = work.select("archive", "path", "ord", "data", "new").mapInArrow(rebuild, "archive string, ord int, path string, content binary, counts string").persist()
    totals = dict.fromkeys(fonts.COUNTERS, 0)
    for r in changed.select("counts").collect():
        for k, v in json.loads(r.counts).items():
            totals[k] += v
    sums = decided.agg(*(F.count_if(c).alias(n) for n, c in (("applied", F.col("applied")), ("already_translated", F.col("already")), ("skipped", ~F.col("applied"))))).first()
    drift = decided.where("drift").orderBy("cpk", "cpk_path", "ord").collect()
    report = sums.asDict() | {
        "drift": [{"cpk": r.cpk, "cpk_path": r.cpk_path, "spc_member": r.spc_member, "table": r.table_idx, "index": r.id, "on_disk_source": r.seen, "json_source": r.source, "applied": r.applied} for r in drift],
        "missing": [{"cpk": c, "cpk_path": p, "spc_member": m, "slot": None if t is None else {"table": t, "index": i}} for c, p, m, t, i in lost],
        "extract_collisions": [],
    }
    return Outcome(report | totals, changed.drop("counts"))


def validate(spark: SparkSession, patch: Patch, archives: DataFrame) -> tuple[dict, bool]:
    """What applying would find, and whether it is clean: neither drift nor missing targets. Drifted entries don't count as applied."""
    out = apply(spark, patch, archives, "skip")
    return out.report, not (out.report["drift"] or out.report["missing"])


def summary(patch: Patch) -> dict[str, dict[str, int]]:
    """Groups by archive and kind."""
    out: dict[str, dict[str, int]] = {}
    for cpk, kind in patch.groups:
        counts = out.setdefault(cpk, {"stx": 0, "merge": 0, "replace": 0})
        counts[kind] += 1
    return out


def write(outcome: Outcome, archives: list[str], out: str, mode: str = "repack") -> dict:
    """Writes whole archives (`repack`) or their files in one tree, later archives over earlier ones (`extract`); the final report."""
    for path in archives:
        if overlap(os.path.dirname(path) or ".", out):
            raise PatchError(f"OVERLAP: {out} and {path}")
    new: dict[str, dict[int, bytes]] = {}
    for r in outcome.changed.toLocalIterator():
        new.setdefault(r.archive, {})[r.ord] = bytes(r.content)
    report, owner = dict(outcome.report), {}
    report["extract_collisions"] = []
    os.makedirs(local(out), exist_ok=True)
    for path in archives:
        name = os.path.basename(path)
        with open(local(path), "rb") as f:
            a = utf.read_cpk(f.read())
        for i, content in new.get(name, {}).items():
            a.files[i].data = content
        if mode == "repack":
            with open(inside(out, name), "wb") as f:
                f.write(utf.write_cpk(a))
            continue
        for file in a.files:
            to = inside(out, file.path)
            if to in owner:
                report["extract_collisions"].append({"path": file.path, "kept_from_cpk": name, "replaced_from_cpk": owner[to]})
            owner[to] = name
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(file.data)
    return report


def archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of all archives. Names must differ, as patches refer to them."""
    names = [os.path.basename(p) for path in paths for p in found(path, ".cpk")]
    if len(set(names)) < len(names):
        raise PatchError(f"DUPLICATE_ARCHIVE: {sorted(n for n in names if names.count(n) > 1)[0]}")
    frames = [spark.read.format("cpk").load(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
