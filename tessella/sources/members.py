"""Formats of which a whole file is one record: read from and written to rows (path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..codecs import archive, font, text

#: Parsed rows that are handed on together.
ROWS = 20_000

SPC = "path string, ord int, name binary, compression_flag int, unknown_flag int, data binary, unknown1 binary, unknown2 bigint"
STX = "path string, table_idx int, unknown bigint, pos int, id bigint, text string"
WRD = "path string, kind string, seq int, opcode int, args array<int>, name string, a bigint, b bigint"
SRD = (
    "path string, node_id int, parent_id int, depth int, ord int, magic string, unknown_0c bigint, "
    "txr struct<unknown_10: int, swizzle: int, width: int, height: int, scanline: int, format: int, unknown_1d: int, palette: int, palette_id: int>, "
    "rsi struct<unknown_10: int, unknown_11: int, unknown_12: int, fallback_count: int, count: int, fallback_size: int, size: int, unknown_1a: int, info: array<array<bigint>>, data: binary, strings: array<binary>>, data binary"
)
SPFT = "path string, font_name string, unknown6 bigint, bit_flags bigint, scale_flag bigint, codepoint int, x int, y int, width int, height int, kern_left int, kern_right int, kern_vertical int"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _spc(path: str, data: bytes) -> Iterator[tuple]:
    a = archive.read_spc(data)
    for i, m in enumerate(a.members):
        yield path, i, m.name, m.flag, m.unknown, m.data, a.unknown1, a.unknown2


def _stx(path: str, data: bytes) -> Iterator[tuple]:
    for k, t in enumerate(text.read_stx(data)):
        for i, (id, s) in enumerate(t.entries):
            yield path, k, t.unknown, i, id, s


def _wrd(path: str, data: bytes) -> Iterator[tuple]:
    s = text.read_wrd(data)
    yield path, "header", 0, None, None, None, s.unknown, s.external
    for i, (opcode, args) in enumerate(s.commands):
        yield path, "command", i, opcode, args, None, None, None
    for i, (a, b) in enumerate(s.branches):
        yield path, "branch", i, None, None, None, a, b
    for i, (name, at) in enumerate(s.labels):
        yield path, "label", i, None, None, name, at, None
    for i, name in enumerate(s.params):
        yield path, "param", i, None, None, name, None, None
    for i, name in enumerate(s.strings or ()):
        yield path, "string", i, None, None, name, None, None


def _srd(path: str, data: bytes) -> Iterator[tuple]:
    for r in font.flatten(font.read_srd(data)):
        yield path, r["node_id"], r["parent_id"], r["depth"], r["ord"], r["magic"], r["unknown_0c"], r["txr"], r["rsi"], r["data"]


def _spft(path: str, data: bytes) -> Iterator[tuple]:
    f = font.read_spft(data)
    for g in f.glyphs:
        yield path, f.name, f.unknown6, f.flags, f.scale, *g


def _parse(content: DataFrame, parse: Callable, schema: str) -> DataFrame:
    names = [c.split()[0] for c in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows += parse(path, bytes(data))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return content.select("path", "content").mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def parse_spc(content: DataFrame) -> DataFrame:
    return _parse(content, _spc, SPC)


def parse_stx(content: DataFrame) -> DataFrame:
    return _parse(content, _stx, STX)


def parse_wrd(content: DataFrame) -> DataFrame:
    return _parse(content, _wrd, WRD)


def parse_srd(content: DataFrame) -> DataFrame:
    return _parse(content, _srd, SRD)


def parse_spft(content: DataFrame) -> DataFrame:
    return _parse(content, _spft, SPFT)


def read_spc(spark: SparkSession, path: str) -> DataFrame:
    return parse_spc(files(spark, path))


def read_stx(spark: SparkSession, path: str) -> DataFrame:
    return parse_stx(files(spark, path))


def read_wrd(spark: SparkSession, path: str) -> DataFrame:
    return parse_wrd(files(spark, path))


def read_srd(spark: SparkSession, path: str) -> DataFrame:
    return parse_srd(files(spark, path))


def read_spft(spark: SparkSession, path: str) -> DataFrame:
    return parse_spft(files(spark, path))


def commands(wrd: DataFrame) -> DataFrame:
    return wrd.where("kind = 'command'").select("path", "seq", "opcode", "args")


def params(wrd: DataFrame) -> DataFrame:
    return wrd.where("kind = 'param'").select("path", F.col("seq").alias("idx"), "name")


def _build(df: DataFrame, build: Callable[[list[dict]], bytes]) -> DataFrame:
    """(path, content): one file of the rows of each path."""

    def made(files: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in files], pa.string()), pa.array([c for _, c in files], pa.binary())], names=["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if rows and r["path"] != rows[0]["path"]:
                    done.append((rows[0]["path"], build(rows)))
                    rows = []
                rows.append(r)
            if done:
                yield made(done)
        if rows:
            yield made([(rows[0]["path"], build(rows))])

    # files follow each other within a partition, so that one at a time is held
    return df.repartition("path").sortWithinPartitions("path").mapInArrow(run, "path string, content binary")


def build_spc(df: DataFrame) -> DataFrame:
    def build(rows: list[dict]) -> bytes:
        rows.sort(key=lambda r: r["ord"])
        first = rows[0]
        return archive.write_spc(archive.Spc(bytes(first["unknown1"]), int(first["unknown2"]), [archive.Member(bytes(r["name"]), int(r["compression_flag"]), int(r["unknown_flag"]), bytes(r["data"])) for r in rows]))

    return _build(df, build)


def build_stx(df: DataFrame) -> DataFrame:
    def build(rows: list[dict]) -> bytes:
        tables: dict[int, text.StringTable] = {}
        for r in sorted(rows, key=lambda r: (r["table_idx"], r["pos"])):
            tables.setdefault(int(r["table_idx"]), text.StringTable(int(r["unknown"]))).entries.append((int(r["id"]), r["text"]))
        return text.write_stx([tables.get(i, text.StringTable()) for i in range(max(tables) + 1)])

    return _build(df, build)


def build_wrd(df: DataFrame) -> DataFrame:
    def build(rows: list[dict]) -> bytes:
        kinds: dict[str, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            kinds.setdefault(r["kind"], []).append(r)
        head = kinds["header"][0]
        named = lambda k: [r["name"] for r in kinds.get(k, [])]
        return text.write_wrd(text.Script(int(head["a"]), [(int(r["opcode"]), [int(a) for a in r["args"]]) for r in kinds.get("command", [])], [(int(r["a"]), int(r["b"])) for r in kinds.get("branch", [])], [(r["name"], int(r["a"])) for r in kinds.get("label", [])], named("param"), named("string") or None, int(head["b"])))

    return _build(df, build)


def build_srd(df: DataFrame) -> DataFrame:
    return _build(df, lambda rows: font.write_srd(font.unflatten(rows)))


def build_spft(df: DataFrame) -> DataFrame:
    def build(rows: list[dict]) -> bytes:
        f = rows[0]
        keys = ("codepoint", "x", "y", "width", "height", "kern_left", "kern_right", "kern_vertical")
        return font.write_spft(font.Font(f["font_name"], int(f["unknown6"]), int(f["bit_flags"]), int(f["scale_flag"]), [tuple(int(r[k]) for k in keys) for r in rows]))

    return _build(df, build)


def decode_textures(df: DataFrame, out: str = "alpha") -> DataFrame:
    """Adds the 8-bit pixels of textures (format, width, height, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [font.decode_atlas(int(f), bytes(d), int(w), int(h)) for f, d, w, h in zip(b["format"], b["data"], b["width"], b["height"])]
            yield b

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))
