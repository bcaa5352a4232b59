"""Spark data sources for self-describing tables and archives: `cpk`, `utf` and `dat`.

Register them with `register(spark)`. Options: `path` (file, folder or pattern); for
`cpk` also `includeData` (false leaves bodies unread) and `partitionBytes`.
"""

from __future__ import annotations

import json
import os
import pickle
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..codecs import dat, utf
from ..codecs.binary import Malformed
from .files import found, inside, local

NUMBER_TYPES = {"u8": T.ShortType(), "s8": T.ByteType(), "u16": T.IntegerType(), "s16": T.ShortType(), "u32": T.LongType(), "s32": T.IntegerType(), "u64": T.DecimalType(20, 0), "s64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType()}


def _value(kind: str, v):
    return Decimal(v) if kind == "u64" and v is not None else v


def _plain(kind: str, v):
    return int(v) if kind == "u64" and v is not None else v


def tagged(columns: list[utf.Column], values: dict) -> str:
    """A row's values with their kinds as JSON, blobs in hex."""
    kinds = {c.name: c.type for c in columns}
    return json.dumps({k: {"type": kinds[k], "value": v.hex() if isinstance(v, bytes) else v} for k, v in values.items()}, ensure_ascii=False)


def untagged(text: str | None) -> dict:
    return {k: bytes.fromhex(v["value"]) if v["type"] == "data" else v["value"] for k, v in json.loads(text or "{}").items()}


@dataclass
class _Part(InputPartition):
    path: str
    first: int = 0
    last: int = -1


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


class DatSource(DataSource):
    """Typed tables: cells of one value are scalars, others arrays; kind and count are in the fields' metadata."""

    @classmethod
    def name(cls) -> str:
        return "dat"

    def schema(self) -> T.StructType:
        with open(found(self.options["path"], ".dat")[0], "rb") as f:
            d = dat.read_dat(f.read())
        return dat_schema(d.schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DatReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _StagedWriter(self.options["path"], overwrite, schema, "dat")


def dat_schema(columns: list[tuple[str, str, int]]) -> T.StructType:
    fields = []
    for name, (_, kind, count) in zip(_unique([c[0] for c in columns]), columns):
        t = NUMBER_TYPES.get(kind, T.StringType())
        fields.append(T.StructField(name, t if count == 1 else T.ArrayType(t), True, {"dat.type": kind, "dat.count": count}))
    return T.StructType(fields)


def dat_columns(schema: T.StructType) -> list[tuple[str, str, int]]:
    """The kinds of a DataFrame's columns: those in its metadata, else by type."""
    plain = {"tinyint": "s8", "smallint": "s16", "int": "s32", "bigint": "s64", "float": "f32", "double": "f64", "string": "utf16", "decimal(20,0)": "u64", "timestamp_ntz": "s64", "boolean": "u8"}
    out = []
    for f in schema:
        if "dat.type" in f.metadata:
            out.append((f.name, f.metadata["dat.type"], f.metadata["dat.count"]))
        elif f.dataType.simpleString() in plain:
            out.append((f.name, plain[f.dataType.simpleString()], 1))
        else:
            raise ValueError(f"NO_KIND: {f.name} of type {f.dataType.simpleString()} needs dat.type and dat.count metadata")
    return out


def dat_rows(columns: list[tuple[str, str, int]], rows) -> list[list[list]]:
    return [[[_plain(kind, x) for x in ([v] if count == 1 and not isinstance(v, list) else v)] for (_, kind, count), v in zip(columns, row)] for row in rows]


class _DatReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(p) for p in found(self.path, ".dat")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            d = dat.read_dat(f.read())
        for row in d.rows:
            yield tuple([_value(kind, v) for v in cell][0] if count == 1 else [_value(kind, v) for v in cell] for (_, kind, count), cell in zip(d.schema, row))


class UtfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "utf"

    def schema(self) -> T.StructType:
        with open(found(self.options["path"], ".utf")[0], "rb") as f:
            t = utf.read_utf(f.read())
        fields: dict[str, T.StructField] = {}
        for c in t.columns:
            if c.name is not None:
                kind = T.StringType() if c.type == "string" else T.BinaryType() if c.type == "data" else NUMBER_TYPES[c.type]
                fields[c.name] = T.StructField(c.name, kind, True, {"utf.type": c.type, "utf.storage": c.storage, "utf.table": t.name})
        return T.StructType(list(fields.values()))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _UtfReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _StagedWriter(self.options["path"], overwrite, schema, "utf")


def utf_columns(schema: T.StructType) -> list[utf.Column]:
    """The columns of a DataFrame as a table's: kinds and storage classes from the metadata, else by type and stored in each row.

    A constant column's value is that of the rows; it is put in by the writer."""
    plain = {"tinyint": "s8", "smallint": "s16", "int": "s32", "bigint": "s64", "float": "f32", "double": "f64", "string": "string", "binary": "data", "decimal(20,0)": "u64"}
    out = []
    for f in schema:
        kind = f.metadata.get("utf.type") or plain.get(f.dataType.simpleString())
        if kind is None:
            raise ValueError(f"NO_KIND: {f.name} of type {f.dataType.simpleString()} needs utf.type metadata")
        out.append(utf.Column(f.name, f.metadata.get("utf.storage", "per_row"), kind))
    return out


class _UtfReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names

    def partitions(self):
        return [_Part(p) for p in found(self.path, ".utf")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            t = utf.read_utf(f.read())
        for row in t.rows:
            yield tuple(_value(t.kind(n), row.get(n)) for n in self.names)


CPK = "archive string, ord int, dir_name string, file_name string, id bigint, user_string string, extra string, size bigint, data binary"


class CpkSource(DataSource):
    """Files of archives. Only byte ranges of wanted bodies are read."""

    @classmethod
    def name(cls) -> str:
        return "cpk"

    def schema(self) -> str:
        return CPK

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _CpkReader(self.options["path"], str(self.options.get("includeData", "true")).lower() != "false", int(self.options.get("partitionBytes", 64 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _StagedWriter(self.options["path"], overwrite, schema, "cpk", int(self.options.get("align", 0x800)))


def _toc(path: str):
    with open(path, "rb") as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return utf.read_toc(read, os.path.getsize(path))


class _CpkReader(DataSourceReader):
    def __init__(self, path: str, data: bool, most: int):
        self.path, self.data, self.most = path, data, most

    def partitions(self):
        parts = []
        for p in found(self.path, ".cpk"):
            files = _toc(p)[2]
            begin = total = 0
            for i, (_, _, size) in enumerate(files):
                if i > begin and total + size > self.most and self.data:
                    parts.append(_Part(p, begin, i))
                    begin, total = i, 0
                total += size
            parts.append(_Part(p, begin, len(files)))
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        _, toc, files, _ = _toc(partition.path)
        with open(partition.path, "rb") as f:
            for i in range(partition.first, partition.last):
                file, at, size = files[i]
                data = None
                if self.data:
                    f.seek(at)
                    data = f.read(size)
                yield os.path.basename(partition.path), i, file.dir, file.name, file.id, file.user, tagged(toc.columns, file.extra), size, data


@dataclass
class _Staged(WriterCommitMessage):
    path: str


class _StagedWriter(DataSourceWriter):
    """Tasks put their rows into a staging folder beside the target; the commit puts each output file together."""

    def __init__(self, path: str, overwrite: bool, schema: T.StructType, kind: str, align: int = 0x800):
        self.path, self.overwrite, self.kind, self.align = local(path), overwrite, kind, align
        self.names, self.schema = schema.names, schema
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> _Staged:
        os.makedirs(self.staging, exist_ok=True)
        to = f"{self.staging}/{uuid.uuid4().hex}"
        with open(to, "wb") as f:
            for r in rows:
                pickle.dump(tuple(r), f)
        return _Staged(to)

    def _rows(self, messages) -> Iterator[tuple]:
        for m in messages:
            if m is not None:
                with open(m.path, "rb") as f:
                    while True:
                        try:
                            yield pickle.load(f)
                        except EOFError:
                            break

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for p in found(self.path, "." + self.kind):
                os.remove(p)
        try:
            for name, content in {"dat": self._dat, "cpk": self._cpk, "utf": self._utf}[self.kind](messages):
                part = f"{self.path}/_{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, inside(self.path, name))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

    def _dat(self, messages) -> Iterator[tuple[str, bytes]]:
        columns = dat_columns(self.schema)
        for i, m in enumerate(messages):
            rows = dat_rows(columns, self._rows([m]))
            if rows:  # a table without rows can't be read
                yield f"part-{i:05d}.dat", dat.write_dat(dat.Dat(columns, rows))

    def _utf(self, messages) -> Iterator[tuple[str, bytes]]:
        table = next((f.metadata["utf.table"] for f in self.schema if "utf.table" in f.metadata), "Table")
        for i, m in enumerate(messages):
            columns = utf_columns(self.schema)
            rows = [{c.name: _plain(c.type, v if v is not None else utf.zero(c.type)) for c, v in zip(columns, r)} for r in self._rows([m])]
            for c in columns:
                if c.storage.startswith("constant"):
                    values = [r[c.name] for r in rows]
                    if any(v != values[0] for v in values):
                        raise ValueError(f"NOT_CONSTANT: {c.name}")
                    c.constant = values[0] if values else utf.zero(c.type)
            yield f"part-{i:05d}.utf", utf.write_utf(utf.Table(table, columns, rows))

    def _cpk(self, messages) -> Iterator[tuple[str, bytes]]:
        by: dict[str, list[dict]] = {}
        for r in self._rows(messages):
            row = dict(zip(self.names, r))
            by.setdefault(row["archive"], []).append(row)
        for name, rows in sorted(by.items()):
            rows.sort(key=lambda r: r["ord"])
            kinds: dict[str, str] = {}
            for r in rows:
                for k, v in json.loads(r.get("extra") or "{}").items():
                    if kinds.setdefault(k, v["type"]) != v["type"]:
                        raise ValueError(f"MIXED_KINDS: {k} is {kinds[k]} and {v['type']} in {name}")
            extra = [utf.Column(k, "per_row", kind) for k, kind in kinds.items()]
            zeros = {k: utf.zero(kind) for k, kind in kinds.items()}
            yield name, utf.write_cpk(new_archive([utf.File(r.get("dir_name") or "", r["file_name"], r.get("id") or 0, r.get("user_string") or "", zeros | untagged(r.get("extra")), bytes(r["data"] or b"")) for r in rows], self.align, extra))


def new_archive(files: list[utf.File], align: int = 0x800, extra: list[utf.Column] | None = None) -> utf.Cpk:
    """An archive with a plain header; `extra` are columns of the table of contents besides the usual ones."""
    if align < 1 or align & align - 1 or align > 0x8000:
        raise Malformed(0, f"an alignment of {align}")
    names = [n + s for n in ("Content", "Toc", *utf.EXTRA_PACKETS) for s in ("Offset", "Size")]
    columns = [utf.Column(n, "per_row", "u64") for n in names] + [utf.Column("Files", "per_row", "u32"), utf.Column("Align", "per_row", "u16"), utf.Column("Sorted", "per_row", "u16")]
    header = utf.Table("CpkHeader", columns, [dict.fromkeys(names, 0) | {"Files": 0, "Align": align, "Sorted": 1}])
    return utf.Cpk(header, [*utf.TOC_COLUMNS, *(extra or [])], files)


def register(spark: SparkSession) -> None:
    for source in (CpkSource, UtfSource, DatSource):
        spark.dataSource.register(source)
