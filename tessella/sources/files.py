"""Paths that sources read and sinks write, guarded."""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql import DataFrame, functions as F


def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def found(path: str, suffix: str = "") -> list[str]:
    """Files of a path, a folder or a pattern, sorted."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "**", "*" + suffix), recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    hits = sorted(glob.glob(path)) or ([path] if os.path.exists(path) else [])
    if not hits:
        raise FileNotFoundError(path)
    return hits


def inside(folder: str, name: str) -> str:
    """The place of a relative path in a folder; empty parts drop out, whatever would leave the folder is refused."""
    if name.startswith(("/", "\\")) or "\\" in name or "\0" in name or (len(name) > 1 and name[1] == ":"):
        raise ValueError(f"UNSAFE_PATH: {name}")
    parts = [p for p in name.split("/") if p]
    if not parts or any(p in (".", "..") for p in parts):
        raise ValueError(f"UNSAFE_PATH: {name}")
    return os.path.join(local(folder), *parts)


def overlap(a: str, b: str) -> bool:
    """Whether one path is, or lies in, the other, links and missing ends taken into account."""
    x, y = (os.path.realpath(local(p)) for p in (a, b))
    return x == y or x.startswith(y + os.sep) or y.startswith(x + os.sep)


def write_files(df: DataFrame, folder: str) -> None:
    """Writes rows (path, content) as files; each appears whole or not at all, so that a repeated task does no harm."""

    def put(rows):
        for r in rows:
            to = inside(folder, r.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(bytes(r.content or b""))
            os.replace(part, to)

    df.select("path", "content").foreachPartition(put)


def round_trip(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, equal, first_diff) of files before and after: rows (path, content)."""
    from ..operators.ordered import first_difference

    b = after.select("path", F.col("content").alias("__after"))
    return before.select("path", "content").join(b, "path").select("path", (F.col("content") == F.col("__after")).alias("equal"), first_difference(F.col("content"), F.col("__after")).alias("first_diff"))
