"""Operators over ordered rows: carried-forward values, prefix sums, pools, overlays and sparse indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalar import align_up, utf16_bytes

#: Parts that a prefix sum over a whole table is made in.
PARTS = 64


def carry_forward(df: DataFrame, keys: list[str], order: list[str], sets: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the last row, up to and with this one, for which `sets` holds; a null that was set stays a null.

    The value is wrapped before it is carried, so that setting nothing differs from not setting."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last_value(F.when(sets, F.struct(value.alias("v"))), ignoreNulls=F.lit(True)).over(w)["v"])


def dialogue_lines(commands: DataFrame, speakers: tuple[int, ...] = (0x1D, 0x22), line: int = 0x4B) -> DataFrame:
    """(path, seq, speaker_param, string_id) of the lines in commands (path, seq, opcode, args)."""
    first = F.get("args", F.lit(0))
    said = carry_forward(commands, ["path"], ["seq"], F.col("opcode").isin(*speakers), first, "speaker_param")
    return said.where((F.col("opcode") == line) & (F.size("args") > 0)).select("path", "seq", "speaker_param", first.alias("string_id"))


def named_lines(lines: DataFrame, params: DataFrame) -> DataFrame:
    """Lines with the speaker's name from params (path, idx, name); unknown ones as `<unknown>`."""
    p = params.select("path", F.col("idx").alias("speaker_param"), F.col("name").alias("speaker"))
    return lines.join(p, ["path", "speaker_param"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("<unknown>")))


def prefix_sum(df: DataFrame, order: str, size: Column, name: str, parts: int = PARTS) -> DataFrame:
    """Adds the sum of `size` over all rows of a smaller `order`, a unique number, without gathering rows in one task.

    Rows are cut into ranges of `order` that hold about as many rows each; each range is summed on its own, and a table with
    one row a range adds what lies before."""
    part, own_size, total, base, own_sum = (_fresh(df, c) for c in ("part", "size", "total", "base", "own"))
    cuts = sorted({c for c in df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)})
    rows = df.withColumn(part, F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)).withColumn(own_size, size.cast("bigint"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(part).agg(F.sum(own_size).alias(total)).select(part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    own = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn(own_sum, F.coalesce(F.sum(own_size).over(own), F.lit(0)))
    # one row for each of at most `parts` ranges
    return within.join(F.broadcast(sums), part).withColumn(name, F.col(base) + F.col(own_sum)).drop(part, own_size, own_sum, base)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def string_pool(df: DataFrame, text: str, pos: str) -> DataFrame:
    """(text, pos, offset): distinct texts by first appearance, and where each begins in a pool of UTF-16 texts with final zeros."""
    first = df.groupBy(text).agg(F.min(pos).alias(pos))
    return prefix_sum(first, pos, utf16_bytes(F.col(text)) + 2, "offset")


def aligned_layout(df: DataFrame, order: str, size: Column, align: int) -> DataFrame:
    """Adds the place at which each row's body begins when all begin on `align`."""
    return prefix_sum(df, order, align_up(size, align), "offset")


def overlay(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `replaces`, the order of the row of the same key that this one replaces, and `survives`: the last one does."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("replaces", F.lag(order).over(w)).withColumn("survives", F.lead(order).over(w).isNull())


def charset_index(chars: DataFrame, codepoint: str = "cp", cap: int = 0xD800) -> DataFrame:
    """(cp, idx, base): rank of each code point, and the first rank in its window of 32.

    The input is distinct code points, at most as many as Unicode has."""
    i = chars.where(F.col(codepoint) < cap).select(F.col(codepoint).alias("cp"), (F.row_number().over(Window.orderBy(codepoint)) - 1).cast("bigint").alias("idx"))
    return i.select("cp", "idx", F.min("idx").over(Window.partitionBy(F.expr("cp div 32"))).alias("base"))


def characters(df: DataFrame, text: str) -> DataFrame:
    """(cp) distinct code points of a text column."""
    own = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch"))  # a row's own characters once, before any exchange
    return own.where("ch <> ''").select(F.ascii("ch").alias("cp")).distinct()


@F.pandas_udf(T.LongType())
def _first_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if x is None or y is None or x == y:
            out.append(None)
            continue
        n = min(len(x), len(y))
        differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
        out.append(int(differ.argmax()) if differ.any() else n)
    return pd.Series(out, dtype="Int64")


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first byte in which two values differ; their shorter length where one begins the other; null if equal."""
    return _first_difference(a, b)
