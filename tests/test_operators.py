"""Ordered-row operators, scalar expressions, and every query against its SQL."""

import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import scalar
from tessella.operators import ordered, patching
from tessella.plans import bridge


def _plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(bridge.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_prefix_sum_matches_a_running_total(spark):
    r = random.Random(1)
    for n, spread in ((0, 1), (1, 5), (500, 3), (500, 10**9)):
        keys = sorted(r.sample(range(-spread * n, spread * n + 2), n))
        rows = [(k, r.randrange(100)) for k in keys]
        got = {x.k: x.s for x in ordered.prefix_sum(spark.createDataFrame(rows, "k bigint, v int"), "k", F.col("v"), "s", 7).collect()}
        total, want = 0, {}
        for k, v in rows:
            want[k] = total
            total += v
        assert got == want


def test_dialogue_resets_and_names(spark):
    rows = [("a", 0, 29, [3]), ("a", 1, 75, [1]), ("a", 2, 29, []), ("a", 3, 75, [9, 8]), ("a", 4, 75, []), ("a", 5, 10, [1]), ("b", 0, 75, [5])]
    lines = ordered.dialogue_lines(spark.createDataFrame(rows, "path string, seq int, opcode int, args array<int>"))
    params = spark.createDataFrame([("a", 3, "C003")], "path string, idx int, name string")
    got = sorted((r.path, r.seq, r.speaker_param, r.string_id, r.speaker) for r in ordered.named_lines(lines, params).collect())
    assert got == [("a", 1, 3, 1, "C003"), ("a", 3, None, 9, "<unknown>"), ("b", 0, None, 5, "<unknown>")]


def test_scalar_expressions(spark):
    row = spark.createDataFrame([("a/b/c.stx", "x", "é😀", 5, "FONT.SRD")], "p string, q string, t string, n int, f string")
    d, f = scalar.split_path(F.col("p"))
    d2, f2 = scalar.split_path(F.col("q"))
    got = row.select(d, f, d2, f2, scalar.utf16_bytes(F.col("t")), scalar.align_up(F.col("n"), 4), scalar.align_up(F.lit(8), 4), scalar.join_path(F.lit("a"), F.lit("b")), scalar.join_path(F.lit(""), F.lit("b")), scalar.sidecar_name(F.col("f")), scalar.char_matches(F.lit("ä"), F.lit(228)), scalar.bc4_size(F.lit(5), F.lit(4))).first()
    assert list(got) == ["a/b", "c.stx", "", "x", 6, 8, 8, "a/b", "b", "FONT.srdv", True, 8]
    kinds = spark.createDataFrame([("a.stx", bytearray(b"STXT")), ("a.stx", bytearray(b"SpFt")), ("a.stx", bytearray(b"$CFH")), ("a.WRD", bytearray(b"")), ("x", bytearray(b"CPK ")), ("x", bytearray(b"?"))], "p string, c binary")
    assert [r[0] for r in kinds.select(scalar.file_kind(F.col("p"), F.col("c"))).collect()] == ["stx", "spft", "srd", "wrd", "cpk", None]
    for bad in ("/a", "a//b", "../a", "a\\b", "."):
        with pytest.raises(Exception, match="UNSAFE_PATH"):
            spark.range(1).select(scalar.strict_path(F.concat(F.lit(bad), F.when(F.col("id") > 5, "x").otherwise("")))).collect()
    for bad in ("abc", "zz"):
        with pytest.raises(Exception, match="BAD_HEX"):
            spark.range(1).select(scalar.from_hex(F.concat(F.lit(bad), F.when(F.col("id") > 5, "x").otherwise("")))).collect()


def test_first_difference(spark):
    r = random.Random(2)
    pairs = [(bytes(r.choices(b"ab", k=r.randrange(40))), bytes(r.choices(b"ab", k=r.randrange(40)))) for _ in range(200)] + [(b"same", b"same"), (b"", b"x")]
    for a, _ in pairs[:50]:
        pairs.append((a, a[:-1] + b"z"))
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")
    got = [x[0] for x in df.select(ordered.first_difference(F.col("a"), F.col("b"))).collect()]
    want = [None if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairs]
    assert got == want


def test_upsert_and_overlay(spark):
    old = spark.createDataFrame([(1, 10, 1), (2, 20, 2)], "k int, x int, y int")
    new = spark.createDataFrame([(2, None, 9), (3, 30, None)], "k int, x int, y int")
    assert sorted(map(tuple, patching.upsert(old, new, ["k"]).collect())) == [(1, 10, 1), (2, 20, 9), (3, 30, None)]
    assert sorted(map(tuple, patching.upsert(old, new, ["k"], replace=True).collect()), key=str) == [(2, None, 9), (3, 30, None)]
    layers = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "p string, o int")
    assert sorted((r.p, r.o, r.replaces, r.survives) for r in ordered.overlay(layers, "p", "o").collect()) == [("a", 1, None, False), ("a", 2, 1, True), ("b", 1, None, True)]


def test_plans_prune_and_push_down(spark, sf_dir):
    plan = lambda df: df._jdf.queryExecution().toString()
    q = entry.queries()
    scan = plan(q["groups_by_kind"](spark, sf_dir))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string>" in scan
    assert "In(opcode" not in plan(q["dialogue_lines"](spark, sf_dir)) and plan(q["dialogue_lines"](spark, sf_dir)).count("Exchange hashpartitioning") >= 1
    assert "Exchange SinglePartition" not in plan(q["overlay_collisions"](spark, sf_dir))


def test_importing_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), check=True, timeout=120)


def test_small_tables_are_spread_and_large_ones_left(spark, sf_dir):
    from tessella.functions.partitioning import spread

    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "REPARTITION_BY_NUM" in spread(small)._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert spread(small) is small
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(spread(small).collect()) == sorted(small.collect())


def test_prefix_sums_with_outliers_and_clashing_names(spark):
    ids = [*range(500), 10**12, 2 * 10**12]
    df = spark.createDataFrame([(i, i % 7, 1) for i in ids], "id bigint, size int, part int").repartition(5)
    got = {r.id: r.offset for r in ordered.prefix_sum(df, "id", F.col("size"), "offset").collect()}
    assert got == {i: sum(j % 7 for j in ids if j < i) for i in ids}
    assert ordered.prefix_sum(df.where("false"), "id", F.col("size"), "offset").count() == 0
    parts = ordered.prefix_sum(df, "id", F.col("size"), "offset").columns
    assert parts == ["id", "size", "part", "offset"]


def test_archives_keep_their_own_columns(spark, tmp_path):
    from tessella.sources import tables

    tables.register(spark)
    rows = [("a.cpk", 0, "", "x", 1, "", '{"Crc": {"type": "u32", "value": 7}, "Raw": {"type": "data", "value": "0aff"}}', 1, bytearray(b"q")), ("a.cpk", 1, "", "y", 2, "", "{}", 1, bytearray(b"r"))]
    spark.createDataFrame(rows, tables.CPK).write.format("cpk").mode("append").save(str(tmp_path / "o"))
    back = spark.read.format("cpk").load(str(tmp_path / "o")).orderBy("ord").collect()
    assert [tables.untagged(r.extra) for r in back] == [{"Crc": 7, "Raw": b"\x0a\xff"}, {"Crc": 0, "Raw": b""}]
    mixed = [rows[0], (*rows[1][:6], '{"Crc": {"type": "u64", "value": 7}}', *rows[1][7:])]
    with pytest.raises(Exception, match="MIXED_KINDS"):
        spark.createDataFrame(mixed, tables.CPK).coalesce(1).write.format("cpk").mode("append").save(str(tmp_path / "p"))


def test_the_first_language_that_is_given(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (4, "de"), (3, "fr")], "k int, lang string")
    assert [r.lang for r in patching.first_nonempty(df, "lang", "k").collect()] == ["fr"]
    assert [r.lang for r in patching.first_nonempty(df.where("k < 3"), "lang", "k").collect()] == [None]
