"""Round trips over tables that are larger than those of the star schema: files become more, not larger."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.plans import bridge, workflows


def _same(df, want):
    """Rows equal, as often as they occur."""
    assert sorted(df.columns) == sorted(want.columns)
    total = lambda x: x.select(F.count("*"), F.sum(F.xxhash64(*sorted(want.columns)).cast("decimal(38,0)"))).first()
    assert total(df) == total(want)


def test_lineitem_of_more_texts_than_the_pools_of_sixteen_files(spark, tmp_path):
    id = F.col("id")
    n = 1_100_000
    rows = spark.range(n).select(id.alias("l_orderkey"), id.alias("l_partkey"), id.alias("l_suppkey"), F.lit(1).cast("bigint").alias("l_linenumber"), *(F.lit(0.5).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), id.cast("string").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit("1995-01-02").cast("timestamp").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    _same(entry.queries()["dat_roundtrip_lineitem"](spark, str(tmp_path)), rows.withColumn("ship_us", F.unix_micros("l_shipdate")).drop("l_shipdate"))


def test_rows_of_a_key_stay_in_one_file(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 25_000, -1).otherwise(F.expr("id div 7")).alias("k"), F.col("id").alias("n"))

    def both(table: pa.Table) -> pa.Table:
        return pa.table({"k": table.column("k"), "n": pa.array([hash((table.column("n")[0].as_py(), len(table)))] * len(table))})

    got = bridge._through(df, both, "k").groupBy("k").agg(F.count("*").alias("c"), F.count_distinct("n").alias("files"))
    assert got.where("files > 1").count() == 0 and got.agg(F.sum("c")).first()[0] == 60_000
    assert bridge._through(df.where("false"), both, "k").count() == 0


def _seen(monkeypatch, module):
    """Makes a task fail whose file holds more than files may."""
    through, rows, size = module._through, 10_000, 8 << 20

    def spy(*args, **more):
        def checked(both):
            def run(table):
                body = table.drop_columns(["__file"]) if "__file" in table.column_names else table
                if len(body) > rows or body.nbytes > size:
                    raise ValueError(f"FILE_TOO_LARGE: {len(body)} rows, {body.nbytes} bytes")
                return both(table)

            return run

        return through(*(checked(a) if callable(a) else a for a in args), **more)

    monkeypatch.setattr(module, "_through", spy)


def test_files_of_exchange_wrd_do_not_grow(spark, tmp_path, monkeypatch):
    _seen(monkeypatch, workflows)
    id = F.col("id")
    rows = spark.range(240_000).select(id.alias("event_id"), F.pmod(id, F.lit(3)).alias("user_id"), (id % 100 + 0.5).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    _same(entry.queries()["exchange_wrd"](spark, str(tmp_path)), rows.select("user_id", "event_id", (F.col("event_id") % 256).alias("opcode"), F.floor("value").cast("bigint").alias("arg")))


def _pages(spark, path, n):
    rows = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.concat(F.lit("<p>"), "id"), 20_000).alias("html"))
    rows.write.parquet(f"{path}/pages.parquet")
    return rows


def test_files_of_exchange_manifests_do_not_grow(spark, tmp_path, monkeypatch):
    _seen(monkeypatch, workflows)
    rows = _pages(spark, tmp_path, 1_000)
    _same(entry.queries()["exchange_manifests"](spark, str(tmp_path)), rows.select("page_id", F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("path"), "html"))


def test_files_of_exchange_dat_do_not_grow(spark, tmp_path, monkeypatch):
    _seen(monkeypatch, workflows)
    rows = spark.range(120_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("p"), "id").alias("p_name"), F.lit(3).cast("bigint").alias("p_size"), F.lit(0.5).alias("p_retailprice"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    _same(entry.queries()["exchange_dat"](spark, str(tmp_path)), rows)


def test_files_of_cpk_roundtrip_do_not_grow(spark, tmp_path, monkeypatch):
    _seen(monkeypatch, bridge)
    rows = _pages(spark, tmp_path, 1_000)
    _same(entry.queries()["cpk_roundtrip"](spark, str(tmp_path)), rows)
