"""The engine's operators over the star-schema tables, each with the SQL that gives the same rows.

Round-trip queries write a table in a format and parse it again; their SQL reads the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codecs import dat, font, lzss, utf
from ..functions import scalar
from ..functions.partitioning import spread
from ..operators import ordered, patching
from ..sources import members
from ..sources.tables import dat_columns, new_archive

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f, sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- ordered rows


@_query("""select user_id, event_id, struct_extract(last_value(case when event_type in ('signup', 'view') then {'v': value} end ignore nulls)
    over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 'v') speaker from events""")
def dialogue_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    said = ordered.carry_forward(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("signup", "view"), F.col("value"), "speaker")
    return said.select("user_id", "event_id", "speaker")


@_query("""with c as (select user_id path, event_id seq, case event_type when 'signup' then 29 when 'view' then 34 when 'click' then 75 else 0 end opcode, cast(floor(value) as int) arg, value is not null and event_id % 7 <> 0 has from events),
 s as (select *, struct_extract(last_value(case when opcode in (29, 34) then {'v': case when has then arg end} end ignore nulls) over (partition by path order by seq rows between unbounded preceding and current row), 'v') speaker_param from c)
 select path, seq, speaker_param, arg string_id from s where opcode = 75 and has""")
def script_lines(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", 29).when(F.col("event_type") == "view", 34).when(F.col("event_type") == "click", 75).otherwise(0)
    has = F.col("value").isNotNull() & (F.col("event_id") % 7 != 0)
    args = F.when(has, F.array(F.floor("value").cast("int"))).otherwise(F.array().cast("array<int>"))
    return ordered.dialogue_lines(_t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), op.alias("opcode"), args.alias("args")))


_POOL = """with f as (select text, min(doc_id) pos from documents group by text), o as (select text, pos, coalesce(sum(2 * (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) + 2)
    over (order by pos rows between unbounded preceding and 1 preceding), 0) off from f)"""


@_query(_POOL + " select d.doc_id, cast(o.off as bigint) pool_offset from documents d join o using (text)")
def string_pool(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    pool = ordered.string_pool(docs, "text", "doc_id").select("text", F.col("offset").alias("pool_offset"))
    return docs.join(pool, "text").select("doc_id", "pool_offset")


@_query("""select doc_id, lag(doc_id) over (partition by text order by doc_id) replaces, lead(doc_id) over (partition by text order by doc_id) is null survives from documents""")
def overlay_collisions(spark: SparkSession, d: str) -> DataFrame:
    return ordered.overlay(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "replaces", "survives")


@_query("""select page_id, cast(octet_length(encode(html)) as bigint) size, cast(coalesce(sum(cast(ceil(octet_length(encode(html)) / 2048.0) as bigint) * 2048) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) body_offset from pages""")
def aligned_layout(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("size"))
    return ordered.aligned_layout(p, "page_id", F.col("size"), 2048).select("page_id", "size", F.col("offset").alias("body_offset"))


@_query("""with c as (select distinct unicode(ch) cp from (select unnest(string_split(text, '')) ch from documents) where ch <> ''),
 i as (select cp, cast(row_number() over (order by cp) - 1 as bigint) idx from c where cp < 55296) select cp, idx, min(idx) over (partition by cp // 32) base from i""")
def charset_index(spark: SparkSession, d: str) -> DataFrame:
    return ordered.charset_index(ordered.characters(spread(_t(spark, d, "documents").select("text")), "text"))


# --- scalar functions


@_query("""select page_id, case when instr(url, '/') > 0 then left(url, length(url) - instr(reverse(url), '/')) else '' end dir_name,
    case when instr(url, '/') > 0 then right(url, instr(reverse(url), '/') - 1) else url end file_name from pages""")
def split_path(spark: SparkSession, d: str) -> DataFrame:
    directory, name = scalar.split_path(F.col("url"))
    return _t(spark, d, "pages").select("page_id", directory.alias("dir_name"), name.alias("file_name"))


@_query("""with p as (select l_orderkey, l_linenumber, l_partkey % 4096 x, l_suppkey % 4096 y from lineitem),
 q as (select *, x & 255 a, ((y & 15) << 4) | ((x >> 8) & 15) b, (y >> 4) & 255 c from p)
 select l_orderkey, l_linenumber, a, b, c, a | ((b & 15) << 8) x, ((b >> 4) & 15) | (c << 4) y from q""")
def xy_pack(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4096).alias("x"), (F.col("l_suppkey") % 4096).alias("y"))
    a, b, c = scalar.pack_xy(F.col("x"), F.col("y"))
    q = p.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))
    x, y = scalar.unpack_xy(F.col("a"), F.col("b"), F.col("c"))
    return q.select("*", x.alias("x"), y.alias("y"))


@_query("select item_id, lower(hex(encode(text))) hex_text, decode(unhex(hex(encode(text)))) back from benchmark")
def hex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    h = scalar.to_hex(F.encode("text", "UTF-8"))
    return _t(spark, d, "benchmark").select("item_id", h.alias("hex_text"), F.decode(scalar.from_hex(h), "UTF-8").alias("back"))


@_query("select doc_id, cast(2 * (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) as bigint) n_bytes from documents")
def utf16_length(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", scalar.utf16_bytes(F.col("text")).cast("bigint").alias("n_bytes"))


@_query("select page_id, regexp_replace(url, '(?i)\\.(stx|srd)$', '') || '.srdv' sidecar from pages")
def sidecar_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", scalar.sidecar_name(F.col("url")).alias("sidecar"))


# --- the patch engine

#: Every third document has drifted, every fifth is a key that isn't there, every seventh has its target already.
_PATCH_SQL = """with patch as (select case when doc_id % 5 = 0 then doc_id + 1000000000 else doc_id end doc_id, case when doc_id % 3 = 0 then text || '!' else text end src, case when doc_id % 7 = 0 then text else 'T:' || text end tgt from documents where doc_id % 2 = 0),
 j as (select p.doc_id, src, tgt, d.text cur from patch p left join documents d on d.doc_id = p.doc_id)"""


def _patch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    key = lambda df: df.select(F.lit("docs.cpk").alias("cpk"), F.lit("text/all.spc").alias("cpk_path"), F.lit("all.stx").alias("spc_member"), F.lit(0).alias("table_idx"), "*")
    id = F.col("doc_id")
    entries = docs.where("doc_id % 2 = 0").select(F.when(id % 5 == 0, id + 1000000000).otherwise(id).alias("id"), id.alias("ord"), F.when(id % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("source"), F.when(id % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("T:"), "text")).alias("target"))
    return key(entries), key(docs.select(id.alias("pos"), id.alias("id"), "text"))


@_query(_PATCH_SQL + """ select count(cur) applied, count(*) filter (cur = tgt) already, cast(0 as bigint) skipped, count(*) filter (cur <> src) drift, count(*) filter (cur is null) missing, count(*) entries, cast(1 as bigint) archives, cast(1 as bigint) files from j""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    entries, slots = _patch(spark, d)
    hit, missing = patching.resolve(entries, slots)
    return patching.report(patching.decide(hit), missing, entries)


def _detail(spark: SparkSession, d: str, policy: str) -> DataFrame:
    hit, _ = patching.resolve(*_patch(spark, d))
    return patching.decide(hit, policy).select(F.col("id").alias("doc_id"), "drift", "already", "applied", F.md5("new_text").alias("new_text"))


@_query(_PATCH_SQL + " select doc_id, cur <> src drift, cur = tgt already, true applied, md5(tgt) new_text from j where cur is not null")
def drift_detail_warn(spark: SparkSession, d: str) -> DataFrame:
    return _detail(spark, d, "warn")


@_query(_PATCH_SQL + " select doc_id, cur <> src drift, cur = src and cur = tgt already, cur = src applied, md5(case when cur = src then tgt else cur end) new_text from j where cur is not null")
def drift_detail_skip(spark: SparkSession, d: str) -> DataFrame:
    return _detail(spark, d, "skip")


@_query(_PATCH_SQL + " select min(doc_id) first_drift from j where cur <> src")
def drift_detail_error(spark: SparkSession, d: str) -> DataFrame:
    hit, _ = patching.resolve(*_patch(spark, d))
    return patching.decide(hit).where("drift").agg(F.min_by("id", "ord").alias("first_drift"))


@_query(_PATCH_SQL + " select d.doc_id, md5(coalesce(tgt, text)) text_md5 from documents d left join j on j.doc_id = d.doc_id and j.cur is not null")
def patched_slots(spark: SparkSession, d: str) -> DataFrame:
    entries, slots = _patch(spark, d)
    hit, _ = patching.resolve(entries, slots)
    return patching.updated(slots, patching.decide(hit)).select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"))


@_query(_PATCH_SQL + " select doc_id id from j where cur is null")
def missing_records(spark: SparkSession, d: str) -> DataFrame:
    return patching.resolve(*_patch(spark, d))[1].select("id")


_SHARDED_SQL = _PATCH_SQL.replace("select p.doc_id, src", "select p.doc_id, 'docs' || p.doc_id % 4 || '.cpk' cpk, src")


def _sharded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same patch over four archives."""
    return tuple(df.withColumn("cpk", F.concat(F.lit("docs"), F.col("id") % 4, F.lit(".cpk"))) for df in _patch(spark, d))


@_query(_SHARDED_SQL + " select cpk, count(*) n_drift from j where cur <> src group by cpk")
def drift_by_archive(spark: SparkSession, d: str) -> DataFrame:
    return patching.drift_by_archive(patching.decide(patching.resolve(*_sharded(spark, d))[0]))


@_query(_PATCH_SQL + " select cast(count(cur) + count(*) filter (cur = src) as bigint) applied, cast(count(*) filter (cur = tgt) + count(*) filter (cur = src and cur = tgt) as bigint) already, cast(count(*) filter (cur <> src) as bigint) skipped, cast(2 * count(*) filter (cur is null) as bigint) missing from j")
def report_union(spark: SparkSession, d: str) -> DataFrame:
    """The reports of two runs, by different policies."""
    entries, slots = _patch(spark, d)
    hit, missing = patching.resolve(entries, slots)
    one, two = (patching.report(patching.decide(hit, policy), missing, entries).select("applied", "already", "skipped", "missing") for policy in ("warn", "skip"))
    return patching.merge_reports(one.unionByName(two))


@_query("select md5(text) text_md5, count(*) n from documents group by text having count(*) > 1")
def duplicate_slots(spark: SparkSession, d: str) -> DataFrame:
    return patching.duplicate_keys(_t(spark, d, "documents"), ["text"]).select(F.md5("text").alias("text_md5"), "n")


@_query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unknown_targets(spark: SparkSession, d: str) -> DataFrame:
    return patching.unknown_keys(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), ["doc_id"])


@_query("select l_suppkey, count(*) filter (l_returnflag = 'A') n_a, count(*) filter (l_returnflag = 'N') n_n, count(*) filter (l_returnflag = 'R') n_r from lineitem group by l_suppkey")
def groups_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return patching.groups_by_kind(_t(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@_query("""select coalesce(o.o_custkey, c.c_custkey) key, coalesce(o.total, c.c_acctbal) amount from customer c full outer join (select o_custkey, max(o_totalprice) total from orders where o_custkey % 2 = 0 group by 1) o on o.o_custkey = c.c_custkey""")
def glyph_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    new = _t(spark, d, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("amount"))
    return patching.upsert(old, new, ["key"])


# --- formats: what is written reads back as what it was


@_query("select conv_id, turn, text from conversations")
def stx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    rows = c.select(F.concat(F.lit("conv-"), F.expr("conv_id div 100")).alias("path"), (F.col("conv_id") % 100).cast("int").alias("table_idx"), F.col("conv_id").alias("unknown"), F.col("turn").cast("int").alias("pos"), F.col("turn").alias("id"), "text")
    back = members.parse_stx(members.build_stx(rows))
    return back.select(F.col("unknown").alias("conv_id"), F.col("id").alias("turn"), "text")


#: Rows and about as many bytes that a file holds at most: of larger tables there are more files, not larger ones.
FILE_ROWS, FILE_BYTES = 10_000, 4 << 20


def _through(df: DataFrame, there_and_back: Callable[[pa.Table], pa.Table], key: str | None = None, most: int = FILE_ROWS) -> DataFrame:
    """Rows in files, each of which is written and parsed again by one task; rows of one key are in one file, whatever it holds."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            step = max(1, min(most, len(batch) * FILE_BYTES // max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                yield pa.Table.from_batches([batch.slice(at, step)])

    def whole(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for table in tables:
            keys = table.column(key).to_pylist()
            cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)  # where the last key begins
            if held and (cut or held[-1].column(key)[-1].as_py() != keys[0]):
                if cut:
                    held.append(table.slice(0, cut))
                yield pa.concat_tables(held)
                held = []
            elif cut:
                yield table.slice(0, cut)
            held.append(table.slice(cut))
        if held:
            yield pa.concat_tables(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(files(batches)) if key else files(batches):
            yield from there_and_back(table).cast(table.schema).to_batches()

    rows = df.repartition(key).sortWithinPartitions(key) if key else spread(df)
    return rows.mapInArrow(run, df.schema)


def _dat(df: DataFrame) -> DataFrame:
    columns = dat_columns(df.schema)
    texts = sum(count for _, kind, count in columns if kind not in dat.NUMBERS)

    def both(table: pa.Table) -> pa.Table:
        raw = dat.write_columns(columns, [c.to_numpy() for c in table.columns])
        return pa.table({name: cells[:, 0] for (name, _, _), cells in zip(*dat.read_columns(raw))})

    return _through(df, both, most=min(FILE_ROWS, 0xFFFF // max(1, texts)))  # so that a pool holds all texts, if none is there twice


@_query("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def dat_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _dat(_t(spark, d, "part"))


@_query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) ship_us from lineitem")
def dat_roundtrip_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("ship_us", F.unix_micros(F.col("l_shipdate").cast("timestamp"))).drop("l_shipdate")
    return _dat(rows)


@_query("select doc_id, text from documents")
def lzss_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [lzss.decompress(lzss.compress(raw := s.encode()), len(raw)).decode() for s in b["text"]]
            yield b

    return spread(_t(spark, d, "documents").select("doc_id", "text")).mapInPandas(run, "doc_id bigint, text string")


@_query("select page_id, url, html from pages")
def cpk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def both(table: pa.Table) -> pa.Table:
        files = [utf.File(*(r["url"].rsplit("/", 1) if "/" in r["url"] else ("", r["url"])), r["page_id"], data=r["html"].encode()) for r in table.to_pylist()]
        back = utf.read_cpk(utf.write_cpk(new_archive(files))).files
        return pa.table({"page_id": [f.id for f in back], "url": [f.path for f in back], "html": [f.data.decode() for f in back]})

    return _through(_t(spark, d, "pages").select("page_id", "url", "html"), both)


@_query("select r_regionkey, r_name from region")
def utf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def both(table: pa.Table) -> pa.Table:
        t = utf.Table("region", [utf.Column("r_regionkey", "per_row", "s32"), utf.Column("r_name", "per_row", "string"), utf.Column("k", "constant", "u16", 7)], table.to_pylist())
        back = utf.read_utf(utf.write_utf(t)).rows
        return pa.table({c: [r[c] for r in back] for c in ("r_regionkey", "r_name")})

    return _through(_t(spark, d, "region").select("r_regionkey", "r_name"), both)


@_query("select conv_id, turn, role, text from conversations")
def spc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Members of conversations, every fourth one compressed."""
    c = _t(spark, d, "conversations").select("conv_id", F.col("turn"), "role", "text")
    rows = c.select(F.concat(F.lit("c-"), F.expr("conv_id div 50")).alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("ord"), F.encode(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role"), "UTF-8").alias("name"), F.when(F.col("turn") % 4 == 3, 2).otherwise(1).alias("compression_flag"), F.lit(0).alias("unknown_flag"), F.encode("text", "UTF-8").alias("data"), F.unhex(F.lit("00" * 36)).alias("unknown1"), F.lit(4).cast("bigint").alias("unknown2"))
    parts = F.split(F.decode("name", "UTF-8"), "/")
    return members.parse_spc(members.build_spc(rows)).select(parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), parts[2].alias("role"), F.decode("data", "UTF-8").alias("text"))


@_query("""with c as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 seq, case event_type when 'signup' then 29 when 'view' then 34 when 'click' then 75 else 20 end opcode, event_id % 20000 arg from events)
 select user_id, cast(seq as int) seq, opcode, arg from c""")
def wrd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    op = F.when(F.col("event_type") == "signup", 29).when(F.col("event_type") == "view", 34).when(F.col("event_type") == "click", 75).otherwise(20)
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.lit("command").alias("kind"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("seq"), op.alias("opcode"), F.array((F.col("event_id") % 20000).cast("int")).alias("args"))
    e = e.select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    head = e.select("path").distinct().select("path", F.lit("header").alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast("int").alias("opcode"), F.lit(None).cast("array<int>").alias("args"), F.lit(None).cast("string").alias("name"), F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    back = members.commands(members.parse_wrd(members.build_wrd(e.unionByName(head))))
    return back.select(F.col("path").cast("bigint").alias("user_id"), "seq", "opcode", F.get("args", F.lit(0)).cast("bigint").alias("arg"))


@_query("""with c as (select distinct unicode(ch) cp from (select unnest(string_split(text, '')) ch from documents) where ch <> '') select cp, cp % 4096 x, (cp * 7) % 4096 y from c where cp < 55296""")
def spft_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    cp = F.col("cp")
    chars = ordered.characters(spread(_t(spark, d, "documents").select("text")), "text").where("cp < 55296")
    rows = chars.select(F.lit("f").alias("path"), F.lit("F").alias("font_name"), F.lit(6).alias("unknown6"), F.lit(0).alias("bit_flags"), F.lit(1).alias("scale_flag"), cp.alias("codepoint"), (cp % 4096).alias("x"), ((cp * 7) % 4096).alias("y"), F.lit(8).alias("width"), F.lit(9).alias("height"), F.lit(-1).alias("kern_left"), F.lit(0).alias("kern_right"), F.lit(1).alias("kern_vertical"))
    return members.parse_spft(members.build_spft(rows)).select(F.col("codepoint").alias("cp"), "x", "y")


@_query("select vec_id, cast(label as bigint) depth_mark from embeddings")
def srd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A block for each vector, under one block for each label."""

    def both(table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for r in table.to_pylist():
            by.setdefault(r["depth_mark"], []).append(font.Block(b"$VEC", 0, str(r["vec_id"]).encode()))
        rows = font.flatten(font.read_srd(font.write_srd([font.Block(b"$LAB", k, b"", v) for k, v in by.items()])))
        mark = {r["node_id"]: r["unknown_0c"] for r in rows if r["depth"] == 0}
        leaves = [r for r in rows if r["depth"] == 1]
        return pa.table({"vec_id": [int(r["data"]) for r in leaves], "depth_mark": [mark[r["parent_id"]] for r in leaves]})

    return _through(_t(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("depth_mark")), both)
