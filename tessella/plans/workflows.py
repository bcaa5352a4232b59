"""Whole workflows as queries: patch documents applied to archives, data sources written and read, exchange JSON, hard cases.

Registered beside those of `bridge`, each with the SQL that gives the same rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codecs import archive, dat, font, text, utf
from ..functions import scalar
from ..functions.partitioning import spread
from ..functions.shared import run_folder
from ..operators import fonts, ordered, patching
from ..sources import exchange, members, tables
from ..sources.files import local
from . import apply
from .bridge import _query, _t, _through

# --- patch documents applied to archives

#: Items of `benchmark` lie in two archives of four string tables. Every third has drifted, every fifth's target is there already.
_APPLY_SQL = """with e as (select item_id, text, text || case when item_id % 3 = 0 then '!' else '' end src, case when item_id % 5 = 0 then text else 'T:' || text end tgt, item_id % 2 = 0 named from benchmark)"""


def _archives(spark: SparkSession, d: str) -> tuple[list[str], str, str]:
    """Archives written by the data source, a patch document for the even items, and a folder to write to."""
    tables.register(spark)
    folder = run_folder(spark, "archives")
    items = _t(spark, d, "benchmark").select("item_id", "text")
    at = F.concat(F.lit("a"), F.col("item_id") % 2, F.lit(".cpk|text/f"), F.col("item_id") % 4, F.lit(".spc"))
    slots = items.select(at.alias("path"), F.lit(0).alias("table_idx"), F.lit(7).cast("bigint").alias("unknown"), F.col("item_id").cast("int").alias("pos"), F.col("item_id").alias("id"), "text")
    one = members.build_stx(slots).select("path", F.lit(0).alias("ord"), F.encode(F.lit("m.stx"), "UTF-8").alias("name"), F.lit(2).alias("compression_flag"), F.lit(1).alias("unknown_flag"), F.col("content").alias("data"), F.unhex(F.lit("00" * 36)).alias("unknown1"), F.lit(4).cast("bigint").alias("unknown2"))
    name = F.split("path", r"\|")
    rows = members.build_spc(one).select(name[0].alias("archive"), F.substring(name[1], 7, 1).cast("int").alias("ord"), F.lit("text").alias("dir_name"), F.substring_index(name[1], "/", -1).alias("file_name"), F.lit(1).cast("bigint").alias("id"), F.lit("u").alias("user_string"), F.lit('{"Crc": {"type": "u32", "value": 9}}').alias("extra"), F.octet_length("content").cast("bigint").alias("size"), F.col("content").alias("data"))
    rows.write.format("cpk").mode("append").save(f"{folder}/in")
    # a patch document is made by hand, so the driver holds it
    groups: dict[tuple[str, str], list[dict]] = {}
    for r in items.where("item_id % 2 = 0").orderBy("item_id").collect():
        groups.setdefault(("a0.cpk", f"/text/f{r.item_id % 4}.spc"), []).append({"table": 0, "index": r.item_id, "source": r.text + "!" * (r.item_id % 3 == 0), "target": r.text if r.item_id % 5 == 0 else "T:" + r.text})
    files = [{"format": "stx", "cpk": c, "cpk_path": p, "spc_member": "m.stx", "entries": e} for (c, p), e in groups.items()]
    files += [{"format": "stx", "cpk": "a1.cpk", "cpk_path": p, "spc_member": m, "entries": [{"table": t, "index": 10**9, "source": "x", "target": "y"}]} for p, m, t in (("text/none.spc", "m.stx", 0), ("text/f1.spc", "none.stx", 0), ("text/f1.spc", "m.stx", 0))]
    os.makedirs(local(folder), exist_ok=True)
    with open(f"{local(folder)}/patch.json", "w", encoding="utf-8") as f:
        json.dump({"schema": exchange.tag("translate"), "source_language": "", "target_language": "de", "files": files}, f)
    return [f"{local(folder)}/in/a{k}.cpk" for k in range(2)], f"{local(folder)}/patch.json", f"{folder}/out"


@_query(_APPLY_SQL + " select item_id, case when named then tgt else text end text from e")
def apply_patch(spark: SparkSession, d: str) -> DataFrame:
    """Archives rebuilt by a patch document, written, and read again down to their strings."""
    paths, document, out = _archives(spark, d)
    apply.write(apply.apply(spark, apply.load([document]), apply.archives(spark, paths)), paths, out)
    files = spark.read.format("cpk").load(out).select(F.concat_ws("|", "archive", "file_name").alias("path"), F.col("data").alias("content"))
    tables_ = members.parse_spc(files).select("path", F.col("data").alias("content"))
    return members.parse_stx(tables_).select(F.col("id").alias("item_id"), "text")


@_query(_APPLY_SQL + """ select cast(count(*) filter (named) as bigint) applied, cast(count(*) filter (named and tgt = text and src = text) as bigint) same_as_source, cast(count(*) filter (named and src <> text) as bigint) drift,
    cast(3 as bigint) missing, cast(count(*) filter (named and tgt = text) as bigint) already_translated from e""")
def apply_report(spark: SparkSession, d: str) -> DataFrame:
    paths, document, _ = _archives(spark, d)
    report = apply.apply(spark, apply.load([document]), apply.archives(spark, paths)).report
    same = [e for g in json.load(open(document, encoding="utf-8"))["files"] for e in g["entries"] if e["source"] == e["target"]]
    return spark.createDataFrame([(report["applied"], len(same), len(report["drift"]), len(report["missing"]), report["already_translated"])], "applied bigint, same_as_source bigint, drift bigint, missing bigint, already_translated bigint")


@_query(_APPLY_SQL + " select item_id, case when named and src = text then tgt else text end text from e")
def apply_skip_extract(spark: SparkSession, d: str) -> DataFrame:
    """The same by the policy that leaves drifted slots, written as one tree of files."""
    paths, document, out = _archives(spark, d)
    apply.write(apply.apply(spark, apply.load([document]), apply.archives(spark, paths), "skip"), paths, out, "extract")
    spc = members.read_spc(spark, f"{out}/text")
    return members.parse_stx(spc.select("path", F.col("data").alias("content"))).select(F.col("id").alias("item_id"), "text")


@_query("""with d as (select doc_id, text, case when doc_id % 4 = 0 then text || '#2' else text end cur from documents),
 e as (select doc_id, cur <> text drift, cur = 'A' || text already from d where doc_id % 2 = 0 union all select doc_id, false, 'A' || text = 'B' || text from d where doc_id % 8 = 0)
 select count(*) applied, count(*) filter (already) already, cast(0 as bigint) skipped, count(*) filter (drift) drift, (select cast(any_value(1) filter (doc_id % 10 = 1) is not null as bigint) + cast(any_value(1) filter (doc_id % 10 = 3) is not null as bigint) + count(*) filter (doc_id % 10 = 5) from documents) missing from e""")
def drift_corner_cases(spark: SparkSession, d: str) -> DataFrame:
    """Two slots of one id (the last is the target), two entries for one slot, an absent file, an absent member, absent slots."""
    docs, id = _t(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    key = lambda df, path, member: df.select(F.lit("docs.cpk").alias("cpk"), F.lit(path).alias("cpk_path"), F.lit(member).alias("spc_member"), F.lit(0).alias("table_idx"), "*")
    slot = docs.select(id.alias("pos"), id.alias("id"), "text")
    slots = key(slot.unionByName(slot.where("id % 4 = 0").select((F.col("pos") + 10**9).alias("pos"), "id", F.concat("text", F.lit("#2")).alias("text"))), "text/all.spc", "all.stx")
    entry = lambda rows, second, source, target, shift=0: rows.select((id + shift).alias("id"), (2 * id + second).alias("ord"), source.alias("source"), target.alias("target"))
    a, b = F.concat(F.lit("A"), "text"), F.concat(F.lit("B"), "text")
    entries = key(entry(docs.where("doc_id % 2 = 0"), 0, F.col("text"), a).unionByName(entry(docs.where("doc_id % 8 = 0"), 1, a, b)).unionByName(entry(docs.where("doc_id % 10 = 5"), 0, a, b, 10**10)), "//text/all.spc", "all.stx")
    entries = entries.unionByName(key(entry(docs.where("doc_id % 10 = 1"), 0, a, b), "text/none.spc", "all.stx")).unionByName(key(entry(docs.where("doc_id % 10 = 3"), 0, a, b), "text/all.spc", "none.stx"))
    hit, missing = patching.resolve(entries, slots)
    return patching.report(patching.decide(hit), missing, entries).select("applied", "already", "skipped", "drift", "missing")


# --- data sources


@_query("select page_id, url, html, page_id % 1000 crc, cast(octet_length(encode(html)) as bigint) size from pages")
def cpk_source(spark: SparkSession, d: str) -> DataFrame:
    """Written as archives with a column of their own in the table of contents, and read again."""
    tables.register(spark)
    out = run_folder(spark, "cpk")
    extra = F.concat(F.lit('{"Crc": {"type": "u32", "value": '), F.col("page_id") % 1000, F.lit("}}"))
    rows = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 4, F.lit(".cpk")).alias("archive"), F.col("page_id").cast("int").alias("ord"), F.lit("").alias("dir_name"), F.col("page_id").cast("string").alias("file_name"), F.col("page_id").alias("id"), F.col("url").alias("user_string"), extra.alias("extra"), F.lit(0).cast("bigint").alias("size"), F.encode("html", "UTF-8").alias("data"))
    rows.write.format("cpk").mode("append").save(out)
    crc = F.get_json_object("extra", "$.Crc.value").cast("bigint")
    return spark.read.format("cpk").load(out).select(F.col("id").alias("page_id"), F.col("user_string").alias("url"), F.decode("data", "UTF-8").alias("html"), crc.alias("crc"), "size")


@_query("select archive, cast(count(*) as bigint) files, cast(sum(octet_length(encode(html))) as bigint) bytes from (select 'p' || page_id % 4 || '.cpk' archive, html from pages) group by archive")
def archive_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of archives, from their tables of contents alone."""
    tables.register(spark)
    out = run_folder(spark, "cpk")
    rows = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 4, F.lit(".cpk")).alias("archive"), F.col("page_id").cast("int").alias("ord"), F.lit("d").alias("dir_name"), F.col("page_id").cast("string").alias("file_name"), F.col("page_id").alias("id"), F.lit("").alias("user_string"), F.lit("{}").alias("extra"), F.lit(0).cast("bigint").alias("size"), F.encode("html", "UTF-8").alias("data"))
    rows.write.format("cpk").mode("append").save(out)
    toc = spark.read.format("cpk").option("includeData", "false").load(out)
    return toc.groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@_query("select c_custkey, c_name, c_acctbal from customer")
def utf_source(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    out = run_folder(spark, "utf")
    _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.format("utf").mode("append").save(out)
    return spark.read.format("utf").load(out)


@_query("select s_suppkey, s_name, s_acctbal from supplier")
def dat_source(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    out = run_folder(spark, "dat")
    _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format("dat").mode("append").save(out)
    return spark.read.format("dat").load(out)


# --- exchange JSON


@_query("select conv_id, turn, text from conversations")
def exchange_stx(spark: SparkSession, d: str) -> DataFrame:
    def both(table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, str]]] = {}
        for r in table.to_pylist():
            by.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
        doc = exchange.dumps(exchange.stx_to_json([text.StringTable(k, e) for k, e in by.items()]))
        rows = [(t.unknown, i, s) for t in exchange.stx_from_json(json.loads(doc)) for i, s in t.entries]
        return pa.table([pa.array(c) for c in zip(*rows)], names=["conv_id", "turn", "text"])

    return _through(_t(spark, d, "conversations").select("conv_id", "turn", "text"), both, "conv_id")


@_query("select p_partkey, p_name, p_size, p_retailprice from part")
def exchange_dat(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    columns = tables.dat_columns(rows.schema)

    def both(table: pa.Table) -> pa.Table:
        cells = [[[v] for v in r.values()] for r in table.to_pylist()]
        back = exchange.dat_from_json(json.loads(exchange.dumps(exchange.dat_to_json(dat.Dat(columns, cells)))))
        return pa.table([pa.array(c) for c in zip(*([x for (x,) in r] for r in back.rows))], names=[n for n, _, _ in back.schema])

    return _through(rows, both)


@_query("select user_id, event_id, event_id % 256 opcode, cast(floor(coalesce(value, 0)) as bigint) % 65536 arg from events")
def exchange_wrd(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 256).alias("opcode"), (F.floor(F.coalesce("value", F.lit(0))) % 65536).cast("bigint").alias("arg"))

    def both(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        script = text.Script(5, [(r["opcode"], [r["arg"]]) for r in rows], [(1, 2)], [("start", 3)], [f"{r['user_id']}/{r['event_id']}" for r in rows], None, 0)
        back = exchange.wrd_from_json(json.loads(exchange.dumps(exchange.wrd_to_json(script))))
        cells = [(*map(int, p.split("/")), o, a[0]) for p, (o, a) in zip(back.params, back.commands)]
        return pa.table([pa.array(c) for c in zip(*cells)], names=["user_id", "event_id", "opcode", "arg"])

    return _through(rows, both)


@_query("select page_id, 'p/' || page_id || '.html' path, html from pages")
def exchange_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Each body as a member of a container, these in an archive; both rebuilt from their manifests."""
    pages = _t(spark, d, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id"), F.lit(".html")).alias("path"), "html")

    def both(table: pa.Table) -> pa.Table:
        files, bodies = [], {}
        for r in table.to_pylist():
            spc = archive.Spc(b"\1" * 36, 4, [archive.Member(b"body", 2 if r["page_id"] % 8 == 0 else 1, 0, r["html"].encode())])
            again = exchange.spc_from_json(json.loads(exchange.dumps(exchange.spc_to_json(spc))), [m.data for m in spc.members])
            bodies[r["path"]] = archive.write_spc(again)
            files.append(utf.File("p", r["path"][2:], r["page_id"], "", {"Crc": r["page_id"] % 9}, bodies[r["path"]]))
        a = tables.new_archive(files, extra=[utf.Column("Crc", "per_row", "u32")])
        a.packets["Itoc"] = bodies["_itoc.bin"] = b"opaque"
        back = utf.read_cpk(utf.write_cpk(exchange.cpk_from_json(json.loads(exchange.dumps(exchange.cpk_to_json(a))), bodies.__getitem__)))
        if back.packets != a.packets or any(f.extra != {"Crc": f.id % 9} for f in back.files):
            raise ValueError("the manifest lost a packet or a column")
        return pa.table({"page_id": [f.id for f in back.files], "path": [f.path for f in back.files], "html": [archive.read_spc(f.data).members[0].data.decode() for f in back.files]})

    return _through(pages, both)


@_query("select c_custkey, c_custkey % 4096 x, c_nationkey y, 'font-' || c_nationkey font from customer")
def exchange_spft(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4096).alias("x"), F.col("c_nationkey").alias("y"), F.concat(F.lit("font-"), "c_nationkey").alias("font"))

    def both(table: pa.Table) -> pa.Table:
        by: dict[str, list[dict]] = {}
        for r in table.to_pylist():
            by.setdefault(r["font"], []).append(r)
        out = []
        for name, own in by.items():
            made = font.Font(name, 6, 0, 1, [(r["c_custkey"], r["x"], r["y"], 1, 2, -3, 4, 5) for r in own])
            back = exchange.spft_from_json(json.loads(exchange.dumps(exchange.spft_to_json(made))))
            out += [(g[0], g[1], g[2], back.name) for g in back.glyphs]
        return pa.table([pa.array(c) for c in zip(*out)], names=["c_custkey", "x", "y", "font"])

    return _through(rows, both)


# --- fonts and textures


@_query("""select cp, cp * 3 % 4096 x, case when cp % 2 = 0 then 9 else 1 end w, count(*) filter (cp % 2 = 0) over () changed from (select distinct unicode(ch) cp from (select unnest(string_split(text, '')) ch from documents) where ch <> '') where cp < 55296""")
def glyph_merge(spark: SparkSession, d: str) -> DataFrame:
    """A font's glyphs, every second of which a patch widens."""
    chars = ordered.characters(spread(_t(spark, d, "documents").select("text")), "text").where("cp < 55296")

    def run(table: pa.Table) -> pa.Table:
        codes, count = table.column("cp").to_pylist(), dict.fromkeys(fonts.COUNTERS, 0)
        old = [(c, c * 3 % 4096, 0, 1, 1, 0, 0, 0) for c in codes]
        new = fonts.merge_glyphs(old, [fonts.Glyph(c, size=(9, 1)) for c in codes if c % 2 == 0], count)
        return pa.table({"cp": pa.array([g[0] for g in new], pa.int32()), "x": pa.array([g[1] for g in new], pa.int32()), "w": pa.array([g[3] for g in new], pa.int32()), "changed": pa.array([count["font_glyphs_changed"]] * len(new), pa.int64())})

    # distinct code points, at most as many as Unicode has
    return chars.select(F.lit("font").alias("font"), "cp").groupBy("font").applyInArrow(run, "cp int, x int, w int, changed bigint")


_TEXTURE = "select p_partkey, cast(p_partkey % 256 as int) a, cast(p_size * 37 % 256 as int) b from part"


@_query(f"""with t as ({_TEXTURE}), p as (select *, unnest(range(16)) i from t), q as (select *, cast((p_partkey * (i + 1)) % 8 as int) k from p),
 v as (select p_partkey, i, case when k = 0 then a when k = 1 then b when a > b then ((8 - k) * a + (k - 1) * b) // 7 when k < 6 then ((6 - k) * a + (k - 1) * b) // 5 else (k - 6) * 255 end v from q)
 select p_partkey, string_agg(lpad(lower(to_hex(v)), 2, '0'), '' order by i) alpha from v group by p_partkey""")
def bc4_pixels(spark: SparkSession, d: str) -> DataFrame:
    """A texture of 4 x 4 pixels for each part: two end points, and places on the ramp between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, a, b = (c.to_numpy() for c in batch.columns)
            places = key[:, None] % 8 * np.arange(1, 17) % 8
            word = (places << np.arange(0, 48, 3)).sum(axis=1)
            blocks = np.column_stack([a, b, *(word >> at & 0xFF for at in range(0, 48, 8))]).astype(np.uint8)
            alpha = pa.Array.from_buffers(pa.binary(16), len(batch), [None, pa.py_buffer(font.decode_blocks(blocks).tobytes())])  # a block is a texture
            yield pa.RecordBatch.from_arrays([batch.column(0), alpha.cast(pa.binary())], names=["p_partkey", "alpha"])

    t = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("a"), (F.col("p_size") * 37 % 256).cast("int").alias("b"))
    return spread(t).mapInArrow(run, "p_partkey bigint, alpha binary").select("p_partkey", scalar.to_hex(F.col("alpha")).alias("alpha"))


# --- hard cases of small operators


@_query("""select doc_id, cast(case doc_id % 4 when 1 then octet_length(encode(left(text, length(text) // 2))) when 2 then octet_length(encode(text)) when 3 then case when text <> '' then octet_length(encode(left(text, length(text) - 1))) end end as bigint) first_diff from documents""")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    """Texts against themselves, changed in the middle, longer, and shorter."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    mode = F.col("doc_id") % 4
    other = F.when(mode == 1, F.concat(F.left("text", half), F.lit("\x01"), F.substring("text", half + 2, F.char_length("text")))).when(mode == 2, F.concat("text", F.lit("x"))).when(mode == 3, F.left("text", F.greatest(F.char_length("text") - 1, F.lit(0)))).otherwise(F.col("text"))
    docs = spread(_t(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", ordered.first_difference(F.encode("text", "UTF-8"), F.encode(other, "UTF-8")).alias("first_diff"))


_KINDS_SQL = """with f as (select doc_id, (['a.stx', 'b/c.srd', 'd.WRD', 'e', 'f.dat', 'g.CPK', 'h.txt', 'i.spc'])[doc_id % 8 + 1] path, (['STXT', 'SpFt', '$CFH', 'CPK ', 'CPS.', '@UTF', '', 'x'])[doc_id // 8 % 8 + 1] magic from documents),
 e as (select *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) ext from f)"""


@_query(_KINDS_SQL + """ select doc_id, case when ext = 'stx' then case magic when 'STXT' then 'stx' when 'SpFt' then 'spft' else 'srd' end when ext in ('srd', 'wrd', 'dat', 'spc', 'cpk', 'spft') then ext
    else case magic when 'CPK ' then 'cpk' when 'CPS.' then 'spc' when 'STXT' then 'stx' when '@UTF' then 'utf' when 'SpFt' then 'spft' when '$CFH' then 'srd' end end kind from e""")
def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of files by extension and first bytes."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    path = pick(["a.stx", "b/c.srd", "d.WRD", "e", "f.dat", "g.CPK", "h.txt", "i.spc"], F.col("doc_id") % 8)
    magic = pick(["STXT", "SpFt", "$CFH", "CPK ", "CPS.", "@UTF", "", "x"], F.expr("doc_id div 8 % 8"))
    content = F.when(magic.isin("", "x"), F.encode(magic, "UTF-8")).otherwise(F.encode(F.concat(magic, "text"), "UTF-8"))
    return _t(spark, d, "documents").select("doc_id", scalar.file_kind(path, content).alias("kind"))


@_query("""with c as (select user_id path, event_id seq, case event_type when 'signup' then 29 when 'click' then 75 else 0 end opcode, event_id % 50 arg from events),
 s as (select *, last_value(case when opcode = 29 then arg end ignore nulls) over (partition by path order by seq rows between unbounded preceding and current row) sp from c)
 select path, seq, arg string_id, case when sp < 40 then 'C' || lpad(cast(sp as varchar), 3, '0') else '<unknown>' end speaker from s where opcode = 75""")
def named_speakers(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", 29).when(F.col("event_type") == "click", 75).otherwise(0)
    e = _t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), op.alias("opcode"), F.array(F.col("event_id") % 50).alias("args"))
    names = e.select("path").distinct().crossJoin(F.broadcast(spark.range(40))).select("path", F.col("id").alias("idx"), F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"))  # 40 rows
    lines = ordered.named_lines(ordered.dialogue_lines(e), names)
    return lines.select("path", "seq", F.col("string_id"), F.coalesce("speaker", F.lit("<unknown>")).alias("speaker"))


@_query("select page_id, 'd' || page_id % 7 || '/' || page_id || '.bin' path, page_id % 3 = 0 matches from pages")
def strict_paths(spark: SparkSession, d: str) -> DataFrame:
    """Safe paths pass as they are; a glyph's character against its code point."""
    path = scalar.strict_path(scalar.join_path(F.concat(F.lit("d"), F.col("page_id") % 7), F.concat("page_id", F.lit(".bin"))))
    code = 65 + F.col("page_id") % 3
    return _t(spark, d, "pages").select("page_id", path.alias("path"), scalar.char_matches(F.lit("A"), code.cast("int")).alias("matches"))


@_query("select arg_min(case when doc_id % 3 = 0 then lang else '' end, doc_id) filter (doc_id % 3 = 0 and lang <> '') language from documents")
def first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """The language of the first document that names one."""
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("lang"))
    return patching.first_nonempty(docs, "lang", "doc_id").select(F.col("lang").alias("language"))


@_query("""select p_partkey, cast(p_size // 4 * cast(ceil(p_partkey % 64 / 4.0) as bigint) * 8 as bigint) bytes from part""")
def texture_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", scalar.bc4_size(F.col("p_size"), F.col("p_partkey") % 64).alias("bytes"))
