"""The patch engine: entries find slots by key, are tested for drift and update them; what happened is reported.

entries: cpk, cpk_path, spc_member, table_idx, id, ord, source, target
slots:   cpk, cpk_path, spc_member, table_idx, pos, id, text

* groups whose file or member is absent give one missing record each, entries whose slot is absent one each;
* of slots with one id in a table the last is the target;
* drift (the text is not the source) is tested before "is the target already": both may hold;
* policy `warn` applies with drift, `skip` leaves the slot, `error` fails at the first in order of path and ord;
* entries for one slot apply in order, each seeing what the one before it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FILE, MEMBER = ["cpk", "cpk_path"], ["cpk", "cpk_path", "spc_member"]
SLOT = [*MEMBER, "table_idx", "id"]
#: Parts in which the absent slots of a member are looked at.
PARTS = 64
POLICIES = ("warn", "skip", "error")


class PatchError(ValueError):
    pass


def check_archives(entries: DataFrame, archives: DataFrame) -> None:
    """Fails where an archive name occurs twice or a patch names one that isn't there."""
    twice = archives.groupBy("cpk").count().where("count > 1").select("cpk").orderBy("cpk").first()
    if twice:
        raise PatchError(f"DUPLICATE_ARCHIVE: {twice.cpk}")
    unknown = entries.select("cpk").distinct().join(archives, "cpk", "left_anti").orderBy("cpk").first()
    if unknown:
        raise PatchError(f"UNKNOWN_ARCHIVE: {unknown.cpk}")


def unknown_keys(entries: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return entries.join(known.select(*keys), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def resolve(entries: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the slot they hit (pos and text, null where there is none), and the missing records."""
    path = F.regexp_replace("cpk_path", "^/+", "")
    entries = entries.withColumn("cpk_path", path)
    slots = slots.withColumn("cpk_path", path)
    groups = entries.groupBy(*MEMBER).agg(F.count("*").alias("n_entries"))
    files, members = slots.select(*FILE).distinct(), slots.select(*MEMBER).distinct()
    no_file = groups.join(files, FILE, "left_anti")
    no_member = groups.join(files, FILE, "left_semi").join(members, MEMBER, "left_anti")
    target = slots.groupBy(*SLOT).agg(F.max_by(F.struct("pos", "text"), "pos").alias("slot")).where("slot.pos is not null")
    hit = entries.join(target, SLOT).select(*entries.columns, F.col("slot.pos").alias("pos"), F.col("slot.text").alias("text"))
    # a member may have most entries: what tells its rows apart is joined with, too, and texts don't move
    part = lambda id: F.pmod(F.xxhash64(id), F.lit(PARTS)).cast("int").alias("__part")
    parts = members.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    absent = entries.select(*SLOT).join(slots.where("pos is not null").select(*SLOT).distinct(), SLOT, "left_anti")
    absent = absent.select("*", part("id")).join(parts, [*MEMBER, "__part"], "left_semi")
    record = lambda df, member, table, id: df.select("cpk", "cpk_path", member.alias("spc_member"), table.cast("int").alias("table_idx"), id.cast("bigint").alias("id"))
    missing = record(no_file, F.lit(""), F.lit(None), F.lit(None)).unionByName(record(no_member, F.col("spc_member"), F.lit(None), F.lit(None)))
    return hit, missing.unionByName(record(absent, F.col("spc_member"), F.col("table_idx"), F.col("id")))


def decide(hit: DataFrame, policy: str = "warn") -> DataFrame:
    """A row for each entry: seen, drift, already, applied, and new_text, the slot's text after it."""
    if policy not in POLICIES:
        raise PatchError(f"UNKNOWN_POLICY: {policy}")
    per_slot = hit.groupBy(*SLOT, "pos", "text").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "target"))).alias("todo"))
    made = "struct(e.ord as ord, e.source as source, e.target as target, acc.cur as seen, acc.cur <> e.source as drift, {ok} and acc.cur = e.target as already, {ok} as applied, if({ok}, e.target, acc.cur) as new_text)"
    ok = "(acc.cur = e.source)" if policy == "skip" else "true"
    made = made.format(ok=ok)
    kind = "array<struct<ord: bigint, source: string, target: string, seen: string, drift: boolean, already: boolean, applied: boolean, new_text: string>>"
    fold = f"aggregate(todo, struct(text as cur, cast(array() as {kind}) as done), (acc, e) -> struct(if({ok}, e.target, acc.cur) as cur, concat(acc.done, array({made})) as done)).done"
    rows = per_slot.withColumn("todo", F.expr("transform(todo, e -> struct(cast(e.ord as bigint) as ord, e.source as source, e.target as target))"))
    out = rows.select(*SLOT, "pos", F.explode(F.expr(fold)).alias("d")).select(*SLOT, "pos", "d.*")
    if policy == "error":
        first = out.where("drift").orderBy("cpk", "cpk_path", "ord").first()
        if first:
            raise PatchError(f"DRIFT: {first.cpk}/{first.cpk_path}/{first.spc_member} table {first.table_idx} id {first.id}")
    return out


def report(decided: DataFrame, missing: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counters. `applied` counts slots that had their target already, too."""
    done = decided.agg(*(F.count_if(c).alias(n) for n, c in (("applied", F.col("applied")), ("already", F.col("already")), ("skipped", ~F.col("applied")), ("drift", F.col("drift")))))
    return done.crossJoin(missing.agg(F.count("*").alias("missing"))).crossJoin(entries.agg(F.count("*").alias("entries"), F.count_distinct("cpk").alias("archives"), F.count_distinct("cpk", "cpk_path").alias("files")))


def drift_by_archive(decided: DataFrame) -> DataFrame:
    """(cpk, n_drift) of the archives with drifted entries."""
    return decided.where("drift").groupBy("cpk").agg(F.count("*").alias("n_drift"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """One row: the sums of all counters of a union of reports."""
    return reports.agg(*(F.sum(c).alias(c) for c in reports.columns))


def updated(slots: DataFrame, decided: DataFrame) -> DataFrame:
    """All slots, those that entries applied to with their new text."""
    last = decided.groupBy(*MEMBER, "table_idx", "pos").agg(F.max_by("new_text", "ord").alias("__new"), F.max("applied").alias("__applied"))
    joined = slots.join(last, [*MEMBER, "table_idx", "pos"], "left")
    return joined.withColumn("text", F.when(F.coalesce("__applied", F.lit(False)), F.col("__new")).otherwise(F.col("text"))).select(*slots.columns)


def first_nonempty(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: the first value, in order, that is neither null nor empty; null without any."""
    return df.agg(F.min_by(F.when(F.col(value) != "", F.col(value)), F.when(F.col(value) != "", F.col(order))).alias(value))


def groups_by_kind(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """A count for each kind, by key, in one pass."""
    return df.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """Rows of `old` with the non-null values of `new` put in by key, and the rows that only `new` has; with `replace`, only these."""
    if replace:
        return new
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in values))
    return old.join(n, keys, "full_outer").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in values))
