"""From raw documents to training windows: quality rules, language ID, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again before the next stage. All but the last return the columns of
documents, further ones too, whatever their names.

Cases: null, empty and wordless texts go in the first stage, texts without letters in the
second; rows with a null id stay through all stages; rows that repeat an id count as one
document from the third stage on, where that of smallest fingerprint stays; of equal texts
the one of smallest id stays; texts of any length are read and packed whole; ties in
packing go by hash; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.language_id import fit, keep_identified
from tessella.llm.lineage import shared_table
from tessella.llm.minhash_dedup import drop_near_duplicates
from tessella.llm.packing import pack_windows
from tessella.llm.repetition import keep_quality

#: Not all stages can be put in SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_windows(docs)


STAGES = [("quality_rules", quality), ("language_id", language), ("minhash_near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs, name)
    return docs
