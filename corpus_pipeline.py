"""A corpus from raw documents to packed sequences. Counted with the subpackage `llm`, whose operators it calls.

`STAGES` are (name, function) in order; each function takes (spark, docs, sf_dir), and its result is written as a table
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import language, lines, packing, pii, similar
from cuemill.llm.shared import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """Columns of documents, with the code points of a text that may have changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: the rest (no letter, or no better than chance) goes."""
    return language.accepted(docs.select(*COLUMNS), language.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in at least five documents, but in the last of these."""
    return _counted(lines.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8 or more): the one with the smallest
    doc_id, nulls last, and among rows that share it the one with the least checksum. Rows are told apart by a number of
    their own, so rows that share an id, or have none, are documents like all others."""
    numbered = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("number")), "numbered")
    found = similar.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), words=5, similarity=0.8)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "number")
    groups = numbered.select("number", order.alias("order")).join(found.withColumnRenamed("doc_id", "number"), "number").groupBy("component_id")
    return numbered.join(groups.agg(F.min_by("number", "order").alias("number")).select("number"), "number", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    return _counted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in sequences of 1024."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # the network, the trees and the tokenizer are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
