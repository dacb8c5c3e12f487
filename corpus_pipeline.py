"""A corpus in five stages: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from boxwright.llm.common import cut, fresh
from boxwright.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; copies, extra columns and empty tables stay as they are."""
    (verdict,) = fresh(docs, "verdict")
    return quality_rules.quality_rules(docs, out=verdict).where(F.col(f"{verdict}.kept")).drop(verdict)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines taken out of the texts, n_chars renewed. A document left without lines is empty and stays; so does a null text."""
    cleaned = line_dedup.remove_lines(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id. Texts without words and null doc_ids stay."""
    return near_dedup.keep_one(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null texts have none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is the end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Signatures and tokens are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
