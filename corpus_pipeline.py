"""A corpus from raw documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again for the next one; all but the
last return the columns of ``documents``. Nulls, empty texts, repeated rows and other columns are treated as the operators'
docstrings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frameloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from frameloom.llm.common import materialise, table
from frameloom.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals, ``n_chars`` as of the new text."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in the packed sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: Near-dedup, the edit join's order and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
