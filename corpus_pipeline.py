"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of documents. A stage sees only what the
one before it kept. Nulls, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import cube_mixing, packing, quality_rules, secret_scan, simhash
from terraloom.llm.common import documents, shared_dir

#: Packing depends on a tokenizer and on balanced draws, which SQL can't state; the stages are tested one by one.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.unique(docs)


def secretless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; credentials in them are masked, and n_chars follows the text."""
    return secret_scan.redacted(docs, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return cube_mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", good), ("near-duplicates", distinct), ("secrets", secretless), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents that the stages keep."""
    out = documents(spark, sf_dir)
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, out, sf_dir)
        made.write.parquet(f"{place}/{k}")
        out = spark.read.schema(made.schema).parquet(f"{place}/{k}")
    return out
