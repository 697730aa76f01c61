"""From raw documents to token ids: five operators, one after the other.

Each stage takes what the one before kept, is written as Parquet and read again:
toxic documents go, repeated lines go (of all but the first place), of each group of
near-duplicate documents one stays, documents that leak a test item go, and the rest is
encoded.

Defined results are those of the five operators, stated in their modules. A null text stays
null and is encoded as the empty text; rows of one id and one text are one row from the third
stage on; columns beyond those of documents pass through to the fourth stage; an empty table
stays empty. One text is held by one task, whatever its length.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import qaloom
from qaloom.lineage import written
from qaloom.llm import bpe, lines, simhash, tiling, toxicity
from qaloom.llm.catalog import tokenizer_path
from qaloom.llm.registry import bounded_batches, free_name, table

# Functions travel to the Python workers by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(qaloom)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; of each group of similar lines one line does."""
    bounded_batches(spark)
    cut = lines.deduplicated(docs, removed=free_name(docs, "removed")).select(*docs.columns)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of ids and decoded text."""
    bounded_batches(spark)
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

# SQL has neither the model nor the fingerprints; tests compare run() with a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
