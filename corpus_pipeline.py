"""A corpus from raw documents to packed sequences: toxic documents go, one of each group of near-duplicates stays, repeated passages go, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismatic.llm.bagminhash import one_of_each
from prismatic.llm.common import table
from prismatic.llm.packing import pack_documents
from prismatic.llm.queries import vocabulary
from prismatic.llm.repeats import written
from prismatic.llm.suffix_dedup import without_repeats
from prismatic.llm.toxicity import learn, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats), ("packing", pack)]

#: No SQL expresses the tokenizer, the learned lexicon or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
