"""From raw documents to sharded training data, in five stages.

Each stage works on all that the one before it kept, and only the last adds columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.llm import decontaminate, mixing, probminhash, sharding, toxicity
from visitlens.llm.common import Scratch, table

N_SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among ``docs``, rejects go.

    Null, empty and very long texts, ties, repeated rows, clashing names and empty tables: see ``toxicity.remove_toxic``.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; odd rows are treated as ``probminhash.remove_near_duplicates`` says."""
    return probminhash.remove_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words of a benchmark item in a row, or a whole shorter item, go; odd rows: see ``decontaminate.remove_contaminated``."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until every source has its share of the words; odd rows: see ``mixing.mix_documents``."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its virtual slot, and a shard by the map that balances their bytes; odd rows: see ``sharding.assign``."""
    return sharding.assign(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: None: fitted scores, near-duplicate classes and random rounding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    No stage fails on null, empty or very long texts, repeated rows, further columns or an empty table; what becomes of
    such rows is said in the stages.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
