"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Defined results: rows and their columns come out as they went in, with slot and shard added by the last stage; columns
of any name pass, those named slot or shard are replaced by the last stage's. A null text is empty.
Equal texts, so all empty ones too, are copies, of which the smallest id stays; rows that share an id stay or go together.
Rows without an id are no copies and no leaks; they are drawn and placed by the hash of the empty string. Long texts
are judged whole; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evkg.llm import decontamination, mixing, sharding, simhash_dedup, toxicity
from evkg.llm.common import remove, shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; all labels of the corpus are learned from."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target shares of sources, languages and topics."""
    return mixing.sample(docs, mixing.TARGETS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard."""
    return sharding.assign_shards(docs)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", leaks), ("mixing", mixed), ("sharding", shards)]

#: SQL can't express the trained model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage leaves; what a stage wrote is removed once the next one is written."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
