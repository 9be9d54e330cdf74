"""Corpus preparation: documents through the stages below, each written and read again before the next.

Rows stay whole: a stage drops, shortens (suffix array, mixing) or repeats (mixing) rows and leaves all other columns as they
are, whatever their names. A null text counts as an empty one; null and repeated ids are rows like any other, told apart
by their texts (of rows that repeat id and text the near-duplicate stage keeps one); empty and blank texts are near copies of each
other; texts are processed whole, however long; ties are broken by id, then by hashes of the text; an empty table gives an
empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import bpe, mixing, quality, simhash, suffix_dedup
from kgloom.llm.common import stored

#: Rejects low quality, keeps one document of each near-duplicate group, cuts repeated passages, mixes sources, encodes.
STAGES = [("quality", quality.stage), ("simhash", simhash.stage), ("suffix_dedup", suffix_dedup.stage), ("mixing", mixing.stage), ("bpe", bpe.stage)]

#: Stages run trained models and tokenizers, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
