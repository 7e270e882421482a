"""From raw documents to packed sequences: each stage takes (spark, docs, sf_dir) and hands a DataFrame to the next.

All stages but the last return the columns of ``documents``.  ``run`` writes each stage's rows to the folder the cluster
shares and reads them back, so that a lost executor costs one stage at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmspan.llm import catalog, line_dedup, mixing, packing, simhash, toxicity
from alarmspan.llm.common import table
from alarmspan.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at or above the threshold of their language go.  The net is fitted to labelled raw documents."""
    net = toxicity.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, net)
    return scored.where(~F.col(toxicity.added_columns(docs)[1])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, in whole lines, that stand in an earlier document go; the document stays."""
    return line_dedup.drop_repeated_lines(docs, catalog.LEAST_WORDS).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints stays."""
    return simhash.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources up to twice, as the target says."""
    return mixing.mix(docs, catalog.TARGET).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2 048-token sequences with their ids."""
    return packing.pack_documents(docs, catalog.tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", drop_near_copies),
          ("source_mix", mix_sources), ("packing", pack)]

# A trained net and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir), name)
    return rows
