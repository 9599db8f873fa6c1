"""From raw documents to packed token sequences: five stages, each written and read again.

1. language_id: documents whose language can't be told go; a missing label is filled in.
2. near_duplicates: one document, the one of smallest id, stays of each class of near copies.
3. personal_data: every span found is replaced by its kind in brackets.
4. source_mix: documents are taken as often, whole or in part, as the target weights ask for.
5. packing: sequences of at most 4096 ids.

Every stage works on all rows that the one before it kept. A stage given no rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import common, language_id, mixing, ngram_join, packing, pii


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    contents = language_id.dictionaries(docs)
    names = common.free(docs.columns, "lang_pred", "score", "rejected")
    kept = language_id.predicted(docs, contents, *docs.columns, names=tuple(names)).where(~F.col(names[2]))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, lambda df: common.written(df, "pii"))


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("source_mix", source_mix_stage),
    ("packing", packing_stage),
]

#: SQL has neither the dictionaries' compression nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
