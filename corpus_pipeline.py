"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage works on whatever the one before kept and returns its columns, extra
ones too; the last adds ``token_ids`` and ``decoded``, with underscores where a
column has that name. Null ids and texts, empty and very long texts, ties,
repeated rows and empty tables are as the operators' modules say; each stage's
docstring has what that means for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import _shared, bpe, exact_dedup, mixing, near_dedup, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text counts as empty. Repeated rows go or stay together. Without
    labels, or with one class of them, the mean label decides for all.
    """
    _shared.small_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays, once.

    Empty texts are equal. Rows with a null id or text stay.
    """
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Rows with a null id, or without words, stay.
    """
    return near_dedup.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or sampled to their target weights.

    A null source is a source of its own; one without bytes is kept once.
    """
    return mixing.mix_sources(docs, copy_col=None)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text they decode to; both null for a null text."""
    _shared.small_batches(spark)
    encoded = bpe.encode_bpe(docs)
    return bpe.decode_bpe(encoded, ids_col=encoded.columns[-1])


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier, the signatures and the tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
