"""The corpus pipeline: language, lines, near copies, benchmarks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylume.llm import decontaminate, langid, line_dedup, mixing, simhash
from skylume.llm.common import delete_folder, ensure_checkpoint_dir, settle, table

#: Below this score a language is not believed.
MIN_SCORE = 0.2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """Columns beyond those of documents travel as one, so that their names cannot clash."""
    extra = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*(c for c in docs.columns if c in COLUMNS), F.struct(*extra).alias("__extra")) if extra else docs


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with the columns of ``docs`` in their order."""
    return found.select(*(F.col(c) if c in COLUMNS else F.col("__extra")[c].alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter to judge by ("und") go.

    With up to two languages a family every score is 0.25 or more, so ``MIN_SCORE`` then drops
    nothing else: texts in a language that was not learnt stay, under the nearest learnt one.
    """
    model = langid.train(docs)
    found = langid.predict(_packed(docs), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _unpacked(found, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    out = line_dedup.drop_common_lines(_packed(docs), min_docs=10, min_chars=1)
    n_chars = F.when(F.col("line_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _unpacked(out.withColumn("n_chars", n_chars), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _unpacked(simhash.one_of_each(_packed(docs), shingle=5, similarity=0.8), docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _unpacked(decontaminate.remove_documents(_packed(docs), table(spark, sf_dir, "benchmark"), window=10), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mixture takes, with their number of copies and their permuted order.

    Columns of those names that were there are replaced, all others stay.
    """
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("source_mixing", mixture),
]

#: SQL cannot express the first and third stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/skylume-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    docs = settle(docs)
    delete_folder(spark, folder)
    return docs
