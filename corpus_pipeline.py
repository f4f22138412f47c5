"""Cleaning and packing of a document corpus, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.chosen_path import near_duplicate_classes, row_key
from sitewright.llm.common import documents, fresh_name, staged
from sitewright.llm.language_centroids import fit_languages, language_of
from sitewright.llm.packing import pack_sequences
from sitewright.llm.quality_network import fit_quality, quality_score
from sitewright.llm.surrogates import replace_entities

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the byte-level network scores at ``LEAST_QUALITY`` or more; it learns from ``labels``."""
    net = fit_quality(docs, documents(spark, sf_dir, "labels"))
    score = fresh_name(docs, "_score")
    return docs.withColumn(score, quality_score(net, F.col("text"))).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are near enough to a centroid of a learned language."""
    model = fit_languages(docs)
    found = fresh_name(docs, "_found")
    kept = docs.withColumn(found, language_of(model, F.col("text"))).filter(~F.col(found)["rejected"])
    return kept.drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, that with the smallest id; of equal rows one."""
    kept = near_duplicate_classes(docs).filter("kept").select("row_key").distinct()
    key = fresh_name(docs, "_key")
    rows = docs.withColumn(key, row_key("doc_id", "text"))
    return rows.join(kept.withColumnRenamed("row_key", key), key).dropDuplicates([key]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; ``n_chars`` follows the new text."""
    return replace_entities(docs, length_column="n_chars").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents left into sequences of 2048 tokens."""
    pieces = pack_sequences(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_network", quality),
    ("language_centroids", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned scores and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
