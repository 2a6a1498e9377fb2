"""From raw documents to packed training sequences, in stages that each apply one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import brookmill
from brookmill.llm import line_dedup, mixing, near_dedup, packing, quality_model
from brookmill.llm.common import with_size
from brookmill.llm.queries import own_id, read, vocabulary
from brookmill.session import cut_lineage

# functions that run in Python workers travel with the task
cloudpickle.register_pickle_by_value(brookmill)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    return quality_model.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents share; the largest id keeps them."""
    return with_size(line_dedup.line_dedup(docs, counts=False), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last copy in part where it says so."""
    return with_size(mixing.copies(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    packed = packing.pack_documents(docs, vocabulary())
    return packed.select(own_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

# a boosted model, sampled weights and a tokenizer have no SQL form: each stage is tested
# against a brute-force version on its own input
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next begins."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
