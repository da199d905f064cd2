"""From documents to token files: quality, near duplicates, benchmark passages, mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents;
the last returns the digest of the token files it wrote. Further columns, of any names, go along. An empty table leaves every stage empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import decontaminate, mixing, near_duplicates, quality, token_files
from sieveline.llm.common import table
from sieveline.sources.shared import shared_folder, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the network, learned from labelled rows that are not held out, scores at 0.3 or more.

    A NULL text is scored as an empty one, whole texts however long; each row is judged by its text alone, so equal rows stay or go together.
    """
    return quality.keep_quality(docs, quality.learn_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, once; rows without an id, and each id's empty text once, stay."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no window of a benchmark item, repeats included; NULL and empty texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and the draw of its id say: up to three times, or not at all. NULL is a source, NULL ids draw as one."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from its token files; NULL texts are empty, NULL ids come first."""
    folder = shared_folder(spark)
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digest(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_ids),
]

#: A trained network and signatures have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
