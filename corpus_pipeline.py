"""A training corpus from raw documents: quality, exact and near dedup, mixing, encoding.

Every stage works on all rows of the one before it, takes very long texts whole and
repeated rows one by one, keeps columns of any name, and gives an empty result for an
empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, exact_dedup, mixing, quality, simhash
from lectern.llm.registry import tokenizer_file
from lectern.llm.shared import collected, removed, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of the shared root that the last stage's result is read from.
_spent: list[str] = []


def _in_turn(stage: Stage) -> Stage:
    """``stage``, which first deletes what the stage before it left in the shared folder.

    A stage is called when the rows of the one before it were written and read
    again, so nothing reads those folders by then.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _spent)
        _spent.clear()
        with collected() as folders:
            result = stage(spark, docs, sf_dir)
        _spent.extend(folders)
        return result

    return run_stage


@_in_turn
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules.

    Null, empty and white texts go, as they have no words; null languages and sources
    are groups of their own.
    """
    return quality.keep_good(docs)


@_in_turn
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    A null text counts as empty, a null id as the smallest; of rows that repeat id and
    text one stays.
    """
    return exact_dedup.survivors(docs)


@_in_turn
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, a null one goes before others; texts without words are
    one group, rows that share an id are told apart by their text.
    """
    return simhash.near_dedup(docs, width=5, similarity=0.8)


@_in_turn
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source to their target weights; a document drawn again is repeated.

    Rows lie by shard, in random order within it. A null source is a source, rows of
    one id are drawn alike, a text without words counts nothing.
    """
    return mixing.mixture(docs, weights=(5, 2, 1), cap=3).select(*docs.columns)


@_in_turn
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them.

    A null text is empty: no tokens.
    """
    return bpe.round_trip_digests(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe_encoding", encode),
]

#: Hash draws and fingerprints have no SQL.  Tests hold the stages' operators against
#: brute-force versions, and what run() keeps against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with collected() as folders:
                docs = written(docs, f"pipeline-{name}")
            removed(spark, before)
            before = folders
    return docs
