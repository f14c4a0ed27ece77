"""A pipeline over documents: identified languages, no repeated lines, no near-duplicates, mixed sources, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, whatever other columns there are and whatever their names. An empty table gives an empty result in every
stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, langid, lines, mixing, simhash
from quire.llm.common import discard, scratch, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null and empty texts, texts without letters, and all if no row is labelled.

    Repeated rows stay or go together; a null lang or source is no evidence.
    """
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents that have no other line.

    Rows alike in id and text stay as they are; null texts stay; null ids come first in the order that tells copies.
    """
    return lines.remove_copies(docs, drop_empty=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least by id, then text digest, nulls first.

    Null, empty and wordless texts are near-duplicates of each other. Rows alike in id and text count as one.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them. A null source is a source of its own; null texts have size 0.

    Rows alike in id, text and source are drawn one by one.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, beside their digests as in the query of the operator; null and empty texts have none.

    Repeated rows give repeated rows; of the other columns only the id stays.
    """
    return bpe.encode(docs, bpe.public_tokenizer(), with_ids=True, with_decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: SQL can't express the fingerprints' hash or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:  # what a stage wrote on its way goes with it
            before, docs = docs, settle(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
            kept.append(docs)
        discard(before)
    return docs
