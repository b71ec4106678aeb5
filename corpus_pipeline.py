"""The text pipeline: toxic documents go, copies and near copies go, sources are mixed, texts are packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is stored as Parquet and read again by the next one.
The mix is the order of the rows in their part files: packing reads it from there, and numbers its sequences by it.
All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, near_dup, packing, toxicity
from tidemark.llm.session import table, tune_text
from tidemark.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(tune_text(spark), sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_text(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_text(spark)
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_text(spark)
    return mixing.mix(docs, weights=mixing.TARGETS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune_text(spark)
    # Workers still hold what the stages before needed, so fewer words are remembered here.
    path, order = public_tokenizers.path("word_bpe_49k.json"), packing.stored_order(docs)
    return packing.pack(docs, path, group_pieces=packing.ORDERED_PIECES, order=order, remembered=50_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The network, the signatures and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
