"""Cleaning and tokenizing a corpus in five stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from sitelake.llm.queries import tokenizer_path
from sitelake.llm.shared import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not reject.

    Each row is judged by its own text: repeated rows stay or go together, null and empty texts are judged as texts
    without words, null ids are judged as any other. Without labels of both kinds every text has the one score that the
    labels leave. An empty table gives an empty one; all columns are kept, whatever their names.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z lower-cased): that with the largest id.

    Null and empty texts are one text. Rows that repeat an id and its text are one; a row with a null id stays only where
    no row of its text has an id. An empty table gives an empty one; all columns are kept, whatever their names.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at likeness 0.8: that with the smallest id.

    Null and empty texts are linked with nothing and stay. Rows that share an id stay or go together, so repeated rows of
    an id that stays are kept; rows with a null id stay. An empty table gives an empty one; all columns are kept, whatever
    their names.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of 150 % of the words takes them, sources weighing 5, 2, 1 in turn.

    Null and empty texts add no words and come as often as their source's rate says, rounded down; a null source is the
    last source; rows that repeat id, source and size are told apart by a running number. An empty table gives an empty one; all columns are kept, whatever
    their names.
    """
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: doc_id, lang, source, ids, n_tokens.

    One row per input row, repeats included; a null text has no ids; null ids, languages and sources stay null. An empty
    table gives an empty one; other columns are not read.
    """
    return bpe.encode_documents(docs, tokenizer_path(), keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: BPE ids, model scores and random draws are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``: doc_id, lang, source, ids, n_tokens of every row of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
