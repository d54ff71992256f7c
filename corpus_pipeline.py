"""Corpus pipeline: the stages in order, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all rows of `docs`. All but the last return the columns of documents.

Defined cases of every stage: texts of any length are read whole, an empty table gives an empty result, and extra columns
of any name pass through all stages but the last. Nulls, ties and repeated rows (same doc_id and text) are stated by stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import exact, jaccard, packing, suffix, toxicity
from barweave.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
# repeated passages of more words than this are cut, also where they have fewer bytes than suffix.LENGTH; None leaves those
OVER_WORDS: int | None = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine marks as toxic go; a null or empty text scores the bias. Equal texts are judged alike."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one only if it repeats; null counts as empty, a null doc_id loses."""
    return exact.largest_of_each(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id stays, with its repeated rows; texts without words all stay."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of `suffix.LENGTH` bytes, or over `OVER_WORDS` words, that occur more than once are cut; no document goes.

    A null text becomes empty. Repeated rows are places like any others: they lose everything that they repeat.
    """
    return suffix.cleaned_documents(docs, OVER_WORDS).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is one piece, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
# models, tokenizers and suffix orders are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
