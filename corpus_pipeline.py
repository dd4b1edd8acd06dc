"""Corpus pipeline: language ID, exact dedup, near dedup, source mix, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that the next
stage reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm import document_dedup, exact_dedup, language, mixing, sentencepiece
from clausegraph.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.  Profiles are learned from the labelled rows of ``docs`` that are not held out.

    Null texts and texts without letters go, and all if no language was learned; a short text whose cosines lie close
    together stays.  The ``lang`` column stays as it is.
    """
    label, score = "_" + "_".join(docs.columns), "__" + "_".join(docs.columns)  # no column has these names
    prototypes = language.train(docs.where(~language.held_out()))
    judged = language.identify(docs, prototypes, label=label, score=score)
    return judged.where(f"`{label}` != '{language.UNKNOWN}'").select(*docs.columns)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id.

    Null texts equal empty ones; rows alike in key and text are copies too, a row without a key stays only if no row of
    its group has one.  All columns stay, whatever their names; an empty table gives no rows.
    """
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies share five-word shingles at a Jaccard similarity of 0.8 or more.  SimHash fingerprints within 4 bits propose pairs, all that their
    links connect; MinHash bands propose those that lie beyond that radius; every class is verified on the texts.
    Null, empty and blank texts are copies of each other; a row without a key stays, repeated rows stay or go together.
    All columns stay, whatever their names; an empty table gives no rows.
    """
    return document_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents repeated, kept, cut or left out as the mix takes their words.

    A null source is one source, the last; null and empty texts have no words and are left out.  All columns stay, whatever
    their names; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of every document, with the decoded text; ``exact`` tells whether that is the text.

    Null texts have no tokens and null as decoded text, empty ones no tokens; repeated rows and null keys are encoded
    like any other.  Other columns are left out; an empty table gives no rows.
    """
    return sentencepiece.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", tokenize),
]

#: Profiles, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
