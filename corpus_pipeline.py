"""From raw documents to a mixed, tokenised corpus: five stages, each over all that its predecessor kept.

Every stage takes an empty table (and gives one), texts of any length, repeated rows, nulls in any column and further
columns of any name; the last stage adds token_ids, n_tokens and intact, and replaces columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipep.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from lumipep.llm.common import held_out, named, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them), and those whose text is far from every language's profile. Without labelled texts every document with a letter stays."""
    profiles = language_id.fit(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    return language_id.accepted(docs, profiles, "text")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the smallest doc_id, null ids last; of rows that repeat an id the first."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over 5-word shingles the smallest doc_id stays. Null ids are linked with nothing and stay; rows of one id stay or go together."""
    return jaccard_join.near_deduplicated(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of each document at its source's rate, in a global random order. Null is a source of its own; rows of one id and source get equally many copies."""
    return mixing.poisson_mix(docs).select(*named(docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens, and whether the ids decode to the text (intact). A null text has no ids and is intact."""
    return byte_bpe.round_trip(docs, byte_bpe.public_bpe().learn_words(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The stages have no SQL form (profiles, components, merges); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
