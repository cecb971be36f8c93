"""A training corpus from raw documents: language, exact and near copies, benchmark leaks, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kycmill.llm import bpe, decontaminate, exact_dedup, language_id, minhash
from kycmill.llm.common import stored, table
from kycmill.llm.queries import PIECES, TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and letter junk and languages far from those of all labelled training documents."""
    model = language_id.learn_from(language_id.training_rows(docs), public_tokenizers.path(PIECES))
    # Every text is scored once; both the usual surprise and the rows that stay are read from that. The table stays to the end.
    found = stored(language_id.predict(docs, model), "language-scores", "zstd")
    known = language_id.training_rows(found.select("row.doc_id", "row.lang", "row.text", "lang_pred", "letters", "surprise"))
    return language_id.drop_strangers(found, language_id.usual_of(known))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest id stays."""
    return minhash.drop_near(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    path = public_tokenizers.path(TOKENIZER)
    # Ids are written between the two ways: in one stage a task would hold a Python worker, with its tables, for each.
    ids = stored(bpe.encode(docs, path), "pipeline-ids")
    return bpe.digests(bpe.decode(ids, path), "ids")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("minhash", near_copies),
    ("decontaminate", benchmark_leaks),
    ("bpe", tokens),
]

#: Not to be said in SQL: learned languages, signatures, alignments and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
