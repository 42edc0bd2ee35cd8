"""A training-corpus pipeline over ``documents``: each stage is one operator of
``basaltic.llm``, takes (spark, docs, sf_dir) and returns what the next one reads.

Nulls, empty texts and repeated rows are treated as each operator says. All stages but the
last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.llm import exact_dedup, lang_id, order_minhash, packing, secret_scan
from basaltic.llm.common import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: null texts, no letter, or pieces that no
    language explains better than chance. The held-out quarter isn't learned from; a missing
    ``lang`` is filled with the prediction."""
    learnable = docs.where(~lang_id.held_out(F.col("doc_id")))
    return lang_id.recognised(docs, learnable, public_tokenizers.path("piece_bpe_32k.model"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays."""
    return order_minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; no document goes."""
    return secret_scan.redact(docs, public_tokenizers.path("word_bpe_49k.json"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the language model nor near copies nor packing; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-").lower())
    return docs
