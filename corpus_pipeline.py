"""Corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes each result to the shared folder and reads it for the next stage.  Rows
with nulls, empty or repeated texts pass through as each operator's docstring defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stavelake.llm import decontam, duck_bpe, ngram_join, suffix_dedup, toxicity
from stavelake.llm.common import discard, stored, table
from stavelake.session import ship

TOXIC = 0.7
#: Words that an encoding task remembers.
WORDS = 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below ``TOXIC``; it learns as in op2, on rows not held out."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return docs.filter(toxicity.score_column(machine) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word Jaccard similarity of 0.8 or more."""
    return ngram_join.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start more than once; no document goes."""
    return suffix_dedup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as copy or paraphrase."""
    return docs.filter(decontam.leak_free(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (decimal, by spaces) of every document, and digests of them and of what they decode to."""
    encoded = duck_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=WORDS, batch=10_000, with_decoded=False, group=1 << 19, lasting=False)
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("ngram_jaccard", _shipped(drop_near_copies)),
    ("suffix_dedup", _shipped(cut_repeats)),
    ("decontamination", _shipped(drop_benchmark_leaks)),
    ("duckdb_bpe", _shipped(encode)),
]

#: The first stage is a learned model, which SQL cannot express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
