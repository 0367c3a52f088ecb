"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers

from logweave.llm import bpe, common, decontam, langid, near_dup, secret_scan


def language(spark, docs, sf_dir):
    """Documents whose language the model rejects go."""
    return langid.keep_known(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, that with the smallest id."""
    return near_dup.keep_one(docs)


def benchmark(spark, docs, sf_dir):
    """Contaminated documents go; from others the words of benchmark passages are cut."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark, docs, sf_dir):
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def tokens(spark, docs, sf_dir):
    """Ids of every document, and a check that they decode to its text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]

#: SQL can state neither the trained model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
