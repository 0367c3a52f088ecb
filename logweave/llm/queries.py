"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers

from logweave.llm import (
    bpe, decontam, langid, mixture, near_dup, phrases, quality, secret_scan, suffix_dedup, token_files, turn_repair, vector_codes, warc_zip,
)


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mixed_range_coder(spark, sf):
    return token_files.report(_read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


def op2_secret_links(spark, sf):
    return secret_scan.report(_read(spark, sf, "documents"))


def op3_rule_cascade(spark, sf):
    return quality.report(_read(spark, sf, "documents"))


def op4_phrase_automata(spark, sf):
    return phrases.report(_read(spark, sf, "documents"))


def op5_benchmark_hash_set(spark, sf):
    return decontam.report(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op6_subword_language(spark, sf):
    return langid.report(_read(spark, sf, "documents"))


def op7_zip_packages(spark, sf):
    return warc_zip.report(_read(spark, sf, "pages"))


def op8_chosen_path(spark, sf):
    return near_dup.cluster(_read(spark, sf, "documents"))


def op9_sentencepiece_bpe(spark, sf):
    return bpe.round_trip(_read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_induced_sorting(spark, sf):
    return suffix_dedup.report(_read(spark, sf, "documents"))


def op11_repetition_rates(spark, sf):
    return mixture.report(_read(spark, sf, "documents"))


def op12_cover_tree_lloyd(spark, sf):
    return vector_codes.report(_read(spark, sf, "embeddings"))


def op13_target_alignment(spark, sf):
    return turn_repair.report(_read(spark, sf, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mixed_range_coder, op2_secret_links, op3_rule_cascade, op4_phrase_automata, op5_benchmark_hash_set, op6_subword_language, op7_zip_packages,
                                     op8_chosen_path, op9_sentencepiece_bpe, op10_induced_sorting, op11_repetition_rates, op12_cover_tree_lloyd,
                                     op13_target_alignment)}

#: The others rest on a tokenizer, a trained model or positions of matches, which SQL cannot state.
ORACLE = {
    "op3_rule_cascade": quality.ORACLE,
    "op4_phrase_automata": phrases.ORACLE,
    "op5_benchmark_hash_set": decontam.ORACLE,
    "op7_zip_packages": warc_zip.ORACLE,
    "op8_chosen_path": near_dup.ORACLE,
    "op10_induced_sorting": suffix_dedup.ORACLE,
    "op11_repetition_rates": mixture.ORACLE,
    "op12_cover_tree_lloyd": vector_codes.ORACLE,
    "op13_target_alignment": turn_repair.ORACLE,
}
