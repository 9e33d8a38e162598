"""One registered query per training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import align, chat, decontam, fim, htmltext, jaccard, langid, media, oracles, packing, pieces, substring, tokencount, toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(C.table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(C.table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(C.table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(C.table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(C.table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(C.table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digest(C.table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(C.table(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(C.table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(C.table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(C.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_media_columns": op7_media_columns,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_html_extraction": op9_html_extraction,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": oracles.DECONTAMINATION,
        "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op10_chat_formatting": oracles.CHAT,
        "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    }
