"""Thin queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolgauge.llm import bpe, chat, crosstok, decontam, langid, linededup, packing, pii, quality, repair, simhash, warc, wavelet
from poolgauge.llm.common import table


#: Key of the pseudonyms in these queries; a deployment passes its own.
PII_KEY = "poolgauge example key"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(spark, table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), PII_KEY)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.digest(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_language_id, op3_wavelet, op4_pii, op5_simhash, op6_bpe, op7_warc, op8_line_dedup, op9_quality, op10_decontaminate, op11_conversation_repair, op12_cross_tokenizer, op13_packing)
}
