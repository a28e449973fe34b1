"""Registered queries of the operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import alignment, audio, chat, decontaminate, language, packing, pages, quality, secrets, simhash, structure, substrings, urls
from quirelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda spark, sf: decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op2_extract": lambda spark, sf: pages.extract(table(spark, sf, "pages")),
    "op3_pack": lambda spark, sf: packing.pack(table(spark, sf, "documents")),
    "op4_audio": lambda spark, sf: audio.report(table(spark, sf, "embeddings")),
    "op4_audio_links": lambda spark, sf: audio.report_links(table(spark, sf, "embeddings")),
    "op5_simhash": lambda spark, sf: simhash.report(table(spark, sf, "documents")),
    "op6_chat": lambda spark, sf: chat.report(chat.with_forgery(table(spark, sf, "conversations"))),
    "op7_quality": lambda spark, sf: quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_secrets": lambda spark, sf: secrets.report(table(spark, sf, "documents")),
    "op9_language": lambda spark, sf: language.report(table(spark, sf, "documents")),
    "op10_urls": lambda spark, sf: urls.report(table(spark, sf, "pages")),
    "op11_align": lambda spark, sf: alignment.report(table(spark, sf, "documents")),
    "op12_structure": lambda spark, sf: structure.report(table(spark, sf, "conversations")),
    "op13_substrings": lambda spark, sf: substrings.report(table(spark, sf, "documents")),
}

SQL: dict[str, str] = {"op1_decontaminate": decontaminate.SQL, "op10_urls": urls.SQL, "op13_substrings": substrings.SQL}
