"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, embedding_dedup, line_dedup, media, packing, quality, resampling, sharding, simhash, suffix_dedup, url_filter, vector_codes
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {
    "op1_quality_classifier": lambda spark, d: quality.op1(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_chat_formatting": lambda spark, d: chat.chat_format(table(spark, d, "conversations")),
    "op3_bpe_codec": lambda spark, d: bpe.op3(table(spark, d, "documents"), VOCABULARY),
    "op4_line_dedup": lambda spark, d: line_dedup.op4(table(spark, d, "documents")),
    "op5_media_columns": lambda spark, d: media.op5(table(spark, d, "documents")),
    "media_document_sequences": lambda spark, d: media.document_sequences(table(spark, d, "documents")),
    "media_page_sequences": lambda spark, d: media.page_sequences(table(spark, d, "pages")),
    "op6_simhash_near_dedup": lambda spark, d: simhash.op6(table(spark, d, "documents")),
    "op7_url_filters": lambda spark, d: url_filter.judged(table(spark, d, "pages"), table(spark, d, "labels")),
    "op8_suffix_array_dedup": lambda spark, d: suffix_dedup.op8(table(spark, d, "documents")),
    "op10_embedding_near_dedup": lambda spark, d: embedding_dedup.op10(table(spark, d, "embeddings")),
    "op9_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), VOCABULARY),
    "op11_importance_resampling": lambda spark, d: resampling.op11(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_vector_codes": lambda spark, d: vector_codes.op12(table(spark, d, "embeddings")),
    "op13_sharding": lambda spark, d: sharding.op13(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_url_filters": url_filter.ORACLE,
    "op8_suffix_array_dedup": suffix_dedup.ORACLE,
    "op10_embedding_near_dedup": embedding_dedup.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
