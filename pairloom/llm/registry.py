"""The queries opN_<name> over the whole supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import chat, licenses, media, neighbours, oracles, packing, pieces, quality, sharding, simhash, substrings
from pairloom.llm.common import table, texts


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(texts(spark, sf_dir).select("doc_id", "text"), licenses.known_digests(spark))
    return found.select("doc_id", "license.digest", "license.license_id", F.array_join("license.notices", ",").alias("notices"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.strip_repeats(texts(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "stripped.n_words", "stripped.n_removed", F.sha2(F.col("stripped.kept").cast("binary"), 256).alias("kept_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_columns(texts(spark, sf_dir))
    return read.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "error",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    formed = chat.format_preferences(chat.last_reply_pairs(table(spark, sf_dir, "conversations")))
    own = formed.select("conv_id", "preference.*")
    return own.withColumns({c: spans(c) for c in ("chosen_spans", "rejected_spans")})


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_nbest(texts(spark, sf_dir).select("doc_id", "text"), path)
    figures = encoded.select("doc_id", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), pieces.digest_column(F.col("encoded"), path).alias("d"))
    return figures.select("doc_id", "d.n_pieces", "d.ids_crc32", "d.score", "d.others", (F.col("d.decoded_crc32") == F.col("text_crc32")).alias("round_trip"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(texts(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_sharding": op2_sharding,
        "op3_neighbours": op3_neighbours,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_media": op5_media,
        "op6_simhash": op6_simhash,
        "op7_chat": op7_chat,
        "op8_pieces": op8_pieces,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.scan_sql(), "op2_sharding": oracles.sharding(), "op4_substring_dedup": oracles.SUBSTRINGS, "op7_chat": chat.LAST_REPLY_SQL}
