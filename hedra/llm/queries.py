"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedra.llm import chat_snapshots, decontaminate, hilbert_shards, jaccard_join, language_id, line_dedup, lm_score, piece_encoding, prefix_trie, telephony, toxicity, vector_codes, weak_quality
from hedra.llm.common import read


def piece_model(file: str | None = None) -> bytes:
    """The bytes of a model's file; by default of the public tokenizer that op9_offset_pieces takes."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("piece_bpe_32k.model")
    with open(file, "rb") as f:
        return f.read()


def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word")


def op3_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(5)) != 1
    return lm_score.score_texts(read(spark, sf_dir, "documents"), mine)


def op4_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse_snapshots(read(spark, sf_dir, "conversations"))


def op5_family_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    mine = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(4)) != 2
    return language_id.identify_languages(docs, mine).select("doc_id", held.alias("held_out"), "lang_pred", "score", "family_pred")


def op6_prefix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read(spark, sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"), passage_words=line_dedup.PASSAGE_WORDS)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(read(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


def op9_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_encoding.encode_pieces(read(spark, sf_dir, "documents"), piece_model())
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("covered_bytes"),
    )


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = telephony.store_telephony(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("bigint").alias("pcm_bytes"),
    )


def op11_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(3)) != 1
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    done = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn)
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_windows", "worst_window")


def op12_segment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"))


def op13_patricia_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_weak_quality, op2_simhash_windows, op3_elias_fano_scores, op4_snapshot_chats, op5_family_languages, op6_prefix_orders, op7_line_chunks, op8_hilbert_shards, op9_offset_pieces, op10_telephony_audio, op11_gru_toxicity, op12_segment_codes, op13_patricia_prefixes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_simhash_windows": decontaminate.SQL, "op4_snapshot_chats": chat_snapshots.SQL, "op7_line_chunks": line_dedup.PASSAGES_SQL, "op12_segment_codes": vector_codes.SQL, "op13_patricia_prefixes": prefix_trie.SQL}
