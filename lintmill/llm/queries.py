"""Named queries that apply the operators to their whole tables, and SQL for them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm import (
    chat_format, fingerprints, jaccard_join, lm_scoring, mixing, neighbours, packing, quality, repair, substring_dedup, toxicity,
    vector_codes, warc,
)
from lintmill.session import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % of


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.page_records(_table(spark, sf_dir, "pages")), path)
    responses = warc.read_archive(spark, path).filter("record_type = 'response'").select(
        warc.page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = warc.read_archive(spark, path, payload=False).filter("record_type = 'revisit'").select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest_pieces(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces with the crc32 of their ids as unsigned 32-bit integers in place of the ids."""
    kind = f"<u{width}"

    def digest(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in batch["ids"].to_pylist()]
            kept = [batch[n] for n in batch.schema.names if n != "ids"]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return pieces.mapInArrow(
        digest, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    path = tokenizer_path()
    width = packing.token_width(path)
    pieces = packing.pack(packing.tokenize(docs, path), width)
    return digest_pieces(
        pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), width
    ).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return jaccard_join.linked_documents(docs).select("doc_id", "n_shingles", "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 3) == 1
    model, prior = quality.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return quality.score(docs, model, prior).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count("text").alias("words"), F.xxhash64("text").alias("text_key")
    )
    mixed = mixing.mix_sources(materialize(docs, "words"), F.col("words"), F.col("text_key"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score_texts(docs, remainder("doc_id", 5) == 1).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 4) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_table(spark, sf_dir, "conversations"))


#: A conversation of control strings, formatted with the table's own.
CONTROL = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chats")
    chat_format.write_formatted(table.unionByName(more), path)
    back = chat_format.read_back(chat_format.read_formatted(spark, path)).withColumnRenamed("conv", "conv_id")
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_neighbours": op4_neighbours,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_format": op13_chat_format,
}

