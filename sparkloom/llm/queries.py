"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, embed_dedup, exact_dedup, hard_negatives, huffman, lang_id, mixing, ngram_join, oracle, pieces, quality, spelling, token_counts, warc
from sparkloom.llm.common import Scratch, crc_fold, held_out, read



def vocabulary(name: str) -> str:
    """A file of the public tokenizers, in $TOKENIZERS_DIR if that is set."""
    folder = os.environ.get("TOKENIZERS_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


BYTE_BPE, PIECE_BPE = str(vocabulary("byte_bpe_50k.json")), str(vocabulary("piece_bpe_32k.model"))

#: The ids that close a document in op4's and op7's files.
END_OF_CODED, END_OF_FLAT = 2, 50256
EVERY = 50


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, Scratch(spark, "op1"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op2"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(read(spark, sf_dir, "documents"))
    taken = mixing.copies(spark, sized, Scratch(spark, "op3"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    manifest = huffman.write(spark, read(spark, sf_dir, "documents"), scratch.path("files"), BYTE_BPE, END_OF_CODED, scratch)
    return huffman.digests(spark, manifest)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(spark, read(spark, sf_dir, "embeddings"), Scratch(spark, "op5"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a doc_id is scored, and has held_out false."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    measured, model = quality.measure_and_fit(spark, docs, read(spark, sf_dir, "labels"), Scratch(spark, "op6"), crc_fold("doc_id", 5) != 0)
    scored = quality.score(spark, measured, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, end id included, from flat files of their ids."""
    scratch = Scratch(spark, "op7")
    folder = scratch.path("flat")
    placed = scratch.write(token_counts.write_flat(read(spark, sf_dir, "documents"), folder, BYTE_BPE, END_OF_FLAT), "placed")
    counted = token_counts.count(spark, folder, scratch, END_OF_FLAT, token_counts.id_type(BYTE_BPE)).where("closed").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return placed.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each page, its metadata and its conversion record, as the written WARC files hold them."""
    scratch = Scratch(spark, "op8")
    folder = scratch.path("files")
    written = scratch.write(warc.write_files(warc.responses(read(spark, sf_dir, "pages")), folder, warc.derivatives, 1), "written")
    made = warc.read_files(spark, folder).drop("key").join(written.select("key", "record_id"), "record_id")
    header = lambda name: F.element_at("headers", name)
    return made.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", header("WARC-Concurrent-To").alias("concurrent_to"), header("WARC-Source-Payload-Digest").alias("source_digest"),
        header("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("bigint").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECE_BPE, with_ids=False).select("doc_id", "pieces.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a doc_id is predicted, and has held_out false."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(crc_fold("doc_id", 4) != 2))
    found = lang_id.identify(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2), "language.lang_pred", "language.score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, Scratch(spark, "op11"), label=label)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, read(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, read(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_ngram_join": op2_ngram_join,
    "op3_mixing": op3_mixing,
    "op4_token_files": op4_token_files,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_pieces": op9_pieces,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling": op13_spelling,
}
#: The other queries can't be expressed in DuckDB's SQL within reason; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {"op2_ngram_join": oracle.NGRAM_JOIN, "op5_embedding_dedup": oracle.EMBEDDING_DEDUP, "op11_hard_negatives": oracle.HARD_NEGATIVES, "op12_exact_dedup": oracle.EXACT_DEDUP, "op13_spelling": oracle.SPELLING}
